"""A training corpus from raw documents: language, near copies, repeated passages, secrets, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; all but the last return the columns
of `documents`. A stage's text is final for the next one: passages that repeat are cut out, secrets are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartolake.llm import exactdedup, langid, packing, secrets, simhash
from cartolake.llm.common import saved

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
SECRET = "[secret]"
#: Least probability of the best language.
MAJORITY = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a language that the network knows, and writes the predicted one to `lang`.

    Documents without a letter go, and those in which no language has the majority: the best one's probability, the mean
    over all windows of the text, is under MAJORITY. Where there is nothing to learn from, all documents with a letter stay
    as they are. Every row is judged by its text alone: rows with null or repeated ids and repeated rows stay or go alike;
    null and empty texts go; further columns are not read.
    """
    net = langid.fit(docs)
    if net is None:
        return langid.lettered(docs).select(*COLUMNS)
    found = langid.predict(docs, net, carried=("text", "source", "n_chars"))
    kept = found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= MAJORITY))
    return kept.withColumnRenamed("lang_pred", "lang").select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near copies: the smallest by id (null ids last), then by hash of id and text.

    Likeness alone decides: rows with a null or a repeated id stay where their texts differ. Of rows that agree in id and
    text, the one with the least other columns stays.
    """
    text = F.coalesce(F.concat(F.lit("t"), "text"), F.lit(""))
    key = F.sha2(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), text), 256)
    name = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), key.alias("key"))
    first = simhash.first_of_each(docs.select(name.alias("name"), "text"), "name").select("name.key")
    rows = docs.groupBy(key.alias("key")).agg(F.min(F.struct(*COLUMNS)).alias("row"))
    return rows.join(first, "key", "left_semi").select("row.*")


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts out byte strings that occur elsewhere; documents of which nothing is left go.

    Rows with null or repeated ids are documents of their own; texts shorter than a window, empty and null ones stay as they
    are; n_chars is counted anew, null for a null text.
    """
    found = exactdedup.remove_repeats(docs, carried=("text", "lang", "source", "n_chars"), decoded=True)
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    left = found.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_bytes")))
    return left.select("doc_id", text.alias("text"), "lang", "source").withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret; all documents stay, null texts as empty ones; n_chars is counted anew."""
    found = secrets.scan(docs, redact=SECRET, carried=("lang", "source"))
    return found.select("doc_id", F.col("redacted").alias("text"), "lang", "source").withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all documents into sequences; null and empty texts are an end id, repeated rows are packed as often as they occur."""
    return packing.packed(docs)


STAGES = [
    ("language", language),
    ("near_copies", near_copies),
    ("repeats", repeats),
    ("without_secrets", without_secrets),
    ("packed", packed),
]

#: Hashes, networks and tokenizers are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
