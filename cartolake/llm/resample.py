"""Importance resampling towards a target distribution, by external sort-count over packed bucket streams.

Features are the runs of one to three consecutive words; each falls into one of BUCKETS buckets by its checksum. The first
pass writes, block by block, the buckets of all features of a block's documents as one stream of packed uint16 numbers, with
the places at which documents begin. The second reads the streams, sorts each and run-length encodes it; the runs are summed
by bucket, for the corpus and for the target texts alike. From both a gain for each bucket follows. The third pass reads the
streams once more, gathers the gains of all features and adds them up by document with np.add.reduceat. Texts are read once.

A document's weight plus Gumbel noise from its id is its score; the highest scores are drawn. Ranks come from one sort by
range, whose blocks are counted, so no task and not the driver ever holds an order of all documents; what reaches the driver
is BUCKETS counts of each side and a count for each block of the sort.

Defined cases: null and empty texts have no features and weight 0; each row is a document of its own, so rows that repeat an
id have the same noise and the same place in the order where they also agree in weight (which of them comes first is then
fixed by the place at which the first pass met them); a null id is hashed as empty and comes after all others in ties; only id and text
are read; an empty corpus gives an empty result; an empty target makes all gains follow from the corpus alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartolake.llm.common import bounded_batches, cores, saved, shuffle_partitions, slices, utf8
from cartolake.llm.licenses import LOWER, UPPER

BUCKETS = 10_000
#: Longest run of words that is a feature.
RUN = 3
#: Documents of fewer words are never drawn.
LEAST_WORDS = 20
#: Percentage of the other documents that is drawn.
PERCENT = 5
SEED = 42
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A-Z to a-z, digits, small letters and all bytes beyond ASCII as they are, the rest to a space.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def buckets_of(raw: bytes, buckets: int = BUCKETS) -> tuple[np.ndarray, int]:
    """The buckets of a text's features (uint16) and its number of words."""
    words = raw.translate(_FOLD).split()
    sums = list(map(zlib.crc32, words))
    spaced, level = [b" " + w for w in words[1:]], sums
    for _ in range(RUN - 1):
        level = list(map(zlib.crc32, spaced, level))  # the checksum of a run goes on from that of the run without its last word
        sums += level
        spaced = spaced[1:]
    return (np.array(sums, np.uint32) % buckets).astype(np.uint16), len(words)


def streams(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """One row per block of documents: ids, words (of each), starts (packed int64: where each document's features begin, and the stream's length), stream (packed uint16)."""
    if not 0 < buckets <= 1 << 16:
        raise ValueError("a bucket is a uint16 number")
    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = utf8(batch.column(1))
            for a, b in slices(np.diff(at)):
                parts = [buckets_of(raw[at[i] : at[i + 1]].tobytes(), buckets) for i in range(a, b)]
                starts = np.concatenate([[0], np.cumsum([len(p) for p, _ in parts])]).astype("<i8")
                ids = pa.ListArray.from_arrays(pa.array([0, b - a], pa.int32()), batch.column(0).slice(a, b - a))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array([[n for _, n in parts]], pa.list_(pa.int64())), pa.array([starts.tobytes()], pa.binary()), pa.array([np.concatenate([p for p, _ in parts]).astype("<u2").tobytes()], pa.binary())], ["ids", "words", "starts", "stream"]
                )

    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    return rows.mapInArrow(work, f"ids array<{kind.simpleString()}>, words array<long>, starts binary, stream binary")


def counts(written: DataFrame) -> DataFrame:
    """bucket, n over all streams: each is sorted and run-length encoded where it lies, the runs are summed."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for packed in batch.column(0):
                stream = np.sort(np.frombuffer(packed.as_buffer(), "<u2"), kind="stable")
                first = np.flatnonzero(np.diff(stream, prepend=-1 if len(stream) == 0 else int(stream[0]) - 1)) if len(stream) else np.zeros(0, np.int64)
                lengths = np.diff(first, append=len(stream))
                yield pa.RecordBatch.from_arrays([pa.array(stream[first].astype(np.int32)), pa.array(lengths.astype(np.int64))], ["bucket", "n"])

    return written.select("stream").mapInArrow(work, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def dense(counted: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The counts as an array; at most `buckets` rows reach the driver."""
    out = np.zeros(buckets, np.int64)
    for r in counted.collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of each bucket's share in the target against that in the corpus, one added to each count."""
    n = float(len(source))
    s, t = source.astype(np.float64), target.astype(np.float64)
    return np.floor(1000.0 * np.log((t + 1.0) * (s.sum() + n) / ((s + 1.0) * (t.sum() + n)))).astype(np.int64)


def weights(written: DataFrame, gain: np.ndarray) -> DataFrame:
    """id, n_words, n_features, weight, place (a number that no other row has) of every document in the streams."""
    kind = written.schema["ids"].dataType.elementType

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                starts = np.frombuffer(batch.column(2)[k].as_buffer(), "<i8")
                gathered = gain[np.frombuffer(batch.column(3)[k].as_buffer(), "<u2")]
                some = np.diff(starts) > 0  # reduceat takes no empty ranges
                sums = np.zeros(len(starts) - 1, np.int64)
                if some.any():
                    sums[some] = np.add.reduceat(gathered, starts[:-1][some])
                yield pa.RecordBatch.from_arrays([batch.column(0)[k].values, batch.column(1)[k].values, pa.array(np.diff(starts)), pa.array(sums)], ["id", "n_words", "n_features", "weight"])

    found = written.select("ids", "words", "starts", "stream").mapInArrow(work, f"id {kind.simpleString()}, n_words long, n_features long, weight long")
    return found.withColumn("place", F.monotonically_increasing_id())


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Thousandths of Gumbel noise by the hash of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long").cast("double")
    return F.floor(-1000.0 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def ranked(scored: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """Adds rank: 1, 2, 3... for the drawn rows, by falling score and rising id; null for the others.

    Rows are dealt by ranges of their order and numbered inside a range; the ranges' sizes, one number each, are added up.
    """
    spark = scored.sparkSession
    scored = scored.withColumn("short", F.col("n_words") < least_words)
    order = [F.col("short").asc(), F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("place").asc()]
    ranges = max(cores(spark), shuffle_partitions(spark))
    dealt = saved(scored.repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "resampled")
    block = F.shiftright("at", 33)
    sizes = dealt.groupBy(block.alias("block")).agg(F.count("*").alias("n"), F.count_if(~F.col("short")).alias("long")).orderBy("block").collect()
    drawn = percent * sum(r["long"] for r in sizes) // 100
    before, total = {}, 0
    for r in sizes:
        before[r["block"]] = total
        total += r["n"]
    offsets = spark.createDataFrame(list(before.items()), "block long, before long")
    number = F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1) + 1
    return dealt.withColumn("block", block).join(F.broadcast(offsets), "block").withColumn("rank", F.when(number <= drawn, number)).drop("block", "before", "at", "short")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, buckets: int = BUCKETS) -> DataFrame:
    """id, n_words, n_features, weight, score, rank (null: not drawn) of every row of docs."""
    written = saved(streams(docs, id_col, text_col, buckets), "streams")
    wanted = streams(target.select(F.lit(0).alias("id"), target[target_col].alias("text")), "id", "text", buckets)
    gain = gains(dense(counts(written), buckets), dense(counts(wanted), buckets))
    scored = saved(weights(written, gain), "weights").withColumn("score", F.col("weight") + noise(F.col("id"), seed))
    return ranked(scored, percent, least_words).select(F.col("id").alias(id_col), "n_words", "n_features", "weight", "score", "rank")


def oracle() -> str:
    """The query's rows in SQL: checksums of the distinct features byte by byte, from the table of the checksum's polynomial."""
    table = "(SELECT list(list_reduce(list_prepend(v, [0::UBIGINT for x in range(8)]), lambda x, y: xor(x >> 1, 3988292384::UBIGINT * (x & 1))) ORDER BY v) FROM (SELECT unnest(range(256))::UBIGINT AS v) x)"
    words = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w"
    return f"""
        WITH d AS MATERIALIZED (SELECT 0 AS side, row_number() OVER () AS rid, doc_id::VARCHAR AS id, {words} FROM documents UNION ALL SELECT 1, row_number() OVER (), NULL, {words} FROM benchmark),
        f AS MATERIALIZED (SELECT side, rid, array_to_string(w[i : i + k], ' ') AS feature FROM (SELECT side, rid, w, k, unnest(range(1, len(w) - k + 1)) AS i FROM d, (SELECT unnest(range({RUN})) AS k) n WHERE len(w) > k) x),
        c AS MATERIALIZED (SELECT {table} AS crc),
        b AS MATERIALIZED (SELECT feature, xor(list_reduce(list_prepend(4294967295::UBIGINT, [('0x' || hex(feature)[2 * j + 1 : 2 * j + 2])::UBIGINT for j in range(strlen(feature))]), lambda a, x: xor(a >> 8, crc[(xor(a, x) & 255)::INT + 1])), 4294967295::UBIGINT) % {BUCKETS} AS bucket
              FROM (SELECT DISTINCT feature FROM f) y, c),
        n AS (SELECT bucket, count(*) FILTER (side = 0) AS s, count(*) FILTER (side = 1) AS t FROM f JOIN b USING (feature) GROUP BY bucket),
        a AS (SELECT coalesce(sum(s), 0)::DOUBLE AS s_all, coalesce(sum(t), 0)::DOUBLE AS t_all FROM n),
        g AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (s_all + {BUCKETS}) / ((s + 1)::DOUBLE * (t_all + {BUCKETS}))))::BIGINT AS gain FROM n, a),
        w AS (SELECT rid, count(*) AS n_features, sum(gain)::BIGINT AS weight FROM f JOIN b USING (feature) JOIN g USING (bucket) WHERE side = 0 GROUP BY rid),
        r AS (SELECT doc_id, len(w.w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('{SEED}:' || coalesce(id, ''))[1 : 8])::BIGINT + 0.5e0) / 4294967296e0)))::BIGINT AS score
              FROM (SELECT row_number() OVER () AS rid, doc_id FROM documents) x JOIN d w ON w.side = 0 AND w.rid = x.rid LEFT JOIN w v ON v.rid = x.rid),
        o AS (SELECT *, row_number() OVER (PARTITION BY n_words >= {LEAST_WORDS} ORDER BY score DESC, doc_id NULLS LAST) AS place, {PERCENT} * count(*) FILTER (n_words >= {LEAST_WORDS}) OVER () // 100 AS drawn FROM r)
        SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= {LEAST_WORDS} AND place <= drawn THEN place END AS rank FROM o"""
