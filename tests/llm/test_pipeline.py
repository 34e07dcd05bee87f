"""The pipeline against a brute-force version of its stages, and the registered queries."""

import sys
import zlib

import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

sys.path.insert(0, __file__.rsplit("/", 1)[0])

import test_operators as brute

import corpus_pipeline
from cartolake.llm import bpe, langid, queries, secrets

SF = brute.SF


def convolved(net, text):
    """Mean answer of the network over a text's windows, all places at once."""
    raw = text.encode()
    x = np.frombuffer(raw.ljust(max(1, -(-len(raw) // langid.WINDOW)) * langid.WINDOW, b"\0"), np.uint8).reshape(-1, langid.WINDOW)
    pooled = [sum(f[j].astype(float)[x[:, j : langid.WINDOW - w + 1 + j]] for j in range(w)).max(axis=1) for w, f in zip(langid.WIDTHS, net.filters, strict=True)]
    z = np.maximum(np.concatenate(pooled, axis=1) + net.bias, 0) @ net.out + net.out_bias
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return (e / e.sum(axis=1, keepdims=True)).mean(axis=0)


def test_against_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    net = langid.fit(spark.read.parquet(f"{SF}/documents.parquet"))
    docs = [(i, t) for i, t in docs if any(c.isalpha() for c in t or "") and convolved(net, t).max() >= corpus_pipeline.MAJORITY]
    prints = np.array([brute.brute_simhash(t) for _, t in docs], np.uint64)
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 3
    label = np.array([i for i, _ in docs])
    while not np.array_equal(label, new := np.array([label[n].min() for n in near])):
        label = new
    docs = [(i, t) for (i, t), g in zip(docs, label, strict=True) if i == g]
    cut = brute.brute_repeats([t for _, t in docs], 200)
    docs = [(i, t if not gone else kept.decode("utf-8", "ignore")) for (i, t), (size, gone, _, kept) in zip(docs, cut, strict=True) if not gone or gone < size]
    clean = []
    for i, t in docs:
        first = secrets.patterned(t)
        out, at = [], 0
        for a, _, b in sorted(first + brute.brute_random(t, first)):
            if b > at:
                if a >= at:
                    out += [t[at:a], corpus_pipeline.SECRET]
                at = b
        clean.append((i, "".join(out) + t[at:]))
    tool = Tokenizer.from_file(bpe.WORD_BPE)
    wanted = []
    for i, t in clean:
        ids = [*tool.encode(t, add_special_tokens=False).ids, 1]
        wanted += [(i, k, at, len(ids[at : at + 4096]), zlib.crc32(np.array(ids[at : at + 4096], "<u4").tobytes())) for k, at in enumerate(range(0, len(ids), 4096))]
    found = corpus_pipeline.run(spark, SF)
    assert brute.by_row(found, "doc_id", "piece", "start", "length", "ids_crc32") == brute.expected(wanted)


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns


def test_stages_take_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_near_copies_with_null_and_repeated_ids(spark):
    """Only likeness removes rows, in any order of arrival."""
    a, b, c, d, e = (brute.prose(90 + i, 150) for i in range(5))
    rows = [(None, a), (None, b), (None, b), (1, c), (1, d), (2, d), (3, e), (None, e), (3, e), (1, a.upper())]
    wanted = [(None, b), (1, a.upper()), (1, c), (1, d), (3, e)]
    for given in (rows, rows[::-1]):
        docs = spark.createDataFrame([(i, t, "en", f"s{k % 2}", len(t)) for k, (i, t) in enumerate(given)], "doc_id long, text string, lang string, source string, n_chars long")
        found = corpus_pipeline.near_copies(spark, docs, SF)
        assert found.columns == list(corpus_pipeline.COLUMNS)
        assert brute.by_row(found, "doc_id", "text") == brute.expected(wanted)


def test_language_without_labels(spark):
    """With nothing to learn from, only documents without a letter go."""
    rows = [(1, "some text", None, "s", 9), (2, "12 34", None, "s", 5), (3, None, None, "s", 0), (None, "é", None, "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    found = corpus_pipeline.language(spark, docs, SF)
    assert found.columns == list(corpus_pipeline.COLUMNS)
    assert brute.by_row(found, "doc_id", "text") == brute.expected([(1, "some text"), (None, "é")])


def test_language_decides(spark):
    """Documents that no language has the majority of go, and the prediction is written; ids and other columns play no part."""
    table = spark.read.parquet(f"{SF}/documents.parquet")
    net = langid.fit(table)
    ends = {l: table.where(f"lang = '{l}' AND n_chars > 400").orderBy("doc_id").first().text[:384] for l in net.languages}
    mixed = "".join(ends[l][:120].ljust(128) for l in net.languages)
    given = [(None, ends["en"]), (1, ends["fr"]), (1, ends["fr"]), (1, mixed), (2, None), (3, ""), (4, "1 2 3"), (None, ends["de"] * 2000)]
    odd = spark.createDataFrame([(i, t, None, "s", 1, "x", "y") for i, t in given], "doc_id long, text string, lang string, source string, n_chars long, score string, lang_pred string")
    both = table.withColumn("score", F.lit("")).withColumn("lang_pred", F.lit("")).unionByName(odd)
    found = corpus_pipeline.language(spark, both, SF)
    assert found.columns == list(corpus_pipeline.COLUMNS)
    assert convolved(net, mixed).max() < corpus_pipeline.MAJORITY
    assert brute.by_row(found.where("n_chars = 1"), "doc_id", "text", "lang") == brute.expected([(None, ends["en"], "en"), (1, ends["fr"], "fr"), (1, ends["fr"], "fr"), (None, ends["de"] * 2000, "de")])
    kept = {(r.doc_id, r.lang) for r in found.where("n_chars > 1").collect()}
    wanted = {(r.doc_id, net.languages[int(p.argmax())]) for r in table.collect() if any(c.isalpha() for c in r.text or "") and (p := convolved(net, r.text)).max() >= corpus_pipeline.MAJORITY}
    assert kept == {(i, l) for i, l in wanted if i is not None}


def odd_documents(spark):
    """Null and repeated ids, null, empty, long and equal texts, columns under names that the operators use inside."""
    shared = brute.prose(40, 60)
    texts = [(None, None), (None, ""), (1, brute.prose(41, 90) + shared), (1, brute.prose(42, 90) + shared), (2, brute.prose(43, 30) + brute.SECRET), (2, brute.prose(43, 30) + brute.SECRET), (None, "é" * 300), (3, brute.prose(44, 20_000)), (4, "x")]
    rows = [(i, t, None, f"s{k}", None, *["clash"] * len(brute.CLASH)) for k, (i, t) in enumerate(texts)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in brute.CLASH)
    return texts, spark.createDataFrame(rows, schema)


def test_repeats_stage_of_odd_rows(spark):
    texts, docs = odd_documents(spark)
    cut = brute.brute_repeats([t for _, t in texts], 200)
    wanted = [(i, k, None if t is None else t if not gone else kept.decode("utf-8", "ignore")) for (k, (i, t)), (size, gone, _, kept) in zip(enumerate(texts), cut, strict=True) if not gone or gone < size]
    rows = corpus_pipeline.repeats(spark, docs, SF).collect()
    assert brute.expected((r.doc_id, int(r.source[1:]), r.text) for r in rows) == brute.expected(wanted)
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in rows)


def test_secrets_and_packing_stages_of_odd_rows(spark):
    texts, docs = odd_documents(spark)
    rows = corpus_pipeline.without_secrets(spark, docs, SF).collect()
    value = brute.SECRET.split('"')[1]
    assert len(rows) == len(texts) and not any(value in r.text for r in rows)
    clean = {(r.doc_id, r.source): r.text for r in rows}
    assert all(clean[i, f"s{k}"] == (t or "") for k, (i, t) in enumerate(texts) if brute.SECRET not in (t or ""))
    tool = Tokenizer.from_file(bpe.WORD_BPE)
    wanted = []
    for i, t in texts:
        n = len(tool.encode(t or "", add_special_tokens=False).ids) + 1
        wanted += [(i, k, min(4096, n - 4096 * k)) for k in range(-(-n // 4096))]
    assert brute.by_row(corpus_pipeline.packed(spark, docs, SF), "doc_id", "piece", "length") == brute.expected(wanted)


def test_near_copies_stage_of_odd_rows(spark):
    texts, docs = odd_documents(spark)
    prints = [brute.brute_simhash(t) for _, t in texts]
    group = list(range(len(texts)))
    for _ in texts:
        for a, b in [(a, b) for a in range(len(texts)) for b in range(len(texts)) if (prints[a] ^ prints[b]).bit_count() <= 3]:
            group[a] = group[b] = min(group[a], group[b])
    rows = corpus_pipeline.near_copies(spark, docs, SF).collect()
    assert len(rows) == len(set(group))
    assert all(any(r.doc_id == i and r.text == t for i, t in texts) for r in rows)


def test_registered(spark):
    assert set(queries.oracle_sql()) <= set(queries.queries())
    names = sorted(queries.queries())
    assert len(names) == 14 and sorted(n.split("_")[0] for n in names if n != "pipeline") == sorted(f"op{n}" for n in range(1, 14))
