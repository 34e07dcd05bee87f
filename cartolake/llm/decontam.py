"""Benchmark decontamination by a broadcast set of normalised test n-grams, in DataFrame operations only.

The test items are cut into words and all their windows of N consecutive words are taken (an item of fewer words is one window).
The set of different windows, each with the items that hold it, is hashed and broadcast; training texts are cut in the same
way, each of their windows is looked up by hash, and those that may be test windows are joined and verified word by word. What leaves a task
is one row for each document and one for each window that was met. By document the windows are merged into spans, which
may then be cut out, or documents with a large share of such words dropped.

The set is broadcast only if its size, which is summed first, is within BROADCAST_BYTES; a larger one is joined by a shuffle on the hash, with
the same result. Up to GATE hashes also stand in the expression that cuts windows, so that no other window becomes a row; beyond that every window does. Windows shorter than N words are looked for only in the lengths that the items have (nine other lengths at most).

Defined cases: null and empty texts have no words and no hits; every row gives one row: rows that repeat an id are kept
apart by their text, rows that repeat both are counted once and given out as often as they occur; items with the same id
are one item; an item without id is named by an empty string; items without words have no window; only id and text are read; an empty
corpus gives an empty result, an empty benchmark leaves all documents clean; whole texts are scanned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartolake.llm.licenses import LOWER, UPPER, WORD_GAP, words

#: Words of a window.
N = 10
#: Most bytes of test windows (words, ids and 100 bytes each) that are broadcast.
BROADCAST_BYTES = 64 << 20
#: Most hashes of test windows that are sent with the scan itself.
GATE = 20_000
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _starts(w: Column, n: int) -> Column:
    """Places (from 1) at which n consecutive words of an array start."""
    last = F.size(w) - n + 1
    return F.when(last > 0, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))


def windows(w: Column, n: int) -> Column:
    """All runs of n consecutive words of an array, in order; none of fewer words."""
    return F.transform(_starts(w, n), lambda i: F.slice(w, i, n))


def test_windows(benchmark: DataFrame, n: int = N, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """window (array of words), hash, size, items (ids of those that hold it, as sorted strings): one row for each different window."""
    items = benchmark.select(F.coalesce(benchmark[id_col].cast("string"), F.lit("")).alias("item"), words(benchmark[text_col]).alias("w"))
    own = F.when(F.size("w") >= n, windows(F.col("w"), n)).when(F.size("w") > 0, F.array("w")).otherwise(F.array().cast("array<array<string>>"))
    each = items.select("item", F.explode(own).alias("window"))
    grouped = each.groupBy("window").agg(F.array_sort(F.collect_set("item")).alias("items"))
    return grouped.withColumns({"hash": F.xxhash64("window"), "size": F.size("window")})


def hits(docs: DataFrame, benchmark: DataFrame, n: int = N, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row per different (id, text) and window met: id, th (hash of the text), at (its first word), size, items.

    A row of size 0 stands for the document: its `at` is the number of words; it comes once for each row of docs.
    """
    tests = test_windows(benchmark, n, item_col, item_text_col)
    chars = F.aggregate("window", F.lit(0).cast("long"), lambda s, w: s + F.length(w) + 16) + F.aggregate("items", F.lit(0).cast("long"), lambda s, w: s + F.length(w) + 16)
    by_size = tests.groupBy("size").agg(F.sum(chars + 100).alias("bytes"), F.count("*").alias("n")).collect()  # n rows at most
    sizes = sorted({r["size"] for r in by_size} | {n})
    known = [r["hash"] for r in tests.select("hash").distinct().collect()] if sum(r["n"] for r in by_size) <= GATE else None
    whole = docs.sparkSession.createDataFrame([([], 0, [])], "window array<string>, size int, items array<string>").withColumn("hash", F.xxhash64("window"))
    tests = tests.unionByName(whole)
    cut = docs.select(docs[id_col].alias("id"), F.xxhash64(docs[text_col]).alias("th"), words(docs[text_col]).alias("w"))

    def of_size(m: int, closing: bool) -> DataFrame:
        starts = _starts(F.col("w"), m)
        if known is not None:
            starts = F.filter(starts, lambda i: F.xxhash64(F.slice("w", i, m)).isin(known))
        runs = F.transform(starts, lambda i: F.struct((i - 1).alias("pos"), F.slice("w", i, m).alias("run")))
        # The last window is empty: it meets the row of size 0, and its place is the number of words.
        end = F.array(F.struct(F.size("w").alias("pos"), F.slice("w", 1, 0).alias("run")))
        each = cut.select("id", "th", F.explode(F.concat(runs, end) if closing else runs).alias("x"))
        return each.select("id", "th", "x.pos", "x.run")

    each = of_size(sizes[0], True)
    for m in sizes[1:]:
        each = each.unionByName(of_size(m, False))
    each = each.withColumn("hash", F.xxhash64("run"))
    small = sum(r["bytes"] for r in by_size) <= broadcast_bytes
    met = each.join(F.broadcast(tests) if small else tests.hint("merge"), "hash").where(F.col("run") == F.col("window"))
    return met.select("id", "th", F.col("pos").alias("at"), "size", "items")


def merged(runs: Column) -> Column:
    """Spans (start, end exclusive) that an array of (at, size) covers, by start; runs that touch are one span."""
    none = F.array().cast("array<struct<start:int,end:int>>")

    def add(done: Column, r: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        ends = (r["at"] + r["size"]).alias("end")
        grown = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], ends).alias("end"))))
        return F.when(last.isNull() | (r["at"] > last["end"]), F.concat(done, F.array(F.struct(r["at"].alias("start"), ends)))).otherwise(grown)

    return F.aggregate(F.array_sort(runs), none, add)


def scan(docs: DataFrame, benchmark: DataFrame, n: int = N, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """id, n_words, n_hit, n_items, items, contaminated, spans (start, end exclusive, in words) of every document."""
    return _by_text(docs, benchmark, n, id_col, text_col, item_col, item_text_col, broadcast_bytes).select(F.col("id").alias(id_col), "n_words", "n_hit", "n_items", "items", (F.col("n_hit") > 0).alias("contaminated"), "spans")


def _by_text(docs: DataFrame, benchmark: DataFrame, n: int, id_col: str, text_col: str, item_col: str, item_text_col: str, broadcast_bytes: int) -> DataFrame:
    met = hits(docs, benchmark, n, id_col, text_col, item_col, item_text_col, broadcast_bytes)
    inside = F.col("size") > 0
    found = met.groupBy("id", "th").agg(
        F.count_if(~inside).alias("copies"),
        F.max(F.when(~inside, F.col("at"))).cast("long").alias("n_words"),
        F.collect_set(F.when(inside, F.struct("at", "size"))).alias("runs"),
        F.collect_set(F.when(inside, F.col("items"))).alias("sets"),
    )
    out = found.withColumns({"spans": merged(F.col("runs")), "items": F.array_sort(F.array_distinct(F.flatten("sets")))})
    out = out.withColumns({"n_hit": F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"]), "n_items": F.size("items").cast("long")})
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))


def without_words(text: Column, spans: Column) -> Column:
    """The text without the words of the spans and without what stands between the words of one span."""
    gaps, w = F.split(text, WORD, -1), F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))
    cuts = F.concat(F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"))), spans, F.array(F.struct(F.size(w).alias("start"), F.size(w).alias("end"))))
    # Between two spans: the words from the end of one to the start of the next, each after its gap; the gap before a span stays.
    kept = F.transform(F.sequence(F.lit(1), F.size(cuts) - 1), lambda k: F.concat(F.array_join(F.transform(_range(F.element_at(cuts, k)["end"], F.element_at(cuts, k + 1)["start"]), lambda i: F.concat(gaps[i], w[i])), ""), gaps[F.element_at(cuts, k + 1)["start"]]))
    return F.when(F.size(spans) > 0, F.array_join(kept, "")).otherwise(text)


def _range(a: Column, b: Column) -> Column:
    return F.when(b > a, F.sequence(a, b - 1)).otherwise(F.array().cast("array<int>"))


def clean(docs: DataFrame, benchmark: DataFrame, n: int = N, most_share: float = 0.5, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs without the words that stand in test items; rows of which more than `most_share` is hit go whole.

    All columns stay. most_share=0 drops every contaminated row, 1 drops none.
    """
    options = {"item_col": "item_id", "item_text_col": "text", "broadcast_bytes": BROADCAST_BYTES} | options
    found = _by_text(docs, benchmark, n, id_col, text_col, **options).where("n_hit > 0")
    dirty = found.select(F.struct(F.col("id"), F.col("th")).alias("found_key"), F.struct("n_hit", "n_words", "spans").alias("found_hits")).distinct()
    # Contaminated documents only meet the texts again; names of the caller's columns cannot clash with two that are dropped.
    keyed = docs.select(F.struct(*docs.columns).alias("row"), F.struct(docs[id_col].alias("id"), F.xxhash64(docs[text_col]).alias("th")).alias("key"))
    joined = keyed.join(dirty, F.col("key").eqNullSafe(F.col("found_key")), "left")
    left = joined.where(F.col("found_hits").isNull() | (F.col("found_hits.n_hit") <= most_share * F.col("found_hits.n_words")))
    text = F.when(F.col("found_hits").isNull(), F.col(f"row.{text_col}")).otherwise(without_words(F.col(f"row.{text_col}"), F.col("found_hits.spans")))
    return left.select(*[text.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns])


def oracle() -> str:
    """The query's rows in SQL: windows as slices of the word lists, compared as lists."""
    cut = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w"
    return f"""
        WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {cut} FROM documents),
        b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {cut} FROM benchmark),
        t AS MATERIALIZED (SELECT DISTINCT item, w[i : i + least(len(w), {N}) - 1] AS win FROM (SELECT item, w, unnest(range(1, greatest(len(w) - {N}, 0) + 2)) AS i FROM b WHERE len(w) > 0) x),
        s AS (SELECT DISTINCT len(win) AS size FROM t),
        g AS (SELECT rid, size, i, w[i : i + size - 1] AS win FROM (SELECT rid, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, s WHERE len(w) >= size) x),
        h AS MATERIALIZED (SELECT rid, size, i, item FROM g JOIN t USING (win)),
        c AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + size)) AS p FROM h) x GROUP BY rid),
        a AS (SELECT rid, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY rid)
        SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN c USING (rid) LEFT JOIN a USING (rid)"""
