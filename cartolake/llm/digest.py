"""Document fingerprints from statistically improbable features.

Each 64-byte window has an entropy. Windows are ranked by how rare their entropy is in the corpus: how often each grade of
entropy occurs is counted in the windows of all documents, and the rarer its grade, the better a window's rank;
the extremes, which carry no text, are excluded. A window that is the best-ranked (leftmost) one of enough neighbouring
stretches is a feature. Digests can be compared if they were made with the same ranks. Features are hashed
into a chain of Bloom filters, a new filter being opened when one is full. Two digests are compared filter by filter: the
bits that two filters share, less what chance would give, over what could be shared at most; each filter of the shorter
digest takes its best partner, and the mean over them is the likeness (0 to 1).

Windows are counted incrementally: as a window moves on, only the counts of the byte that leaves and of the byte that comes
change, so a running sum of whole numbers gives every entropy, and equal texts have equal fingerprints wherever they lie.
Long texts are worked on in parts that overlap, which bounds the memory and changes nothing in the result.

Short texts have few or no features. A text of less than BOTH bytes, or of less than FEW features, is described by its
distinct 8-byte strings in filters of their own; features that it has are kept beside them. Two digests are compared by
strings where both have them, else by features, so an edit that moves a text across BOTH still compares like with like.

Defined cases: null text counts as empty; a text of at most 8 bytes is one string; an empty text has no feature, is like
another empty text (1) and unlike the rest (0).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartolake.llm.common import bounded_batches, shuffle_partitions, texts

WIDTH = 64
STRETCH = 64
#: Neighbouring stretches in which a window must come first.
POPULAR = 16
#: Short texts are described by all distinct strings of this many bytes.
SHORT = 8
#: Texts of less than so many bytes, or of less than so many features, are short.
BOTH, FEW = 512, 8
#: First byte of each filter.
FEATURES, STRINGS = 0, 1
BITS = 2048
HASHES = 5
MOST_FEATURES = 160
SCALE = 1 << 20

#: Windows worked on at once.
PART = 1 << 18
#: Features hashed at once.
FEATURES_AT_ONCE = 1 << 13

#: Ranges of ids for each shuffle partition: many, so that a partition's share is even.
RANGES = 8

_counts = np.arange(WIDTH + 2, dtype=np.float64)
#: What the c-th equal byte adds to the sum of c log2 c, as a whole number.
GAIN = np.concatenate([[0], np.diff(np.round(np.where(_counts > 0, _counts * np.log2(np.maximum(_counts, 1)), 0) * SCALE))]).astype(np.int64)
#: log2(64) * 64 on the same scale: the sum at entropy zero.
ZERO = int(GAIN[: WIDTH + 1].sum())
GRADES = 1000
#: Grades at most this low or at least this high carry no text.
LOWEST, HIGHEST = 100, 990
#: Counts of so many grades on either side are added to a grade's own.
SMOOTH = 5
EXCLUDED = 1 << 20


def rarity(counts: np.ndarray) -> np.ndarray:
    """Rank of each entropy grade (0 to GRADES) from the number of windows with it; smaller is rarer, EXCLUDED for the extremes.

    Grades are ranked by how many windows have them or a grade next to them; equally rare ones by grade, so ranks differ.
    """
    near = np.convolve(counts, np.ones(2 * SMOOTH + 1, np.int64))[SMOOTH:-SMOOTH]
    rank = np.empty(GRADES + 1, np.int64)
    rank[np.argsort(near, kind="stable")] = np.arange(GRADES + 1)
    rank[:LOWEST], rank[HIGHEST + 1 :] = EXCLUDED, EXCLUDED
    return rank


def entropies(data: np.ndarray) -> np.ndarray:
    """Entropy grade of every WIDTH-byte window."""
    n = len(data)
    order = np.argsort(data, kind="stable")
    key = order + data[order].astype(np.int64) * (n + WIDTH)
    ahead = np.ones(n, np.int8)  # equal bytes in the window that starts at a place, itself included
    behind = np.ones(n, np.int8)  # equal bytes in the window that ends there
    for t in range(1, WIDTH):
        near = key[t:] - key[:-t] < WIDTH
        if not near.any():
            break
        ahead[: n - t] += near
        behind[t:] += near
    leaving, coming = np.empty(n, np.int8), np.empty(n, np.int8)
    leaving[order], coming[order] = ahead, behind
    first = np.bincount(data[:WIDTH], minlength=256)
    total = np.empty(n - WIDTH + 1, np.int64)
    total[0] = np.cumsum(GAIN)[first].sum()
    # A window loses its first byte, then gains the next one; behind counts the new window, so it is the count after.
    total[1:] = GAIN[coming[WIDTH:]] - GAIN[leaving[: n - WIDTH]]
    np.cumsum(total, out=total)
    return (ZERO - total) * GRADES // ZERO


def first_least(rank: np.ndarray, width: int) -> np.ndarray:
    """Place of the leftmost least value in every stretch of `width` values, by doubling."""
    best = rank * np.int64(len(rank) + 1) + np.arange(len(rank))
    size = 1
    while size * 2 <= width:
        best = np.minimum(best[:-size], best[size:])
        size *= 2
    if size < width:
        best = np.minimum(best[: len(best) - (width - size)], best[width - size :])
    return best % (len(rank) + 1)


_ODD = (np.random.default_rng(64).integers(0, 1 << 63, WIDTH, np.uint64) << np.uint64(1)) | np.uint64(1)


def mixed(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    return h


def grades(data: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Entropy grades of all windows, in parts: (place of the first, grades)."""
    n = len(data) - WIDTH + 1
    for a in range(0, n, PART):
        yield a, entropies(data[a : min(n, a + PART) + WIDTH - 1])


def features(raw: bytes, ranks: np.ndarray) -> np.ndarray:
    """64-bit hashes of the selected features of a text, in text order; ranks: from rarity()."""
    if len(raw) < WIDTH + STRETCH - 1:
        return np.zeros(0, np.uint64)
    data = np.frombuffer(raw, np.uint8)
    rank = np.empty(len(data) - WIDTH + 1, np.int32)
    for a, part in grades(data):
        rank[a : a + len(part)] = ranks[part]
    votes = np.zeros(len(rank), np.uint8)
    for a in range(0, len(rank) - STRETCH + 1, PART):
        part = rank[a : a + PART + STRETCH - 1].astype(np.int64)
        votes[a : a + len(part)] += np.bincount(first_least(part, STRETCH), minlength=len(part)).astype(np.uint8)
    at = np.nonzero((votes >= POPULAR) & (rank < EXCLUDED))[0]
    h = np.empty(len(at), np.uint64)
    for a in range(0, len(at), FEATURES_AT_ONCE):
        windows = data[at[a : a + FEATURES_AT_ONCE, None] + np.arange(WIDTH)].astype(np.uint64)
        h[a : a + FEATURES_AT_ONCE] = (windows + np.uint64(1)) @ _ODD
    return mixed(h)


def strings(raw: bytes) -> np.ndarray:
    """64-bit hashes of the distinct SHORT-byte strings of a text, in the order of their first places."""
    if len(raw) <= SHORT:
        return np.array([xxhash.xxh64_intdigest(raw)] if raw else [], np.uint64)
    data = np.frombuffer(raw, np.uint8)
    h = np.zeros(len(data) - SHORT + 1, np.uint64)
    for k in range(SHORT):
        h |= data[k : k + len(h)].astype(np.uint64) << np.uint64(8 * k)
    first = np.unique(h, return_index=True)[1]
    h = h[np.sort(first)]
    return mixed(mixed(h))


def chained(h: np.ndarray, kind: int) -> np.ndarray:
    """Chain of Bloom filters, one row of bytes each, the kind first. Strings fill their filters evenly."""
    rows = -(-len(h) // MOST_FEATURES)
    chain = np.full((rows, 1 + BITS // 8), kind, np.uint8)
    if rows:
        places = (h[:, None] >> (np.arange(HASHES, dtype=np.uint64) * np.uint64(11))) & np.uint64(BITS - 1)
        order = np.arange(len(h))
        row = order * rows // len(h) if kind == STRINGS else order // MOST_FEATURES
        flat = row[:, None] * BITS + places.astype(np.int64)
        bits = np.zeros(rows * BITS, np.uint8)
        bits[flat.ravel()] = 1
        chain[:, 1:] = np.packbits(bits).reshape(-1, BITS // 8)
    return chain


def digest(raw: bytes, ranks: np.ndarray) -> np.ndarray:
    """The filters of a text: those of its features, then, if it is short, those of its strings."""
    found = features(raw, ranks)
    chain = chained(found, FEATURES)
    if len(raw) < BOTH or len(found) < FEW:
        chain = np.concatenate([chain, chained(strings(raw), STRINGS)])
    return chain


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Normalised overlap of two digests."""
    if a.shape == b.shape and np.array_equal(a, b):
        return 1.0
    for kind in (STRINGS, FEATURES):
        x, y = a[a[:, 0] == kind, 1:], b[b[:, 0] == kind, 1:]
        if len(x) and len(y):
            return overlap(x, y)
    return 0.0


def overlap(a: np.ndarray, b: np.ndarray) -> float:
    """Mean over the filters of the shorter chain of what each shares with its best partner."""
    if len(a) > len(b):
        a, b = b, a
    na, nb = np.bitwise_count(a).sum(axis=1, dtype=np.int64), np.bitwise_count(b).sum(axis=1, dtype=np.int64)
    total = 0.0
    for row, n in zip(a, na, strict=True):
        shared = np.bitwise_count(row & b).sum(axis=1, dtype=np.int64)
        chance = n * nb / BITS
        most = np.minimum(n, nb)
        score = np.where(most > chance, (shared - chance) / np.maximum(most - chance, 1e-9), 0.0)
        total += float(np.clip(score.max(), 0.0, 1.0))
    return total / len(a)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int | None = None) -> np.ndarray:
    """Ranks learned from all documents; with `sample` from at most so many, by hash of id, then of text, so the same ones at each run.

    Windows are counted where the texts are; one count for each grade comes to the driver.
    """
    bounded_batches(docs.sparkSession)
    once = docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    if sample is not None:
        rows = once.withColumn("h", F.xxhash64("text"))
        chosen = rows.select("id", "h").distinct().orderBy(F.xxhash64("id"), "id", "h").limit(sample)
        same = F.col("id").eqNullSafe(F.col("c")) & (F.col("h") == F.col("g"))
        once = rows.join(F.broadcast(chosen.select(F.col("id").alias("c"), F.col("h").alias("g"))), same, "left_semi").groupBy("id", "h").agg(F.first("text").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(GRADES + 1, np.int64)
        for batch in batches:
            for text in texts(batch.column(0)):
                data = np.frombuffer(text.encode(), np.uint8)
                if len(data) >= WIDTH:
                    for _, part in grades(data):
                        total += np.bincount(part, minlength=GRADES + 1)
        at = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["grade", "n"])

    counts = np.zeros(GRADES + 1, np.int64)
    for r in once.select("text").mapInArrow(count, "grade int, n long").groupBy("grade").agg(F.sum("n").alias("n")).collect():
        counts[r["grade"]] = r["n"]
    return rarity(counts)


def compare(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: np.ndarray | None = None) -> DataFrame:
    """One row per document: id, n_chars, fingerprint and edited_fingerprint (binary), edited_sha256, near_edited, near_next.

    ranks: from rarity(); if none are given, they are learned from docs.

    The next document is the one with the next smaller id, after the last the first; ties in id go by the text, null ids
    come last. Texts are shuffled once: rows are dealt to ranges of ids, and each range also gets the first row of the next
    one, which is found from ids alone. A range is read in order and a row at a time.
    """
    spark = docs.sparkSession
    ranks = fit(docs, id_col, text_col) if ranks is None else ranks
    bounded_batches(spark)
    ranges = max(2, RANGES * shuffle_partitions(spark))
    rows = docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    # Only the ids' quantiles, one for each range, and one id for each range come to the driver.
    cuts = rows.select(F.percentile_approx("id", [i / ranges for i in range(1, ranges)], 20 * ranges)).first()[0] or []
    cuts = sorted(set(cuts))
    # Ranges count down with the ids; null ids are the last range.
    last, sorted_cuts = len(cuts), np.array(cuts)

    def place(ids: pd.Series) -> pd.Series:
        return pd.Series(last - np.searchsorted(sorted_cuts, ids.to_numpy()).astype(np.int32))

    where = F.when(F.col("id").isNull(), last + 1).otherwise(F.pandas_udf(place, "int")(F.coalesce("id", F.lit(cuts[0])))) if cuts else F.lit(0)
    placed = rows.withColumn("range", where)
    heads = placed.groupBy("range").agg(F.max("id").alias("id")).orderBy("range").collect()
    order = [r["range"] for r in heads]
    moved = spark.createDataFrame([(r["range"], r["id"], order[i - 1], i == 0) for i, r in enumerate(heads)], f"r int, head {kind}, to int, wraps boolean")
    lead = placed.join(F.broadcast(moved), (F.col("range") == F.col("r")) & F.col("id").eqNullSafe(F.col("head")))
    both = placed.select("range", F.lit(0).alias("guest"), "id", "text").union(lead.select("to", F.lit(1), "id", "text"))
    dealt = both.repartition(max(shuffle_partitions(spark), 1), "range").sortWithinPartitions("range", "guest", F.desc_nulls_last("id"), "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: tuple | None = None  # range, id, text, bytes, digest
        served = None

        def result(row: tuple, after: tuple) -> tuple:
            _, key, text, raw, own = row
            n = len(text)
            cut = n // 3
            edited = (text[: n - cut] + after[2][:cut]).encode()
            changed = own if edited == raw else digest(edited, ranks)
            return key, n, own.tobytes(), changed.tobytes(), hashlib.sha256(edited).hexdigest(), likeness(own, changed), likeness(own, after[4])

        for batch in batches:
            out = []
            ids, guests, where = batch.column(2), batch.column(1).to_pylist(), batch.column(0).to_pylist()
            for r, (part, guest, text) in enumerate(zip(where, guests, texts(batch.column(3)), strict=True)):
                if guest and served == part:
                    continue
                raw = text.encode()
                row = (part, ids[r].as_py(), text, raw, digest(raw, ranks))
                if waiting is not None:
                    out.append(result(waiting, row))
                waiting, served = (None, part) if guest else (row, None)
            if out:
                columns = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], ids.type), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.binary()), pa.array(columns[3], pa.binary()), pa.array(columns[4], pa.string()), pa.array(columns[5], pa.float64()), pa.array(columns[6], pa.float64())], ["id", "n_chars", "fingerprint", "edited_fingerprint", "edited_sha256", "near_edited", "near_next"])

    schema = f"id {kind}, n_chars long, fingerprint binary, edited_fingerprint binary, edited_sha256 string, near_edited double, near_next double"
    return dealt.mapInArrow(work, schema).withColumnRenamed("id", id_col)
