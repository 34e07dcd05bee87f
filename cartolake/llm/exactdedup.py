"""Removal of byte strings that occur more than once in the corpus, by shard suffix arrays.

A corpus-wide suffix array is built as many small ones. Every window of `window` bytes is routed by the least hash among
its `gram`-byte grams, so equal windows always meet, and windows that follow each other mostly travel together as one
segment. Segments whose key occurs once hold no repeated window and stay behind; equal segments are counted and kept once.
Keys that only ever come with one and the same segment are settled by that count. The texts of the others are joined into
shard texts of bounded size, whose suffix arrays (induced sorting) and permuted common prefixes show the groups of suffixes
that share `window` bytes; a window is repeated if its group stands for two or more places. A key with very many different
segments (a passage in very many contexts) is dealt anew by longer grams, in the end by whole windows, before it is sorted.

Defined cases: null text counts as empty; texts shorter than the window lose nothing; matches never cross documents, and
rows with equal ids or equal texts are different documents, so both lose what they share; one row comes out for each row
that goes in; strings are judged on the input; other columns are carried, and clash with nothing since the work is keyed
on internal names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartolake.llm.common import bounded_batches, released, saved, shuffle_partitions, slices, utf8
from cartolake.llm.suffix import common_prefixes, suffix_array

WINDOW = 200
#: Gram lengths by level; the last is the window itself.
GRAMS = (50, 150, 188)
#: A key with more different segments than this is dealt anew by longer grams.
MOST_SEGMENTS = 1_000
SHARD_BYTES = 1 << 20
#: Windows hashed at once; positions take the low bits of the compared values, so this bounds them.
PART = 4 << 20
PLACE = np.uint64((1 << 23) - 1)

_rng = np.random.default_rng(200)
LETTERS = _rng.integers(0, 1 << 64, 256, np.uint64, endpoint=False)
BASE = np.uint64(0x9E3779B97F4A7C15)
UNBASE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def powers(base: np.uint64, n: int) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    if n:
        p[0] = 1
    return np.cumprod(p, dtype=np.uint64)


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """Rolling hash of every gram-byte string."""
    n = len(data) - gram + 1
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(LETTERS[data] * powers(BASE, len(data)), dtype=np.uint64, out=total[1:])
    return mixed((total[gram:] - total[:n]) * powers(UNBASE, n))


def window_least(h: np.ndarray, width: int) -> np.ndarray:
    """Least of every `width` neighbours, from running minima within blocks of that width."""
    n = len(h) - width + 1
    if width == 1:
        return h
    padded = np.full(-(-len(h) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(h)] = h
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def segments(data: np.ndarray, offsets: np.ndarray, gram: int, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, start in the row, windows, key) of the runs of windows with one leftmost least gram, for texts end to end.

    No window occurs twice in a run: the second one's leftmost least gram would lie further right.
    """
    lengths = np.diff(offsets)
    found = []
    for at in range(0, max(0, len(data) - window + 1), PART):
        part = data[at : at + PART + window - 1]
        n = len(part) - window + 1
        h = gram_hashes(part, gram)
        place = window_least((h & ~PLACE) | np.arange(len(h), dtype=np.uint64), window - gram + 1) & PLACE
        row = np.searchsorted(offsets, np.arange(at, at + n, dtype=np.int64), side="right") - 1 if len(lengths) > 1 else np.zeros(n, np.int64)
        end_of_row = offsets[row + 1] - at
        fresh = np.concatenate([[True], (place[1:] != place[:-1]) | (row[1:] != row[:-1])])
        cuts = np.append(np.nonzero(fresh)[0], n)
        start, end = cuts[:-1], cuts[1:]
        # In a row the valid windows are the first ones.
        end = np.minimum(end, end_of_row[start] - window + 1)
        on = end > start
        start, end = start[on], end[on]
        found.append((row[start], start + at - offsets[row[start]], end - start, h[place[start].astype(np.int64)]))
    if not found:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, empty.astype(np.uint64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _segmented(texts: DataFrame, gram: int, window: int) -> DataFrame:
    """key, digest, doc, th, base, start, windows of each segment; texts: doc, th, shift, body (binary); base is the shift of its text."""
    kind = texts.schema["doc"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        released()
        for batch in batches:
            data, offsets = utf8(batch.column(3))
            shift = batch.column(2).to_numpy(zero_copy_only=False)
            for a, b in slices(np.diff(offsets), 1 << 20):
                part = data[offsets[a] : offsets[b]]
                row, start, windows, key = segments(part, offsets[a : b + 1] - offsets[a], gram, window)
                raw = part.tobytes()
                at = (offsets[a + row] - offsets[a] + start).tolist()
                digest = xxhash.xxh3_64_intdigest
                digests = np.array([digest(raw[i : i + w + window - 1]) for i, w in zip(at, windows.tolist(), strict=True)], np.uint64)
                take = pa.array(a + row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)), pa.array(digests.view(np.int64)), batch.column(0).take(take), batch.column(1).take(take), pa.array(shift[a + row].astype(np.int32)), pa.array((start + shift[a + row]).astype(np.int32)), pa.array(windows.astype(np.int32))],
                    ["key", "digest", "doc", "th", "base", "start", "windows"],
                )

    return texts.select("doc", "th", "shift", "body").mapInArrow(work, f"key long, digest long, doc {kind}, th long, base int, start int, windows int")


def repeated_windows(data: np.ndarray, offsets: np.ndarray, weights: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first window, windows) of the runs of windows that stand for two or more places; weights: places of each row."""
    sa = suffix_array(data)
    shared = common_prefixes(data, sa)
    lengths = np.diff(offsets)
    row = np.repeat(np.arange(len(lengths)), lengths)
    valid = np.arange(len(data)) + window <= offsets[row + 1]
    group = np.cumsum(shared < window) - 1
    inside = valid[sa]
    places = np.bincount(group[inside], weights=weights[row[sa[inside]]], minlength=group[-1] + 1 if len(group) else 0)
    hit = np.zeros(len(data) + 1, bool)
    hit[sa[inside & (places[group] >= 2)]] = True
    at = np.nonzero(hit)[0]
    if not len(at):
        return at, at, at
    fresh = np.concatenate([[True], (np.diff(at) != 1) | (row[at[1:]] != row[at[:-1]])])
    first = at[fresh]
    count = np.diff(np.append(np.nonzero(fresh)[0], len(at)))
    return row[first], first - offsets[row[first]], count


def _sorted_shards(found: DataFrame, window: int) -> DataFrame:
    """key, digest, first, count of repeated window runs; found: key, digest, places, body, whole keys in a partition."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        released()
        held: list[tuple] = []
        size = 0

        def flush(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            if not rows:
                return
            bodies = [r[3] for r in rows]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in bodies])]).astype(np.int64)
            row, first, count = repeated_windows(np.frombuffer(b"".join(bodies), np.uint8), offsets, np.array([r[2] for r in rows], np.float64), window)
            if len(row):
                yield pa.RecordBatch.from_arrays([pa.array([rows[i][0] for i in row], pa.int64()), pa.array([rows[i][1] for i in row], pa.int64()), pa.array(first.astype(np.int32)), pa.array(count.astype(np.int32))], ["key", "digest", "first", "count"])

        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size >= SHARD_BYTES and held[-1][0] != r[0]:
                    yield from flush(held)
                    held, size = [], 0
                held.append(r)
                size += len(r[3])
        yield from flush(held)

    return found.mapInArrow(work, "key long, digest long, first int, count int")


def _spans(df: DataFrame, first, count, window: int) -> DataFrame:
    return df.select("doc", "th", (F.col("start") + first).alias("from"), (F.col("start") + first + count + F.lit(window - 1)).alias("to"))


def repeated_spans(texts: DataFrame, window: int = WINDOW, grams: tuple[int, ...] = GRAMS) -> DataFrame:
    """doc, th, from, to: byte ranges covered by repeated windows (they may overlap); texts: doc, th, shift, body."""
    spark = texts.sparkSession
    n = shuffle_partitions(spark)
    out, source = None, texts
    for level, gram in enumerate((*grams, window)):
        every = saved(_segmented(source, gram, window), "segments")
        # Written first, so that the join's sides are plain shuffles, whose hot keys Spark can split.
        often = saved(every.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "often")
        every = saved(every.join(often, "key"), "repeated")
        distinct = every.groupBy("key", "digest").agg(F.count("*").alias("places"), F.min(F.struct("th", "doc", "base", "start", "windows")).alias("at"))
        distinct = saved(distinct.withColumn("at", F.struct("at.th", "at.doc", "at.base", "at.start", "at.windows")), "distinct")
        kinds = saved(distinct.groupBy("key").agg(F.count("*").alias("kinds")).where("kinds > 1"), "mixed")
        # One and the same segment in several places: every window of it is repeated.
        plain = every.join(kinds, "key", "left_anti")
        spans = _spans(plain, F.lit(0), F.col("windows"), window)
        out = spans if out is None else out.union(spans)
        last = gram == window
        hot = kinds.where(F.col("kinds") > MOST_SEGMENTS) if not last else None
        normal = kinds.where(F.col("kinds") <= MOST_SEGMENTS) if not last else kinds
        asked = distinct.join(normal, "key").select("key", "digest", "places", "at.*")
        bodies = source.select(F.col("doc").alias("d"), F.col("th").alias("t"), F.col("shift").alias("s"), "body")
        if level:  # rows that repeat id and text have brought the same bodies
            bodies = bodies.dropDuplicates(["d", "t", "s"])
        same = F.col("doc").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t")) & (F.col("base") == F.col("s"))
        text = F.expr(f"substring(body, start - s + 1, windows + {window - 1})")
        wanted = asked.join(bodies, same).select("key", "digest", "places", text.alias("body"))
        shards = wanted.repartition(n, "key").sortWithinPartitions("key", "digest")
        runs = saved(_sorted_shards(shards, window), "runs")
        out = out.union(_spans(every.join(runs, ["key", "digest"]), F.col("first"), F.col("count"), window))
        if hot is None or hot.isEmpty():
            return out
        again = every.join(hot, "key").select("doc", "th", "base", "start", "windows")
        source = saved(again.join(bodies, same).select("doc", "th", F.col("start").alias("shift"), text.alias("body")), "hot")
    return out


def remove_repeats(docs: DataFrame, window: int = WINDOW, text_col: str = "text", id_col: str = "doc_id", carried: tuple[str, ...] = (), decoded: bool = False) -> DataFrame:
    """One row per document: id, carried columns, kept (binary), n_bytes, n_removed, n_spans.

    decoded: also kept_text, the kept bytes as text; a character that a cut has split goes with the cut.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(docs[id_col].alias("doc"), F.encode(F.coalesce(docs[text_col], F.lit("")), "UTF-8").alias("body"), *[docs[c].alias(f"c{i}") for i, c in enumerate(carried)])
    rows = rows.withColumn("th", F.xxhash64("body"))
    # Rows with equal id and text are told apart by place only; each emits its own segments, so both count as places.
    found = repeated_spans(rows.select("doc", "th", F.lit(0).alias("shift"), "body"), window)
    per_doc = found.groupBy(F.col("doc").alias("d"), F.col("th").alias("t")).agg(F.collect_set(F.struct("from", "to")).alias("spans"))
    per_doc = per_doc.select("d", "t", F.transform(F.sort_array("spans"), lambda s: s["from"]).alias("froms"), F.transform(F.sort_array("spans"), lambda s: s["to"]).alias("tos"))
    joined = rows.join(per_doc, F.col("doc").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t")), "left").drop("d", "t", "th")
    joined = joined.select("body", "froms", "tos", "doc", *[f"c{i}" for i in range(len(carried))])
    fields = joined.schema.fields[3:]
    names = ["kept", "n_bytes", "n_removed", "n_spans", *["kept_text"] * decoded]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        released()
        for batch in batches:
            kept, removed, spans, sizes = [], [], [], []
            for body, froms, tos in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                raw = body.as_py()
                parts, at, cut, runs = [], 0, 0, 0
                end = -1
                for a, b in zip(froms.as_py() or (), tos.as_py() or (), strict=True):
                    if a > end:
                        parts.append(raw[at:a])
                        runs += 1
                        cut += b - a
                        at = end = b
                    elif b > end:
                        cut += b - end
                        at = end = b
                parts.append(raw[at:])
                kept.append(b"".join(parts))
                removed.append(cut)
                spans.append(runs)
                sizes.append(len(raw))
            extra = [pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string())] if decoded else []
            yield pa.RecordBatch.from_arrays([*batch.columns[3:], pa.array(kept, pa.binary()), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), *extra], [*batch.schema.names[3:], *names])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields) + ", kept binary, n_bytes long, n_removed long, n_spans long" + ", kept_text string" * decoded
    out = joined.mapInArrow(work, schema)
    return out.select(F.col("doc").alias(id_col), *[F.col(f"c{i}").alias(c) for i, c in enumerate(carried)], *names)


def oracle(window: int = WINDOW) -> str:
    """The query's rows in SQL, for small tables: every window as a string of hexadecimal digits, counted."""
    return f"""
        WITH d AS (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
        p AS (SELECT rid, i, md5(substring(h, 2 * i + 1, {2 * window})) AS k FROM (SELECT rid, h, unnest(range(0, CAST(len(h) // 2 AS BIGINT) - {window - 1})) AS i FROM d WHERE len(h) >= {2 * window}) x),
        q AS (SELECT rid, i FROM p WHERE k IN (SELECT k FROM p GROUP BY k HAVING count(*) > 1)),
        f AS (SELECT rid, i, CASE WHEN i <= lag(i) OVER (PARTITION BY rid ORDER BY i) + {window} THEN 0 ELSE 1 END AS fresh FROM q),
        g AS (SELECT rid, i, sum(fresh) OVER (PARTITION BY rid ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM f),
        s AS (SELECT rid, min(i) AS a, max(i) + {window} AS b FROM g GROUP BY rid, run),
        cut AS (SELECT rid, a, b, coalesce(lag(b) OVER (PARTITION BY rid ORDER BY a), 0) AS before, row_number() OVER (PARTITION BY rid ORDER BY a DESC) = 1 AS final FROM s),
        k AS (SELECT rid, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans,
              string_agg(substring(h, 2 * before + 1, 2 * (a - before)) || CASE WHEN final THEN substring(h, 2 * b + 1) ELSE '' END, '' ORDER BY a) AS kept FROM cut JOIN d USING (rid) GROUP BY rid)
        SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM d LEFT JOIN k USING (rid)"""
