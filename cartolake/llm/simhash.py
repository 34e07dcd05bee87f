"""SimHash near-duplicates by an inverted index over byte positions with count filtering.

Two 64-bit fingerprints that differ in at most 3 bits differ in at most 3 of their 8 bytes, so they share at least 5
positional bytes. Posting lists of single bytes would hold a 256th of all fingerprints each; the index therefore posts each
distinct fingerprint under sets of 4 byte positions. Of the 70 sets 14 are enough: they are chosen so that any 5 positions
hold one of them. Pairs that meet in a list share 4 positional bytes; the bytes they share in all are tallied, pairs under
the guaranteed 5 are dropped, the rest are verified bit by bit. In a long list the tally goes by a second level of lists,
one for each value of each further position, in which every pair reaches 5; if such a list is still long, its 24 free bits
are probed with all patterns of at most 3 bits, which is linear in the list. A list gives a star of links, never all pairs.

Defined cases: null or empty texts have fingerprint zero and link like any other; shorter texts than a shingle are hashed
whole; equal fingerprints form one class before the index is built, so copies cost one posting; rows keep their number,
repeated ids included; a null id never names a class that has another id.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartolake.llm.common import bounded_batches, kept, released, saved, shuffle_partitions, texts, wide_batches
from cartolake.llm.components import components

SHINGLE = 3
SEED = 42
MOST_BITS = 3
SHARED_BYTES = 8 - MOST_BITS
#: Lists of at most so many fingerprints are tallied pair by pair.
PAIRWISE = 1500


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of the word shingles of a text, words being runs without ASCII white space, A-Z in lower case."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    start = np.cumsum(size + 1) - size - 1
    k = min(shingle, len(words))
    ends = (start + size)[k - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[a:b], SEED) for a, b in zip(start.tolist(), ends, strict=False)], "<u8")
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        part = h[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    bits = np.packbits((2 * ones > len(h)).astype(np.uint8), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """id, fp (the fingerprint as a signed long)."""
    bounded_batches(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        released()
        for batch in batches:
            fp = np.array([fingerprint(t, shingle) for t in texts(batch.column(1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp, pa.int64())], ["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(work, f"id {kind}, fp long")


def position_sets() -> list[tuple[int, ...]]:
    """14 sets of 4 byte positions, one of them within any 5 of the 8.

    The positions are two halves of 4. A half splits into two pairs in three ways. The sets are the halves, and all unions of
    a pair of one half with a pair of the other that belongs to the same way. Of 5 positions, 4 or more in one half hold that
    half; else one half has 3 of them, which hold a pair of each way, so one to go with the two of the other half.
    """
    ways = [[(0, 1), (2, 3)], [(0, 2), (1, 3)], [(0, 3), (1, 2)]]
    return [(0, 1, 2, 3), (4, 5, 6, 7)] + [(*x, y[0] + 4, y[1] + 4) for way in ways for x in way for y in way]


def masks() -> list[int]:
    """The byte masks of the position sets, as signed longs."""
    found = []
    for places in position_sets():
        m = sum(0xFF << 8 * p for p in places)
        found.append(m - (1 << 64) if m >> 63 else m)
    return found


def flips() -> list[int]:
    """All patterns of 1 to MOST_BITS set bits among 24."""
    return [sum(1 << i for i in c) for k in range(1, MOST_BITS + 1) for c in combinations(range(24), k)]


def agree(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Tally of shared positional bytes, count filter, then verification, for pairs of fingerprints."""
    x = a ^ b
    shared = (x.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
    ok = shared >= SHARED_BYTES
    ok[ok] = np.bitwise_count(x[ok]) <= MOST_BITS
    return ok


def settle(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Smallest reachable index of each of n members, for links given in blocks."""
    parent = np.arange(n)
    for i, j in pairs:
        while len(i):
            a, b = parent[i], parent[j]
            apart = a != b
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            if not len(i):
                break
            np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(parent, above := parent[parent]):
                parent = above
    return parent


def paired(members: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links of a short list, by the tally of all its pairs."""
    n = len(members)
    for a in range(0, n, 256):
        i, j = np.nonzero(np.arange(a, min(n, a + 256))[:, None] < np.arange(n)[None, :])
        i += a
        ok = agree(members[i], members[j])
        yield i[ok], j[ok]


def probed(members: np.ndarray, free: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links of a sorted list whose members differ in three byte positions at most, by looking up changed members."""
    for f in flips():
        x = np.uint64(sum((f >> 8 * k & 0xFF) << 8 * p for k, p in enumerate(free)))
        other = members ^ x
        at = np.minimum(np.searchsorted(members, other), len(members) - 1)
        i = np.nonzero((members[at] == other) & (members < other))[0]
        yield i, at[i]


def links_of(members: np.ndarray, mask: int) -> tuple[np.ndarray, np.ndarray]:
    """Star links within one posting list of distinct fingerprints (uint64)."""
    members = np.sort(members)  # Spark sorted them as signed numbers

    def blocks() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if len(members) <= PAIRWISE:
            yield from paired(members)
            return
        free = [p for p in range(8) if not mask >> 8 * p & 0xFF]
        for p in free:
            value = members >> np.uint64(8 * p) & np.uint64(0xFF)
            order = np.argsort(value, kind="stable")
            cuts = np.searchsorted(value[order], np.arange(257))
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                part = order[a:b]
                if len(part) > 1:
                    for i, j in paired(members[part]) if len(part) <= PAIRWISE else probed(members[part], [q for q in free if q != p]):
                        yield part[i], part[j]

    root = settle(len(members), blocks())
    moved = np.nonzero(root != np.arange(len(members)))[0]
    return members[moved], members[root[moved]]


def class_links(distinct: DataFrame) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) whose closure is the whole link relation."""
    spark = distinct.sparkSession
    all_masks = masks()
    posts = distinct.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in all_masks])).alias("list", "key"))
    # Lists of different positions may meet in one partition; list is part of the sort, so they stay apart.
    posts = posts.repartition(shuffle_partitions(spark), "key", "list").sortWithinPartitions("list", "key", "fp").select("list", "key", "fp")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        released()
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def out(lists: np.ndarray, keys: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
            """Links of whole posting lists."""
            if not len(fps):
                return
            fresh = np.concatenate([[True], (keys[1:] != keys[:-1]) | (lists[1:] != lists[:-1])])
            start = np.nonzero(fresh)[0]
            size = np.diff(np.append(start, len(fps)))
            two = start[size == 2]
            ok = agree(fps[two], fps[two + 1]) if len(two) else np.zeros(0, bool)
            a, b = [fps[two[ok]]], [fps[two[ok] + 1]]
            for s, n in zip(start[size > 2].tolist(), size[size > 2].tolist(), strict=True):
                x, y = links_of(fps[s : s + n], all_masks[int(lists[s])])
                a.append(x)
                b.append(y)
            a, b = np.concatenate(a).view(np.int64), np.concatenate(b).view(np.int64)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        def joined() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            return tuple(np.concatenate(x) for x in zip(*held, strict=True))

        for batch in batches:
            lists, keys = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            fps = batch.column(2).to_numpy().view(np.uint64)
            if not len(fps):
                continue
            last = np.nonzero((keys != keys[-1]) | (lists != lists[-1]))[0]
            cut = last[-1] + 1 if len(last) else 0
            if cut:  # the list that runs over the batch's end waits for the rest
                held.append((lists[:cut], keys[:cut], fps[:cut]))
                yield from out(*joined())
                held = []
            elif held and (held[-1][1][-1] != keys[0] or held[-1][0][-1] != lists[0]):
                yield from out(*joined())
                held = []
            held.append((lists[cut:], keys[cut:], fps[cut:]))
        if held:
            yield from out(*joined())

    return posts.mapInArrow(work, "a long, b long")


def rooted(prints: DataFrame) -> DataFrame:
    """fp, least (the smallest id), root (the smallest fingerprint reachable over links) of every distinct fingerprint."""
    classes = kept(prints.groupBy("fp").agg(F.min("id").alias("least")))
    with wide_batches(prints.sparkSession):
        roots = components(class_links(classes.select("fp")))
    return classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """One row per document: id, fp, component (the smallest id reachable over links)."""
    prints = saved(fingerprints(docs, id_col, text_col, shingle), "simhash")
    classes = rooted(prints)
    named = classes.groupBy("root").agg(F.min("least").alias("component"))
    of_class = classes.join(named, "root").select("fp", "component")
    return prints.join(of_class, "fp").select(F.col("id").alias(id_col), "fp", "component")


def first_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """One row per component: its smallest id, which may be a struct. Components are told apart by fingerprint, so ids may repeat."""
    prints = saved(fingerprints(docs, id_col, text_col, shingle), "simhash")
    return rooted(prints).groupBy("root").agg(F.min("least").alias(id_col)).select(id_col)
