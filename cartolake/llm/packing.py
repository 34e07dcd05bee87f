"""Packing of token sequences into as few sequences of a fixed length as local search finds.

Documents are encoded, closed with an end id and cut into pieces only where they are longer than a sequence. Pieces are
dealt to shards of bounded size by hash, so no task gets more than a share and a hot document or source is spread. In a
shard, bins are first filled best-fit, long pieces first; then a local search over the underfull bins moves single pieces,
exchanges one for one and two for one, accepting only exchanges that raise the sum of squared fills, and drops bins as they
run empty. Each accepted step raises an integer that is bounded, so the search ends; it stops early at the lower bound.

Defined cases: null and empty texts are the end id alone; every row is packed, repeated ids included; a full piece is a
sequence of its own; ties in length go by the order of id, piece and digest, so a shard's result does not depend on the
order its rows arrive in; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartolake.llm.bpe import WORD_BPE, coder
from cartolake.llm.common import bounded_batches, saved, texts

CAPACITY = 4096
END_ID = 1
SHARD_PIECES = 20_000


def pieces(docs: DataFrame, path: str = WORD_BPE, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, and with `with_ids` the ids themselves (binary)."""
    bounded_batches(docs.sparkSession)
    names = ["id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, end = coder(path), end_id.to_bytes(4, "little")
        for batch in batches:
            row, piece, start, length, crc, ids = [], [], [], [], [], []
            for r, code in enumerate(bpe.encode_all(texts(batch.column(1)))):
                code += end
                for k, at in enumerate(range(0, len(code), 4 * capacity)):
                    part = code[at : at + 4 * capacity]
                    row.append(r)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(part)
            columns = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(ids, pa.binary())] * with_ids, names)

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    return rows.mapInArrow(work, f"id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers; items in falling size, each into the fullest bin that takes it."""
    bins: list[list[int]] = []
    by_room: dict[int, list[int]] = {}
    rooms = 0  # bit r: some bin has room r
    for item in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        size = sizes[item]
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            stack = by_room[room]
            b = stack.pop()
            if not stack:
                rooms ^= 1 << room
            bins[b].append(item)
        else:
            room, b = capacity, len(bins)
            bins.append([item])
        left = room - size
        if left:
            by_room.setdefault(left, []).append(b)
            rooms |= 1 << left
    return bins


class Offers:
    """What open bins can give: for each amount (a piece, or two pieces of a bin together), the emptiest bins that hold it."""

    def __init__(self, bins: list[list[int]], sizes: list[int], capacity: int):
        self.bins, self.sizes, self.capacity = bins, sizes, capacity
        self.fill = [0] * len(bins)
        self.stamp = [0] * len(bins)
        self.amounts: list[set[int]] = [set() for _ in bins]
        #: Fill of the emptiest bin with an amount, less that amount.
        self.rest = np.full(capacity + 1, capacity + 1, np.int64)
        self.refill()

    def refill(self) -> None:
        self.heaps: list[list[tuple[int, int, int]]] = [[] for _ in range(self.capacity + 1)]
        self.pushed = 0
        for b in range(len(self.bins)):
            self.put(b)
        self.bound = 2 * self.pushed + 200_000
        self.freshen(range(self.capacity + 1))

    def put(self, b: int) -> None:
        count: dict[int, int] = {}
        for i in self.bins[b]:
            count[self.sizes[i]] = count.get(self.sizes[i], 0) + 1
        self.fill[b] = sum(z * n for z, n in count.items())
        kinds = sorted(count)
        found = set(kinds) | {2 * z for z, n in count.items() if n > 1}
        found.update(y + z for k, y in enumerate(kinds) for z in kinds[k + 1 :])
        self.amounts[b] = found
        self.stamp[b] += 1
        entry = (self.fill[b], b, self.stamp[b])
        for x in found:
            heapq.heappush(self.heaps[x], entry)
        self.pushed += len(found)

    def top(self, x: int) -> tuple[int, int, int] | None:
        heap = self.heaps[x]
        while heap and heap[0][2] != self.stamp[heap[0][1]]:
            heapq.heappop(heap)
        return heap[0] if heap else None

    def freshen(self, amounts: Iterable[int]) -> None:
        for x in amounts:
            first = self.top(x)
            self.rest[x] = first[0] - x if first else self.capacity + 1

    def changed(self, *which: int) -> None:
        stale = set().union(*(self.amounts[b] for b in which))
        for b in which:
            self.put(b)
        self.freshen(stale.union(*(self.amounts[b] for b in which)))
        if self.pushed > self.bound:
            self.refill()

    def giver(self, x: int, t: int) -> int | None:
        """The emptiest bin but t that can give x."""
        first = self.top(x)
        if first is None or first[1] != t:
            return first and first[1]
        heapq.heappop(self.heaps[x])
        second = self.top(x)
        heapq.heappush(self.heaps[x], first)
        return second and second[1]

    def taken_from(self, s: int, x: int) -> list[int]:
        """One or two pieces of bin s of size x together."""
        seen: dict[int, int] = {}
        for i in self.bins[s]:
            if self.sizes[i] == x:
                return [i]
        for i in self.bins[s]:
            if (j := seen.get(x - self.sizes[i])) is not None:
                return [j, i]
            seen[self.sizes[i]] = i
        raise ValueError("no such amount")

    def best_for(self, t: int) -> tuple[int, int, int] | None:
        """(gain, giver, size of the piece it gets in turn or 0): the exchange that fills bin t most.

        Bin s giving x for z raises the sum of squared fills if x > z and what else lies in s is less than what else lies in
        t. Of the bins with x, the emptiest one has the least besides; so one look-up for each amount covers all of them.
        """
        room, best = self.capacity - self.fill[t], None
        for z in {0} | {self.sizes[j] for j in self.bins[t]}:
            least = best[0] if best else 0
            window = self.rest[z + least + 1 : z + room + 1]
            for at in np.nonzero(window < self.fill[t] - z)[0][::-1].tolist():
                x = z + least + 1 + at
                s = self.giver(x, t)
                if s is not None and self.fill[s] - x < self.fill[t] - z:
                    best = (x - z, s, z)
                    break
            if best and best[0] == room:
                break
        return best


def improve(bins: list[list[int]], sizes: list[int], capacity: int) -> list[list[int]]:
    """Local search over the underfull bins until no exchange raises the sum of squared fills, or the lower bound is met.

    Every underfull bin is tried as receiver, fullest first, and every other one as giver, with all their pieces; the search
    ends after a round over all receivers in which none had an exchange.
    """
    least = -(-sum(sizes) // capacity)
    full = [b for b in bins if sum(sizes[i] for i in b) == capacity]
    open_ = [b for b in bins if sum(sizes[i] for i in b) < capacity]
    used = len(full) + sum(map(bool, open_))
    if used <= least:
        return full + [b for b in open_ if b]
    offers = Offers(open_, sizes, capacity)  # works on the same list
    moved = True
    while moved:
        moved = False
        for t in sorted(range(len(open_)), key=lambda t: -offers.fill[t]):
            while open_[t] and offers.fill[t] < capacity and (found := offers.best_for(t)):
                gain, s, z = found
                give = offers.taken_from(s, gain + z)
                take = [next(j for j in open_[t] if sizes[j] == z)] if z else []
                open_[s] = [i for i in open_[s] if i not in give] + take
                open_[t] = [j for j in open_[t] if j not in take] + give
                offers.changed(s, t)
                moved = True
                used -= not open_[s]
                if used <= least:
                    return full + [b for b in open_ if b]
    return full + [b for b in open_ if b]


def pack(cut: DataFrame, capacity: int = CAPACITY, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Adds sequence_id and offset to pieces, which it writes to the shared folder first, so encoding happens once."""
    cut = saved(cut, "pieces")
    shards = max(1, -(-cut.count() // shard_pieces))
    kind = cut.schema["id"].dataType.simpleString()
    carried = [c for c in cut.columns if c not in ("id",)]

    def work(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["id", "piece", "ids_crc32"], kind="stable", na_position="first").reset_index(drop=True)
        sizes = rows["length"].tolist()
        bins = improve(best_fit(sizes, capacity), sizes, capacity)
        sequence, offset = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        for b, items in enumerate(bins):
            at = 0
            for i in items:
                sequence[i], offset[i] = (int(key[0]) << 40) + b, at
                at += sizes[i]
        return rows.drop(columns="shard").assign(sequence_id=sequence, offset=offset)

    schema = f"id {kind}, " + ", ".join(f"{c} {cut.schema[c].dataType.simpleString()}" for c in carried) + ", sequence_id long, offset long"
    dealt = cut.withColumn("shard", F.pmod(F.xxhash64("id", "piece", "ids_crc32"), F.lit(shards)).cast("int"))
    return dealt.groupBy("shard").applyInPandas(work, schema)


def packed(docs: DataFrame, path: str = WORD_BPE, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece of every document: id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(pieces(docs, path, capacity, end_id, id_col, text_col, with_ids), capacity).withColumnRenamed("id", id_col)
