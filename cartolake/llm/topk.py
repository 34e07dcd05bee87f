"""Exact top-k by inner product, by branch and bound over dimensions stored column by column.

Queries and candidates are cut into blocks, and every pair of blocks is one small group. In a group candidates are laid out
dimension by dimension, those of large norm first, and are gone through in stripes. Partial scores are accumulated over a
few dimensions at a time, dimensions in which the queries have much mass first. After each step a pair of query and candidate
can gain at most the product of its remaining norms (Cauchy-Schwarz); pairs that cannot reach the query's present k-th score
are dropped. While many pairs are left, a step is a product of whole matrices; once they are few, they are compacted into
a list and followed one by one. A query's k-th score starts from a bounded sample of candidates (`seeds`), so bounds hold from the first
stripe on. The k best of each pair of blocks are then merged by query.

Components are whole numbers, floor(scale * x) of x as double, and scores are exact: in double precision where sums stay
below 2^53, else in whole numbers of any size, without bounds.

Defined cases: vectors that are null or hold a null or non-finite component take no part, as query or candidate; empty
vectors do, and missing trailing components count as zero; a null vec_id takes no part; rows that repeat a vec_id are rows of
their own: each is asked and a candidate for the others, also where the vectors are equal; ties go to the smaller vec_id; a
score beyond 2^63 - 1 on either side counts as that.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALE = 64
K = 20
QUERY_BLOCK = 4096
CANDIDATE_BLOCK = 16384
#: Queries and candidates of one matrix product.
TILE, STRIPE = 512, 2048
DIMENSIONS = 8
#: Share of pairs at which matrix products give way to a list.
FEW = 0.2
#: Candidates from which the k-th scores start.
SEEDS = 2048
HIGHEST = (1 << 63) - 1


def usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(False))


def floors(rows: list, scale: int, width: int) -> np.ndarray:
    """Matrix of whole numbers floor(scale * x): as doubles, which hold them exactly, or as integers where scale * x has no double."""
    out = np.zeros((len(rows), width))
    for i, v in enumerate(rows):
        out[i, : len(v)] = v
    with np.errstate(over="ignore"):
        wide = np.floor(out * scale)
    if np.isfinite(wide).all():
        return wide
    exact = np.array([int(np.floor(x * scale)) if abs(x) < 1 << 52 else int(x) * scale for x in out.ravel().tolist()], object)
    return exact.reshape(out.shape)


@dataclass
class Work:
    """Pairs times dimensions: all there are, and those that were multiplied."""

    all: int = 0
    done: int = 0


def left_norms(m: np.ndarray, cuts: list[int]) -> np.ndarray:
    """Norm of what is left of each row from each cut on, a column for each cut."""
    return np.stack([np.sqrt((m[:, c:] ** 2).sum(axis=1)) for c in cuts], axis=1)


def is_small(queries: np.ndarray, candidates: np.ndarray) -> bool:
    """Whether all sums are exact in double precision."""
    if queries.dtype == object or candidates.dtype == object:
        return False
    most = float(np.abs(queries).max(initial=1)) * float(np.abs(candidates).max(initial=1)) * max(1, queries.shape[1])
    return most < 1 << 53


class Best:
    """The k best (score, id) found so far for each query, and the score a further one must reach."""

    def __init__(self, n: int, k: int, floor: np.ndarray):
        self.k, self.floor = k, floor.copy()
        self.ids = [np.zeros(0, np.int64)] * n
        self.scores: list[np.ndarray] = [np.zeros(0)] * n

    def add(self, query: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Takes pairs, in any order."""
        if not len(query):
            return
        order = np.argsort(query, kind="stable")
        query, ids, scores = query[order], ids[order], scores[order]
        cuts = np.nonzero(np.diff(query, prepend=-1))[0].tolist()
        for a, b in zip(cuts, [*cuts[1:], len(query)], strict=True):
            q = int(query[a])
            s, i = np.concatenate([self.scores[q], scores[a:b]]), np.concatenate([self.ids[q], ids[a:b]])
            if len(s) > 4 * self.k:
                top = np.partition(s, len(s) - self.k)[len(s) - self.k]
                s, i = s[s >= top], i[s >= top]
            first = np.lexsort((i, -s))[: self.k]
            self.scores[q], self.ids[q] = s[first], i[first]
            if len(first) == self.k:
                self.floor[q] = max(self.floor[q], s[first[-1]])


def seed_floors(queries: np.ndarray, query_ids: np.ndarray, seeds: np.ndarray, seed_ids: np.ndarray, k: int) -> np.ndarray:
    """Each query's k-th score among the seeds; those with its own id are left out, so repeats of it cannot raise it."""
    floor = np.full(len(queries), -np.inf)
    if len(seeds) > k and is_small(queries, seeds):
        for a in range(0, len(queries), TILE):
            score = queries[a : a + TILE] @ seeds.T
            score[query_ids[a : a + TILE, None] == seed_ids[None, :]] = -np.inf
            floor[a : a + TILE] = np.partition(score, len(seeds) - k, axis=1)[:, len(seeds) - k]
    return floor


def best(queries: np.ndarray, query_ids: np.ndarray, candidates: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int = K, floor: np.ndarray | None = None, step: int = DIMENSIONS, work: Work | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query row, ids, scores) of the k best of each query, ties to the smaller id; own: the candidate that is the query itself, or -1."""
    if not is_small(queries, candidates):
        yield from best_whole(queries, candidates, ids, own, k)
        return
    width = queries.shape[1]
    order = np.argsort(-(queries**2).sum(axis=0), kind="stable")
    q, c = queries[:, order], candidates[:, order]
    cuts = [*range(step, width, step), width] if width else [0]
    by_norm = np.argsort(-(c**2).sum(axis=1), kind="stable")
    place = np.empty(len(c), np.int64)
    place[by_norm] = np.arange(len(c))
    c, ids = c[by_norm], ids[by_norm]
    own = np.where(own >= 0, place[own], -1)
    q_left, c_left = left_norms(q, cuts), left_norms(c, cuts)
    columns = np.ascontiguousarray(c.T)
    found = Best(len(q), k, np.full(len(q), -np.inf) if floor is None else floor)
    for a in range(0, len(c), STRIPE):
        b = min(len(c), a + STRIPE)
        for x in range(0, len(q), TILE):
            y = min(len(q), x + TILE)
            limit = found.floor[x:y, None]
            score = np.zeros((y - x, b - a))
            rows = cols = sums = None  # the list of pairs, once they are few
            at = 0
            for n, to in enumerate(cuts):
                if rows is None:
                    score += q[x:y, at:to] @ columns[at:to, a:b]
                    done = score.size
                    if to < width:
                        on = score + q_left[x:y, n, None] * c_left[None, a:b, n] * (1 + 1e-9) + 1e-6 >= limit
                        if np.count_nonzero(on) < FEW * score.size:
                            rows, cols = np.nonzero(on)
                            sums = score[rows, cols]
                else:
                    sums = sums + np.einsum("ij,ij->i", q[x + rows, at:to], c[a + cols, at:to])
                    done = len(rows)
                    if to < width:
                        on = sums + q_left[x + rows, n] * c_left[a + cols, n] * (1 + 1e-9) + 1e-6 >= limit[rows, 0]
                        rows, cols, sums = rows[on], cols[on], sums[on]
                if work is not None:
                    work.done += done * (to - at)
                at = to
            if work is not None:
                work.all += score.size * width
            if rows is None:
                rows, cols = np.nonzero(score >= limit)
                sums = score[rows, cols]
            on = (sums >= limit[rows, 0]) & (own[x + rows] != a + cols)
            found.add(x + rows[on], ids[a + cols[on]], sums[on])
    for r in range(len(q)):
        yield r, found.ids[r], found.scores[r]


def best_whole(queries: np.ndarray, candidates: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The same for numbers of any size."""
    whole = lambda m: [[int(x) for x in row] for row in m.tolist()]
    have = whole(candidates)
    for r, row in enumerate(whole(queries)):
        scored = ((-max(-HIGHEST, min(HIGHEST, sum(x * y for x, y in zip(row, other, strict=True)))), int(i)) for n, (other, i) in enumerate(zip(have, ids, strict=True)) if n != own[r])
        first = heapq.nsmallest(k, scored)
        yield r, np.array([i for _, i in first], np.int64), np.array([-s for s, _ in first], object)


def search(vectors: DataFrame, every: int = 20, k: int = K, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding", seeds: int = SEEDS) -> DataFrame:
    """query_id, rank, vec_id, score for every query (ids divisible by `every`) against all other rows.

    Rows that agree in id and vector are one row with a count on the way; as candidates they stand k + 1 times at most, since
    more cannot be among a query's k best besides itself, and the answer is given once for each.
    """
    rows = vectors.select(vectors[id_col].cast("long").alias("id"), vectors[vector_col].cast("array<double>").alias("v"))
    rows = rows.where(F.col("id").isNotNull() & usable(F.col("v")))
    rows = rows.groupBy("id", "v").agg(F.count("*").alias("n")).withColumn("key", F.xxhash64("id", "v"))
    asks = F.col("id") % every == 0
    total, asked, width = rows.agg(F.count("*"), F.count_if(asks), F.max(F.size("v"))).first()
    q_blocks, c_blocks = max(1, -(-(asked or 0) // QUERY_BLOCK)), max(1, -(-(total or 0) // CANDIDATE_BLOCK))
    width = width or 0
    start = rows.orderBy("key", "id").limit(seeds).select("id", "v").collect()
    start_ids, start_at = np.array([r["id"] for r in start], np.int64), floors([r["v"] for r in start], scale, width)
    queries = rows.where(asks).select(F.lit(True).alias("query"), "id", "v", "n", "key", F.pmod("key", F.lit(q_blocks)).cast("int").alias("q"), F.explode(F.sequence(F.lit(0), F.lit(c_blocks - 1))).alias("c"))
    candidates = rows.select(F.lit(False).alias("query"), "id", "v", "n", "key", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))).alias("q"), F.pmod(F.xxhash64("key"), F.lit(c_blocks)).cast("int").alias("c"))

    def work(block: pd.DataFrame) -> pd.DataFrame:
        ask, have = block[block["query"]].sort_values(["id", "key"]), block[~block["query"]].sort_values(["id", "key"])
        out = {"query_id": [], "key": [], "n": [], "vec_id": [], "score": []}
        if len(ask) and len(have):
            q, c = floors(ask["v"].tolist(), scale, width), floors(have["v"].tolist(), scale, width)
            ids, keys = ask["id"].to_numpy(), ask["key"].to_numpy()
            times = np.minimum(have["n"].to_numpy(), k + 1)
            first = dict(zip(zip(have["id"], have["key"], strict=True), (np.cumsum(times) - times).tolist(), strict=True))
            own = np.array([first.get(x, -1) for x in zip(ids.tolist(), keys.tolist(), strict=True)], np.int64)
            at = np.repeat(np.arange(len(have)), times)
            floor = seed_floors(q, ids, start_at, start_ids, k)
            for r, found, scores in best(q, ids, c[at], have["id"].to_numpy()[at], own, k, floor):
                out["query_id"] += [ids[r]] * len(found)
                out["key"] += [keys[r]] * len(found)
                out["n"] += [ask["n"].iat[r]] * len(found)
                out["vec_id"] += found.tolist()
                out["score"] += [int(x) for x in scores.tolist()]
        return pd.DataFrame(out, dtype=np.int64)

    part = queries.union(candidates).groupBy("q", "c").applyInPandas(work, "query_id long, key long, n long, vec_id long, score long")
    # At most k rows of each pair of blocks are left; a query's are merged in one small sorted array.
    merged = part.groupBy("query_id", "key").agg(F.first("n").alias("n"), F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("less"), "vec_id"))), 1, k).alias("best"))
    each = merged.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    return each.select("query_id", F.posexplode("best").alias("at", "hit")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "hit.vec_id", (-F.col("hit.less")).alias("score"))


def oracle(k: int = K, scale: int = SCALE, every: int = 20) -> str:
    """The same in SQL, by comparing every query with every row."""
    return f"""
        WITH v AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
                   WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.rid, q.vec_id AS query_id, c.vec_id, CAST(coalesce(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])), 0) AS BIGINT) AS score
              FROM v q JOIN v c ON q.rid <> c.rid WHERE q.vec_id % {every} = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS rank FROM s)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= {k}"""
