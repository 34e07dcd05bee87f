"""The trie of all conversation prefixes, from the longest common prefixes of neighbours in sorted order.

A conversation is the sequence of its turns' digests. All are sorted by it, in blocks (ranges of the order); L(i) is the number
of turns that conversation i shares with the one before it. Every node of the trie is an interval of the order: those i
whose neighbours share at least its depth. For each i the nearest smaller values to the left and right of L(i) bound the
interval of the node at depth L(i); these are the nodes of the Cartesian tree over L. They are found in parallel: a stack inside
each block, then the block minima tell which block holds an answer outside, and there the records of its minima are searched.
Nodes of equal depth and left end are one (merged), and where a node is deeper than its parent by more than one turn, the
depths between are put in (expanded): node and depth are one for each i and depth in L(i)+1 to the length of i.

Aggregates over an interval are differences of running sums: leaves are the conversations that the next one does not extend,
and the words saved below a node of depth d over l..r are the shared words of l+1..r, less those before depth d. The smallest id
is a range minimum, inside a block and over block minima. Digests of who ends at a node are taken from sorted ids, streamed.

One number or two for each block reach the driver, and blocks have a bounded number of rows; a conversation's digests (32
characters a turn) and running word counts lie in one row, which is this form's bound: conversations of millions of turns.
Equal sequences are told by a 128-bit digest of each turn.

Defined cases: rows without conversation id take no part; null turns come first, null roles and texts are empty, turns with the same
number are ordered by digest; rows that repeat are turns of their own; an empty table gives no node, not even a root;
further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cartolake.llm.common import bounded_batches, cores, saved, shuffle_partitions

#: Characters of a turn's digest in the sort key.
DIGEST = 32
#: Conversations of a block, about.
BLOCK_ROWS = 20_000
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def sequences(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: id, turns (array of digest and words, in order)."""
    role, text = F.coalesce(turns[role_col], F.lit("")), F.coalesce(turns[text_col], F.lit(""))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    words = F.size(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("long")
    each = turns.select(turns[id_col].alias("id"), F.struct(turns[turn_col].isNotNull().alias("numbered"), turns[turn_col].alias("turn"), digest.alias("digest"), words.alias("words")).alias("t")).where("id is not null")
    ordered = F.transform(F.array_sort(F.collect_list("t")), lambda t: F.struct(t["digest"].alias("digest"), t["words"].alias("words")))
    return each.groupBy("id").agg(ordered.alias("turns"))


def with_shared_starts(convs: DataFrame, group: int = 20, most: int = 3) -> DataFrame:
    """Each conversation c with its first h turns replaced by those of conversation c - c % group; h is the checksum of c modulo most + 1."""
    h = (F.crc32(F.col("id").cast("string")) % (most + 1)).cast("int")
    donors = convs.where(F.col("id") % group == 0).select(F.col("id").alias("donor"), F.slice("turns", 1, most).alias("start"))
    own = convs.withColumn("donor", F.col("id") - F.col("id") % group).join(donors, "donor", "left")
    start = F.coalesce(F.slice("start", F.lit(1), h), F.slice("turns", 1, 0))
    return own.select("id", F.concat(start, F.slice("turns", h + 1, F.size("turns"))).alias("turns"))


def _common(a: str, b: str) -> int:
    """Whole digests that two keys share from the start."""
    n = min(len(a), len(b))
    x, y = np.frombuffer(a.encode(), np.uint8)[:n], np.frombuffer(b.encode(), np.uint8)[:n]
    other = np.flatnonzero(x != y)
    return (int(other[0]) if len(other) else n) // DIGEST


def sorted_blocks(convs: DataFrame, blocks: int) -> DataFrame:
    """block, idx (place in it), id, len, lcp (turns shared with the row before; null for a block's first), shared (their words),
    cum (words of the first 1, 2, ... turns), edge (the key of a block's first row, and in a further row with idx -1 that of its last)."""
    kind = convs.schema["id"].dataType.simpleString()
    keyed = convs.select("id", F.array_join("turns.digest", "").alias("key"), F.col("turns.words").alias("words"))
    dealt = keyed.repartitionByRange(blocks, "key", "id").sortWithinPartitions("key", "id")
    names = ["block", "idx", "id", "len", "lcp", "shared", "cum", "edge"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, at, before = TaskContext.get().partitionId(), 0, None
        for batch in batches:
            lens, lcps, shared, cums, edges = [], [], [], [], []
            for key, words in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                cum = np.cumsum(np.array(words, np.int64))
                n = None if before is None else _common(before, key)
                lens.append(len(cum))
                lcps.append(n)
                shared.append(int(cum[n - 1]) if n else 0)
                cums.append(cum)
                edges.append(key if before is None else None)
                before = key
            rows = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [pa.array([block] * rows, pa.int32()), pa.array(range(at, at + rows), pa.int64()), batch.column(0), pa.array(lens, pa.int32()), pa.array(lcps, pa.int32()), pa.array(shared, pa.int64()), pa.array(cums, pa.list_(pa.int64())), pa.array(edges, pa.string())], names
            )
            at += rows
        if at:
            yield pa.RecordBatch.from_arrays(
                [pa.array([block], pa.int32()), pa.array([-1], pa.int64()), pa.nulls(1, batch.schema.field(0).type), pa.array([0], pa.int32()), pa.nulls(1, pa.int32()), pa.array([0], pa.int64()), pa.array([[]], pa.list_(pa.int64())), pa.array([before])], names
            )

    return dealt.mapInArrow(work, f"block int, idx long, id {kind}, len int, lcp int, shared long, cum array<long>, edge string")


def positions(stored: DataFrame) -> DataFrame:
    """The rows with their places in the whole order: block (0, 1, ... without gaps), g, id, len, lcp (-1 for the very first), next (the following row's lcp, -1 for the last), shared, cum."""
    spark = stored.sparkSession
    sizes = stored.where("idx >= 0").groupBy("block").agg(F.count("*").alias("n")).orderBy("block").collect()
    number = {r["block"]: k for k, r in enumerate(sizes)}
    starts = np.cumsum([0, *(r["n"] for r in sizes)]).tolist()
    of = spark.createDataFrame([(r["block"], number[r["block"]], starts[number[r["block"]]]) for r in sizes], "block int, rank int, offset long")
    # The first row of each block meets the last of the block before it.
    edges = stored.where("edge is not null").join(F.broadcast(of), "block")
    first = edges.where("idx = 0").select("rank", F.col("edge").alias("a"), "cum")
    last = edges.where("idx = -1").select((F.col("rank") + 1).alias("rank"), F.col("edge").alias("b"))
    digests = F.least(F.length("a"), F.length("b")) / DIGEST
    same = F.when(digests > 0, F.transform(F.sequence(F.lit(1), digests.cast("int")), lambda k: F.substring("a", (k - 1) * DIGEST + 1, F.lit(DIGEST)) == F.substring("b", (k - 1) * DIGEST + 1, F.lit(DIGEST)))).otherwise(F.array().cast("array<boolean>"))
    other = F.array_position(same, F.lit(False)).cast("int")
    met = first.join(last, "rank").select("rank", F.when(other > 0, other - 1).otherwise(F.size(same)).alias("lcp"), "cum").withColumn("shared", F.when(F.col("lcp") > 0, F.element_at("cum", F.greatest("lcp", F.lit(1)))).otherwise(0)).select("rank", "lcp", "shared").collect()
    found = {r["rank"]: (r["lcp"], r["shared"]) for r in met} | {0: (-1, 0)}
    rows = [(r["block"], k, starts[k], *found[k], found[k + 1][0] if k + 1 < len(sizes) else -1) for k, r in enumerate(sizes)]
    table = spark.createDataFrame(rows, "block int, rank int, offset long, first_lcp int, first_shared long, next_lcp int")
    each = stored.where("idx >= 0").join(F.broadcast(table), "block")
    opening = F.col("idx") == 0
    each = each.select(
        F.col("rank").alias("block"), (F.col("offset") + F.col("idx")).alias("g"), "id", "len", F.when(opening, F.col("first_lcp")).otherwise(F.col("lcp")).alias("lcp"), F.when(opening, F.col("first_shared")).otherwise(F.col("shared")).alias("shared"), "cum", "next_lcp"
    )
    following = F.lead("lcp").over(Window.partitionBy("block").orderBy("g"))
    return each.withColumn("next", F.coalesce(following, F.col("next_lcp"))).drop("next_lcp")


def smaller(values: list[int]) -> tuple[list[int], list[int]]:
    """For each place the nearest one to the left and to the right with a smaller value; -1 and -2 where there is none."""
    left, right, stack = [-1] * len(values), [-2] * len(values), []
    for i, v in enumerate(values):
        while stack and values[stack[-1]] > v:
            right[stack.pop()] = i
        # Equal values share what lies to their left; those to the right are set when something smaller comes.
        if stack:
            left[i] = left[stack[-1]] if values[stack[-1]] == v else stack[-1]
        stack.append(i)
    return left, right


class Least:
    """Range minima by a table over powers of two."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        while 2 ** len(self.levels) <= len(values):
            half = 2 ** (len(self.levels) - 1)
            self.levels.append(np.minimum(self.levels[-1][:-half], self.levels[-1][half:]))

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Minima over places a to b, both included and a <= b."""
        out = np.empty(len(a), self.levels[0].dtype)
        level = np.floor(np.log2(b - a + 1)).astype(np.int64)
        for k in np.unique(level):
            at = level == k
            out[at] = np.minimum(self.levels[k][a[at]], self.levels[k][b[at] - 2**k + 1])
        return out


def _toward(minima: np.ndarray, block: int, values: np.ndarray, step: int) -> np.ndarray:
    """For each value the nearest block before (step -1) or after (step 1) `block` whose minimum is smaller; -1 where none is."""
    rest = minima[:block][::-1] if step < 0 else minima[block + 1 :]
    falling = np.minimum.accumulate(rest) if len(rest) else rest
    at = np.searchsorted(-falling, -values, side="right")
    return np.where(at < len(falling), block + step * (at + 1), -1)


LOCAL = "block int, g long, id long, len int, lcp int, next int, cum array<long>, l long, r long, least long, gain long, leaves long, tl int, tr int, cs long, cl long, leaf int, head long, tail long, opens boolean, closes boolean"


def within_blocks(rows: DataFrame, minima: np.ndarray, shared: np.ndarray, leaves: np.ndarray) -> DataFrame:
    """Solves each block by itself.

    l, r: the interval of the node at depth lcp, null where it leaves the block on that side; then tl, tr name the block that holds the answer
    (tr null: none, the interval ends with the order). least, gain, leaves: smallest id, shared words of l+1..r and leaves of l..r, where both ends
    are known. cs, cl: running sums over the whole order; head, tail: smallest id from the block's start, to its end;
    opens, closes: no smaller or equal lcp before, after it in the block.
    """
    shared_before, leaves_before = np.concatenate([[0], np.cumsum(shared)]), np.concatenate([[0], np.cumsum(leaves)])

    def solve(table: pa.Table) -> pa.Table:
        table = table.sort_by("g").combine_chunks()
        col = lambda c: table.column(c).to_numpy()
        block, g, ids, size, lcp, following = int(table.column("block")[0].as_py()), col("g"), col("id"), col("len"), col("lcp"), col("next")
        n, first = len(g), int(g[0])
        leaf = (following < size).astype(np.int64)
        cs, cl = shared_before[block] + np.cumsum(col("shared")), leaves_before[block] + np.cumsum(leaf)
        left, right = (np.array(x, np.int64) for x in smaller(lcp.tolist()))
        in_left, in_right = left >= 0, right >= 0
        both = in_left & in_right
        a, b = left[both], right[both] - 1
        least, gain, below = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        least[both], gain[both], below[both] = Least(ids)(a, b), cs[b] - cs[a], cl[b] - cl[a] + leaf[a]
        tl, tr = _toward(minima, block, lcp, -1), _toward(minima, block, lcp, 1)
        earlier = np.concatenate([[np.iinfo(np.int32).max], np.minimum.accumulate(lcp)[:-1]])
        later = np.concatenate([np.minimum.accumulate(lcp[::-1])[::-1][1:], [np.iinfo(np.int32).max]])
        made = {
            "l": pa.array(left + first, mask=~in_left), "r": pa.array(right - 1 + first, mask=~in_right), "least": pa.array(least, mask=~both), "gain": pa.array(gain, mask=~both), "leaves": pa.array(below, mask=~both),
            "tl": pa.array(tl.astype(np.int32), mask=in_left | (tl < 0)), "tr": pa.array(tr.astype(np.int32), mask=in_right | (tr < 0)), "cs": pa.array(cs), "cl": pa.array(cl), "leaf": pa.array(leaf.astype(np.int32)),
            "head": pa.array(np.minimum.accumulate(ids)), "tail": pa.array(np.minimum.accumulate(ids[::-1])[::-1]), "opens": pa.array(earlier > lcp), "closes": pa.array(later > lcp),
        }
        kept = ["block", "g", "id", "len", "lcp", "next", "cum"]
        return pa.table([*(table.column(c) for c in kept), *made.values()], names=[*kept, *made])

    return rows.select("block", "g", F.col("id").cast("long").alias("id"), "len", "lcp", "next", "shared", "cum").groupBy("block").applyInArrow(solve, LOCAL)


def across_blocks(local: DataFrame, block_least: np.ndarray) -> DataFrame:
    """block, lcp, tl, tr, kl, kr (what is known of l and r), l, r, least, gain, leaves of the intervals that leave their block.

    Rows of a block with the same depth and the same open sides share their interval, so a block gives a row or two for each depth in it.
    """
    open_ = local.where("lcp >= 0 and (l is null or r is null)").select("block", "lcp", "tl", "tr", F.col("l").alias("kl"), F.col("r").alias("kr")).distinct()

    def answers(target: str, records: str, known: str) -> DataFrame:
        asked = open_.where(F.col(target).isNotNull()).select(F.col(target).alias("block"), F.col("lcp").alias("value"), F.lit(None).cast("long").alias("g")).distinct()
        has = local.where(records).select("block", F.col("lcp").alias("value"), "g")
        below = Window.partitionBy("block").orderBy("value").rangeBetween(Window.unboundedPreceding, -1)
        return asked.unionByName(has).withColumn(known, (F.max if known == "fl" else F.min)("g").over(below)).where("g is null").select(F.col("block").alias(target), F.col("value").alias("lcp"), known)

    lefts, rights = answers("tl", "closes", "fl"), answers("tr", "opens", "fr")
    total = local.agg((F.max("g")).alias("last"))
    found = open_.join(lefts, ["tl", "lcp"], "left").join(rights, ["tr", "lcp"], "left").crossJoin(total)  # one row
    found = found.select("block", "lcp", "tl", "tr", "kl", "kr", F.coalesce("kl", "fl").alias("l"), F.coalesce("kr", F.col("fr") - 1, "last").alias("r"))
    ends = found.select("l", "r").distinct()
    at_l = local.select(F.col("g").alias("l"), F.col("block").alias("bl"), F.col("cs").alias("cs_l"), F.col("cl").alias("cl_l"), "leaf", "tail")
    at_r = local.select(F.col("g").alias("r"), F.col("block").alias("br"), F.col("cs").alias("cs_r"), F.col("cl").alias("cl_r"), "head")
    table = Least(block_least)

    @F.pandas_udf("long")
    def between(a: pd.Series, b: pd.Series) -> pd.Series:
        x, y = a.to_numpy(np.int64) + 1, b.to_numpy(np.int64) - 1
        out = np.full(len(x), np.iinfo(np.int64).max)
        some = x <= y
        if some.any():
            out[some] = table(x[some], y[some])
        return pd.Series(out)

    # Where both ends are in one block, the right one is the block's last row, since what ends the interval comes after the block.
    least = F.when(F.col("bl") == F.col("br"), F.col("tail")).otherwise(F.least("tail", "head", between("bl", "br")))
    solved = ends.join(at_l, "l").join(at_r, "r").select("l", "r", least.alias("least"), (F.col("cs_r") - F.col("cs_l")).alias("gain"), (F.col("cl_r") - F.col("cl_l") + F.col("leaf")).alias("leaves"))
    return found.join(solved, ["l", "r"])


def ends_of(solved: DataFrame) -> DataFrame:
    """l, ends_sha256: of the conversations that are the same sequence, the first of which is at l, the digest of their ids, rising and comma-joined."""
    start = F.when(F.col("lcp") == F.col("len"), F.col("l")).otherwise(F.col("g"))
    # Within a block ids are joined first, so that a frequent sequence is one row for each block; those are then hashed in order, one at a time.
    packed = solved.groupBy(start.alias("l"), "block").agg(F.array_join(F.transform(F.array_sort(F.collect_list("id")), lambda x: x.cast("string")), ",").alias("part"))
    dealt = packed.repartition(max(cores(solved.sparkSession), shuffle_partitions(solved.sparkSession)), "l").sortWithinPartitions("l", "block")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, None
        for batch in batches:
            starts, sums = [], []
            for l, part in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):  # noqa: E741
                if l == now:
                    digest.update(b",")
                else:
                    if digest is not None:
                        starts.append(now)
                        sums.append(digest.hexdigest())
                    now, digest = l, hashlib.sha256()
                digest.update(part.as_buffer())
            yield pa.RecordBatch.from_arrays([pa.array(starts, pa.int64()), pa.array(sums, pa.string())], ["l", "ends_sha256"])
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([digest.hexdigest()])], ["l", "ends_sha256"])

    return dealt.select("l", "part").mapInArrow(work, "l long, ends_sha256 string")


def trie(convs: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per node, for conversations as of sequences(): id (its smallest member), depth, parent_id, n_members, n_children, n_leaves, saved_words, ends_sha256."""
    spark: SparkSession = convs.sparkSession
    bounded_batches(spark)
    convs = saved(convs, "sequences")
    blocks = max(cores(spark), -(-convs.count() // block_rows))
    stored = saved(sorted_blocks(convs, blocks), "sorted")
    rows = positions(stored)
    leaf = F.when(F.col("next") < F.col("len"), 1).otherwise(0)
    facts = rows.groupBy("block").agg(F.min("lcp").alias("lcp"), F.sum("shared").alias("shared"), F.sum(leaf).alias("leaves"), F.min("id").alias("least")).orderBy("block").collect()
    per_block = {c: np.array([r[c] for r in facts], np.int64) for c in ("lcp", "shared", "leaves", "least")}
    local = saved(within_blocks(rows, per_block["lcp"], per_block["shared"], per_block["leaves"]), "blocks")
    outside = across_blocks(local, per_block["least"])

    columns = ["block", "g", "id", "len", "lcp", "next", "cum", "l", "r", "least", "gain", "leaves"]
    inside = local.where("lcp < 0 or (l is not null and r is not null)").select(*columns)
    open_ = local.where("lcp >= 0 and (l is null or r is null)").select("block", "g", "id", "len", "lcp", "next", "cum", "tl", "tr", F.col("l").alias("kl"), F.col("r").alias("kr"))
    keys = ("block", "lcp", "tl", "tr", "kl", "kr")
    a, b = open_.alias("a"), outside.alias("b")
    met = a.join(b, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]).select(*[F.col(f"{'b' if c in ('l', 'r', 'least', 'gain', 'leaves') else 'a'}.{c}") for c in columns])
    solved = saved(inside.unionByName(met), "intervals")

    merged = solved.where("lcp >= 0").groupBy("l", F.col("lcp").alias("v")).agg(*[F.first(c).alias(c) for c in ("r", "least", "gain", "leaves")], F.count_if(F.col("len") > F.col("lcp")).alias("children"))
    alone = solved.where("len > lcp and len > next").select(F.col("g").alias("l"), F.col("len").alias("v"), F.col("g").alias("r"), F.col("id").alias("least"), F.lit(0).cast("long").alias("gain"), F.lit(1).cast("long").alias("leaves"), F.lit(0).cast("long").alias("children"))
    of_l = solved.select(F.col("g").alias("l"), "len", F.col("lcp").alias("above"), F.col("least").alias("above_least"), "cum").join(ends_of(solved), "l", "left")
    nodes = merged.unionByName(alone).join(of_l, "l")
    deeper = Window.partitionBy("l").orderBy("v")
    nodes = nodes.withColumns({"p": F.coalesce(F.lag("v").over(deeper), F.col("above")), "parent": F.coalesce(F.lag("least").over(deeper), F.col("above_least"))})
    each = nodes.withColumn("depth", F.explode(F.sequence(F.col("p") + 1, F.col("v"))))
    bottom = F.col("depth") == F.col("v")
    before = F.when(F.col("depth") >= 2, F.element_at("cum", F.greatest(F.col("depth") - 1, F.lit(1)))).otherwise(0)
    return each.select(
        F.col("least").alias("id"),
        F.col("depth").cast("long").alias("depth"),
        F.when(F.col("depth") > F.col("p") + 1, F.col("least")).otherwise(F.col("parent")).alias("parent_id"),
        (F.col("r") - F.col("l") + 1).alias("n_members"),
        F.when(bottom, F.col("children") + (F.col("len") > F.col("v")).cast("long")).otherwise(1).alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        (F.col("gain") - (F.col("r") - F.col("l")) * before).alias("saved_words"),
        F.when(bottom & (F.col("len") == F.col("v")), F.col("ends_sha256")).otherwise(EMPTY_SHA).alias("ends_sha256"),
    )


def oracle() -> str:
    """The query's rows in SQL, from the definition: all prefixes of all conversations, grouped."""
    bits = "list_reduce(list_prepend(xor(a, b), [0::UBIGINT for x in range(8)]), lambda x, y: xor(x >> 1, 3988292384::UBIGINT * (x & 1)))"
    return f"""
        WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos,
                   coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
        c AS (SELECT conv_id, conv_id - conv_id % 20 AS donor, (xor(list_reduce(list_prepend(4294967295::UBIGINT, [ascii(x)::UBIGINT for x in string_split(conv_id::VARCHAR, '')]), lambda a, b: {bits}), 4294967295::UBIGINT) % 4)::BIGINT AS h FROM (SELECT DISTINCT conv_id FROM t) x),
        r AS (SELECT c.conv_id, t.pos, role, text FROM c JOIN t ON t.conv_id = c.donor AND t.pos <= h UNION ALL SELECT c.conv_id, t.pos, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND t.pos > h),
        n AS (SELECT conv_id, row_number() OVER w AS depth, list(md5(length(role)::VARCHAR || ':' || role || text)) OVER (PARTITION BY conv_id ORDER BY pos ROWS UNBOUNDED PRECEDING)::VARCHAR AS node, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS words FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY pos)),
        m AS (SELECT conv_id, 0 AS depth, 'root' AS node, 0 AS words FROM c UNION ALL SELECT * FROM n),
        p AS MATERIALIZED (SELECT *, lag(node) OVER (PARTITION BY conv_id ORDER BY depth) AS above, lead(node) OVER (PARTITION BY conv_id ORDER BY depth) IS NULL AS ends FROM m),
        g AS MATERIALIZED (SELECT node, depth, min(above) AS above, min(words) AS words, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '') AS ids FROM p GROUP BY node, depth),
        k AS (SELECT above, count(*) AS n_children FROM g WHERE above IS NOT NULL GROUP BY above),
        s AS (SELECT DISTINCT a.node, b.node AS below FROM p a JOIN p b ON a.conv_id = b.conv_id AND b.depth >= a.depth),
        l AS (SELECT s.node, count(*) FILTER (k.above IS NULL) AS n_leaves, sum((g.n_convs - 1) * g.words) AS saved_tokens FROM s JOIN g ON g.node = s.below LEFT JOIN k ON k.above = s.below GROUP BY s.node)
        SELECT g.conv_id, g.depth::BIGINT AS depth, u.conv_id AS parent_conv_id, g.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens::BIGINT AS saved_tokens, sha256(g.ids) AS ends_sha256
        FROM g LEFT JOIN g u ON u.node = g.above LEFT JOIN k ON k.above = g.node JOIN l ON l.node = g.node"""
