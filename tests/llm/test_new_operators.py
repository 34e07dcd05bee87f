"""Resampling, prefix trie and decontamination against brute force, on small tables with every odd case."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import types as T

from cartolake.llm import decontam, prefixtrie, resample

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
CLASH = ["id", "th", "w", "words", "at", "size", "items", "run", "hash", "rank", "place", "row", "key", "block"]
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), *(T.StructField(c, T.StringType()) for c in CLASH)])


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice("the of and that with from shore river stone light paper winter".split()) + r.choice(["", "s", "ed", "ing"]) for _ in range(n))


def odd_texts():
    long = prose(5, 40)
    return [
        *[(i, prose(i, 60) + " " + long) for i in range(100, 140)],
        (1, prose(1, 30)),
        (2, "Before. " + long.title() + "! After"),
        (2, "Before. " + long.title() + "! After"),  # a repeated row
        (2, "another text of id two"),
        (3, None),
        (4, ""),
        (None, long[: len(long) // 2]),
        (None, None),
        (5, "ΣΑΣ ǅ é𝒳\x00 12 tiny item ٣ tiny"),
        (6, "one, two; three"),
        (7, "word " * 30_000),  # very long, periodic
        (8, " ".join(long.split()[:9])),  # a word short of a window
    ]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, *["clash"] * len(CLASH)) for i, t in rows], SCHEMA)


def by_row(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def expected(rows):
    return sorted(rows, key=repr)


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, odd_texts())


ITEMS = [(0, prose(5, 40)), (1, "Tiny item"), (10, "two three"), (2, None), (3, "..."), (4, "word " * 12), (4, "of id"), (9, prose(5, 40)), (None, prose(101, 15))]


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(i, t, "x") for i, t in ITEMS], "item_id long, text string, window string")


# 11


def features(text):
    w = words(text)
    return [" ".join(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def brute_resample(rows, target):
    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    s, t = Counter(bucket(f) for _, x in rows for f in features(x)), Counter(bucket(f) for x in target for f in features(x))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + 10_000) / ((s[b] + 1) * (t.total() + 10_000))))
    out = []
    for i, x in rows:
        fs = features(x)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(bucket(f)) for f in fs)
        out.append([i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(x))])
    able = sorted((r for r in out if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = {id(r): k + 1 for k, r in enumerate(able[: 5 * len(able) // 100])}
    return [(*r[:4], drawn.get(id(r))) for r in out]


def test_resample(spark, docs, bench):
    rows = [*odd_texts(), *((1000 + k, prose(1000 + k, 5 + k % 40)) for k in range(300))]
    found = resample.resample(frame(spark, rows), bench)
    assert by_row(found, "doc_id", "n_features", "weight", "score", "rank") == expected(brute_resample(rows, [t for _, t in ITEMS]))
    assert found.where("rank is not null").count() > 10


def test_resample_ties_and_hot_rows(spark, bench):
    """Equal rows, and rows that agree in all but the id, have different ranks; a third of all rows share one id."""
    rows = [(7, prose(7, 25))] * 200 + [(k, prose(3, 25)) for k in range(400)]
    found = resample.resample(spark.createDataFrame(rows, "doc_id long, text string"), bench, percent=100)
    ranks = found.orderBy("rank").collect()
    assert [r["rank"] for r in ranks] == list(range(1, 601))
    assert [r["score"] for r in ranks] == sorted((r["score"] for r in ranks), reverse=True)


def test_resample_empty(spark, docs, bench):
    assert resample.resample(frame(spark, []), bench).count() == 0
    none = resample.resample(docs, bench.limit(0))
    assert none.count() == len(odd_texts()) and none.where("n_features > 0 and weight = 0").count() == 0


def test_streams_are_packed(docs):
    for r in resample.streams(docs).collect():
        starts = np.frombuffer(r["starts"], "<i8")
        assert len(starts) == len(r["ids"]) + 1 and starts[-1] == len(r["stream"]) // 2 and (np.diff(starts) >= 0).all()
    total = sum(len(features(t)) for _, t in odd_texts())
    assert sum(r["n"] for r in resample.counts(resample.streams(docs)).collect()) == total


# 12


def brute_trie(convs):
    """convs: id to list of (role, text)."""
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    children = Counter(n[:-1] for n in members if n)
    out = []
    for n, m in members.items():
        below = [x for x in members if x[: len(n)] == n]
        saved = sum((len(members[x]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", x[-1][1])) for x in below if x)
        leaves = sum(children[x] == 0 for x in below)
        out.append((min(m), len(n), min(members[n[:-1]]) if n else None, len(m), children[n], leaves, saved, hashlib.sha256(",".join(map(str, sorted(ends[n]))).encode()).hexdigest()))
    return out


def rebuilt(convs):
    out = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = convs.get(c - int(math.fmod(c, 20)), [])[:h] + turns[h:]
    return out


NAMES = ["id", "depth", "parent_id", "n_members", "n_children", "n_leaves", "saved_words", "ends_sha256"]
TURNS = "conv_id long, turn int, role string, text string, block string, g string"


def table(spark, convs):
    rows = [(c, k, *t, "x", "y") for c, turns in convs.items() for k, t in enumerate(turns)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, TURNS)


def random_convs(seed, n):
    """Few different turns, so that prefixes are shared; lengths from 1 to 9; copies."""
    r = random.Random(seed)
    out = {}
    for c in r.sample(range(-50, 4 * n), n):
        out[c] = r.choice(list(out.values())) if out and r.random() < 0.3 else [(r.choice("ua"), r.choice(["", "a", "a b", "a  b\tc d"])) for _ in range(r.choice([1, 1, 2, 3, 5, 9]))]
    return out


@pytest.mark.parametrize("seed, n, block_rows", [(1, 60, 1), (2, 150, 7), (3, 400, 3), (4, 300, 1000)])
def test_trie(spark, seed, n, block_rows):
    convs = random_convs(seed, n)
    seqs = prefixtrie.sequences(table(spark, convs))
    assert by_row(prefixtrie.trie(seqs, block_rows), *NAMES) == expected(brute_trie(convs))
    assert by_row(prefixtrie.trie(prefixtrie.with_shared_starts(seqs), block_rows), *NAMES) == expected(brute_trie(rebuilt(convs)))


def test_trie_of_many_copies_over_many_blocks(spark):
    """A third of all are one conversation, others extend it: intervals span whole blocks."""
    base = [("u", "x"), ("a", "y z")]
    convs = {k: base for k in range(60)} | {100 + k: [*base, ("u", f"w {k % 7}"), ("a", str(k))] for k in range(60)} | {300 + k: [("u", "x")] for k in range(9)} | {400: [("u", "x"), *[("a", str(d)) for d in range(200)]]}
    assert by_row(prefixtrie.trie(prefixtrie.sequences(table(spark, convs)), 4), *NAMES) == expected(brute_trie(convs))


def test_trie_odd_rows(spark):
    rows = [(1, 2, "u", "second"), (1, None, "s", "first"), (2, 1, None, None), (2, 1, "", ""), (None, 1, "u", "gone"), (3, 1, "u", "é" * 50_000), (4, 1, "u", "x"), (4, 1, "u", "x"), (5, 0, "a:b", "c"), (6, 0, "a", "b:c")]
    found = prefixtrie.trie(prefixtrie.sequences(spark.createDataFrame([(*r, "x", "y") for r in rows], TURNS)), 2)
    convs = {1: [("s", "first"), ("u", "second")], 2: [("", ""), ("", "")], 3: [("u", "é" * 50_000)], 4: [("u", "x")] * 2, 5: [("a:b", "c")], 6: [("a", "b:c")]}
    assert by_row(found, *NAMES) == expected(brute_trie(convs))
    # A conversation that loses all its turns is a member of the root alone.
    alone = next(c for c in range(1, 99) if c % 20 and zlib.crc32(str(c).encode()) % 4)
    lost = prefixtrie.with_shared_starts(prefixtrie.sequences(spark.createDataFrame([(alone, 0, "u", "x", "", "")], TURNS)))
    assert by_row(prefixtrie.trie(lost), *NAMES) == [(alone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(alone).encode()).hexdigest())]
    assert prefixtrie.trie(prefixtrie.sequences(spark.createDataFrame([], TURNS))).count() == 0


def test_nearest_smaller_values():
    r = random.Random(5)
    for n in range(40):
        v = [r.randint(0, 4) for _ in range(n)]
        left, right = prefixtrie.smaller(v)
        assert left == [max((j for j in range(i) if v[j] < v[i]), default=-1) for i in range(n)]
        assert right == [min((j for j in range(i + 1, n) if v[j] < v[i]), default=-2) for i in range(n)]


# 13


def brute_windows():
    out = defaultdict(set)
    for item, text in ITEMS:
        w = words(text)
        for i in range(max(len(w) - 9, 1) if w else 0):
            out[tuple(w[i : i + 10])].add("" if item is None else str(item))
    return out


def brute_scan(text):
    w, wins = words(text), brute_windows()
    hit, items = set(), set()
    for size in {len(x) for x in wins}:
        for i in range(len(w) - size + 1):
            if found := wins.get(tuple(w[i : i + size])):
                hit |= set(range(i, i + size))
                items |= found
    return len(w), hit, sorted(items)


def test_decontaminate(docs, bench, spark, monkeypatch):
    brute = [(i, *brute_scan(t)) for i, t in odd_texts()]
    want = expected([(i, n, len(hit), len(items), items, bool(hit)) for i, n, hit, items in brute])
    names = ["doc_id", "n_words", "n_hit", "n_items", "items", "contaminated"]
    found = decontam.scan(docs, bench)
    assert by_row(found, *names) == want
    assert sum(r[-1] for r in want) > 40 and any(not r[-1] for r in want)
    assert by_row(decontam.scan(docs, bench, broadcast_bytes=0), *names) == want
    assert "BroadcastHashJoin" not in decontam.scan(docs, bench, broadcast_bytes=0)._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(decontam, "GATE", 0)
    assert by_row(decontam.scan(docs, bench), *names) == want
    spans = {(r["doc_id"], r["n_words"]): [w for s in r["spans"] for w in range(s["start"], s["end"])] for r in found.collect()}
    assert spans == {(i, n): sorted(hit) for i, n, hit, _ in brute}
    assert decontam.scan(frame(spark, []), bench).count() == 0
    assert decontam.scan(docs, bench.limit(0)).where("contaminated").count() == 0


def test_decontaminate_stays_in_the_jvm(docs, bench):
    for df in (decontam.scan(docs, bench), decontam.clean(docs, bench)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", plan)


def brute_clean(text, most):
    n, hit, _ = brute_scan(text)
    if hit and len(hit) > most * n:
        return ()
    if not hit:
        return (text,)
    at = [m.span() for m in WORD.finditer(text)]
    out, end = [], 0
    for k, (a, b) in enumerate(at):
        if k not in hit:
            out.append(text[end:b])
            end = b
        else:
            out.append(text[end:a] if k - 1 not in hit else "")
            end = b
    return ("".join(out) + text[end:],)


@pytest.mark.parametrize("most", [0, 0.5, 1])
def test_clean(docs, bench, most):
    found = decontam.clean(docs, bench, most_share=most)
    assert found.columns == docs.columns
    assert by_row(found, "doc_id", "text") == expected([(i, x) for i, t in odd_texts() for x in brute_clean(t, most)])
