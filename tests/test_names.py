"""Signatures lose no pair of like names, and compare far fewer than all neighbours."""

import random

from pyspark.sql import functions as F

from cartolake.operators import greedy, names

GENERIC = ("cafe", "ev")


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def parts(name):
    every = [w for w in (name or "").lower().split() if w]
    telling = [w for w in every if w not in GENERIC] or every
    return telling, "".join(telling), "".join(every)


def alike(a, b):
    (ta, ca, wa), (tb, cb, wb) = parts(a), parts(b)
    if not ca or not cb:
        return False
    (s, l), (ws, wl) = sorted((ca, cb), key=len), sorted((wa, wb), key=len)  # noqa: E741
    if ca == cb or (len(s) >= 4 and s in l) or (len(ws) >= 8 and ws in wl):
        return True
    return any((x == y and len(x) >= 4) or (min(len(x), len(y)) >= 5 and edits(x, y) <= 1) for x in ta for y in tb)


def test_all_pairs_are_found(spark):
    r = random.Random(6)

    def word():
        w = "".join(r.choice("abcde") for _ in range(r.choice([2, 3, 4, 5, 6])))
        return r.choice([w, w, "cafe", "ev", "liman", "limam", "liman"[: r.randint(2, 5)], "xliman"])

    def places(n, seed):
        return [(k, " ".join(word() for _ in range(r.randint(0, 3))) if r.random() < 0.97 else None, 41 + r.uniform(0, 0.05), 29 + r.uniform(0, 0.05), r.choice(["food", "sight", None])) for k in range(n)]

    a, b = places(250, 1), places(250, 2)
    schema = "place int, name string, lat double, lon double, kind string"
    left, right = (names.prepared(spark.createDataFrame(x, schema), "place", GENERIC, "kind") for x in (a, b))
    near = [(x, y) for x in a for y in b if greedy.metres(x[2:4], y[2:4]) <= 900]
    wanted = {(x[0], y[0]) for x, y in near if alike(x[1], y[1]) and (x[4] is None or y[4] is None or x[4] == y[4])}
    found = names.near_and_alike(left, right, 900).select("a.id", F.col("b.id").alias("other")).collect()
    assert sorted((x.id, x.other) for x in found) == sorted(wanted) and len(wanted) > 50
    assert names.near_and_alike(left.limit(0), right, 900).count() == 0


def test_few_pairs_are_compared(spark):
    """Names of many words: candidates are a small part of the pairs that lie near each other."""
    r = random.Random(7)
    name = lambda: " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(5, 9))) for _ in range(2))
    rows = [(k, name(), 41 + r.uniform(0, 0.005), 29 + r.uniform(0, 0.005)) for k in range(600)]
    df = spark.createDataFrame(rows, "place int, name string, lat double, lon double")
    p = names.prepared(df, "place", GENERIC)
    assert 600 <= names.candidates(p, p, 900).count() < 0.02 * 600 * 600
