"""The corpus operators against brute force, on small tables with every odd case."""

import hashlib
import math
import random
import re
import resource
import time
import zlib
from collections import Counter
from fractions import Fraction
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import types as T
from tokenizers import Tokenizer

from cartolake.llm import bpe, chat, common, components, digest, exactdedup, langid, licenses, packing, secrets, simhash, suffix, topk

SF = "/root/testdata/sf0.001"
#: Extra columns under names that the operators use inside.
CLASH = ["id", "th", "spans", "doc", "fp", "key", "score", "kept", "hash", "piece", "template", "range", "c0", "ids", "component", "lang_pred", "body", "shift"]
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType())] + [T.StructField(c, T.StringType()) for c in CLASH])
SECRET = 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"'
WORDS = "the of and that with from shore river stone light paper winter".split()


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "s", "ed", "ing"]) for _ in range(n))


def odd_texts():
    shared = prose(1, 80)
    return [
        (1, prose(2, 120) + " " + shared),
        (2, prose(3, 120) + " " + shared + " Licensed under CC BY-NC 4.0. All rights reserved"),
        (3, prose(2, 120) + " " + shared),  # a copy of 1
        (3, prose(2, 120) + " " + shared),  # a repeated row
        (4, None),
        (5, ""),
        (None, "GNU General Public License " + SECRET),
        (None, None),
        (6, "ab" * 40_000),  # periodic and long
        (7, "é𝒳 \x00 <|endoftext|> ΣΑΣ　ǅ 12345 ٣"),
        (8, "short"),
        (9, "x" * 199),
        (10, "Zürich " * 50 + "AKIA" + "Z9" * 10 + " cc by cc by"),
    ]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, None, *["clash"] * len(CLASH)) for i, t in odd_texts()], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_row(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def expected(rows):
    return sorted(rows, key=repr)


# 1


def brute_license(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    hits = [(i, label) for phrase, label in licenses.BASE.items() for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
    at = [i for i, _ in hits]
    return len(w), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits}))


def test_licenses(docs, empty):
    found = licenses.scan(docs)
    assert by_row(found, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels") == expected([(i, *brute_license(t)) for i, t in odd_texts()])
    second = found.where("doc_id = 2").first()
    assert set(second.labels.split(",")) >= {"cc-by", "cc-by-nc-4.0", "reserved"} and second.score == 1.0
    assert licenses.scan(empty).count() == 0


def brute_chain(w, phrase):
    """Grams of a template that stand in the words in its order, by trying every way on from every gram."""
    t = phrase.split()
    hits = [(i, j) for i in range(len(w) - 1) for j in range(len(t) - 1) if w[i : i + 2] == t[j : j + 2]]
    longest = {}
    for i, j in hits:
        before = [longest[x, y] for x, y in hits if x < i and y < j and i - x <= licenses.GAP and abs(i - j - x + y) <= licenses.BAND]
        longest[i, j] = 1 + max(before, default=0)
    return max(longest.values(), default=0), len(t) - 1


def brute_labels(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    covers = {label: 0 for label in licenses.TEMPLATES.values()}
    for phrase, label in licenses.TEMPLATES.items():
        n, size = brute_chain(w, phrase)
        covers[label] = max(covers[label], n / size)
    base = brute_license(text)[4]
    found = {x: c for x, c in covers.items() if c >= licenses.COVER} | {x: 1.0 for x in base.split(",") if x}
    return ",".join(sorted(found)), max(found.values(), default=0.0)


def mangled(r):
    """License words, some put in, left out or swapped, among words of other licenses."""
    out = []
    for _ in range(r.randint(1, 4)):
        w = r.choice([*licenses.TEMPLATES, *licenses.BASE]).split()
        for _ in range(r.choice([0, 0, 1, 2, 3])):
            i = r.randrange(len(w))
            w[i : i + r.choice([0, 1])] = r.choice([[], [r.choice("of the to software license mit".split())], w[max(0, i - 2) : i][::-1]])
            w = w or ["the"]
        out += w + [r.choice(WORDS)] * r.choice([0, 1, 9])
    return " ".join(out)


def test_licenses_verify_spans(spark):
    mit = "permission is hereby granted kindly free of charge to any person obtaining a copy of this software and the associated documentation files"
    false = ["the mit the mit the mit the mit", "of the " * 12, "mit license the mit under the released under", " of the".join("this source code form is subject to the terms".split()) * 30]
    texts = [mit, *false, " ".join(mit.split()[::-1]), "of the " * 20_000, *(mangled(random.Random(k)) for k in range(120))]
    rows = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert (rows[0].labels, rows[0].n_base) == ("mit", 0)
    assert all(r.labels == "" and r.score == 0 and r.spans == [] for r in rows[1 : len(false) + 3])
    short = [k for k, t in enumerate(texts) if len(t) < 5000]
    assert [(rows[k].labels, rows[k].score) for k in short] == [brute_labels(texts[k]) for k in short]
    assert sum(r.labels != "" for r in rows) > 60


def test_licenses_of_long_templates(spark):
    """Whole texts of hundreds of words as templates: found whole and with a few words changed, not by half; sizes are checked."""
    r = random.Random(21)
    words = [f"w{k}" for k in range(400)]
    long, other = " ".join(r.choice(words) for _ in range(300)), " ".join(r.choice(words) for _ in range(101))
    changed = long.split()
    for k in range(5, 300, 40):
        changed[k : k + 1] = r.choice([[], ["new"], ["two", "new"]])
    texts = [f"{prose(1, 40)} {long.title()} {prose(2, 30)}", " ".join(changed), " ".join(long.split()[:150]), " ".join(long.split()[::-1]), f"{other}, {other} all rights reserved", "none"]
    table = spark.createDataFrame([("long", long), ("other", other), (None, "x y"), ("gone", None)], "label string, text string")
    templates = licenses.templates_of(table)
    rows = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), templates=templates).orderBy("doc_id").collect()
    assert [r.labels for r in rows] == ["long", "long", "", "", "other,reserved", ""]
    assert rows[0].score == 1.0 and (rows[0].spans[0].start, rows[0].spans[0].end) == (40, 340)
    assert licenses.COVER <= rows[1].score < 1 and brute_chain(changed, long) == (round(rows[1].score * 299), 299)
    with pytest.raises(ValueError, match="fewer than"):
        licenses.template_grams(spark, [("short", "one")])
    with pytest.raises(ValueError, match="broadcast"):
        licenses.template_grams(spark, [("huge", "a b " * licenses.MOST_GRAMS)])


# 2


def test_digest_edits(docs, empty):
    order = sorted(((i, t or "") for i, t in odd_texts()), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    wanted = []
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        cut = len(t) // 3
        wanted.append((i, len(t), hashlib.sha256((t[: len(t) - cut] + after[:cut]).encode()).hexdigest()))
    found = digest.compare(docs)
    assert by_row(found, "doc_id", "n_chars", "edited_sha256") == expected(wanted)
    prints = {}
    for r in found.collect():
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        prints.setdefault(r.doc_id, set()).add(bytes(r.fingerprint))
    assert prints[1] == prints[3]
    assert digest.compare(empty).count() == 0


def brute_grades(raw):
    """Entropy grades window by window; sums of count times log2 count in the same whole numbers as the operator's."""
    cost = [0] + [round(c * math.log2(c) * digest.SCALE) if c > 1 else 0 for c in range(1, 65)]
    return [(cost[64] - sum(cost[c] for c in Counter(raw[i : i + 64]).values())) * 1000 // cost[64] for i in range(len(raw) - 63)]


def brute_rarity(texts):
    counts = Counter(g for t in texts for g in brute_grades(t.encode()))
    near = [sum(counts[x] for x in range(g - digest.SMOOTH, g + digest.SMOOTH + 1) if 0 <= x <= 1000) for g in range(1001)]
    order = sorted(range(1001), key=lambda g: (near[g], g))
    return {g: n for n, g in enumerate(order) if digest.LOWEST <= g <= digest.HIGHEST}


def brute_digest(raw, ranks):
    """Filters of a text as (kind, set of bits): features, then strings of short texts, by plain loops."""
    grade = brute_grades(raw) if len(raw) >= 127 else []
    votes = Counter(min(range(i, i + 64), key=lambda w: (ranks.get(grade[w], 1 << 30), w)) for i in range(len(grade) - 63))
    odd = [int(x) for x in digest._ODD]
    m64 = (1 << 64) - 1

    def mix(h):
        h ^= h >> 31
        h = h * 0x9E3779B97F4A7C15 & m64
        return h ^ h >> 29

    def bits(h):
        return {(h >> 11 * k) % digest.BITS for k in range(digest.HASHES)}

    found = [mix(sum(odd[k] * (raw[w + k] + 1) for k in range(64)) & m64) for w in sorted(votes) if votes[w] >= digest.POPULAR and grade[w] in ranks]
    out = [(0, set().union(*map(bits, found[i : i + 160]))) for i in range(0, len(found), 160)]
    if len(raw) < digest.BOTH or len(found) < digest.FEW:
        if len(raw) <= 8:
            words = [xxhash.xxh64_intdigest(raw)] if raw else []
        else:
            words = [mix(mix(int.from_bytes(w, "little"))) for w in dict.fromkeys(raw[i : i + 8] for i in range(len(raw) - 7))]
        rows = -(-len(words) // 160)
        out += [(1, set().union(*(bits(h) for n, h in enumerate(words) if n * rows // len(words) == r))) for r in range(rows)]
    return out


def brute_likeness(a, b):
    if a == b:
        return 1.0
    for kind in (1, 0):
        x, y = sorted(([s for k, s in d if k == kind] for d in (a, b)), key=len)
        if x and y:
            total = 0.0
            for s in x:
                best = 0.0
                for t in y:
                    chance, most = len(s) * len(t) / digest.BITS, min(len(s), len(t))
                    best = max(best, (len(s & t) - chance) / max(most - chance, 1e-9) if most > chance else 0.0)
                total += min(1.0, best)
            return total / len(x)
    return 0.0


def as_bits(chain):
    return [(int(row[0]), set(np.nonzero(np.unpackbits(row[1:]))[0].tolist())) for row in chain]


@pytest.fixture(scope="module")
def ranks():
    counts = np.zeros(digest.GRADES + 1, np.int64)
    for seed in range(40):
        counts += np.bincount(digest.entropies(np.frombuffer(prose(seed, 300).encode(), np.uint8)), minlength=len(counts))
    return digest.rarity(counts)


def test_digests_against_brute_force(spark, monkeypatch):
    """Ranks learned, features selected, filters filled and compared by plain loops; long texts in parts."""
    r = random.Random(12)
    texts = [prose(300 + k, r.randint(1, 400)) for k in range(12)] + [t or "" for _, t in odd_texts() if len(t or "") < 5000]
    texts += [texts[0][:900] + texts[1], "".join(chr(r.randint(32, 126)) for _ in range(700)), "ab" * 300, prose(5, 2000), texts[-1]]
    texts = list(dict.fromkeys(texts))
    monkeypatch.setattr(digest, "PART", 500)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    fitted, wanted = digest.fit(df), brute_rarity(texts)
    assert {g: n for g, n in enumerate(fitted.tolist()) if n < digest.EXCLUDED} == wanted
    prints, plain = [digest.digest(t.encode(), fitted) for t in texts], [brute_digest(t.encode(), wanted) for t in texts]
    for t, p, b in zip(texts, prints, plain, strict=True):
        assert as_bits(p) == b, t[:80]
    for i in range(len(texts)):
        for j in range(i):
            assert abs(digest.likeness(prints[i], prints[j]) - brute_likeness(plain[i], plain[j])) < 1e-9
    rows = {r.doc_id: r for r in digest.compare(df).collect()}
    for n, t in enumerate(texts):
        after = texts[n - 1]
        edited = t[: len(t) - len(t) // 3] + after[: len(t) // 3]
        assert bytes(rows[n].fingerprint) == prints[n].tobytes() and bytes(rows[n].edited_fingerprint) == digest.digest(edited.encode(), fitted).tobytes()
        assert abs(rows[n].near_edited - brute_likeness(plain[n], brute_digest(edited.encode(), wanted))) < 1e-9
        assert abs(rows[n].near_next - brute_likeness(plain[n], plain[n - 1])) < 1e-9


def test_digest_sample_is_bounded(spark):
    rows = [(k % 7, prose(k, 40)) for k in range(30)] + [(None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert len(digest.fit(df, sample=3)) == digest.GRADES + 1
    assert sorted(digest.fit(df.limit(0)))[0] == digest.LOWEST


def test_digest_recall_and_separation(ranks):
    """Edited copies are told from other texts: of all lengths, with a third replaced, at a likeness of 0.25."""
    r, same, other = random.Random(13), [], []
    texts = [prose(1000 + k, r.choice([15, 40, 120, 400])) for k in range(150)]
    prints = [digest.digest(t.encode(), ranks) for t in texts]
    for k, t in enumerate(texts):
        edited = t[: len(t) - len(t) // 3] + texts[k - 1][: len(t) // 3]
        same.append(digest.likeness(prints[k], digest.digest(edited.encode(), ranks)))
        other.append(digest.likeness(prints[k], prints[k - 7]))
    assert np.mean(np.array(same) > 0.25) >= 0.95 and np.mean(np.array(other) < 0.25) >= 0.95


def test_digest_likeness(ranks):
    a, b = prose(5, 600), prose(6, 600)
    edited = a[: 2 * len(a) // 3] + b[: len(a) // 3]
    own = digest.digest(a.encode(), ranks)
    assert digest.likeness(own, digest.digest(edited.encode(), ranks)) > 0.4
    assert digest.likeness(own, own) == 1.0


@pytest.mark.parametrize("n", range(100, 201, 4))
def test_digest_of_short_texts(n, ranks):
    """An edit that keeps two thirds shows, also where it moves a text across the least length of features; other texts differ."""
    found, other = [], []
    for seed in range(10):
        a, b = prose(100 + seed, 60)[:n], "".join(chr(97 + (i * i * (seed + 3) + i) % 26) for i in range(n))
        for size in (n // 3, n // 3 - 12, n // 3 + 12):
            found.append(digest.likeness(digest.digest(a.encode(), ranks), digest.digest((a[: n - n // 3] + b[:size]).encode(), ranks)))
        other.append(digest.likeness(digest.digest(a.encode(), ranks), digest.digest(b.encode(), ranks)))
    assert min(found) > 0.4 and max(other) < 0.2


# 3


def brute_top(rows, every=20, k=20):
    e = [(i, [math.floor(Fraction(x) * 64) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (q, x) in enumerate(e):
        if q % every == 0:
            best = sorted((-max(1 - (1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(x, y, strict=False)))), c) for m, (c, y) in enumerate(e) if m != n)[:k]
            out += [(q, r + 1, c, -s) for r, (s, c) in enumerate(best)]
    return out


def test_top_k(spark):
    r = random.Random(3)
    rows = [(i, [r.uniform(-1, 1) for _ in range(40)]) for i in range(150)]
    rows += [(200 + i, rows[0][1]) for i in range(30)]  # ties
    rows += [(300, None), (320, []), (340, [1.0, None]), (360, [float("nan")] * 40), (380, [float("inf")] * 40), (None, rows[1][1]), (400, [0.5] * 3)]
    rows += [(20, rows[5][1]), (7, rows[6][1]), (40, rows[40][1])] + [(60, rows[60][1])] * 30 + [(500, rows[9][1])] * 25  # repeated ids, with other and with equal vectors
    df = spark.createDataFrame([(*x, "z") for x in rows], "vec_id long, embedding array<double>, score string")
    wanted = expected(brute_top(rows))
    assert by_row(topk.search(df), "query_id", "rank", "vec_id", "score") == wanted
    assert by_row(topk.search(df, seeds=0), "query_id", "rank", "vec_id", "score") == wanted
    assert topk.search(df.limit(0)).count() == 0


def test_top_k_of_large_numbers(spark):
    r = random.Random(4)
    size = [1.0, 2.0**36, 2.0**50, 2.0**62, 1e300, 1.7e308]
    rows = [(10 * i, [r.choice([-1, 1, 0]) * r.uniform(0.5, 1) * r.choice(size[: 2 + i % 5]) for _ in range(6)]) for i in range(60)]
    rows += [(1, [1.0]), (3, [2.0**30, 1.0]), (20, [2.0**36])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert by_row(topk.search(df), "query_id", "rank", "vec_id", "score") == expected(brute_top(rows))
    assert {(1, 1 << 48)} <= {(x.vec_id, x.score) for x in topk.search(df.where("vec_id in (1, 3) or size(embedding) = 1")).where("query_id = 20").collect()}


def test_bound_blocks_agree(monkeypatch):
    """Many small tiles and stripes, with and without seeds, on clustered vectors, where bounds drop most pairs."""
    monkeypatch.setattr(topk, "TILE", 3)
    monkeypatch.setattr(topk, "STRIPE", 128)
    rng = np.random.default_rng(1)
    centres = rng.normal(0, 30, (40, 48)) * np.linspace(1, 0.1, 48)
    c = np.floor(centres[rng.integers(0, 40, 3000)] + rng.normal(0, 3, (3000, 48)))
    ids = rng.permutation(3000)
    for floor in (None, topk.seed_floors(c[:9], ids[:9], c[:500], ids[:500], 20)):
        work = topk.Work()
        for r, found, scores in topk.best(c[:9], ids[:9], c, ids, np.arange(9), 20, floor, 8, work):
            s = c @ c[r]
            s[r] = -(1 << 40)
            order = np.lexsort((ids, -s))[:20]
            assert list(found) == list(ids[order]) and list(scores) == list(s[order])
        assert 0 < work.done < 0.7 * work.all


# 4 and 7


@pytest.fixture(scope="module")
def library():
    tool = Tokenizer.from_file(bpe.WORD_BPE)
    tool.no_truncation()
    tool.no_padding()
    return tool


def test_bpe(docs, empty, library):
    wanted = []
    for i, t in odd_texts():
        ids = library.encode(t or "", add_special_tokens=False).ids
        raw = np.array(ids, "<u4").tobytes()
        wanted.append((i, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert by_row(bpe.round_trip(docs), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == expected(wanted)
    assert bpe.round_trip(empty).count() == 0


def test_bpe_random(library):
    r, coder = random.Random(4), bpe.coder()
    letters = ["abcde", "thing and ", "'s're <|endoftext|>", "ΣσςİıKé́中文🙂", "\x1c\x1f\x85 \t\nx"]
    for _ in range(3000):
        a = r.choice(letters)
        t = "".join(r.choice(a) for _ in range(r.randint(0, 60)))
        assert np.frombuffer(coder.encode(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, t


def test_packing(docs, empty, library):
    rows = packing.packed(docs, capacity=64, with_ids=True).collect()
    wanted = []
    for i, t in odd_texts():
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), 64)):
            raw = np.array(ids[at : at + 64], "<u4").tobytes()
            wanted.append((i, k, at, len(raw) // 4, zlib.crc32(raw), raw))
    assert expected((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, bytes(r.ids)) for r in rows) == expected(wanted)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    total = sum(r.length for r in rows)
    assert len(by) <= -(-total // 64) + 1
    assert packing.packed(empty).count() == 0


def test_local_search_empties_bins():
    sizes = [5, 5, 5, 3, 3, 3, 4, 4, 4]
    bins = packing.improve([[0, 3], [1, 4], [2, 5], [6], [7], [8]], sizes, 12)
    assert sorted(i for b in bins for i in b) == list(range(9))
    assert all(sum(sizes[i] for i in b) <= 12 for b in bins) and len(bins) == 3


def raises_squares(bins, sizes, capacity):
    """Whether some move, one-for-one or two-for-one exchange raises the sum of squared fills."""
    fill = [sum(sizes[i] for i in b) for b in bins]
    for s, mine in enumerate(bins):
        gives = {sizes[i] for i in mine} | {sizes[i] + sizes[k] for n, i in enumerate(mine) for k in mine[n + 1 :]}
        for t, theirs in enumerate(bins):
            for z in {0} | {sizes[j] for j in theirs}:
                if s != t and any(z < x <= z + capacity - fill[t] and fill[s] - x < fill[t] - z for x in gives):
                    return True
    return False


@pytest.mark.parametrize("seed", range(4))
def test_local_search_tries_every_open_bin(seed):
    """A few pieces a sequence, so that best fit leaves most bins underfull."""
    r, capacity = random.Random(seed), 1000
    sizes = [r.choice((r.randint(220, 330), r.randint(340, 520))) for _ in range(240)]
    first = packing.best_fit(sizes, capacity)
    bins = packing.improve([list(b) for b in first], sizes, capacity)
    assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in b) <= capacity for b in bins) and len(bins) <= len(first)
    assert len(bins) == -(-sum(sizes) // capacity) or not raises_squares(bins, sizes, capacity)


# 5


def test_language(spark, docs, empty):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    net = langid.fit(table)
    rows = langid.predict(table, net, carried=("lang",)).withColumn("held", langid.held_out()).collect()
    held = [r for r in rows if r.held]
    assert len(rows) == table.count() and all((zlib.crc32(str(r.doc_id).encode()) % 4 == 2) == r.held for r in rows)
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.95
    odd = langid.predict(docs, net).collect()
    assert len(odd) == len(odd_texts()) and all((r.lang_pred == "und") == (r.score == 0) for r in odd)
    assert {r.lang_pred for r in odd if r.doc_id in (4, 5)} == {"und"}
    assert {r.lang_pred for r in langid.predict(docs, langid.fit(docs)).collect()} == {"und"}  # no labels
    assert langid.predict(empty, net).count() == 0


def brute_probabilities(net, text):
    """Mean over all windows of the network's answers, filter by filter and place by place, without tables."""
    raw, every = (text or "").encode(), []
    for at in range(0, max(1, len(raw)), langid.WINDOW):
        window = raw[at : at + langid.WINDOW].ljust(langid.WINDOW, b"\0")
        pooled = []
        for width, table in zip(langid.WIDTHS, net.filters, strict=True):
            answers = [sum(table[j, window[p + j]].astype(float) for j in range(width)) for p in range(langid.WINDOW - width + 1)]
            pooled.append(np.max(answers, axis=0))
        z = np.maximum(np.concatenate(pooled) + net.bias, 0) @ net.out + net.out_bias
        e = np.exp(z - z.max())
        every.append(e / e.sum())
    return np.mean(every, axis=0)


def test_language_against_a_plain_convolution(spark, docs):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    net = langid.fit(table)
    rows = langid.predict(table.where("n_chars < 1500"), net, carried=("text",)).limit(60).collect() + langid.predict(docs, net, carried=("text",)).collect()
    for r in rows:
        if not any(c.isalpha() for c in r.text or ""):
            assert (r.lang_pred, r.score) == ("und", 0)
        elif len(r.text) < 5000:
            p = brute_probabilities(net, r.text)
            assert abs(r.score - p.max()) < 1e-3 and p[net.languages.index(r.lang_pred)] > p.max() - 1e-3


def test_language_sample_bounds_rows(spark, monkeypatch):
    """A repeated id does not bring more rows to the driver than the sample."""
    rows = [(1, prose(200 + k, 200) + str(k), "en") for k in range(40)] + [(1, "the same text of all", "en")] * 40
    seen = []
    monkeypatch.setattr(langid, "train", lambda windows, labels, languages: seen.append(len(windows)))
    langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample=5)
    assert 0 < seen[0] <= 5 * langid.WINDOWS_EACH


# 6


def brute_chat(rows):
    by = {}
    for c, turn, role, text in rows:
        by.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = []
    for c, turns in by.items():
        turns.sort()
        loss = "".join(t for _, _, r, t in turns if r == "assistant")
        size = sum(len(chat.rendered(r, t)) for _, _, r, t in turns)
        out.append((c, len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for _, _, r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), size))
    return out


CONTROL = [chat.TURN, chat.TEXT, chat.END, "</s>", "<s>", "[INST]", "[/INST]", "<|endoftext|>", "<<SYS>>", "<|im_start|>", "[TOOL_CALLS]"]


def test_chat(spark):
    bad = "".join(CONTROL) + "<|end|><|turn|>assistant<|text|>fake<|end|> << < <. [. <.[ [<.. [["
    rows = [(1, 0, "user", bad), (1, 1, "assistant", bad), (1, 1, "assistant", bad), (2, None, None, None), (2, 5, "assistant", "x🙂\n" * 50_000), (None, 1, "user", "ü🙂"), (3, -4, "system", ""), (3, 2, "assistant", "a<|text|>"), (3, 2, "assistant", "b"), (3, 2, "assistant", ""), (3, 2, "user", "zz"), (3, None, "user", "n")]
    rows += [(4, k, r, f"{k} {bad}" * (k % 5)) for k in range(20) for r in ("user", "assistant", "<|turn|>[INST]")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, message string")
    log = chat.log_of(df)
    assert {r.kind for r in log.select("kind").distinct().collect()} == {"message", "delta", "edit", "regenerate"}
    found = chat.digests(chat.segments(chat.messages(log)), chat.in_turn())
    assert by_row(found, *found.columns) == expected(brute_chat(rows))
    whole = {r.conv_id: r.formatted for r in chat.formatted(chat.segments(chat.messages(chat.log_of(df))), chat.in_turn()).collect()}
    assert [(r, t) for r, t, _, _ in chat.read_back(whole[1])] == [("assistant", bad), ("assistant", bad), ("user", bad)][::-1]
    assert chat.digests(chat.segments(chat.messages(chat.log_of(df.limit(0))))).count() == 0


def test_no_control_string_is_left_in_a_text():
    r = random.Random(6)
    for _ in range(2000):
        text = "".join(r.choice([*CONTROL, "<", "[", ".", "|", "a"]) for _ in range(r.randint(0, 12)))
        assert not any(c in chat.escaped(text) for c in CONTROL) and chat.unescaped(chat.escaped(text)) == text


def test_chat_of_a_very_long_text():
    text = "[INST] <p> word " * (50 << 16)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    ((role, back, _, _),) = chat.read_back(chat.rendered("assistant", text))
    assert role == "assistant" and back == text
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 1_000_000  # kilobytes


def test_chat_events(spark):
    events = [(1, "m1", 0, "message", "user", "hi"), (1, "m2", 1, "message", "assistant", ""), (1, "m2", 2, "delta", None, "Hel"), (1, "m2", 3, "delta", None, "lo"), (1, "m1", 4, "edit", None, "hey"), (1, "m2", 5, "regenerate", None, ""), (1, "m2", 6, "delta", None, "Yo")]
    df = spark.createDataFrame(events, "conv_id long, message string, seq int, kind string, role string, text string")
    assert by_row(chat.messages(df), "place", "role", "text") == [("m1", "user", "hey"), ("m2", "assistant", "Yo")]


# 8


def brute_simhash(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(docs, empty):
    prints = [(i, brute_simhash(t)) for i, t in odd_texts()]
    ids = [i for i, _ in prints]
    group = list(range(len(prints)))
    for _ in prints:
        for a, (_, x) in enumerate(prints):
            for b, (_, y) in enumerate(prints):
                if (x ^ y).bit_count() <= 3:
                    group[a] = group[b] = min(group[a], group[b])
    least = lambda g: min((ids[k] for k in range(len(ids)) if group[k] == g and ids[k] is not None), default=None)
    wanted = [(i, np.uint64(fp).astype(np.int64).item(), least(group[k])) for k, (i, fp) in enumerate(prints)]
    assert by_row(simhash.near_duplicates(docs), "doc_id", "fp", "component") == expected(wanted)
    assert simhash.near_duplicates(empty).count() == 0


def test_position_sets():
    sets = [set(x) for x in simhash.position_sets()]
    assert len(sets) == 14 and all(len(x) == 4 for x in sets)
    assert all(any(x <= set(five) for x in sets) for five in combinations(range(8), simhash.SHARED_BYTES))


def test_count_filter_rejects():
    """Two bits in each of two bytes: a pair that meets in a list, but is too far; four bytes with one bit each never reach 5."""
    a = np.array([0, 0, 0], np.uint64)
    b = np.array([0x01010101, 0x0303, 0x010101], np.uint64)
    assert simhash.agree(a, b).tolist() == [False, False, True]


@pytest.mark.parametrize("n", [50, 900, 2500])
def test_posting_lists(n, monkeypatch):
    """Pairwise and probing forms find the same classes, a chain of near fingerprints included."""
    monkeypatch.setattr(simhash, "PAIRWISE", 100 if n == 900 else 1500)
    rng = np.random.default_rng(n)
    mask = simhash.masks()[0]
    free = [p for p in range(8) if not mask >> 8 * p & 0xFF]
    values = rng.integers(0, 1 << 32, n)
    values = np.concatenate([values, values & 0xFFFF00FF | 0x4200, values & 0xFF])
    values = np.unique(np.concatenate([values, values[: n // 2] ^ 3, values[: n // 3] ^ (1 << 20), values[: n // 4] ^ 0x01010100, values[: n // 4] ^ 0x81000001]))
    members = np.zeros(len(values), np.uint64)
    for k, p in enumerate(free):
        members |= ((values >> 8 * k) & 0xFF).astype(np.uint64) << np.uint64(8 * p)
    a, b = simhash.links_of(members, mask)
    parent = {int(x): int(x) for x in members}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        parent[root(x)] = root(y)
    near = np.bitwise_count(members[:, None] ^ members[None, :]) <= 3
    for i, j in zip(*np.nonzero(near), strict=True):
        assert root(int(members[i])) == root(int(members[j]))
    assert len({root(int(m)) for m in members}) == len(members) - len(a)


def test_settings_and_saved_tables(spark):
    """Operators lower the batch bound at most, and what they saved can be removed."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        for given, after in (("500", "500"), ("10000", "2000")):
            spark.conf.set(key, given)
            df = spark.createDataFrame([(k, prose(k, 9)) for k in range(9)], "doc_id long, text string")
            assert simhash.near_duplicates(df).count() == 9 and spark.conf.get(key) == after
    finally:
        spark.conf.set(key, before)
    table = common.saved(spark.range(3), "probe")
    assert table.count() == 3
    common.discard_saved(spark)
    with pytest.raises(Exception, match="probe"):
        table.count()


def test_components(spark):
    r = random.Random(8)
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(r.randint(200, 260), r.randint(200, 260)) for _ in range(40)] + [(7, 7), (None, 3)]
    found = dict(by_row(components.components(spark.createDataFrame(edges, "a long, b long")), "node", "root"))
    seen = {}

    def root(x):
        seen.setdefault(x, x)
        while seen[x] != x:
            x = seen[x]
        return x

    for x, y in edges:
        if x is not None and x != y:
            a, b = root(x), root(y)
            seen[max(a, b)] = min(a, b)
    assert found == {x: root(x) for x in seen}


def test_components_of_many_edges(spark):
    """The checksum of the settling test holds for more than 2^20 edges."""
    n = 1_300_000
    found = components.components(spark.range(n).selectExpr("2 * id AS a", "2 * id + 1 AS b"))
    assert found.selectExpr("count(*)", "count_if(root = node - node % 2)").first() == (2 * n, 2 * n)


# 9


def brute_repeats(texts, window):
    raw = [(t or "").encode() for t in texts]
    seen = {}
    for b in raw:
        for i in range(len(b) - window + 1):
            seen[b[i : i + window]] = seen.get(b[i : i + window], 0) + 1
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - window + 1):
            if seen[b[i : i + window]] > 1:
                gone[i : i + window] = b"\1" * window
        out.append((len(b), sum(gone), sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1])), bytes(c for c, g in zip(b, gone, strict=True) if not g)))
    return out


def test_repeats(docs, empty):
    texts = [t for _, t in odd_texts()]
    wanted = [(i, *r) for (i, _), r in zip(odd_texts(), brute_repeats(texts, 200), strict=True)]
    found = exactdedup.remove_repeats(docs, carried=("doc", "key", "body"))
    rows = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in found.collect()]
    assert expected(rows) == expected(wanted) and found.columns[1:4] == ["doc", "key", "body"]
    assert exactdedup.remove_repeats(empty).count() == 0


def test_hot_keys_are_dealt_anew(spark, monkeypatch):
    """With a tiny bound on segments every repeated key goes through the longer grams."""
    monkeypatch.setattr(exactdedup, "MOST_SEGMENTS", 2)
    passage = prose(9, 60)
    texts = [prose(20 + i, 30 + i) + " " + passage + " " + prose(60 + i, 30) for i in range(12)] + [passage, "ab" * 500]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = [(r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in exactdedup.remove_repeats(df).orderBy("doc_id").collect()]
    assert rows == brute_repeats(texts, 200)


def test_suffix_arrays():
    rng = np.random.default_rng(2)
    for k in range(400):
        t = rng.integers(0, 1 + k % 5, rng.integers(0, 50)).astype(np.uint8)
        t = np.tile(t, 1 + k % 3)
        b = t.tobytes()
        order = sorted(range(len(b)), key=lambda i: b[i:])
        sa = suffix.suffix_array(t)
        assert list(sa) == order
        shared = suffix.common_prefixes(t, sa)
        for n in range(1, len(order)):
            x, y = b[order[n - 1] :], b[order[n] :]
            assert shared[n] == next((i for i, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))


# 10


def brute_secrets(text):
    text = text or ""
    assign = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    found = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(found))


def brute_random(text, taken):
    """Spans of random strings, from the definition: character by character, each run measured anew."""
    tool, text = secrets.vocabulary(), text or ""
    inside = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.$%@#!^*~-")
    marks = set(".!*~^%#@/+-_")
    spans, i = [], 0
    while i < len(text):
        if text[i] not in inside:
            i += 1
            continue
        a = i
        while i < len(text) and text[i] in inside:
            i += 1
        end = i
        for pad in (2, 1):
            if text[i : i + pad] == "=" * pad and not (i + pad < len(text) and re.match("[A-Za-z0-9+/_=-]", text[i + pad])):
                end = i + pad
                break
        pieces, at, k = [], a, a
        while k < end:  # a mark three times or more cuts
            n = k
            while n < end and text[n] == text[k]:
                n += 1
            if n - k >= 3 and not text[k].isalnum():
                pieces.append((at, k))
                at = n
            k = n
        for x, y in [*pieces, (at, end)]:
            while x < y and text[x] in marks:
                x += 1
            while x < y and text[y - 1] in marks:
                y -= 1
            value = text[x:y]
            if not value:
                continue
            tokens = sum(len(tool.encode_ordinary(value[k : k + 2048])) for k in range(0, len(value), 2048))
            if len(value) / tokens < 2.2 - 7.0 / len(value) and not secrets.is_known(value) and not any(b < y and x < c for b, _, c in taken):
                spans.append((x, 3, y))
        i = max(i, end)
    return spans


def test_random_spans_by_brute_force(spark):
    r = random.Random(12)
    value = lambda: "".join(r.choice("abcdefghkmnpqrstXYZQWRTPLK0123456789$.-_/+=&!@") for _ in range(r.choice([3, 7, 12, 16, 24, 40, 3000])))
    texts = [t for _, t in odd_texts()] + ["".join(r.choice([value(), prose(k, 3), "$$$$", "...", f"password={value()}", "=", "==", "1234567890123456", "a.b@host.org"]) + r.choice([" ", "", "\n", '"']) for _ in range(8)) for k in range(150)]
    found = secrets.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    names = (*secrets.KINDS, "random")
    for t, row in zip(texts, found, strict=True):
        first = secrets.patterned(t or "")
        assert [(s.start, names.index(s.kind), s.end) for s in row.spans] == sorted(first + brute_random(t, first))
    assert sum(s.kind == "random" for row in found for s in row.spans) > 300


def test_secrets(docs, empty):
    found = secrets.scan(docs, redact="[x]").withColumn("b", secrets.written("base"))
    assert by_row(found, "doc_id", "b") == expected([(i, brute_secrets(t)) for i, t in odd_texts()])
    assert all("24be64439e" not in (r.redacted or "") for r in found.collect())
    assert secrets.scan(empty).count() == 0


def test_random_strings(spark):
    texts = ["key is q8Zt4Lw0xVb93KfhT2mRz7Yd here", "see 123e4567-e89b-12d3-a456-426614174000 and my_long_function_name_2024", "thntretionthhathe shoreriverstonelightpaper", "token: token:abcdefghijk"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    spans = [r.s for r in secrets.scan(df).orderBy("doc_id").select(secrets.written("spans").alias("s")).collect()]
    assert spans == ["random:7:31", "", "", ""]


def test_random_values_of_names(spark):
    """Unquoted name=value lines and URL parameters."""
    value, key = "q8Zt4Lw0xVb93KfhT2mRz7Yd", "wJ4rXUtn7EMI/K7MD9+bPxRfiC1YzqX0mPLvK3Ey"
    texts = [f"AUTH_KEY={value}", f"AWS_SECRET_ACCESS_KEY={key}\nnext", f"https://host.example/a?sig={value}&x=1", f"k={value}==", f"{value}=1", f"a=={value}", "build=my_long_function_name_2024 id=123e4567-e89b-12d3-a456-426614174000"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    rows = secrets.scan(df, redact="[x]").orderBy("doc_id").collect()
    assert [r.redacted for r in rows] == ["AUTH_KEY=[x]", "AWS_SECRET_ACCESS_KEY=[x]\nnext", "https://host.example/a?sig=[x]&x=1", "k=[x]", "[x]=1", "a==[x]", texts[-1]]
    assert all(s.kind == "random" for r in rows for s in r.spans) and all(r.base == [] for r in rows)


def test_random_strings_beside_taken_spans():
    """The sweep over both lists gives what comparing each candidate with each taken span gives, and is linear."""
    r, tool = random.Random(10), secrets.Efficiency(secrets.vocabulary())
    value = lambda n: "".join(r.choice("abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789") for _ in range(n))
    for _ in range(200):
        text = " ".join(r.choice([f"token={value(30)}", value(24), f"{value(10)}-{'0af' * 12}", "AKIA" + "Q7" * 9, f"key:{value(22)}", "word"]) for _ in range(12))
        taken = secrets.patterned(text)
        wanted = [(a, 3, b) for a, _, b in secrets.improbable(text, [], tool) if not any(x < b and a < y for x, _, y in taken)]
        assert secrets.improbable(text, taken, tool) == wanted
    text = " ".join(f"{value(24)} {k:064x}" for k in range(20_000))  # a digest after each
    taken, began = secrets.patterned(text), time.process_time()
    assert len(taken) == 20_000 and len(secrets.improbable(text, taken, tool)) > 19_000
    assert time.process_time() - began < 10


def test_recall_and_precision_on_planted_secrets():
    """Random strings of several alphabets in ordinary places, against words, names, numbers, paths and digests.

    Recall by alphabet and length: 0.9 and more, but for small letters alone, where 12 to 19 of them are too like invented words.
    """
    r, tool = random.Random(11), secrets.Efficiency(secrets.vocabulary())
    small, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    letters = small + small.upper()
    alphabets = {"letters": letters, "all": letters + digits, "base64": letters + digits + "+/", "url": letters + digits + "_-", "upper": small.upper() + digits, "lower": small + digits, "marks": letters + digits + ".$%@#!^*", "small": small}
    recall, hit, planted = {}, 0, 0
    for name, alphabet in alphabets.items():
        for least, most in ((12, 19), (20, 31), (32, 64)):
            found = 0
            for k in range(120):
                value = "".join(r.choice(alphabet) for _ in range(r.randint(least, most)))
                text = f"{prose(k, 8)} {r.choice(['AUTH=', 'sig ', 'https://host/x?key=', 'Authorization: Bearer ', chr(34)])}{value}{r.choice(['', ' ', chr(34), ', ok'])} {prose(k + 1, 5)}"
                at, first = text.index(value), secrets.patterned(text)
                found += any(a <= at + 2 and b >= at + len(value) - 2 for a, _, b in first + secrets.improbable(text, first, tool))
            recall[name, least], hit, planted = found / 120, hit + found, planted + 120
    assert all(x >= (0.5 if key == ("small", 12) else 0.85 if key[0] == "small" else 0.9) for key, x in recall.items()), recall
    false = 0
    for k in range(planted):
        a, b, c = (r.choice(WORDS) for _ in range(3))
        text = r.choice([f"{a}_{b}_{c}_{a}_{k}", f"{a}/{b}/{c}/{b}{k}/{a}.html", f"{a.title()}{b.title()}{c.title()}{a.title()}{b.title()}", "%064x" % r.getrandbits(256), "%08x-1234-4321-abcd-%012x" % (r.getrandbits(32), r.getrandbits(48)), prose(k, 30), f"{r.getrandbits(64)}", f"{a}.{b}{k}@{c}.org", "192.168.17.4:8080", f"+90-555-{k:03d}-4567", f"SKU-{k:05d}-AB-9", "!!!!!!!!!! ***** -----"])
        false += bool(secrets.improbable(text, secrets.patterned(text), tool))
    assert hit >= 0.9 * planted and hit >= 0.98 * (hit + false)


def test_long_texts_are_hashed_in_parts(monkeypatch):
    """Every window has the same key whether or not a text is longer than a part."""
    texts = [prose(70, 300).encode(), b"ab" * 900, b"", b"x" * 199, prose(71, 200).encode()]
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)

    def keys():
        out = {}
        for row, start, windows, key in zip(*exactdedup.segments(data, offsets, 50), strict=True):
            for w in range(windows):
                assert (row, start + w) not in out
                out[row, start + w] = key
        return out

    whole = keys()
    assert len(whole) == sum(max(0, len(t) - 199) for t in texts)
    monkeypatch.setattr(exactdedup, "PART", 333)
    assert keys() == whole


def test_digest_ranks_come_from_all_documents(spark):
    """A document beyond any sample of a thousand still counts."""
    texts = ["abc " * 40] * 1500
    few = [(n, t) for n, t in enumerate(texts)]
    raw = "".join(chr(33 + (k * 7) % 90) for k in range(3000))
    counts = np.zeros(digest.GRADES + 1, np.int64)
    for t in [*texts, *[raw] * 30]:
        counts += np.bincount(digest.entropies(np.frombuffer(t.encode(), np.uint8)), minlength=len(counts))
    df = spark.createDataFrame(few + [(5000 + n, raw) for n in range(30)], "doc_id long, text string")
    assert digest.fit(df).tolist() == digest.rarity(counts).tolist()
