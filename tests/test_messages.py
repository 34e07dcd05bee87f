"""What texts say: dates, areas and foul words, against plain versions and cases of our own."""

import datetime
import random

import pytest

from cartolake.functions.dates import spoken_date
from cartolake.operators import areas, lexicon
from cartolake.operators.rules import conditions, every_match, first_match, written

TODAY = datetime.date(2026, 5, 1)  # a Friday


@pytest.mark.parametrize(
    ("text", "day"),
    [
        ("3 haziran'da gidelim", "2026-06-03"),
        ("19mayis icin plan", "2026-05-19"),
        ("2 nisan", "2027-04-02"),
        ("the 4th of july, please", "2026-07-04"),
        ("dec 24th, 2027", "2027-12-24"),
        ("sept 9", "2026-09-09"),
        ("may 2 people come", None),
        ("aug 3 people", None),
        ("30 subat", None),
        ("29 subat 2028", "2028-02-29"),
        ("31.12.26", "2026-12-31"),
        ("7/8", "2026-08-07"),
        ("12.05", None),
        ("28.09", "2026-09-28"),
        ("25.10 tl", None),
        ("saat 24.10", None),
        ("1.1.2020 ya da 5.6.2026", "2026-06-05"),
        ("10:30 may", None),
        ("yarindan sonra", "2026-05-03"),
        ("yarinki gezi", "2026-05-02"),
        ("cuma", "2026-05-08"),
        ("bu cuma", "2026-05-01"),
        ("bugun, cumaya", "2026-05-01"),
        ("cumartesiye", "2026-05-02"),
        ("pazara gidelim", None),
        ("pazar", "2026-05-03"),
        ("mondays", "2026-05-04"),
        ("this friday", "2026-05-01"),
        ("tonight", "2026-05-01"),
        ("hello", None),
        ("", None),
    ],
)
def test_spoken_date(text, day):
    assert spoken_date(text, TODAY) == (day and datetime.date.fromisoformat(day))


def test_area_names_by_trie_and_by_join(spark, monkeypatch):
    r = random.Random(2)
    words = ["ada", "yeni", "liman", "tepe", "kiyi", "u"]
    names = sorted({" ".join(r.choice(words) for _ in range(r.randint(1, 4))) for _ in range(60)})
    endings = ["", "'de", "de", "den", "nin", "i", "xx", "'"]
    texts = [(k, " ".join(r.choice(words) + r.choice(endings) for _ in range(r.randint(0, 9)))) for k in range(300)] + [(900, None), (901, ""), (902, "Ada'da " * 5000)]

    def plain(text):
        tokens = [w.strip("'") for w in (text or "").lower().split()]
        out = set()
        for name in names:
            ws = name.split(" ")
            for i in range(len(tokens) - len(ws) + 1):
                last = tokens[i + len(ws) - 1]
                fits = any(last[: len(last) - len(e)].removesuffix("'") == ws[-1] or last[: len(last) - len(e)] == ws[-1] for e in areas.ENDINGS if last.endswith(e) and len(last) > len(e))
                if tokens[i : i + len(ws) - 1] == ws[:-1] and fits:
                    out.add(name)
        return out

    wanted = {(k, n) for k, t in texts for n in plain(t)}
    messages = spark.createDataFrame([(k, t, 1) for k, t in texts], "id long, content string, here long")
    table = spark.createDataFrame([(n,) for n in names], "gram string")
    said = lambda: {(x.k, x.gram) for x in areas._said(messages, table, "id", "content", "here").collect()}
    assert said() == wanted and len(wanted) > 200
    monkeypatch.setattr(areas, "MOST_NAMES", 3)
    assert said() == wanted


def test_lexicon_of_hundreds_of_entries(spark):
    r = random.Random(3)
    word = lambda n: "".join(r.choice("abcdeklmno") for _ in range(n))
    entries = [(kind, word(n)) for kind, n in (("word", 4), ("stem", 4), ("harmless", 6), ("joined", 7)) for _ in range(150)]
    some = [e for _, e in entries]
    texts = ["".join(r.choice([r.choice(some), word(5), r.choice(some)[:3]]) + r.choice(["", "x", " ", "!! ", ". "]) for _ in range(6)) for _ in range(400)]
    texts += ["", " ", "".join(c + "." for c in entries[-1][1]), entries[0][1].upper() * 1, "$ " * 9, "a" * 100_000]

    def plain(text):
        import itertools

        letters = "".join({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "$": "s", "@": "a", "!": "i"}.get(c, c if c.isalpha() else " ") for c in text.lower())
        once = lambda w: "".join(k for k, _ in itertools.groupby(w))
        words = [once(w) for w in letters.split()]
        of = lambda kind: [once(e) for k, e in entries if k == kind]
        for w in words:
            if w in of("word") or (any(w.startswith(s) for s in of("stem")) and not any(w.startswith(h) for h in of("harmless"))):
                return True
        joined = once("".join(words))
        return any(j in joined for j in of("joined")) and not any(h in joined for h in of("harmless"))

    df = spark.createDataFrame([*enumerate(texts), (-1, None)], "id long, text string")
    found = {x.id: x.flagged for x in lexicon.flagged(df, "id", "text", spark.createDataFrame(entries, "kind string, entry string")).collect()}
    wanted = {k: plain(t) for k, t in enumerate(texts)} | {-1: False}
    assert found == wanted and 50 < sum(wanted.values()) < len(texts) - 50


def test_rules_sent_and_joined_agree(spark, monkeypatch):
    import cartolake.operators.rules as R
    from pyspark.sql import functions as F

    r = random.Random(4)
    rules = written("\n".join(f"{' '.join(r.choice(['', '!']) + f'f={r.randint(0, 12)}' for _ in range(r.randint(1, 3)))} -> o{k % 17}" for k in range(300)))
    rows = spark.createDataFrame([(k, [f"f={r.randint(0, 12)}" for _ in range(r.randint(0, 5))] + ["always"]) for k in range(200)], "id long, facts array<string>")
    table = conditions(spark, rules)
    both = lambda: (sorted(map(tuple, first_match(rows, "id", F.col("facts"), table).collect())), sorted(map(tuple, every_match(rows, "id", F.col("facts"), table).collect())))
    sent = both()
    monkeypatch.setattr(R, "MOST_CONDITIONS", 1)
    assert both() == sent and sum(o is not None for _, o in sent[0]) > 100


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("iki bin bes yuz lira, yirmi bes kisi", (25, 2500, None, None, None)),
        ("yuz elli tl", (None, 150, None, None, None)),
        ("we are two people with a budget of 1 thousand", (2, 1000, None, None, None)),
        ("saat 9 da, 4 saat", (None, None, 540, 240, None)),
        ("saat 18:45", (None, None, 1125, None, None)),
        ("12 am", (None, None, 0, None, None)),
        ("butun gun cok yuruyelim", (None, None, None, 600, "high")),
        ("alone, a short walk in the evening", (1, None, 1140, None, "low")),
        ("2 kisi 3 kisi", (2, None, None, None, None)),
        ("bir sey yok", (None, None, None, None, None)),
        ("", (None, None, None, None, None)),
    ],
)
def test_slots(text, found):
    from cartolake.functions.slots import slots

    assert slots(text) == found


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("daha ucuz bir kebapci", (True, False, None, "", "kebap")),
        ("yakinda kapali bir yer, kahveler", (False, True, True, "coffee", "yer")),
        ("acik hava olsun, deniz manzarali", (False, False, False, "sea", "acik,hava,manzara")),
        ("cheapest pide house close by", (True, True, None, "", "house,pide")),
        ("", (False, False, None, "", "")),
    ],
)
def test_wishes(text, found):
    from cartolake.functions.wishes import Vocabulary

    known = Vocabulary(("ucuz", "cheap"), ("yakin", "close"), ("kapali",), ("acikhava",), {"kahve": "coffee", "deniz": "sea"}, ("bir", "daha", "olsun"), ("lar", "ler", "ci", "li"))
    assert known.wish(text) == found
