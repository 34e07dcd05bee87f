"""What a request asks for in numbers: people, budget, start, length and walking, by a small grammar over folded words.

Numbers are digits or words of either language, put together by their places (iki bin bes yuz is 2500); what a number counts is
told by the word after it, or before it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from cartolake.functions.text import fold

#: Number words, what multiplies, and parts of the day in minutes.
UNITS = {w: n for words in ("sifir bir iki uc dort bes alti yedi sekiz dokuz", "zero one two three four five six seven eight nine") for n, w in enumerate(words.split())}
TENS = {w: 10 * n for words in ("on yirmi otuz kirk elli altmis yetmis seksen doksan", "ten twenty thirty forty fifty sixty seventy eighty ninety") for n, w in enumerate(words.split(), 1)}
TIMES = {"yuz": 100, "hundred": 100, "bin": 1000, "thousand": 1000}
PARTS = {"sabah": 540, "morning": 540, "ogleden sonra": 840, "afternoon": 840, "ogle": 720, "noon": 720, "aksam": 1140, "evening": 1140}
TOKEN = re.compile(r"[0-9]+(?:[.:][0-9]+)?k?|[a-z]+")
CLOCK = re.compile(r"([01]?[0-9]|2[0-3])(?:[.:]([0-5][0-9]))?\Z")


def numbers(tokens: list[str]) -> list[tuple[int, int, int]]:
    """(first, after the last, value) of the numbers in a text; a clock time like 14.30 is none."""
    out, i = [], 0
    while i < len(tokens):
        j, total, now, seen, digits = i, 0, 0, False, False
        while j < len(tokens):
            w = tokens[j]
            if re.fullmatch(r"[0-9]+k?", w) and not seen:
                now, digits = int(w.rstrip("k")) * (1000 if w.endswith("k") else 1), True
            elif w in TIMES:
                now = max(1, now) * TIMES[w]
                if TIMES[w] == 1000:
                    total, now = total + now, 0
            elif digits and w not in TIMES:
                break  # digits go on with hundreds and thousands only
            elif w in TENS and now % 100 == 0:
                now += TENS[w]
            elif w in UNITS and now % 10 == 0:
                now += UNITS[w]
            else:
                break
            seen = True
            j += 1
        if seen:
            out.append((i, j, total + now))
        i = max(j, i + 1)
    return out


def slots(folded: str) -> tuple[int | None, int | None, int | None, int | None, str | None]:
    """People, budget, start and length in minutes, and walking (low or high) of a folded text; None for what it does not say."""
    tokens = TOKEN.findall(folded)
    at = lambda i: tokens[i] if 0 <= i < len(tokens) else ""
    people = budget = start = length = None
    for a, b, value in numbers(tokens):
        after, before = at(b), at(a - 1)
        if after.startswith(("kisi", "people", "person")):
            people = people or value
        elif after in ("tl", "lira", "liraya", "try"):
            budget = budget or value
        elif after.startswith(("saatl", "hour")) or (after == "saat" and not CLOCK.match(at(b + 1))):
            length = length or 60 * value
        elif after in ("pm", "am") and 1 <= value <= 12:
            start = start if start is not None else value % 12 * 60 + 720 * (after == "pm")
        elif any(t.startswith(("butce", "budget")) for t in tokens[max(0, a - 3) : a]):
            budget = budget or value
        elif before == "saat" and value < 24:
            start = start if start is not None else 60 * value
    for i, t in enumerate(tokens):
        if t == "saat" and (m := CLOCK.match(at(i + 1))) and m[2]:
            start = 60 * int(m[1]) + int(m[2])
    if people is None:
        people = 2 if any(t.startswith(("esim", "sevgilim")) for t in tokens) else 1 if any(t in ("yalniz", "alone") for t in tokens) else None
    if start is None:
        start = next((minute for part, minute in PARTS.items() if part in folded), None)
    if length is None:
        length = 300 if "yarim gun" in folded or "half a day" in folded else 600 if "butun gun" in folded or "all day" in folded else None
    walks = [i for i, t in enumerate(tokens) if t.startswith(("yuru", "walk"))]
    told = {w for i in walks for w in tokens[max(0, i - 2) : i]}
    walking = "low" if told & {"az", "kisa", "little", "short"} else "high" if told & {"cok", "uzun", "long"} else None
    return people, budget, start, length, walking


def with_slots(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, people, budget, start, minutes, walking of every row; null texts say nothing."""
    rows = texts.select(key, fold(texts[text]).alias("folded"))
    names = [key, "people", "budget", "start", "minutes", "walking"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [slots(t or "") for t in batch.column(1).to_pylist()]
            columns = [pa.array([f[k] for f in found], kind) for k, kind in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names)

    return rows.mapInArrow(read, f"{key} {rows.schema[key].dataType.simpleString()}, people int, budget int, start int, minutes int, walking string")
