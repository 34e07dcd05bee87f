"""Opening-hours strings, read by their grammar.

    text  := rule (';' rule)*        rule := [days ' '] (times | 'off' | 'closed')
    days  := range (',' range)*      range := day ['-' day]
    times := span (',' span)*        span  := time '-' time

A week is a list of spans for each day. What does not follow the grammar is not guessed at: the whole text then says nothing.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

DAYS = ("mo", "tu", "we", "th", "fr", "sa", "su")
DAY_END = 24 * 60
TOKEN = re.compile(r"\s*(?:(?P<day>[a-z]+)|(?P<time>\d{1,2}:\d{2})|(?P<sign>[-,;]))")


class Unreadable(ValueError):
    pass


class Reader:
    """A cursor over the tokens of one text."""

    def __init__(self, text: str):
        self.tokens: list[tuple[str, str]] = []
        at, text = 0, text.strip().lower()
        while at < len(text):
            m = TOKEN.match(text, at)
            if m is None:
                raise Unreadable(text)
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.tokens.append(("end", ""))

    def peek(self, kind: str, value: str | None = None) -> bool:
        return self.tokens[0][0] == kind and value in (None, self.tokens[0][1])

    def take(self, kind: str, value: str | None = None) -> str:
        if not self.peek(kind, value):
            raise Unreadable(self.tokens[0][1])
        return self.tokens.pop(0)[1]

    def skip(self, kind: str, value: str) -> bool:
        if self.peek(kind, value):
            self.tokens.pop(0)
            return True
        return False

    def listed(self, read) -> list:
        out = [read()]
        while self.skip("sign", ","):
            out.append(read())
        return out

    def minutes(self) -> int:
        hour, minute = map(int, self.take("time").split(":"))
        if minute > 59:
            raise Unreadable("minutes")
        return 60 * hour + minute

    def span(self) -> tuple[int, int]:
        """Opening and closing minute; the closing one may be the day's end, and at or before opening it is the next day's."""
        opens = self.minutes()
        self.take("sign", "-")
        closes = self.minutes()
        all_day = opens == 0 and closes == DAY_END
        if not (0 <= opens < DAY_END and 0 <= closes <= DAY_END) or (opens == closes % DAY_END and not all_day):
            raise Unreadable("span")
        return opens, closes % DAY_END

    def day(self) -> int:
        name = self.take("day")
        if name not in DAYS:
            raise Unreadable(name)
        return DAYS.index(name)

    def days(self) -> list[int]:
        first = self.day()
        last = self.day() if self.skip("sign", "-") else first
        return [(first + n) % 7 for n in range((last - first) % 7 + 1)]

    def rule(self) -> tuple[list[int], list[tuple[int, int]]]:
        named = self.peek("day") and self.tokens[0][1] in DAYS
        days = [d for part in self.listed(self.days) for d in part] if named else list(range(7))
        if named and (self.skip("day", "off") or self.skip("day", "closed")):
            return days, []
        return days, self.listed(self.span)

    def week(self) -> dict[int, list[tuple[int, int]]]:
        """Spans by day; the last rule that names a day holds for it."""
        out: dict[int, list[tuple[int, int]]] = {}
        while not self.peek("end"):
            if not self.skip("sign", ";"):
                days, spans = self.rule()
                out.update(dict.fromkeys(days, spans))
                if not self.peek("end"):
                    self.take("sign", ";")
        return out


def week(text: str | None) -> list[tuple[int, int, int]]:
    """(day 1 to 7, opening minute, closing minute); the day's end is minute 0. Empty for what is not understood."""
    if text is None or not text.strip():
        return []
    if text.strip() == "24/7":
        return [(d, 0, 0) for d in range(1, 8)]
    try:
        found = Reader(text).week()
    except Unreadable:
        return []
    return [(d + 1, opens, closes) for d in sorted(found) for opens, closes in found[d]]


def parsed(text: Column) -> Column:
    """Rows of a column of strings, as an array of day, opens, closes."""
    read = F.pandas_udf(lambda texts: texts.map(lambda t: [{"day": d, "opens": a, "closes": b} for d, a, b in week(t)]), "array<struct<day:int,opens:int,closes:int>>")
    return read(text)
