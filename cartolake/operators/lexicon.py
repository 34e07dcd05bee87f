"""Foul language by automata over the folded text.

A lexicon has whole words, stems (beginnings of words), harmless words (beginnings that make a stem innocent) and joined ones,
which are looked for in a text whose spaces are left out. Letters are folded by one table of all code points, repeats are
dropped on whole arrays, and one pass of an automaton finds all entries at once, so a text is read once however long the
lexicon is.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cartolake.functions.text import STANDS, STANDS_FOR

KINDS = ("word", "stem", "harmless", "joined")
#: Most entries and letters of a lexicon, which goes to every task.
MOST_ENTRIES, MOST_LETTERS = 200_000, 4_000_000
#: Letters of texts that are looked through together.
CHUNK = 4 << 20


@cache
def _letters() -> np.ndarray:
    """What each code point is read as: a small letter, or a space."""
    out = np.full(0x110000, 32, np.uint32)
    for c in map(chr, range(0x110000)):
        if c.isalpha():
            small = {"\u0130": "i", "I": "\u0131"}.get(c) or c.lower()
            out[ord(c)] = ord(small[0])
    for c, read in zip(STANDS, STANDS_FOR, strict=True):
        out[ord(c)] = ord(read)
    for c in "IŞĞÜÖÇ":
        out[ord(c)] = out[out[ord(c)]]
    return out


def _once(codes: np.ndarray) -> np.ndarray:
    return codes[np.diff(codes, prepend=0xFFFFFFFF) != 0] if len(codes) else codes


def folded(text: str) -> tuple[str, str]:
    """The text's words, a space around each, repeats as one; and the same without spaces."""
    codes = _letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    words = _once(np.concatenate([[32], codes, [32]]).astype(np.uint32))
    return words.tobytes().decode("utf-32-le"), _once(words[words != 32]).tobytes().decode("utf-32-le")


class Lexicon:
    def __init__(self, entries: Iterable[tuple[str, str]]):
        """entries: (kind, entry); an entry is folded like a text, so that it may be given as it is written."""
        self.words, self.letters = ahocorasick.Automaton(), ahocorasick.Automaton()
        inside: dict[str, set[str]] = {}
        for kind, entry in entries:
            if kind not in KINDS:
                raise ValueError(f"no kind of entry: {kind}")
            spaced, joined = folded(entry)
            if not joined:
                continue
            if kind in ("joined", "harmless"):
                inside.setdefault(joined, set()).add(kind)
            if kind != "joined":
                pattern = spaced if kind == "word" else spaced[:-1]
                known = self.words.get(pattern, None)
                self.words.add_word(pattern, (len(pattern), frozenset({kind} | (known[1] if known else set()))))
        for joined, kinds in inside.items():
            self.letters.add_word(joined, frozenset(kinds))
        self.words.make_automaton()
        self.letters.make_automaton()

    def flags(self, text: str) -> bool:
        spaced, joined = folded(text)
        begun, innocent = set(), set()
        if len(self.words):
            for end, (size, kinds) in self.words.iter(spaced):
                if "word" in kinds:
                    return True
                begun |= {end - size} if "stem" in kinds else set()
                innocent |= {end - size} if "harmless" in kinds else set()
        if begun - innocent:
            return True
        found = set().union(*(kinds for _, kinds in self.letters.iter(joined))) if len(self.letters) else set()
        return "joined" in found and "harmless" not in found


def flagged(texts: DataFrame, key: str, text: str, lexicon: DataFrame) -> DataFrame:
    """key, flagged of every row: whether its whole text has a word, a word that begins like a stem and not like a harmless one, or a
    joined entry across spaces while nothing harmless stands there. Null texts are not flagged. lexicon: kind, entry."""
    entries = [(r["kind"], r["entry"]) for r in lexicon.select("kind", "entry").where("entry IS NOT NULL").distinct().limit(MOST_ENTRIES + 1).collect()]
    if len(entries) > MOST_ENTRIES or sum(len(e) for _, e in entries) > MOST_LETTERS:
        raise ValueError("the lexicon is too large to be sent to every task")
    entries.sort()

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        built = Lexicon(entries)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t is not None and built.flags(t) for t in batch.column(1).to_pylist()], pa.bool_())], [key, "flagged"])

    rows = texts.select(key, text)
    return rows.mapInArrow(look, f"{key} {rows.schema[key].dataType.simpleString()}, flagged boolean")
