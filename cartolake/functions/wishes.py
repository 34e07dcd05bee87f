"""What a message wishes of a stop: cheaper, closer, under a roof or in the open, tags, and words to look for."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from cartolake.functions.text import fold

WORD = re.compile(r"[^\W_]+")


@dataclass(frozen=True)
class Vocabulary:
    """Beginnings of words that say something, tags by beginnings, words without a wish of their own, and endings that a
    word is looked for without, if `stem` letters are left."""

    cheap: tuple[str, ...]
    close: tuple[str, ...]
    roofed: tuple[str, ...]
    open_air: tuple[str, ...]
    tags: dict[str, str]
    filler: tuple[str, ...]
    endings: tuple[str, ...]
    least: int = 3
    stem: int = 4

    def wish(self, folded: str) -> tuple[bool, bool, bool | None, str, str]:
        """Cheaper, closer, indoor (None if not said), tags and words, both sorted and comma-joined."""
        words = WORD.findall(folded)
        joined = "".join(words)
        said = self.cheap + self.close + self.roofed + self.open_air
        tags, rest = set(), set()
        for w in words:
            if len(w) < self.least or w in self.filler or w.startswith(said):
                continue
            tag = next((t for x, t in self.tags.items() if w.startswith(x)), None)
            if tag is not None:
                tags.add(tag)
            else:
                rest.add(next((w[: -len(e)] for e in self.endings if w.endswith(e) and len(w) >= len(e) + self.stem), w))
        indoor = False if any(x in joined for x in self.open_air) else True if any(x in joined for x in self.roofed) else None
        return any(w.startswith(self.cheap) for w in words), any(w.startswith(self.close) for w in words), indoor, ",".join(sorted(tags)), ",".join(sorted(rest))


def with_wishes(texts: DataFrame, key: str, text: str, known: Vocabulary) -> DataFrame:
    """key, cheaper, closer, indoor, tags, words of every row; null texts wish for nothing."""
    rows = texts.select(key, fold(texts[text]).alias("folded"))
    names = [key, "cheaper", "closer", "indoor", "tags", "words"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [known.wish(t or "") for t in batch.column(1).to_pylist()]
            kinds = (pa.bool_(), pa.bool_(), pa.bool_(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([f[k] for f in found], kind) for k, kind in enumerate(kinds)]], names)

    return rows.mapInArrow(read, f"{key} {rows.schema[key].dataType.simpleString()}, cheaper boolean, closer boolean, indoor boolean, tags string, words string")
