"""Secret scans: fixed patterns, and a token-efficiency test for random strings that no pattern names.

Ordinary words take one token for several characters of a subword vocabulary; random strings take a token for every one or
two. Characters per token decide for every run of visible characters: it counts as a secret of kind `random` if they are below a limit that rises
with the run's length (a short run's ratio says less), it does not overlap a patterned span, and it is neither a digest of a known
length nor an identifier (UUID, number, mail address, short words and numbers joined by marks). No length, digit or letter is asked for.

Defined cases: null text counts as empty and has no spans; every row gives one row, repeated ids included; offsets are code
points, the end exclusive; whole texts are scanned, however long; only id and text are read, so other columns can't clash.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartolake.llm.common import bounded_batches, released, texts

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: The patterned kinds, in their order.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
LEAST_VALUE = 8

#: Runs that the token-efficiency test looks at: visible ASCII without quotes, brackets and what stands between names and values;
#: padding at the end belongs to a run, other marks around it do not.
RUN = re.compile(r"[A-Za-z0-9+/_.$%@#!^*~-]+(?:={1,2}(?![A-Za-z0-9+/_=-]))?")
MARKS = ".!*~^%#@/+-_"
#: Characters per token that a run of n characters must stay below: MOST - NOISE / n. The ratio of a short run says less, so it has to
#: be lower; for runs of up to five characters the limit is below 1, which no ratio is.
MOST, NOISE = 2.2, 7.0
DIGEST_LENGTHS = frozenset((32, 40, 48, 56, 64, 96, 128))
DIGEST = re.compile(r"[0-9a-f]+\Z|[0-9A-F]+\Z")
UUID = re.compile(r"(?i:[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12})\Z")
#: Identifiers: numbers, short words or a few letters with a number, joined by marks; a number alone; a mail address.
PART = r"(?:[0-9]+|[a-z]{1,8}|[A-Z]{1,8}|[A-Z][a-z]{1,8}|[A-Za-z]{1,4}[0-9]{1,4})"
NAME = re.compile(rf"{PART}(?:[-_/.+#@]+{PART})+\Z|[0-9]+\Z|[A-Za-z0-9._+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z]+)+\Z")
#: One mark over and over, which belongs to no word.
REPEATED = re.compile(r"([^A-Za-z0-9])\1{2,}")
BLOCK = 2048
#: Words whose answer a task remembers; beyond that it starts anew, which changes no answer.
REMEMBERED = 200_000

_LOADED: dict[str, tiktoken.Encoding] = {}


def vocabulary(path: str = VOCABULARY) -> tiktoken.Encoding:
    if path not in _LOADED:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _LOADED[path] = tiktoken.Encoding("scan", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[path]


def chars_per_token(value: str, tool: tiktoken.Encoding) -> float:
    """Long values are measured in blocks, which bounds the cost of one call."""
    tokens = sum(len(tool.encode_ordinary(value[i : i + BLOCK])) for i in range(0, len(value), BLOCK))
    return len(value) / max(1, tokens)


def is_known(value: str) -> bool:
    """Digests of known lengths and identifiers."""
    bare = value.rstrip("=")
    return bool(DIGEST.match(bare) and len(bare) in DIGEST_LENGTHS) or bool(UUID.match(bare)) or bool(NAME.match(bare))


class Efficiency:
    """Whether a run takes too many tokens, with what was asked before."""

    def __init__(self, tool: tiktoken.Encoding):
        self.tool, self.asked = tool, {}

    def __call__(self, value: str) -> bool:
        if (known := self.asked.get(value)) is None:
            known = chars_per_token(value, self.tool) < MOST - NOISE / len(value) and not is_known(value)
            if len(value) <= 24:
                if len(self.asked) >= REMEMBERED:
                    self.asked.clear()
                self.asked[value] = known
        return known


def patterned(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place, end) of the patterned spans."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def runs(text: str) -> Iterator[tuple[int, int]]:
    """Start and end of the runs that can be too short for their tokens; a mark repeated cuts a run."""
    least = NOISE / (MOST - 1)
    for m in RUN.finditer(text):
        if m.end() - m.start() <= least:
            continue
        start = m.start()
        for cut in (*REPEATED.finditer(text, m.start(), m.end()), None):
            end = cut.start() if cut else m.end()
            part = text[start:end]
            a, b = start + len(part) - len(part.lstrip(MARKS)), start + len(part.rstrip(MARKS))
            if b - a > least:
                yield a, b
            start = cut.end() if cut else end


def improbable(text: str, taken: list[tuple[int, int, int]], inefficient: Efficiency) -> list[tuple[int, int, int]]:
    """Spans of the token-efficiency test that do not overlap those already taken, which are in order of their starts.

    Runs come in order too and are apart, so one sweep over both lists tells where the taken ones reach.
    """
    found, at, reach = [], 0, 0
    for a, b in runs(text):
        if not inefficient(text[a:b]):
            continue
        while at < len(taken) and taken[at][0] < b:
            reach = max(reach, taken[at][2])
            at += 1
        if reach <= a:
            found.append((a, 3, b))
    return found


SPANS = "array<struct<kind:string,start:int,end:int>>"
_SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = VOCABULARY, redact: str | None = None, carried: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: id, base spans, all spans, carried columns; with `redact`, also the text with every span replaced by it."""
    bounded_batches(docs.sparkSession)
    names = (*KINDS, "random")
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"), *[docs[c].alias(f"c{i}") for i, c in enumerate(carried)])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        released()
        inefficient = Efficiency(vocabulary(path))
        for batch in batches:
            base, every, clean = [], [], []
            for text in texts(batch.column(1)):
                first = patterned(text)
                spans = sorted(first + improbable(text, first, inefficient))
                base.append([{"kind": names[k], "start": a, "end": b} for a, k, b in first])
                every.append([{"kind": names[k], "start": a, "end": b} for a, k, b in spans])
                if redact is not None:
                    parts, at = [], 0
                    for a, _, b in spans:
                        if b > at:
                            parts += [text[at : max(a, at)], redact] if a >= at else []
                            at = b
                    clean.append("".join(parts) + text[at:])
            columns = [batch.column(0), pa.array(base, _SPAN_TYPE), pa.array(every, _SPAN_TYPE)]
            extra = [pa.array(clean, pa.string())] if redact is not None else []
            yield pa.RecordBatch.from_arrays([*columns, *extra, *batch.columns[2:]], ["id", "base", "spans", *["redacted"] * len(extra), *batch.schema.names[2:]])

    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields]
    out = rows.mapInArrow(work, ", ".join([kinds[0], f"base {SPANS}", f"spans {SPANS}", *["redacted string"] * (redact is not None), *kinds[2:]]))
    return out.withColumnsRenamed({"id": id_col} | {f"c{i}": c for i, c in enumerate(carried)})


def written(spans: str) -> Column:
    """kind:start:end, comma-joined, in the order of the array."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def count_of(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
