"""Chat formatting from event logs.

A conversation is a log of events: whole messages, streamed deltas, edits and regenerations. The log is partitioned by
conversation and message, sorted by sequence and folded into final messages; these are partitioned by conversation, sorted
by place and rendered. Both folds read sorted partitions a row at a time and keep only the message at hand, so a
conversation of any length passes through.

Template: each turn is `<|turn|>role<|text|>text<|end|>`, a conversation is its turns laid end to end, and the loss mask
covers the text of assistant turns. In roles and texts a dot is put behind every `<` and `[`. Control strings, those of the
template and those of other chat formats (`</s>`, `[INST]` and the like), start with one of the two and go on with another
character than a dot, so none is left in a text: it can't open, close or fake a turn, and no tokenizer reads it as a control
token. Taking the dots out again undoes it.

log_of() writes whole turns as such a log: assistant turns are streamed in parts, and by the hash of their key a third of
all messages are posted as a draft and edited, and a third drafted in parts and generated anew.

Defined cases: null role or text counts as empty; rows with a null conversation form one conversation of their own; null
turns come first; rows that tie in turn are in the order of role and text; repeated rows are repeated turns; an empty table
gives the added conversation only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartolake.llm.common import bounded_batches, shuffle_partitions

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Characters with which control strings start, and what is put behind them in texts.
OPENERS, GUARD = "<[", "."
#: Characters of a streamed part.
PART = 1024
LEARNED = "assistant"
#: Length of a turn's place in the keys that log_of() makes.
PLACE = 21


def escaped(text: str) -> str:
    for c in OPENERS:
        text = text.replace(c, c + GUARD)
    return text


def unescaped(text: str) -> str:
    for c in OPENERS:
        text = text.replace(c + GUARD, c)
    return text


def rendered(role: str, text: str) -> str:
    return f"{TURN}{escaped(role)}{TEXT}{escaped(text)}{END}"


def read_back(formatted: str) -> Iterator[tuple[str, str, int, int]]:
    """(role, text, start, end) of each turn, start and end being the place of the text in the formatted string.

    The marks are looked for one after the other; escaped text holds none of them.
    """
    at = 0
    while at < len(formatted):
        role = at + len(TURN)
        middle = formatted.find(TEXT, role)
        start = middle + len(TEXT)
        end = formatted.find(END, start)
        if not formatted.startswith(TURN, at) or middle < 0 or end < 0:
            raise ValueError("not a formatted conversation")
        yield unescaped(formatted[role:middle]), unescaped(formatted[start:end]), start, end
        at = end + len(END)


def folded(events: Iterator[tuple[str, str, str]]) -> tuple[str, str]:
    """Final (role, text) of one message from its events (kind, role, text), in order.

    message and edit set the text, delta appends to it, regenerate starts it anew.
    """
    role, parts = "", []
    for kind, who, text in events:
        role = who or role
        if kind == "delta":
            parts.append(text)
        else:
            parts = [text]
    return role, "".join(parts)


def messages(events: DataFrame) -> DataFrame:
    """conv_id, place, role, text of the final messages; events: conv_id, message, seq, kind, role, text."""
    spark = events.sparkSession
    bounded_batches(spark)
    key = events.schema["conv_id"].dataType.simpleString()
    place = events.schema["message"].dataType.simpleString()
    rows = events.select("conv_id", "message", "seq", "kind", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartition(shuffle_partitions(spark), "conv_id", "message").sortWithinPartitions("conv_id", "message", "seq", "kind", "role", "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: tuple | None = None
        held: list[tuple[str, str, str]] = []
        for batch in batches:
            out = []
            for conv, message, _, kind, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if open_ != (conv, message):
                    if open_ is not None:
                        out.append((*open_, *folded(iter(held))))
                    open_, held = (conv, message), []
                if kind != "delta":  # what came before no longer matters
                    held = [("message", next((r for _, r, _ in [(kind, role, text), *held[::-1]] if r), ""), text)]
                else:
                    held.append((kind, role, text))
            yield from _table(out, batch.schema.types[0], batch.schema.types[1])
            kinds = batch.schema.types[:2]
        if open_ is not None:
            yield from _table([(*open_, *folded(iter(held)))], *kinds)

    return rows.mapInArrow(work, f"conv_id {key}, place {place}, role string, text string")


def _table(rows: list[tuple], conv: pa.DataType, place: pa.DataType) -> Iterator[pa.RecordBatch]:
    if rows:
        c = list(zip(*rows, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(c[0], conv), pa.array(c[1], place), pa.array(c[2], pa.string()), pa.array(c[3], pa.string())], ["conv_id", "place", "role", "text"])


def log_of(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows of whole turns as a log of deltas, edits and regenerations whose fold gives the turns back.

    Rows that tie in turn stay messages of their own, in the order of role and text.
    """
    rows = conversations.select(conversations[conv_col].alias("conv_id"), conversations[turn_col].alias("turn"), F.coalesce(conversations[role_col], F.lit("")).alias("role"), F.coalesce(conversations[text_col], F.lit("")).alias("text"))
    same = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("n"))
    each = same.select("conv_id", "turn", "role", "text", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("copy"))
    # The key's first PLACE characters sort like the turn, null first; the rest tells rows of one turn apart.
    shifted = (F.col("turn").cast("decimal(20,0)") + F.lit(str(1 << 63)).cast("decimal(20,0)")).cast("string")
    place = F.when(F.col("turn").isNull(), F.lpad(F.lit(""), PLACE, "0")).otherwise(F.concat(F.lit("1"), F.lpad(shifted, PLACE - 1, "0")))
    message = F.concat(place, F.sha2(F.concat_ws("\0", "role", "text"), 256), F.lpad(F.col("copy").cast("string"), 10, "0"))
    each = each.select("conv_id", message.alias("message"), "role", "text").withColumn("way", F.pmod(F.xxhash64("message"), F.lit(3)))

    def event(kind: str, text: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), text.alias("text"))

    none, text, way = F.lit(""), F.col("text"), F.col("way")
    draft = F.substring(text, F.lit(1), F.floor(F.length(text) / 2).cast("int"))
    # A pattern cuts a text in one pass; substrings would count from its start each time.
    parts = lambda t: F.transform(F.regexp_extract_all(t, F.lit(f"(?s).{{1,{PART}}}"), F.lit(0)), lambda p: event("delta", p))
    streamed = F.concat(F.array(event("message", none)), parts(text))
    edited = F.array(event("message", draft), event("edit", text))
    anew = F.concat(F.array(event("message", none)), parts(draft), F.array(event("regenerate", none)), parts(text))
    plain = F.when(F.col("role") == LEARNED, streamed).otherwise(F.array(event("message", text)))
    log = each.select("conv_id", "message", "role", F.posexplode(F.when(way == 0, plain).when(way == 1, edited).otherwise(anew)).alias("seq", "event"))
    # The opening event names the role; what follows belongs to it.
    return log.select("conv_id", "message", "seq", "event.kind", F.when(F.col("seq") == 0, F.col("role")).alias("role"), "event.text")


def segments(final: DataFrame) -> DataFrame:
    """conv_id, place, role, text, segment: each message with its rendered turn."""

    def esc(column: str) -> Column:
        out = F.col(column)
        for c in OPENERS:
            out = F.replace(out, F.lit(c), F.lit(c + GUARD))
        return out

    return final.withColumn("segment", F.concat(F.lit(TURN), esc("role"), F.lit(TEXT), esc("text"), F.lit(END)))


def in_turn() -> tuple:
    """Order of messages from log_of(): by turn, then role and text."""
    return F.substring("place", 1, PLACE), "role", "text", "place"


def digests(turns: DataFrame, order: tuple = ("place",)) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from the rendered turns."""
    spark = turns.sparkSession
    bounded_batches(spark)
    key = turns.schema["conv_id"].dataType.simpleString()
    rows = turns.repartition(shuffle_partitions(spark), "conv_id").sortWithinPartitions("conv_id", *order).select("conv_id", "segment")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: list | None = None
        kind = None

        def done() -> list[tuple]:
            return [(state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5])] if state else []

        def out(found: list[tuple]) -> Iterator[pa.RecordBatch]:
            if found:
                c = list(zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c[0], kind), pa.array(c[1], pa.int64()), pa.array(c[2], pa.string()), pa.array(c[3], pa.int64()), pa.array(c[4], pa.string()), pa.array(c[5], pa.int64())], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for batch in batches:
            kind, found = batch.schema.types[0], []
            for conv, segment in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if state is None or state[0] != conv:
                    found += done()
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text, _, _ in read_back(segment):
                    state[1] += 1
                    state[2].update(f"{role}\n{text}\n".encode())
                    if role == LEARNED:
                        state[3] += len(text)
                        state[4].update(text.encode())
                state[5] += len(segment)
            yield from out(found)
        yield from out(done())

    return rows.mapInArrow(work, f"conv_id {key}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def formatted(turns: DataFrame, order: tuple = ("place",)) -> DataFrame:
    """conv_id, formatted: whole conversations as one string each, for conversations that fit into one."""
    keys = [(F.col(c) if isinstance(c, str) else c).alias(f"o{i}") for i, c in enumerate(order)]
    parts = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(*keys, "segment"))).alias("parts"))
    return parts.select("conv_id", F.array_join(F.col("parts.segment"), "").alias("formatted"))


PROBE = "</s>[INST] ok [/INST]"


def oracle() -> str:
    return f"""
        WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                   UNION ALL SELECT -1, 0, 'user', '{PROBE}' UNION ALL SELECT -1, 1, 'assistant', '{PROBE}')
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (role = '{LEARNED}'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = '{LEARNED}'), '')) AS loss_sha256,
               CAST(sum(length(replace(replace(role, '<', '<.'), '[', '[.')) + length(replace(replace(text, '<', '<.'), '[', '[.')) + {len(TURN + TEXT + END)}) AS BIGINT) AS formatted_chars
        FROM c GROUP BY conv_id"""
