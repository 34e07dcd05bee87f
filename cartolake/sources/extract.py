"""Map extracts: files of compressed blocks of elements, as a Spark data source.

A file is a row of blocks, each a length (4 bytes), a checksum (4 bytes) and a zlib body. A body holds up to `block` elements
by column: ids, latitudes and longitudes as differences from the one before in zigzag varints (coordinates in units of 1e-7 degrees), time stamps likewise, a
table of the block's strings in order of first use, and of each element its tags as pairs of places in that table. Columns
that a query does not read are not decoded, nor are strings of tags that it does not name.

A folder holds part files; each is cut into partitions at block borders, so that a large file is read by many tasks. Writing
is by task attempt: a task writes its own file under a name of its own and reports it, and the commit renames the reported ones
and writes a list; readers read only what a list names, so an attempt that failed, or ran twice, leaves nothing.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from cartolake.sources.files import Files

SCHEMA = T.StructType().add("id", "long").add("version", "integer").add("lat", "double").add("lon", "double").add("changed", "long").add("tags", T.MapType(T.StringType(), T.StringType()))
#: Columns as they are laid out; a body starts with the lengths of their parts.
PARTS = ("id", "version", "lat", "lon", "changed", "strings", "tags")
UNIT = 1e7
BLOCK = 8000
#: Bytes of a partition, about.
SPLIT = 32 << 20
HEAD = struct.Struct("<II")


def varints(values: np.ndarray) -> bytes:
    """Numbers in groups of 7 bits, the lowest first, zigzag so that small negative ones stay short."""
    v = np.asarray(values, np.int64)
    z = ((v << 1) ^ (v >> 63)).astype(np.uint64)
    size = np.ones(len(z), np.int64)
    for k in range(1, 10):
        size += z >= np.uint64(1 << 7 * k)
    ends = np.cumsum(size)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k in range(int(size.max(initial=0))):
        has = size > k
        more = np.where(size[has] > k + 1, 128, 0).astype(np.uint8)
        out[(ends - size)[has] + k] = ((z[has] >> np.uint64(7 * k)) & np.uint64(127)).astype(np.uint8) | more
    return out.tobytes()


def numbers(raw: bytes) -> np.ndarray:
    """The numbers of varints(), all at once."""
    b = np.frombuffer(raw, np.uint8)
    if not len(b):
        return np.zeros(0, np.int64)
    last = b < 128
    if not last[-1]:
        raise ValueError("a number goes on beyond its part")
    starts = np.concatenate([[0], np.flatnonzero(last)[:-1] + 1])
    which = np.cumsum(np.concatenate([[0], last[:-1].astype(np.int64)]))
    bits = (b & 127).astype(np.uint64) << (7 * (np.arange(len(b)) - starts[which])).astype(np.uint64)
    z = np.add.reduceat(bits, starts)
    return (z >> np.uint64(1)).astype(np.int64) ^ -(z & np.uint64(1)).astype(np.int64)


def differences(values: np.ndarray) -> bytes:
    return varints(np.diff(values, prepend=0))


def encode(table: pa.Table) -> bytes:
    """One block, with its head."""
    col = lambda c, n: np.nan_to_num(table.column(c).to_numpy(zero_copy_only=False).astype(np.float64) * n).round().astype(np.int64)
    whole = lambda c: table.column(c).fill_null(0).to_numpy().astype(np.int64)
    missing = np.array(table.column("lat").is_null()) | np.array(table.column("lon").is_null())
    strings: dict[bytes, int] = {}
    tags: list[int] = []
    for row in table.column("tags").to_pylist():
        pairs = [] if row is None else row
        tags.append(-1 if row is None else len(pairs))
        for k, v in pairs:
            for s in (k, v):
                tags.append(-1 if s is None else strings.setdefault(s.encode(), len(strings)))
    text = varints(np.array([len(s) for s in strings], np.int64))
    parts = {
        "id": differences(whole("id")), "version": varints(whole("version")), "lat": differences(col("lat", UNIT)), "lon": differences(col("lon", UNIT)), "changed": differences(whole("changed")),
        "strings": struct.pack("<I", len(strings)) + struct.pack("<I", len(text)) + text + b"".join(strings), "tags": varints(np.array(tags, np.int64)),
    }
    nowhere = np.packbits(missing).tobytes()
    head = struct.pack("<II", table.num_rows, len(nowhere)) + nowhere + struct.pack(f"<{len(PARTS)}I", *(len(parts[p]) for p in PARTS))
    body = zlib.compress(head + b"".join(parts[p] for p in PARTS), 6)
    return HEAD.pack(len(body), zlib.crc32(body)) + body


def decode(body: bytes, columns: list[str]) -> dict[str, pa.Array]:
    """The wanted columns of a block's body."""
    raw = zlib.decompress(body)
    rows, bits = struct.unpack_from("<II", raw, 0)
    nowhere = np.unpackbits(np.frombuffer(raw, np.uint8, bits, 8))[:rows].astype(bool)
    sizes = struct.unpack_from(f"<{len(PARTS)}I", raw, 8 + bits)
    ends = np.cumsum([8 + bits + 4 * len(PARTS), *sizes]).tolist()
    part = {p: (ends[k], ends[k + 1]) for k, p in enumerate(PARTS)}
    of = lambda p: numbers(raw[slice(*part[p])])
    out: dict[str, pa.Array] = {}
    for c in columns:
        if c in ("lat", "lon"):
            out[c] = pa.array(np.cumsum(of(c)) / UNIT, mask=nowhere)
        elif c == "version":
            out[c] = pa.array(of(c).astype(np.int32))
        elif c == "tags":
            out[c] = _tags(raw[slice(*part["strings"])], of("tags"), rows)
        else:
            out[c] = pa.array(np.cumsum(of(c)))
    return out if columns else {"": pa.nulls(rows)}


def _tags(table: bytes, flat: np.ndarray, rows: int) -> pa.Array:
    count, size = struct.unpack_from("<II", table, 0)
    lengths = numbers(table[8 : 8 + size])
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    strings = pa.StringArray.from_buffers(count, pa.py_buffer(offsets.tobytes()), pa.py_buffer(table[8 + size :]))
    at, places, starts, null = 0, [], [0], []
    for _ in range(rows):
        n = int(flat[at])
        null.append(n < 0)
        n = max(n, 0)
        places.append(flat[at + 1 : at + 1 + 2 * n])
        starts.append(starts[-1] + n)
        at += 1 + 2 * n
    every = np.concatenate(places) if places else np.zeros(0, np.int64)
    take = lambda x: strings.take(pa.array(np.maximum(x, 0), mask=x < 0)) if count else pa.nulls(len(x), pa.string())
    offsets = pa.array(np.array(starts, np.int32), mask=np.array([*null, False]))
    return pa.MapArray.from_arrays(offsets, take(every[0::2]), take(every[1::2]))


class Blocks(InputPartition):
    """Blocks that begin from `start` up to `end` of a file."""

    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


class ExtractSource(DataSource):
    """spark.read.format("extract").load(folder); options: split (bytes of a partition), columns (comma-joined, all by default), block (rows, writing)."""

    @classmethod
    def name(cls) -> str:
        return "extract"

    def schema(self) -> T.StructType:
        wanted = self.options.get("columns")
        return SCHEMA if wanted is None else T.StructType([SCHEMA[c.strip()] for c in wanted.split(",") if c.strip()])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return ExtractReader(schema, self.options)

    def writer(self, schema: T.StructType, overwrite: bool) -> ExtractWriter:
        return ExtractWriter(schema, self.options, overwrite)


class ExtractReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict):
        self.columns, self.root, self.split = schema.fieldNames(), options["path"], int(options.get("split", SPLIT))

    def partitions(self) -> list[InputPartition]:
        """Runs of blocks of every file that a commit's list names; the lists have the blocks' places, so no file is read here."""
        files, out = Files(self.root), []
        for name in sorted(f for f in files.names() if f.endswith(".list")):
            for entry in json.loads(files.read(name)):
                ends, start = entry["ends"], 0
                for k, end in enumerate(ends):
                    if end - start >= self.split or k + 1 == len(ends):
                        out.append(Blocks(entry["file"], start, end))
                        start = end
        return out or [Blocks("", 0, 0)]

    def read(self, partition: Blocks) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        with Files(self.root).open(partition.path) as f:
            f.seek(partition.start)
            while f.tell() < partition.end:
                size, check = HEAD.unpack(f.read(HEAD.size))
                body = f.read(size)
                if len(body) < size or zlib.crc32(body) != check:
                    raise OSError(f"a damaged block before byte {f.tell()} of {partition.path}")
                made = decode(body, self.columns)
                yield pa.RecordBatch.from_arrays([made[c] for c in self.columns], self.columns) if self.columns else pa.RecordBatch.from_arrays([made[""]], [""])


class Written(WriterCommitMessage):
    def __init__(self, file: str, ends: list[int], rows: int):
        self.file, self.ends, self.rows = file, ends, rows


class ExtractWriter(DataSourceArrowWriter):
    """Bounded blocks by task; only files that their tasks have reported are made part of the folder."""

    def __init__(self, schema: T.StructType, options: dict, overwrite: bool):
        self.names, self.root, self.overwrite, self.block = schema.fieldNames(), options["path"], overwrite, int(options.get("block", BLOCK))
        if self.names != SCHEMA.fieldNames():
            raise ValueError(f"the columns of an extract are {', '.join(SCHEMA.fieldNames())}")

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        files, name, ends, rows = Files(self.root), f"attempt-{uuid.uuid4().hex}", [], 0
        with files.create(name) as f:
            at, held, waiting = 0, [], 0
            for batch in batches:
                held.append(batch)
                waiting += batch.num_rows
                rows += batch.num_rows
                while waiting >= self.block:
                    table = pa.Table.from_batches(held)
                    at += f.write(encode(table.slice(0, self.block)))
                    ends.append(at)
                    held, waiting = table.slice(self.block).to_batches(), waiting - self.block
            if waiting:
                at += f.write(encode(pa.Table.from_batches(held)))
                ends.append(at)
        return Written(name, ends, rows)

    def commit(self, messages: list[Written | None]) -> None:
        """Names the reported files in one new list, which makes them all visible at once; an overwrite then drops the lists before."""
        files = Files(self.root)
        before = [f for f in files.names() if f.endswith(".list")] if self.overwrite else []
        old = [e["file"] for name in before for e in json.loads(files.read(name))]
        files.write(f"{uuid.uuid4().hex}.list", json.dumps([{"file": m.file, "ends": m.ends, "rows": m.rows} for m in messages if m and m.rows]).encode())
        for name in (*before, *old):
            files.delete(name)
        for m in messages:
            if m and not m.rows:
                files.delete(m.file)

    def abort(self, messages: list[Written | None]) -> None:
        """Drops what tasks had reported; files of attempts that never reported are in no list and are read by nobody."""
        for m in messages:
            if m:
                Files(self.root).delete(m.file)
