"""Language identification by a convolutional network over bytes, trained in numpy.

Filters of several widths slide over fixed windows of bytes; the best answer of each filter in a window (max pooling) feeds
a softmax over the languages. Bytes enter as one-hot vectors, so a convolution is a sum of table rows. A document's
probabilities are the mean over all windows of its whole text.

Training takes windows of at most `sample` labelled documents (the documented bound; by hash of id, then of text, so the same
ones at each run; rows that agree in both count once), which is all that reaches the driver; the trained weights, a few tens of kilobytes, go out with the tasks.

Defined cases: null texts and texts without a letter are `und` with score 0; without labelled documents every text is;
rows with a null id are never held out, and repeated rows give repeated results; texts are read to their end, however long.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartolake.llm.common import bounded_batches, released, slices, utf8

WINDOW = 128
WIDTHS = (2, 3, 4)
FILTERS = 16
SAMPLE = 3000
WINDOWS_EACH = 6
UNKNOWN = "und"


@dataclass
class ByteNet:
    languages: list[str]
    filters: list[np.ndarray]  # of each width: width x 256 x FILTERS
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def prepared(self) -> list[np.ndarray]:
        """Filter tables by pairs of bytes, which halve the look-ups."""
        two, three, four = self.filters
        pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(65536, -1).astype(np.float32)
        return [pair(two[0], two[1]), pair(three[0], three[1]), three[2].astype(np.float32), pair(four[0], four[1]), pair(four[2], four[3])]

    def probabilities(self, windows: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
        """Softmax of each window (rows of WINDOW bytes)."""
        pooled = np.empty((len(windows), FILTERS * len(WIDTHS)), np.float32)
        for a in range(0, len(windows), 128):
            x = windows[a : a + 128]
            pairs = (x[:, :-1].astype(np.uint16) << 8) | x[:, 1:]
            pooled[a : a + 128, :FILTERS] = tables[0][pairs].max(axis=1)
            z = tables[1][pairs[:, :-1]]
            z += tables[2][x[:, 2:]]
            pooled[a : a + 128, FILTERS : 2 * FILTERS] = z.max(axis=1)
            z = tables[3][pairs[:, :-2]]
            z += tables[4][pairs[:, 2:]]
            pooled[a : a + 128, 2 * FILTERS :] = z.max(axis=1)
        return softmax(np.maximum(pooled + self.bias, 0) @ self.out + self.out_bias)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(windows: np.ndarray, labels: np.ndarray, languages: list[str], epochs: int = 5, batch: int = 256, rate: float = 0.01, seed: int = 5) -> ByteNet:
    """Adam on the cross entropy; gradients of max pooling reach only the winning places."""
    rng = np.random.default_rng(seed)
    size = FILTERS * len(WIDTHS)
    params = [rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
    params += [np.zeros(size, np.float32), rng.normal(0, 0.2, (size, len(languages))).astype(np.float32), np.zeros(len(languages), np.float32)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step = 0
    for _ in range(epochs):
        shuffled = rng.permutation(len(windows))
        for a in range(0, len(shuffled), batch):
            x, y = windows[shuffled[a : a + batch]], labels[shuffled[a : a + batch]]
            pooled, places = [], []
            for w, f in zip(WIDTHS, params, strict=False):
                z = f[0][x[:, : WINDOW - w + 1]]
                for j in range(1, w):
                    z += f[j][x[:, j : WINDOW - w + 1 + j]]
                at = z.argmax(axis=1)
                places.append(at)
                pooled.append(np.take_along_axis(z, at[:, None, :], 1)[:, 0, :])
            h = np.concatenate(pooled, axis=1) + params[3]
            active = np.maximum(h, 0)
            p = softmax(active @ params[4] + params[5])
            p[np.arange(len(y)), y] -= 1
            p /= len(y)
            back = (p @ params[4].T) * (h > 0)
            grads = []
            for k, w in enumerate(WIDTHS):
                g = np.zeros_like(params[k])
                part = back[:, k * FILTERS : (k + 1) * FILTERS]
                for j in range(w):
                    byte = np.take_along_axis(x, places[k] + j, 1)
                    np.add.at(g[j], (byte, np.broadcast_to(np.arange(FILTERS), byte.shape)), part)
                grads.append(g)
            grads += [back.sum(axis=0), active.T @ p, p.sum(axis=0)]
            step += 1
            for i, g in enumerate(grads):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                params[i] = params[i] - rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-6)
    return ByteNet(languages, params[:3], params[3], params[4], params[5])


def held_out(id_col: str = "doc_id") -> Column:
    """Documents that are never learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> ByteNet | None:
    """Trains on windows of at most `sample` labelled documents that are not held out."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"), docs[lang_col].alias("lang"))
    usable = rows.where(F.col("id").isNotNull() & F.col("lang").isNotNull() & ~held_out("id")).withColumn("h", F.xxhash64("text"))
    chosen = usable.select("id", "h").distinct().orderBy(F.xxhash64("id"), "id", "h").limit(sample)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        released()
        for batch in batches:
            keys, langs, parts = [], [], []
            for key, text, lang in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = (text or "").encode()
                if not any(c.isalpha() for c in text or ""):
                    continue
                last = max(0, len(raw) - WINDOW)
                for at in sorted({last * k // max(1, WINDOWS_EACH - 1) for k in range(WINDOWS_EACH)}):
                    keys.append(f"{key}:{at}")
                    langs.append(lang)
                    parts.append(raw[at : at + WINDOW].ljust(WINDOW, b"\0"))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(langs, pa.string()), pa.array(parts, pa.binary())], ["key", "lang", "part"])

    once = usable.join(F.broadcast(chosen), ["id", "h"], "left_semi").groupBy("id", "h").agg(F.min(F.struct("text", "lang")).alias("row"))
    found = once.select("id", "row.text", "row.lang").mapInArrow(cut, "key string, lang string, part binary").toPandas()
    if found.empty:
        return None
    found = found.sort_values(["key", "lang", "part"], kind="stable")
    languages = sorted(found["lang"].unique())
    windows = np.frombuffer(b"".join(map(bytes, found["part"])), np.uint8).reshape(-1, WINDOW)
    return train(windows, np.searchsorted(languages, found["lang"]), languages)


def windows_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All windows of texts laid end to end, the last of each padded with zeros, and the row of each."""
    lengths = np.diff(offsets)
    count = np.maximum(1, -(-lengths // WINDOW))
    first = np.cumsum(count) - count
    out = np.zeros(int(count.sum()) * WINDOW, np.uint8)
    out[np.arange(len(data)) + np.repeat(first * WINDOW - offsets[:-1], lengths)] = data
    return out.reshape(-1, WINDOW), np.repeat(np.arange(len(lengths)), count)


def lettered(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows whose text has a letter."""

    @F.pandas_udf("boolean")
    def has(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: any(c.isalpha() for c in t or ""))

    bounded_batches(docs.sparkSession)
    return docs.where(has(text_col))


def predict(docs: DataFrame, net: ByteNet | None, id_col: str = "doc_id", text_col: str = "text", carried: tuple[str, ...] = ()) -> DataFrame:
    """id, carried columns, lang_pred, score of every document."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(docs[text_col].alias("text"), docs[id_col].alias("id"), *[docs[c].alias(f"c{i}") for i, c in enumerate(carried)])
    fields = rows.schema.fields[1:]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        released()
        tables = net.prepared() if net else []
        for batch in batches:
            known = np.array([any(c.isalpha() for c in t) if t else False for t in batch.column(0).to_pylist()], bool)
            names, scores = np.full(len(known), UNKNOWN, object), np.zeros(len(known))
            if net and len(known):
                data, offsets = utf8(batch.column(0))
                for a, b in slices(np.diff(offsets), 1 << 20):
                    windows, row = windows_of(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                    total = np.zeros((b - a, len(net.languages)))
                    np.add.at(total, row, net.probabilities(windows, tables))
                    mean = total / np.bincount(row, minlength=b - a)[:, None]
                    names[a:b] = np.array(net.languages, object)[mean.argmax(axis=1)]
                    scores[a:b] = np.clip(mean.max(axis=1), 0, 1)
                names[~known], scores[~known] = UNKNOWN, 0.0
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*batch.schema.names[1:], "lang_pred", "score"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields) + ", lang_pred string, score double"
    found = rows.mapInArrow(work, schema)
    return found.select(F.col("id").alias(id_col), *[F.col(f"c{i}").alias(c) for i, c in enumerate(carried)], "lang_pred", "score")
