"""Language identification by a byte convolutional network: filters of several widths, max pooling and softmax.

Trained by numpy on a bounded sample of labelled windows; applied to all windows of fixed length that cover a whole text.
A text's language is that of the highest mean probability over its windows, weighted by their letters.

A null text, or one without any letter, is `und` with score 0. Without labelled rows every text is. Ties go to the
language that sorts first. Long texts are read whole, a piece at a time. Repeated rows are judged alike, rows without doc_id
too; an empty table gives no rows. Labelled rows without a language or text teach nothing. Other columns, whatever their names,
are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import arrow_batches, bounded_sample, trimmed
from assayer.llm.textwords import PIECE

#: Bytes of a window; widths of the filters, and how many of each.
LENGTH, WIDTHS, FILTERS = 256, (2, 3, 4), 12
#: Labelled documents used of each language at most, and windows of each document.
SAMPLE_DOCS, SAMPLE_WINDOWS = 800, 3
EPOCHS, RATE, BATCH, SEED = 12, 0.01, 64, 11

#: Lower case for A-Z; one class for all that is no letter in ASCII.
_CLASS = np.full(256, 32, np.uint8)
_CLASS[97:123] = np.arange(97, 123)
_CLASS[65:91] = np.arange(97, 123)
_CLASS[128:] = np.arange(128, 256)
_LETTER = _CLASS != 32


class Net:
    """kernel[k]: what the byte k places after a filter's first adds to each filter that is wider than k (the widest come first)."""

    def __init__(self, languages: list[str], seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.languages, wide = languages, sorted(WIDTHS, reverse=True)
        self.size = FILTERS * len(wide)
        self.kernel = [rng.normal(0, 0.2, (256, FILTERS * sum(w > k for w in wide))).astype(np.float32) for k in range(wide[0])]
        self.bias = np.zeros(self.size, np.float32)
        self.out = rng.normal(0, 0.2, (self.size, len(languages))).astype(np.float32)
        self.last = np.zeros(len(languages), np.float32)

    def params(self) -> list[np.ndarray]:
        return [*self.kernel, self.bias, self.out, self.last]

    def maps(self, x: np.ndarray) -> np.ndarray:
        """The filters' responses at each place of each window."""
        places = x.shape[1] - len(self.kernel) + 1
        total = self.kernel[0][x[:, :places]]
        for k, table in enumerate(self.kernel[1:], 1):
            total[:, :, : table.shape[1]] += table[x[:, k : k + places]]
        return total

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        pooled = np.maximum(self.maps(x).max(axis=1) + self.bias, 0)
        z = pooled @ self.out + self.last
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        maps = self.maps(x)
        best = maps.argmax(axis=1)
        pooled = np.take_along_axis(maps, best[:, None], 1)[:, 0] + self.bias
        hidden = np.maximum(pooled, 0)
        z = hidden @ self.out + self.last
        e = np.exp(z - z.max(axis=1, keepdims=True))
        d = e / e.sum(axis=1, keepdims=True)
        d[np.arange(len(y)), y] -= 1
        d /= len(y)
        back = (d @ self.out.T) * (pooled > 0)
        kernel = []
        for k, table in enumerate(self.kernel):
            g = np.zeros_like(table)
            n = table.shape[1]
            byte = np.take_along_axis(x, best[:, :n] + k, 1)
            np.add.at(g, (byte, np.arange(n)[None, :]), back[:, :n])
            kernel.append(g)
        return [*kernel, back.sum(axis=0), hidden.T @ d, d.sum(axis=0)]


def windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows that cover all of each text, their text and their letters."""
    data = _CLASS[np.frombuffer(b"".join(texts), np.uint8)]
    size = np.array([len(t) for t in texts])
    start = np.cumsum(size) - size
    n = -(-size // LENGTH)
    own = np.repeat(np.arange(len(texts)), n)
    first = start[own] + LENGTH * (np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n))
    at = first[:, None] + np.arange(LENGTH)
    x = np.concatenate([data, np.full(LENGTH, 32, np.uint8)])[np.minimum(at, len(data))]
    x[at >= (start + size)[own][:, None]] = 32
    return x, own, _LETTER[x].sum(axis=1)


def train(texts: list[str], langs: list[str]) -> Net:
    """Adam over the windows of labelled texts, in an order fixed by the seed."""
    names = sorted(set(langs))
    net = Net(names)
    x, own, letters = windows([t.encode("utf-8", "replace") for t in texts])
    x, own = x[letters > 0], own[letters > 0]
    y = np.array([names.index(v) for v in langs])[own]
    rng = np.random.default_rng(SEED)
    params = net.params()
    m, v, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(y))
        rate = RATE * (1 - epoch / EPOCHS)
        for i in range(0, len(y), BATCH):
            t += 1
            for p, g, a, b in zip(params, net.gradients(x[order[i : i + BATCH]], y[order[i : i + BATCH]]), m, v):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                p -= rate * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)
    return net


def _judged(net: Net, texts: list[str | None]) -> tuple[list[str], list[float]]:
    total = np.zeros((len(texts), len(net.languages)))
    raw = [(t or "").encode("utf-8", "replace") for t in texts]
    at = 0
    while at < len(raw):
        to, size = at, 0
        while to < len(raw) and (to == at or size + len(raw[to]) <= PIECE):
            size += len(raw[to])
            to += 1
        # A text longer than a piece is taken a piece at a time, cut where windows end.
        step = PIECE // LENGTH * LENGTH
        for low in range(0, max(1, max(map(len, raw[at:to]))), step):
            x, own, letters = windows([t[low : low + step] for t in raw[at:to]])
            for i in range(0, len(x), 128):
                np.add.at(total, at + own[i : i + 128], net.probabilities(x[i : i + 128]) * letters[i : i + 128, None])
        at = to
    weight = total.sum(axis=1)
    best = total.argmax(axis=1)
    return [net.languages[b] if w > 0 else "und" for b, w in zip(best, weight)], [float(t[b] / w) if w > 0 else 0.0 for t, b, w in zip(total, best, weight)]


def _predicted(net):
    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = _judged(net.value, batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), batch.column(2)], names=["doc_id", "lang_pred", "score", "letters"])

    return trimmed(predicted), "doc_id long, lang_pred string, score double, letters boolean"


def identify(docs: DataFrame, labelled: DataFrame) -> DataFrame:
    """Rows of docs (doc_id, text): lang_pred and score; learnt from labelled (doc_id, text, lang)."""
    spark = docs.sparkSession
    arrow_batches(spark)
    rows = labelled.where("lang is not null and text is not null and length(text) > 0").select("doc_id", "lang", "text")
    sample = bounded_sample(rows, "doc_id", "lang", SAMPLE_DOCS)
    cuts = F.array(*(F.substring("text", F.expr(f"1 + cast(floor(length(text) * {k} / {SAMPLE_WINDOWS}) as int)"), F.lit(LENGTH)) for k in range(SAMPLE_WINDOWS)))
    found = sorted(tuple(r) for r in sample.select("lang", "doc_id", F.explode(F.array_distinct(cuts)).alias("part")).collect())
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(F.col("text").cast("string").rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    if not found:
        return texts.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    net = train([r[2] for r in found], [r[0] for r in found])
    out = texts.mapInArrow(*_predicted(spark.sparkContext.broadcast(net)))
    return out.select("doc_id", F.when(F.col("letters"), F.col("lang_pred")).otherwise("und").alias("lang_pred"), F.when(F.col("letters"), F.col("score")).otherwise(0.0).alias("score"))
