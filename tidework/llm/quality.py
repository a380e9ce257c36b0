"""Quality classifier: a byte-level convolutional network in numpy.

Every byte of a text has a learned vector; learned filters slide over all
bytes. The text is covered by chunks of 256 bytes, each overlapping the next by
half. Each filter's strongest response in a chunk is its chunk score; their
mean, largest and smallest over all chunks of the text go into one logistic
unit. Training follows the gradient through the pooling to the bytes that won.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidework.llm.common import fold, labelled_texts, smallest_by_hash

HALF = 128  # bytes; a chunk is two halves, and the next one starts at its second half
PAD = 256  # the symbol around and between texts; its vector is always zero
PIECE = 1 << 8  # halves convolved at a time: they stay in a core's cache whatever the text's length


@dataclass(frozen=True)
class Shape:
    width: int = 7
    filters: int = 16
    depth: int = 8


@dataclass
class ConvModel:
    """``tables[j, byte, k]``: what a byte at place j of a window adds to filter k."""

    tables: np.ndarray
    bias: np.ndarray
    weights: np.ndarray
    offset: float

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        symbols, starts = _lay_out(texts, self.tables.shape[0])
        best = np.concatenate([m for m, _ in _half_maxima(symbols, self.tables, False)])
        features, _ = _pool(np.maximum(best + self.bias, 0), starts)
        return 1 / (1 + np.exp(-np.clip(features @ self.weights + self.offset, -30, 30)))


@dataclass
class ConstantModel:
    """For labels of one kind, or none: every text gets the same score."""

    value: float

    def scores(self, texts: list[bytes]) -> np.ndarray:
        return np.full(len(texts), self.value)


def _lay_out(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """All texts as symbols, each padded to whole halves, two at least, and the first half of each."""
    halves = np.array([max(2, -(-(len(t) + width - 1) // HALF)) for t in texts])
    starts = np.concatenate([[0], np.cumsum(halves)])
    symbols = np.full(starts[-1] * HALF + width - 1, PAD, np.int16)
    for text, at in zip(texts, starts):
        symbols[at * HALF : at * HALF + len(text)] = np.frombuffer(text, np.uint8)
    return symbols, starts[:-1]


def _half_maxima(symbols: np.ndarray, tables: np.ndarray, places: bool) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
    """Each filter's largest response in each half, and where it is if asked for, some halves at a time."""
    width, _, filters = tables.shape
    total = (len(symbols) - width + 1) // HALF
    response, more = np.empty((2, min(PIECE, total) * HALF, filters), np.float32)
    for low in range(0, total, PIECE):
        high = min(total, low + PIECE)
        n = (high - low) * HALF
        window = symbols[low * HALF : low * HALF + n + width - 1]
        np.take(tables[0], window[:n], 0, response[:n], "clip")
        for j in range(1, width):
            np.take(tables[j], window[j : j + n], 0, more[:n], "clip")
            response[:n] += more[:n]
        blocks = response[:n].reshape(high - low, HALF, filters)
        if places:
            where = blocks.argmax(1)
            yield np.take_along_axis(blocks, where[:, None], 1)[:, 0], where + np.arange(low, high)[:, None] * HALF
        else:
            yield blocks.max(1), None


def _pool(halves: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, tuple]:
    """Mean, largest and smallest chunk score of each text, and what the way back needs."""
    second = halves[1:] > halves[:-1]
    chunks = np.where(second, halves[1:], halves[:-1])
    counts = np.diff(np.append(starts, len(halves))) - 1
    if len(starts) > 1:  # a pair of halves of two texts is no chunk
        chunks = np.delete(chunks, starts[1:] - 1, 0)
        second = np.delete(second, starts[1:] - 1, 0)
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])
    features = np.concatenate(
        [
            np.add.reduceat(chunks, first) / counts[:, None],
            np.maximum.reduceat(chunks, first),
            np.minimum.reduceat(chunks, first),
        ],
        axis=1,
    )
    return features, (chunks, second, first, counts)


def train(
    labelled: list[tuple[int, bytes]], weights: tuple[float, float] = (1.0, 1.0), shape: Shape = Shape(), epochs: int = 14, seed: int = 5
) -> ConvModel | ConstantModel:
    """Fits the network on (label, text); ``weights`` are those of a row with label 0 and 1."""
    kinds = {y for y, _ in labelled}
    if len(kinds) < 2:
        return ConstantModel(float(kinds.pop()) if kinds else 0.5)
    rng = np.random.default_rng(seed)
    width, filters, depth = shape.width, shape.filters, shape.depth
    parameters = {
        "vectors": rng.normal(0, 0.5, (PAD + 1, depth)),
        "kernels": rng.normal(0, 1 / np.sqrt(width * depth), (width, depth, filters)),
        "bias": np.zeros(filters),
        "weights": rng.normal(0, 0.1, 3 * filters),
        "offset": np.zeros(1),
    }
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in parameters.items()}
    steps, batch = 0, 32
    rounds = epochs * -(-len(labelled) // batch)
    for _ in range(epochs):
        # Texts of like length share a batch, so that one long text does not fill it with padding.
        order = rng.permutation(len(labelled))
        for at in range(0, len(order), batch):
            some = [labelled[i] for i in order[at : at + batch]]
            y = np.array([v for v, _ in some], float)
            w = np.where(y > 0, weights[1], weights[0])
            gradient = _gradient(parameters, [t for _, t in some], y, w / w.sum())
            steps += 1
            rate = 0.02 * 0.5 * (1 + np.cos(np.pi * steps / rounds)) + 1e-4
            for k, g in gradient.items():
                m, v = moments[k]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                parameters[k] -= rate * (m / (1 - 0.9**steps)) / (np.sqrt(v / (1 - 0.999**steps)) + 1e-8)
            parameters["vectors"][PAD] = 0
    tables = np.einsum("bd,jdk->jbk", parameters["vectors"], parameters["kernels"]).astype(np.float32)
    return ConvModel(tables, parameters["bias"].astype(np.float32), parameters["weights"], float(parameters["offset"][0]))


def _gradient(p: dict, texts: list[bytes], y: np.ndarray, w: np.ndarray) -> dict:
    width, _, filters = p["kernels"].shape
    tables = np.einsum("bd,jdk->jbk", p["vectors"], p["kernels"]).astype(np.float32)
    symbols, starts = _lay_out(texts, width)
    parts = list(_half_maxima(symbols, tables, True))
    best = np.concatenate([m for m, _ in parts]) + p["bias"]
    places = np.concatenate([x for _, x in parts])
    halves = np.maximum(best, 0)
    features, (chunks, second, first, counts) = _pool(halves, starts)
    logit = features @ p["weights"] + p["offset"][0]
    error = w * (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y)
    back = error[:, None] * p["weights"][None, :]
    mean, top, low = back[:, :filters] / counts[:, None], back[:, filters : 2 * filters], back[:, 2 * filters :]
    text = np.repeat(np.arange(len(counts)), counts)
    by_chunk = mean[text]
    for value, part in ((features[:, filters : 2 * filters], top), (features[:, 2 * filters :], low)):
        hit = chunks == value[text]
        by_chunk += part[text] * hit / np.maximum(np.add.reduceat(hit, first)[text], 1)
    # A chunk's first half has as many texts before it as chunks were deleted there.
    half = np.arange(len(chunks)) + text
    by_half = np.zeros_like(halves, dtype=float)
    by_half[half] += by_chunk * ~second
    by_half[half + 1] += by_chunk * second
    by_half *= best > 0
    by_table = np.empty((width, PAD + 1, filters))
    column = np.arange(filters)
    for j in range(width):
        cell = symbols[places + j].astype(np.int64) * filters + column
        by_table[j] = np.bincount(cell.ravel(), by_half.ravel(), (PAD + 1) * filters).reshape(PAD + 1, filters)
    by_table[:, PAD] = 0
    return {
        "vectors": np.einsum("jbk,jdk->bd", by_table, p["kernels"]),
        "kernels": np.einsum("jbk,bd->jdk", by_table, p["vectors"]),
        "bias": by_half.sum(0),
        "weights": features.T @ error + 1e-5 * p["weights"],
        "offset": np.array([error.sum()]),
    }


def fit(
    documents: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    fit_rows: int = 1600,
    fit_bytes: int = 32768,
) -> ConvModel | ConstantModel:
    """Fits on about ``fit_rows`` rows of each label, of up to ``fit_bytes`` bytes of each text: the documented bounds of
    the sample. Each label weighs as much as it does among all labelled rows. Null labels are left out."""
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).select(
        key, F.col(label).cast("int").alias("_label")
    )
    counts = {r[0]: r[1] for r in known.groupBy("_label").count().collect()}
    rows = labelled_texts(documents, smallest_by_hash(known, key, "_label", fit_rows), key, text, "_label", fit_bytes)
    sample = [(int(y > 0), t) for y, _, t in rows]
    share = [sum(y == k for y, _ in sample) / max(1, len(sample)) for k in (0, 1)]
    true = [sum(n for v, n in counts.items() if (v > 0) == k) / max(1, sum(counts.values())) for k in (False, True)]
    return train(sample, tuple(t / s if s else 1.0 for t, s in zip(true, share)))


def score(documents: DataFrame, model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score) of every row, over its whole text; null counts as empty. One pass without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            out, group, size = [np.zeros(0)], [], 0
            for value in texts:
                value = value.as_py() or b""
                group.append(value)
                size += len(value) + HALF
                if size >= 1 << 20:
                    out.append(model.scores(group))
                    group, size = [], 0
            out.append(model.scores(group))
            yield pa.RecordBatch.from_arrays([keys, pa.array(np.concatenate(out), pa.float64())], ["key", "score"])

    rows = documents.select(F.col(key).alias("key"), F.col(text).cast("binary").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, score double").select(F.col("key").alias(key), "score")


def quality_scores(
    documents: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    folds: int = 3,
    held: int = 1,
    **bounds: int,
) -> DataFrame:
    """(key, held_out, score, predicted) of every document; labels of the held-out fold are never read for fitting."""
    model = fit(documents, labels.where(fold(key, folds) != held), key, text, label, **bounds)
    return score(documents, model, key, text).select(
        key,
        (fold(key, folds) == held).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )


def accepted(documents: DataFrame, model, text: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of ``documents``, with all their columns, whose whole text scores ``least`` or more."""
    names = documents.columns
    place = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [v or b"" for v in batch.column(batch.num_columns - 1).to_pylist()]
            good = np.concatenate([np.zeros(0), *(model.scores(values[i : i + 64]) for i in range(0, len(values), 64))]) >= least
            yield pa.RecordBatch.from_arrays(batch.columns[:-1], batch.schema.names[:-1]).filter(pa.array(good))

    numbered = documents.toDF(*(f"c{i}" for i in range(len(names))))
    widened = numbered.withColumn("bytes", F.col(f"c{place}").cast("binary"))
    return widened.mapInArrow(run, numbered.schema).toDF(*names)
