"""Toxicity by non-negative positive-unlabelled learning.

Only confirmed toxic texts and unlabelled texts are learned from. With the share
``prior`` of toxic texts among the unlabelled ones, the risk on clean texts is
the unlabelled risk less ``prior`` times the risk of taking toxic texts for
clean. That difference is never allowed below zero: where it would be, training
steps back instead (the non-negative estimator). The model is logistic over the
words a text contains, their beginnings, and beginnings that two or more of its
words share, hashed to a fixed number of weights: all of them are trained.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidework.llm.common import fold, labelled_texts, smallest_by_hash

BITS = 20
STEMS = (5, 6, 7)  # bytes of a word's beginnings
# Whatever is neither an ASCII letter or digit nor part of another script parts words.
_KEEP = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


class WordCells(dict):
    """The weights of each word and of its beginnings, remembered up to a number of words."""

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        if len(self) >= 200_000:
            self.clear()
        parts = (word, *(b"\x01" + word[:n] for n in STEMS if len(word) >= n))
        found = self[word] = tuple(xxhash.xxh32_intdigest(part) >> (32 - BITS) for part in parts)
        return found


def cells(text: bytes, known: WordCells) -> np.ndarray:
    """The distinct weights of a text's words and their beginnings, and those of what two or more distinct words share."""
    words = set(text.lower().translate(_KEEP).split())
    one, times = np.unique(np.fromiter(chain.from_iterable(map(known.__getitem__, words)), np.int64), return_counts=True)
    shared = (one[times > 1] * 0x9E3779B1 + 1) % (1 << 32) >> (32 - BITS)
    return np.unique(np.concatenate([one, shared]))


@dataclass
class ToxicModel:
    weights: np.ndarray  # one for each hashed word
    offset: float

    def score(self, found: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.weights[found].sum() + self.offset, -30, 30))))


def train(
    positive: list[np.ndarray],
    unlabelled: list[np.ndarray],
    prior: float,
    shrink: float = 3.0,
    steps: int = 150,
) -> ToxicModel:
    """Fits by the non-negative risk estimator with logistic loss on all cells, each step on all texts. A weight is never
    below zero and costs ``shrink`` standard errors of its cell's share of the positive texts, so that the many words of
    a long clean text add little. A cell that no positive text has cannot speak for toxic."""
    size = 1 << BITS
    weights = np.zeros(size)
    if not positive:
        return ToxicModel(weights, -30.0)
    if not unlabelled or prior >= 1:
        return ToxicModel(weights, 30.0 if prior >= 1 else 0.0)
    there = np.unique(np.concatenate(positive))
    column = np.full(size, -1, np.int32)
    column[there] = np.arange(len(there))

    def matrix(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, int]:
        kept = [c[c >= 0] for c in (column[t] for t in texts)]
        return np.repeat(np.arange(len(kept), dtype=np.int32), [len(k) for k in kept]), np.concatenate(kept), len(kept)

    (rp, cp, np_), (ru, cu, nu) = matrix(positive), matrix(unlabelled)
    k = len(there)
    share = (np.bincount(cp, minlength=k) + np.bincount(cu, minlength=k)) / (np_ + nu)
    cost = prior * (shrink * np.sqrt(share * (1 - share) / np_) + 1e-4)
    w, b = np.zeros(k), float(np.log(prior / (1 - prior)))
    m, v = np.zeros((2, k + 1))
    for step in range(1, steps + 1):
        zp, zu = np.bincount(rp, w[cp], np_) + b, np.bincount(ru, w[cu], nu) + b
        sp, su = (1 / (1 + np.exp(-np.clip(z, -30, 30))) for z in (zp, zu))
        # Risks by logistic loss: toxic taken for clean is log(1 + e^z), and so on.
        clean = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        gp, gu, price = -prior / np_ * np.ones(np_), su / nu, cost
        if clean < 0:  # step back from a negative risk
            gp, gu, price = prior * sp / np_, -gu, 0 * cost
        slope = np.bincount(cp, gp[rp], k) + np.bincount(cu, gu[ru], k) + price
        g = np.append(slope, gp.sum() + gu.sum())
        m += 0.1 * (g - m)
        v += 0.01 * (g * g - v)
        rate = 0.1 * 0.5 * (1 + np.cos(np.pi * step / steps))
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
        w = np.maximum(w - move[:-1], 0)
        b -= move[-1]
    weights[there] = w
    return ToxicModel(weights, -_cut(np.bincount(rp, w[cp], np_), np.bincount(ru, w[cu], nu), prior))


def _cut(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> float:
    """The cut with the least non-negative risk of wrong decisions, in the middle of its gap: where scores pass one half."""
    values = np.unique(np.concatenate([positive, unlabelled]))
    values = np.append(values, values[-1] + 2)  # a cut above the largest value flags nothing
    caught = 1 - np.searchsorted(np.sort(positive), values) / len(positive)
    taken = 1 - np.searchsorted(np.sort(unlabelled), values) / len(unlabelled)
    best = int(np.argmin(prior * (1 - caught) + np.maximum(0, taken - prior * caught)))
    return float((values[best] + values[best - 1]) / 2) if best else float(values[0] - 1)


def fit(
    documents: DataFrame,
    labels: DataFrame,
    unlabelled: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    fit_positive: int = 2000,
    fit_unlabelled: int = 8000,
    fit_bytes: int = 32768,
) -> ToxicModel:
    """Fits on about ``fit_positive`` confirmed toxic rows and ``fit_unlabelled`` keys of ``unlabelled``, of up to
    ``fit_bytes`` bytes of each text: the documented bounds of the sample. Of the labels only the toxic ones and their share count."""
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull())
    toxic, total = known.agg(F.count(F.when(F.col(label) > 0, 1)), F.count("*")).first()
    marked = known.where(F.col(label) > 0).select(key, F.lit(1).alias("_label"))
    plain = unlabelled.where(F.col(key).isNotNull()).select(key, F.lit(0).alias("_label"))
    known_cells = WordCells()

    def sample(rows: DataFrame, count: int) -> list[np.ndarray]:
        picked = smallest_by_hash(rows, key, "_label", count)
        return [cells(t, known_cells) for _, _, t in labelled_texts(documents, picked, key, text, "_label", fit_bytes)]

    return train(sample(marked, fit_positive), sample(plain, fit_unlabelled), toxic / max(1, total))


def score(documents: DataFrame, model: ToxicModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score) of every row, over its whole text; null counts as empty. One pass without a shuffle."""
    has = np.flatnonzero(model.weights)
    packed, offset = (has, model.weights[has]), model.offset

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.zeros(1 << BITS)
        weights[packed[0]] = packed[1]
        local, known = ToxicModel(weights, offset), WordCells()
        for batch in batches:
            found = [local.score(cells(t.as_py() or b"", known)) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], ["key", "score"])

    rows = documents.select(F.col(key).alias("key"), F.col(text).cast("binary").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, score double").select(F.col("key").alias(key), "score")


def toxicity_scores(
    documents: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    folds: int = 5,
    held: int = 0,
    **bounds: int,
) -> DataFrame:
    """(key, held_out, score, predicted) of every document; neither labels nor texts of the held-out fold are fitted on."""
    inside = fold(key, folds) != held
    model = fit(documents, labels.where(inside), documents.where(inside).select(key), key, text, label, **bounds)
    return score(documents, model, key, text).select(
        key,
        (fold(key, folds) == held).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )
