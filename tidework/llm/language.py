"""Language identification by a string kernel.

The kernel of two texts is the share of distinct n-grams they have in common:
their blended spectra (all orders from one byte to ``ORDERS``) as sets, scaled
to one. Landmark texts give it a finite map (Nyström): a text's kernels with
all landmarks times the inverse root of the landmarks' own kernel matrix. One
ridge regression per language, against all others, runs on that map, and
scoring a batch is three matrix products.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidework.llm.common import fold, labelled_texts, smallest_by_hash

ORDERS = 3
SPACES = (1 << 8, 1 << 12, 1 << 14)  # places for the n-grams of each order
PLACES = sum(SPACES)
# Letters of the ASCII range in lower case, bytes of other scripts as they are, everything else a blank.
_LETTERS = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))
PIECE = 1 << 16


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def presence(text: str, out: np.ndarray) -> None:
    """Marks the n-grams of the whole text in ``out``; a text is walked in pieces that overlap by an n-gram."""
    data = np.frombuffer(b" " + b" ".join(text.lower().encode("utf-8", "replace").translate(_LETTERS).split()) + b" ", np.uint8)
    for low in range(0, len(data), PIECE):
        code = data[low : low + PIECE + ORDERS - 1].astype(np.uint32)
        out[code] = 1
        first, gram = SPACES[0], code
        for order in range(1, ORDERS):
            if len(gram) < 2:
                break
            gram = (gram[:-1] << np.uint32(8)) | code[order:]
            bits = SPACES[order].bit_length() - 1
            out[first + ((gram * np.uint32(2654435761)) >> np.uint32(32 - bits)).astype(np.int64)] = 1
            first += SPACES[order]


def spectra(texts: list[str]) -> np.ndarray:
    """A row for each text, of length one unless the text is empty."""
    rows = np.zeros((len(texts), PLACES), np.float32)
    for text, row in zip(texts, rows):
        presence(text, row)
    rows /= np.sqrt(np.maximum(rows.sum(1, keepdims=True), 1))
    return rows


@dataclass
class LanguageModel:
    languages: list[str]
    landmarks: np.ndarray  # PLACES x landmarks
    root: np.ndarray  # landmarks x landmarks
    weights: np.ndarray  # landmarks + 1 x languages

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """The best language of each text and its score: the languages' outputs as shares of one."""
        mapped = spectra(texts) @ self.landmarks @ self.root
        outputs = mapped @ self.weights[:-1] + self.weights[-1]
        shares = np.exp(8 * (outputs - outputs.max(1, keepdims=True)))
        shares /= shares.sum(1, keepdims=True)
        best = shares.argmax(1)
        return [self.languages[i] for i in best], shares[np.arange(len(texts)), best].astype(float)


def train(labelled: list[tuple[str, str]], landmarks: int = 96, ridge: float = 1e-3, seed: int = 11) -> LanguageModel | None:
    """Fits on (language, text); None without any. Landmarks are drawn in turn from each language."""
    labelled = [(y, t) for y, t in labelled if has_letter(t)]
    if not labelled:
        return None
    rng = np.random.default_rng(seed)
    languages = sorted({y for y, _ in labelled})
    place = {y: i for i, y in enumerate(languages)}
    y = np.array([place[v] for v, _ in labelled])
    turn = np.empty(len(y), int)
    for k in range(len(languages)):
        of = np.flatnonzero(y == k)
        turn[rng.permutation(of)] = np.arange(len(of))
    chosen = np.lexsort((y, turn))[: max(landmarks, 4 * len(languages))]
    marks = spectra([labelled[i][1] for i in chosen])
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(float))
    kept = values > 1e-6 * values.max()
    root = vectors[:, kept] / np.sqrt(values[kept])
    mapped = np.concatenate(
        [spectra([t for _, t in labelled[i : i + 256]]) @ marks.T for i in range(0, len(labelled), 256)]
    ).astype(float) @ root
    mapped = np.hstack([mapped, np.ones((len(mapped), 1))])
    count = np.bincount(y, minlength=len(languages))
    weight = 1 / count[y]  # every language weighs the same
    target = np.where(y[:, None] == np.arange(len(languages)), 1.0, 0.0)
    gram = mapped.T @ (mapped * weight[:, None]) + ridge * np.eye(mapped.shape[1])
    weights = np.linalg.solve(gram, mapped.T @ (target * weight[:, None]))
    return LanguageModel(languages, np.ascontiguousarray(marks.T), root.astype(np.float32), weights.astype(np.float32))


def fit(
    documents: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    language: str = "lang",
    fit_rows: int = 400,
    fit_bytes: int = 16384,
) -> LanguageModel | None:
    """Fits on about ``fit_rows`` rows of each language, of up to ``fit_bytes`` bytes of each text: the documented bounds."""
    known = documents.where(F.col(language).isNotNull() & F.col(key).isNotNull()).select(
        key, F.col(language).alias("_label")
    )
    picked = smallest_by_hash(known, key, "_label", fit_rows)
    rows = labelled_texts(documents, picked, key, text, "_label", fit_bytes)
    return train([(y, t.decode("utf-8", "replace")) for y, _, t in rows])


def predict(documents: DataFrame, model: LanguageModel | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score) of every row, over its whole text. ``und`` with score 0 for null, for texts without a
    letter, and for every text if nothing could be learned. One pass without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            names, scores = ["und"] * n, np.zeros(n)
            group: list[tuple[int, str]] = []

            def flush() -> None:
                if group:
                    found, value = model.predict([t for _, t in group])
                    for (i, _), name, v in zip(group, found, value):
                        names[i], scores[i] = name, v
                    group.clear()

            for i, value in enumerate(batch.column(1)):
                value = value.as_py()
                if model is not None and value and has_letter(value):
                    group.append((i, value))
                    if len(group) == 64:
                        flush()
            flush()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["key", "lang_pred", "score"]
            )

    rows = documents.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    found = rows.mapInArrow(run, f"key {kind}, lang_pred string, score double")
    return found.select(F.col("key").alias(key), "lang_pred", "score")


def language_ids(
    documents: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    language: str = "lang",
    folds: int = 4,
    held: int = 2,
    **bounds: int,
) -> DataFrame:
    """(key, held_out, lang_pred, score) of every document; nothing of the held-out fold is learned from."""
    model = fit(documents.where(fold(key, folds) != held), key, text, language, **bounds)
    return predict(documents, model, key, text).select(key, (fold(key, folds) == held).alias("held_out"), "lang_pred", "score")
