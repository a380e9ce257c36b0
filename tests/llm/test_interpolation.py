"""Counts and the model's scores against loops over a small corpus; nothing here needs Spark."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa

from tidework.llm import interpolation as op
from tidework.llm.interpolation import packed

START = -1  # stands before each text, as its first context
TRAINED = [[1, 2, 3, 1, 2, 0], [1, 2, 4, 0], [5, 1, 2, 3, 0], [0], [3, 3, 3, 0]]  # 0 ends a text
WORDS = np.random.default_rng(1).integers(1, 1 << 63, 8, dtype=np.uint64)


def _row(texts, training):
    return {
        "training": packed(np.array(training)),
        "lengths": packed(np.array([len(t) for t in texts])),
        "tokens": packed(np.concatenate(texts)),
        "words": packed(WORDS),
    }


def _counts(texts):
    """Of tuples of one, two and three tokens; (START,) counts texts, (START, x) texts that begin with x."""
    out = Counter()
    for text in texts:
        out[START,] += 1
        before = [START, START, *text]
        for i, x in enumerate(text):
            out[x,] += 1
            out[before[i + 1], x] += 1
            out[before[i], before[i + 1], x] += 1
    return out


def _score(text, counts, weights, total, known):
    score = 0.0
    padded = [START, START, *text]
    for i, x in enumerate(text):
        a, b = padded[i], padded[i + 1]
        n2 = counts[b,]
        n3 = counts[a, b] if i else counts[START,]
        if n3:
            bucket = op.TOP + 2 + int(np.log2(n3))
        else:
            bucket = 1 + int(np.log2(n2)) if n2 else 0
        w3, w2, w1, w0 = weights[bucket]
        p = w1 * counts[x,] / total + w0 / (known + 1)
        usable = w1 + w0
        if n2 or n3:
            usable += w2
            p += w2 * counts[b, x] / max(n2, 1)
        if n3:
            usable += w3
            p += w3 * counts[a, b, x] / n3
        score += np.log10(p / usable)
    return score


def _scores(texts):
    everything = TRAINED + texts
    row = _row(everything, [True] * len(TRAINED) + [False] * len(texts))
    counts = op.Chunk(row).counts()
    weights = np.random.default_rng(2).dirichlet(np.ones(4), op.CONTEXTS)
    python = _counts(TRAINED)
    tokens = [k for k in python if len(k) == 1 and k != (START,)]
    total, known = sum(python[k] for k in tokens), len(tokens)
    group = pa.table(
        {
            "part": [0, -1],
            "counts": [packed(counts), None],
            **{k: pa.array([None, v], pa.binary()) for k, v in row.items()},
            "keys": pa.array([None, list(range(len(everything)))], pa.list_(pa.int64())),
        }
    )
    found = op._scored(group, weights, total, known)
    return everything, found, lambda text: _score(text, python, weights, total, known)


def test_scores_are_those_of_loops():
    texts = [[1, 2, 3, 0], [7, 7, 0], [1, 7, 2, 0], [0], [3, 3, 1, 2, 4, 0], [6, 1, 2, 0]]
    everything, found, score = _scores(texts)
    assert np.allclose(found["score"], [score(t) for t in everything])


def test_the_words_after_a_context_and_the_unknown_sum_to_one():
    vocabulary = [0, 1, 2, 3, 4, 5, 7]  # 7 was never seen
    for context in ([1, 2], [3, 3], [7, 1], [7, 7], [2, 5], []):
        # The context alone comes last, so that the others differ from it by one token.
        texts = [[*context, w] for w in vocabulary] + [context] * bool(context)
        _, found, _ = _scores(texts)
        scores = found["score"][len(TRAINED) :]
        alone = scores[-1] if context else 0.0
        assert abs(sum(10 ** (s - alone) for s in scores[: len(vocabulary)]) - 1) < 1e-9


def test_single_tokens_are_told_apart_by_all_bits_of_their_hashes():
    words = np.array([1 << 60, (1 << 60) + 1, (1 << 60) + 2, 5], np.uint64)
    row = _row([[1, 1, 2, 0]], [True]) | {"words": packed(words)}
    chunk = op.Chunk(row)
    counts = chunk.counts()
    assert sorted(chunk.grams[chunk.many :].tolist()) == sorted(words.tolist())
    assert counts[chunk.single].tolist() == [2, 2, 1, 1]
    single = chunk.grams[chunk.many :]
    other = np.array([(1 << 60) + 1, (1 << 60) + 3], np.uint64)
    group = pa.table(
        {
            "part": [8, 8],
            "chunk": [0, 1],
            "held": [False, True],
            "hashes": [packed(np.diff(h, prepend=np.uint64(0))) for h in (single, other)],
            "counts": [packed(counts[chunk.many :]), packed(np.array([4, 6]))],
        }
    )
    found = op._answer(group, 8)
    assert found["tokens"].tolist() == [0, 0, 14] and found["known"].tolist() == [0, 0, 4]
    assert found["kept_tokens"].tolist() == [0, 0, 4] and found["kept_known"].tolist() == [0, 0, 3]
    assert op.unpacked(found["every"][1].as_py()).tolist() == [6, 6]
    assert op._answer(group, 9)["tokens"].tolist() == [0, 0, 0]  # a range of pairs and triples has no single tokens
