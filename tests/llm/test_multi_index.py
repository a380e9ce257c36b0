"""Codebooks and cells against all distances; nothing here needs Spark."""

from __future__ import annotations

import numpy as np
import pytest

from tidework.llm import embedding_dedup as op


def _points(count, width, seed=1):
    rng = np.random.default_rng(seed)
    points = rng.normal(size=(count, width))
    return points / np.linalg.norm(points, axis=1, keepdims=True)


@pytest.mark.parametrize("count", [1, 40, 256, 257, 700])
def test_a_codebook_has_as_many_codewords_as_asked_for(count):
    points = _points(9000, 8)
    book = op._codebook(points, count, np.random.default_rng(3))
    assert book.shape == (count, 8) and np.isfinite(book).all()
    assert np.bincount(op._nearest(points, book), minlength=count).max() < 40 * len(points) / count


@pytest.mark.parametrize("width", [0, 3])
def test_equal_points_are_parted_too(width):
    assert op._codebook(np.ones((2000, width)), 700, np.random.default_rng(3)).shape == (700, width)


def test_fewer_points_than_codewords():
    assert op._codebook(_points(300, 4), 700, np.random.default_rng(3)).shape == (300, 4)


def test_cells_are_the_nearest_of_the_whole_grid():
    vectors = _points(2500, 12)
    rng = np.random.default_rng(5)
    index = op.MultiIndex(tuple(op._codebook(p, 30, rng) for p in (vectors[:, :6], vectors[:, 6:])), 1)
    parts = [op._distances(p, b) for p, b in zip((vectors[:, :6], vectors[:, 6:]), index.books)]
    whole = (parts[0][:, :, None] + parts[1][:, None, :]).reshape(len(vectors), -1)
    for count in (1, 7, 100):
        cells = index.cells(vectors, count)
        assert cells.shape == (len(vectors), count)
        found = np.take_along_axis(whole, cells, 1)
        assert np.allclose(found, np.sort(whole, 1)[:, :count])
    others = np.roll(vectors, 1, 0)
    to = np.take_along_axis(whole, index.cells(others, 1), 1)
    assert abs(index.place(vectors, others) - (whole < to).sum(1)).max() <= 1  # the partner's own cell, by rounding


def test_cells_hold_as_many_vectors_at_any_size():
    for count in (10**4, 10**7, 10**10):
        words = op.codewords_for(count, 64)
        assert 56 < count / words**2 < 72
        assert op.SAMPLED * words < 10**6  # what the driver fits them on


def test_a_large_index_keeps_its_recall():
    rng = np.random.default_rng(2)
    vectors = _points(6000, 16)
    index = op.build_index(vectors, 0.98, 0.999, 400)
    assert [len(b) for b in index.books] == [400, 400]
    aside = rng.normal(size=vectors.shape)
    aside -= (aside * vectors).sum(1, keepdims=True) * vectors
    near = 0.985 * vectors + (1 - 0.985**2) ** 0.5 * aside / np.linalg.norm(aside, axis=1, keepdims=True)
    a, b = index.cells(vectors, index.visits), index.cells(near, index.visits)
    met = (a == b[:, :1]).any(1) | (b == a[:, :1]).any(1)
    assert met.mean() > 0.99
