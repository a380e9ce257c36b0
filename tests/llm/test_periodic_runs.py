"""Runs by block convolution against a search through all periods."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest

from tidework.llm import periodic_runs as runs_of
from tidework.llm.periodic_runs import copies, digests, periodic_runs, runs, with_loops


def brute(words: list, shortest: int = 24, times: int = 3) -> list[tuple[int, int, int]]:
    n, found = len(words), {}
    for q in range(1, n // times + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(shortest, times * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def some_text(pick: random.Random, most: int) -> list[int]:
    letters, words = pick.choice([1, 2, 3, 30]), []
    size = pick.randint(0, most)
    while len(words) < size:
        passage = [pick.randrange(letters) for _ in range(pick.randint(1, pick.choice([3, 12, 40])))]
        words += (passage * 12)[: pick.randint(1, 12 * len(passage))]
        words += [pick.randrange(letters) for _ in range(pick.choice([0, 0, 1, 9]))]
    return words[:size]


@pytest.mark.parametrize(("shortest", "times"), [(24, 3), (6, 3), (1, 3), (40, 4)])
def test_runs_of_random_texts(shortest, times):
    pick = random.Random(shortest)
    for _ in range(500):
        words = some_text(pick, 220)
        assert runs(np.array(words, np.int64), shortest, times) == brute(words, shortest, times), words


def test_wide_blocks_are_compared_in_pieces(monkeypatch):
    pick = random.Random(2)
    texts = []
    for _ in range(60):
        passage = [pick.randrange(9) for _ in range(pick.randint(20, 130))]
        texts.append([pick.randrange(9) for _ in range(pick.randint(0, 30))] + (passage * 4)[: pick.randint(300, 500)])
    monkeypatch.setattr(runs_of, "WIDEST", 16)
    for words in texts:
        assert runs(np.array(words, np.int64)) == brute(words)


def test_sums_of_squares_are_zero_only_for_copies():
    """Codes whose squared differences add up to a prime are not taken for equal ones."""
    pick = np.random.default_rng(1)
    for width in (1, 2, 8, 64):
        blocks = pick.integers(0, 3, (5, width))
        windows = pick.integers(0, 3, (5, 2 * width))
        windows[0, width // 2 : width // 2 + width] = blocks[0]
        windows[1, :width] = blocks[1] + (1 << 20)
        expected = [[bool((windows[b, d : d + width] == blocks[b]).all()) for d in range(width)] for b in range(5)]
        assert copies(blocks, windows).tolist() == expected
    root = 2013265921  # 30000**2 + ... : a difference whose square is a multiple of the first prime
    assert not copies(np.array([[0]]), np.array([[root, 0]])).any()


def test_long_texts_take_little_time():
    for words in ([0] * 400_000, [0, 1] * 200_000, ([0] * 3000 + [1]) * 100):
        assert runs(np.array(words, np.int64))[0][:2] == (0, len(words)) or len(set(words)) == 2


def test_fewer_than_three_periods_are_refused():
    with pytest.raises(ValueError, match="three"):
        runs(np.zeros(50, np.int64), times=2)


def expected_row(key: int | None, text: str | None) -> tuple:
    words = (text or "").encode().split()
    n = len(words)
    h = None if key is None else zlib.crc32(str(key).encode())
    if n and h is not None and h % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute(words)
    dropped = {i for s, length, q in found for i in range(s + q, s + length)}
    left = b" ".join(w for i, w in enumerate(words) if i not in dropped)
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None, None, None))
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    most = None if best[0] is None else 1000 * best[1] // best[2]
    return (key, len(found), *best, most, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(left).hexdigest())


def test_whole_table(documents):
    short = [r for r in documents.collect() if len((r.text or "").split()) <= 1500]
    found = {r.doc_id: tuple(r) for r in digests(periodic_runs(with_loops(documents))).collect()}
    assert len(found) == documents.count()
    for row in short:
        assert found[row.doc_id] == expected_row(row.doc_id, row.text)


def test_awkward_rows(awkward, nothing):
    found = [tuple(r) for r in digests(periodic_runs(with_loops(awkward))).collect()]
    rows = [(r.doc_id, r.text) for r in awkward.collect() if r.doc_id != 5]
    expected = [expected_row(*row) for row in rows]
    whole = [r for r in found if r[0] == 5]
    assert sorted((r for r in found if r[0] != 5), key=str) == sorted(expected, key=str)
    # 30,000 times one word
    assert [r[1:6] for r in whole] == [(1, 0, 30_000, 1, 30_000_000)]
    assert whole[0][7] == hashlib.sha256(b"word").hexdigest()
    assert digests(periodic_runs(with_loops(nothing))).count() == 0


def test_loops_of_all_keys_with_them(spark):
    keys = [k for k in range(400) if zlib.crc32(str(k).encode()) % 10 == 0]
    pick = random.Random(9)
    rows = [(k, " ".join(f"w{pick.randrange(60)}" for _ in range(pick.randint(0, 300)))) for k in keys]
    found = digests(periodic_runs(with_loops(spark.createDataFrame(rows, "doc_id long, text string")))).collect()
    assert sorted(tuple(r) for r in found) == sorted(expected_row(*row) for row in rows)
