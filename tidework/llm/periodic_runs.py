"""Stretches of a text that repeat a passage of words several times over, found by block convolution.

At each dyadic scale L a text is cut into blocks of L words. A run of a period from L to 2L - 1 that holds three
periods or more has a whole block whose copy lies one period further on, still in the run. So for each block the sums
of squared differences to all places of the window that follows are worked out at once, by a convolution in exact
integers (a number-theoretic transform); places where the sum is zero are copies, and their distances are seeds, which
are extended to both sides until a word differs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidework.llm.common import WORD

# Primes with many roots of unity of orders that are powers of two, and a non-residue of each.
PRIMES = ((2013265921, 31), (1811939329, 13), (469762049, 3))
WIDEST = 1 << 16  # words of a block that are compared; windows of larger scales are cut into pieces of this size
CELLS = 1 << 20  # numbers that are transformed at once
FLUSH = 1 << 24  # bytes of output a task holds


@cache
def _powers(prime: int, root: int, half: int, inverse: bool) -> np.ndarray:
    """The first ``half`` powers of a root of unity of order ``2 * half``."""
    base = pow(root, (prime - 1) // (2 * half), prime)
    if inverse:
        base = pow(base, -1, prime)
    powers = np.ones(half, np.uint64)
    done = 1
    while done < half:
        more = min(done, half - done)
        powers[done : done + more] = powers[:more] * np.uint64(pow(base, done, prime)) % np.uint64(prime)
        done += more
    return powers


def _times(a: np.ndarray, b: np.ndarray, prime: np.uint64) -> np.ndarray:
    product = a * b  # below 2**63
    product -= product // prime * prime
    return product


def _transformed(rows: np.ndarray, prime: int, root: int) -> np.ndarray:
    """The transform of each row, its numbers in bit-reversed order."""
    p, (count, size) = np.uint64(prime), rows.shape
    half = size // 2
    while half:
        pairs = rows.reshape(count, -1, 2, half)
        a, b = pairs[:, :, 0], pairs[:, :, 1]
        total = a + b
        # Unsigned numbers wrap, so the smaller one of a number and itself less the prime is the remainder.
        pairs[:, :, 1] = _times(a + p - b, _powers(prime, root, half, False), p)
        pairs[:, :, 0] = np.minimum(total, total - p)
        half //= 2
    return rows


def _restored(rows: np.ndarray, prime: int, root: int) -> np.ndarray:
    p, (count, size) = np.uint64(prime), rows.shape
    half = 1
    while half < size:
        pairs = rows.reshape(count, -1, 2, half)
        a, b = pairs[:, :, 0].copy(), _times(pairs[:, :, 1], _powers(prime, root, half, True), p)
        total, gap = a + b, a + p - b
        pairs[:, :, 0] = np.minimum(total, total - p)
        pairs[:, :, 1] = np.minimum(gap, gap - p)
        half *= 2
    return _times(rows, np.uint64(pow(size, -1, prime)), p)


def copies(blocks: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Where in its window each block occurs: a row for each block, a truth value for each of its places.

    Blocks have a power of two of codes, from 0 on, and windows twice as many, of which the last is not looked at.
    """
    count, width = blocks.shape
    bound = width * int(max(blocks.max(), windows.max())) ** 2  # no sum of squares is larger
    same, product = np.ones((count, width), bool), 1
    for prime, root in PRIMES:
        p = np.uint64(prime)
        left, right = blocks.astype(np.uint64) % p, windows.astype(np.uint64) % p
        right[:, -1] = 0
        padded = np.zeros((count, 2 * width), np.uint64)
        padded[:, :width] = left[:, ::-1]
        found = _times(_transformed(padded, prime, root), _transformed(right.copy(), prime, root), p)
        mixed = _restored(found, prime, root)[:, width - 1 : 2 * width - 1]
        sums = np.zeros((count, 2 * width), np.uint64)
        np.cumsum(_times(right, right, p)[:, :-1], axis=1, out=sums[:, 1:])
        squares = sums[:, width:] - sums[:, :width] + _times(left, left, p).sum(axis=1, dtype=np.uint64)[:, None]
        same &= squares % p == np.uint64(2) * mixed % p
        product *= prime
        if product > bound:  # a sum below the product of the primes that all of them divide is zero
            return same
    raise ValueError("a text has too many different words")


def _ahead(codes: np.ndarray) -> np.ndarray:
    """How far it is from each word to the next equal one; the text's length where there is none."""
    order = np.argsort(codes, kind="stable")
    ahead = np.full(len(codes), len(codes), np.int64)
    again = codes[order[1:]] == codes[order[:-1]]
    ahead[order[:-1][again]] = (order[1:] - order[:-1])[again]
    return ahead


def _matching(codes: np.ndarray, at: int, distance: int, step: int) -> int:
    """How many words from ``at`` on, forwards or backwards, equal those ``distance`` further on."""
    limit = len(codes) - distance - at if step > 0 else at + 1
    done, size = 0, 64
    while done < limit:
        more = min(size, limit - done)
        low = at + done if step > 0 else at - done - more + 1
        differs = codes[low : low + more] != codes[low + distance : low + distance + more]
        if differs.any():
            return done + int(np.argmax(differs if step > 0 else differs[::-1]))
        done += more
        size *= 2
    return done


class _Found:
    """Runs of one text, and for each word the one that holds it and ends last."""

    def __init__(self, words: int) -> None:
        self.runs: dict[tuple[int, int], int] = {}
        self.end = np.zeros(words, np.int64)
        self.period = np.ones(words, np.int64)

    def add(self, start: int, end: int, period: int) -> None:
        """A stretch found with several periods has the smallest; the others are multiples of it."""
        self.runs[start, end] = min(period, self.runs.get((start, end), period))
        later = np.flatnonzero(self.end[start:end] < end) + start
        self.end[later] = end
        self.period[later] = period

    def tells(self, starts: np.ndarray, ends: np.ndarray, distances: np.ndarray) -> np.ndarray:
        """Whether a run is known that holds the words from start to end and whose period divides the distance."""
        return (self.end[starts] >= ends) & (distances % self.period[starts] == 0)


def runs(codes: np.ndarray, shortest: int = 24, times: int = 3) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs in a text of words, given as codes from 0 on, by start, then period.

    A run is a stretch of at least ``shortest`` words and ``times`` periods that no word beside it extends; its
    period is the smallest one.
    """
    if times < 3:
        raise ValueError("runs hold three periods or more: with fewer no block need lie in one with its copy")
    words = len(codes)
    if words < max(shortest, times):
        return []
    # All starts of equal words of a run, and so one whole block of the first scale, whatever the period.
    certain = min(max(shortest - q, (times - 1) * q) for q in range(1, shortest // times + 2))
    scale = 1
    while 2 * (2 * scale) - 1 <= certain:
        scale *= 2
    found, ahead, first = _Found(words), _ahead(codes), True
    alphabet = int(codes.max()) + 1
    while (1 if first else scale) * times <= words:
        width = min(scale, WIDEST)
        starts = np.arange(0, words - width + 1, scale)
        # A block can only come back in the window if each of its words does.
        farthest = np.maximum.reduceat(ahead, np.column_stack([starts, starts + width]).ravel()[: 2 * len(starts) - 1])
        starts = starts[farthest[::2] < 2 * scale] if len(starts) else starts
        # In a run of at most half a block's words as period, copies lie at multiples of the period only.
        ends = np.minimum(starts + 3 * scale, words)
        starts = starts[(found.end[starts] < ends) | (2 * found.period[starts] > width)]
        firsts = [1, scale] if first else list(range(scale, 2 * scale, width))
        for seeds in _seeds(codes, starts, width, firsts, alphabet):
            _extend(codes, seeds[seeds[:, 1] * times <= words], width, shortest, times, found)
        scale, first = 2 * scale, False
    return sorted(((s, e - s, q) for (s, e), q in found.runs.items()), key=lambda run: (run[0], run[2]))


def _seeds(
    codes: np.ndarray, starts: np.ndarray, width: int, firsts: list[int], alphabet: int
) -> Iterator[np.ndarray]:
    """(start, distance) of blocks that come back: from each of the first distances, as many as a block has words."""
    rows = max(1, CELLS // (2 * width))
    block, window = np.arange(width), np.arange(2 * width)
    for low in range(0, len(starts), rows):
        some = starts[low : low + rows]
        blocks = codes[some[:, None] + block]
        for distance in firsts:
            at = some[:, None] + (distance + window)
            # What lies behind the text equals no word.
            windows = np.where(at < len(codes), codes[np.minimum(at, len(codes) - 1)], alphabet)
            which, place = np.nonzero(copies(blocks, windows))
            if len(which):
                yield np.column_stack([some[which], place + distance])


def _extend(codes: np.ndarray, seeds: np.ndarray, width: int, shortest: int, times: int, found: _Found) -> None:
    """Extend seeds of one scale, small distances first, and keep what is a run."""
    seeds = seeds[np.lexsort((seeds[:, 0], seeds[:, 1]))]
    edges = np.flatnonzero(np.diff(seeds[:, 1], prepend=-1, append=-1)) if len(seeds) else []
    for low, high in zip(edges[:-1], edges[1:]):
        distance = int(seeds[low, 1])
        left = seeds[low:high, 0]
        left = left[~found.tells(left, left + distance + width, np.full(len(left), distance))]
        while len(left):
            at = int(left[0])
            start = at - _matching(codes, at - 1, distance, -1)
            end = at + width + _matching(codes, at + width, distance, 1) + distance
            if end - start >= max(shortest, times * distance):
                found.add(start, end, distance)
            left = left[np.searchsorted(left, end - distance) :]


def _codes(words: list[bytes]) -> np.ndarray:
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))


def periodic_runs(
    documents: DataFrame, key: str = "doc_id", text: str = "text", shortest: int = 24, times: int = 3
) -> DataFrame:
    """(key, n_words, runs, collapsed): a row for each row of ``documents``.

    ``runs`` are (start, length, period) of the text's runs by start, then period, counted in words from 0; a run is
    a longest stretch of at least ``shortest`` words that repeats its first ``period`` words at least ``times`` times
    (the last time in part). ``collapsed`` is the text without the words that any run holds behind its first period,
    joined by one blank. Texts are read whole. Null, empty and blank texts have no words, no runs and an empty
    ``collapsed``; keys may be null or repeated and come back as they are; a table without rows gives none; other
    columns, whatever their names, are not read. Nothing is shuffled; a task holds one text at a time.
    """
    rows = documents.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("binary").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low, held, counts, lists, texts = 0, 0, [], [], []
            for n, value in enumerate(batch.column(1), 1):
                words = (value.as_py() or b"").split()  # at the six blanks of ASCII
                found = runs(_codes(words), shortest, times) if len(words) >= shortest else []
                counts.append(len(words))
                lists.append([dict(zip(("start", "length", "period"), r)) for r in found])
                texts.append(b" ".join(_kept(words, found)))
                held += len(texts[-1]) + 128 * len(found)
                if held >= FLUSH or n == batch.num_rows:
                    columns = [batch.column(0).slice(low, n - low), pa.array(counts, pa.int64())]
                    columns += [pa.array(lists, pa.list_(run)), pa.array(texts, pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, ["key", "n_words", "runs", "collapsed"])
                    low, held, counts, lists, texts = n, 0, [], [], []

    schema = f"key {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed binary"
    return rows.mapInArrow(searched, schema).select(
        F.col("key").alias(key), "n_words", "runs", F.col("collapsed").cast("string").alias("collapsed")
    )


def _kept(words: list[bytes], found: list[tuple[int, int, int]]) -> list[bytes]:
    if not found:
        return words
    kept = np.ones(len(words), bool)
    for start, length, period in found:
        kept[start + period : start + length] = False
    return [words[i] for i in np.flatnonzero(kept)]


def with_loops(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``documents`` with a passage repeated to the end of the text in about one of ten, as their keys say.

    With h the CRC of the key as text and g a tenth of it, texts with h divisible by ten and n words, n > 0, repeat
    from word a = g mod n on a passage of 1 + (n - a) div (3 + g mod 8) words. Rows without a key stay as they are.
    """
    h = F.crc32(F.col(f"`{key}`").cast("string"))
    g = F.floor(h / 10)

    def looped(words: Column) -> Column:
        n = F.size(words)
        a = (g % n).cast("int")
        passage = F.slice(words, a + 1, (F.floor((n - a) / (3 + g % 8)) + 1).cast("int"))
        tail = F.slice(F.flatten(F.array_repeat(passage, (3 + g % 8).cast("int"))), F.lit(1), n - a)
        return F.when(n > 0, F.array_join(F.concat(F.slice(words, F.lit(1), a), tail), " ")).otherwise("")

    words = F.regexp_extract_all(F.col(f"`{text}`"), F.lit(WORD), F.lit(0))
    # The words stand in a list of one, so that they are cut once for all uses.
    return documents.withColumn(
        text, F.when(h % 10 == 0, F.get(F.transform(F.array(words), looped), 0)).otherwise(F.col(f"`{text}`"))
    )


def digests(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256) of :func:`periodic_runs`:
    the run with the most periods, the first of them, and hashes of all runs and of the text that is left."""
    more = F.reduce(
        "runs",
        F.get("runs", 0),
        lambda best, r: F.when(r.length * best.period > best.length * r.period, r).otherwise(best),
    )
    line = F.transform("runs", lambda r: F.concat_ws(",", r.start, r.length, r.period))
    lines = F.array_join(F.transform(line, lambda one: F.concat(one, F.lit("\n"))), "")
    return found.withColumn("most", more).select(
        F.col(key),
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col(f"most.{c}").alias(c) for c in ("start", "length", "period")],
        F.expr("1000 * most.length div most.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
