"""Randomness tests, discovery and spans against plain Python; long texts full of keys in time that grows with them."""

from __future__ import annotations

import hashlib
import math
import random
import re
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidework.llm import secret_scan as scan

LETTERS = scan.ALPHABETS[9]


def normal(z: float) -> float:
    return upper(-z) if z < 0 else 1 - upper(z)


def upper(a: float) -> float:
    t = 1 / (1 + 0.2316419 * a)
    poly = t * (0.31938153 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return math.exp(-a * a / 2) * 0.3989422804014327 * poly


def battery(token: str) -> tuple | None:
    """(n, k, p_random, p_text) as the three tests are defined."""
    if token.isdigit():
        return None
    letters = next((a for a in [*scan.ALPHABETS, scan.MIXED] if set(token) <= set(a)), None)
    if letters is None:
        return None
    v, k, n = [letters.index(c) for c in token], len(letters), len(token)
    chi = sum(c * c for c in Counter(v).values()) * k / n - n
    centred = [2 * x - k + 1 for x in v]
    serial = abs(sum(a * b for a, b in zip(centred, centred[1:])) / ((k * k - 1) / 3 * math.sqrt(n - 1)))
    changes = sum((2 * a >= k) != (2 * b >= k) for a, b in zip(v, v[1:]))
    runs = abs((2 * changes - (n - 1)) / math.sqrt(n - 1))
    uniform = (chi - (k - 1)) / math.sqrt(2 * (k - 1) * (n - 1) / n)
    excess = max(0.0, n * (k * max(scan.TEXT_REPEAT, scan.TEXT_EXCESS / k) - 1))
    p = min(1.0, 3 * min(1 - normal(uniform), 2 * (1 - normal(serial)), 2 * (1 - normal(runs))))
    return n, k, p, normal((chi - (k - 1) - excess) / math.sqrt(2 * (k - 1) + 4 * excess))


def matches(pattern: str, text: str, kind: int) -> list[tuple]:
    return [(m.start(), kind, m.end(), m.group()) for m in re.finditer(pattern, text)]


def base_spans(text: str) -> list[tuple]:
    assign = [m for m in matches(scan.ASSIGN, text, 0) if len(re.search(scan.ASSIGN, m[3]).group(2)) >= 12]
    access = [m for m in matches(scan.ACCESS, text, 1) if len(m[3]) >= 18]
    return sorted(assign + access + [m for m in matches(scan.HEX, text, 2) if len(m[3]) >= 16])


def candidates(text: str, base: list[tuple]) -> list[list[tuple]]:
    beside = list(text)
    for start, _, end, _ in base:
        beside[start:end] = " " * (end - start)
    found = []
    for run in matches(scan.CANDIDATE, "".join(beside), 3):
        spans = {run}
        if re.search("[+/_-]", run[3]):
            for pattern in scan.PARTS:
                spans |= {(s + run[0], 3, e + run[0], t) for s, _, e, t in matches(pattern, run[3], 3)}
        found.append(sorted(spans))
    return found


def bin_of(p: float) -> int:
    return min(scan.LAST_BIN, math.floor(-math.log10(max(p, 1e-30)) * scan.BINS))


def brute(texts: list[str], rate: float = 0.01, level: float = 0.001) -> list[list[tuple]]:
    bins = Counter()
    for text in texts:
        base = base_spans(text)
        every = {s for run in candidates(text, []) for s in run} | {s for run in candidates(text, base) for s in run}
        tested = [t for s in every if (t := battery(s[3]))]
        bins.update((int(math.log2(n)), bin_of(p_text)) for n, _, _, p_text in tested)
    cuts = {}
    for band in {b for b, _ in bins}:
        counts = {x: n for (b, x), n in bins.items() if b == band}
        total = sum(counts.values())
        lower = [
            x
            for x in range(scan.LAST_BIN + 1)
            if any(y >= x for y in counts)
            and total * 10 ** (-x / scan.BINS) <= rate * sum(n for y, n in counts.items() if y >= x)
        ]
        cuts[band] = min(lower or [scan.LAST_BIN + 1])
    found = []
    for text in texts:
        base = base_spans(text)
        spans = list(base)
        for run in candidates(text, base):
            kept = []
            for s in run:
                t = battery(s[3])
                if t and t[2] >= level and bin_of(t[3]) >= cuts.get(int(math.log2(t[0])), scan.LAST_BIN + 1):
                    kept.append(s)
            end = 0
            for s in sorted(kept, key=lambda s: (s[0], -s[2])):
                if s[2] > end:
                    spans.append(s)
                    end = s[2]
        found.append(sorted(spans))
    return found


@pytest.fixture(scope="module")
def keys():
    pick = random.Random(11)

    def key(letters: str, n: int) -> str:
        return "".join(pick.choice(letters) for _ in range(n))

    words = ["river", "stone", "Haus", "fenêtre", "and", "then", "漢字", "some_long_identifier_in_a_program", "path/to/a/file/of/text"]
    texts = ["", "no key here"]
    for i in range(70):
        parts = [pick.choice(words) for _ in range(pick.randint(0, 30))]
        for _ in range(pick.randint(0, 4)):
            n = pick.randint(8, 90)
            parts.insert(
                pick.randint(0, len(parts)),
                pick.choice([
                    key(LETTERS, n), key(scan.ALPHABETS[0], n), key(scan.ALPHABETS[10], n), f"token={key(LETTERS, n)}",
                    f"AKIA{key(scan.ALPHABETS[6], n)}", f'API_KEY: "{key(scan.ALPHABETS[8], n)}"', "ab" * n, key("0123456789", n),
                    f"/v1/keys/{key(scan.ALPHABETS[8], n)}/use", f"sk_live_{key(LETTERS, n)}", key("abcde", n),
                ]),
            )
        texts.append(pick.choice([" ", "\n", ", "]).join(parts))
    return texts


def test_battery_of_single_tokens(spark):
    pick = random.Random(4)
    alphabets = [*scan.ALPHABETS, scan.MIXED, "abc", "0123456789"]
    tokens = ["".join(pick.choice(a) for _ in range(n)) for a in alphabets for n in (20, 33, 64, 500)] + ["thequickbrownfoxjumpsover"]
    frame = spark.createDataFrame([(t,) for t in tokens], "t string")
    for row in frame.select("t", scan.battery(F.col("t")).alias("b")).collect():
        want = battery(row.t)
        assert (row.b is None) == (want is None)
        if want:
            assert (row.b.n, row.b.k) == want[:2]
            assert row.b.p_random == pytest.approx(want[2], abs=1e-9)
            assert row.b.p_text == pytest.approx(want[3], abs=1e-9)


def test_all_spans_of_a_corpus(spark, keys):
    rows = list(enumerate(keys))
    found = {r.doc_id: r for r in scan.secret_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute(keys)
    assert sum(len([s for s in spans if s[1] == 3]) for spans in want) > 20

    def digest(spans):
        return ",".join(f"{scan.KINDS[k]}:{s}:{e}" for s, k, e, _ in spans)

    for i, spans in enumerate(want):
        assert found[i].spans == digest(spans), keys[i]
        base = [s for s in spans if s[1] < 3]
        assert found[i].base_sha256 == hashlib.sha256(digest(base).encode()).hexdigest()
        assert (found[i].n_assign, found[i].n_access, found[i].n_hex) == tuple(sum(s[1] == k for s in base) for k in range(3))


def test_masked_texts_of_a_corpus(spark, keys):
    rows = list(enumerate(keys))
    found = dict(scan.masked(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    for i, spans in enumerate(brute(keys)):
        out, at = [], 0
        for s, _, e, _ in spans:
            if s > at or (at == 0 and s == 0):
                out += [keys[i][at:s], "[SECRET]"]
            at = max(at, e)
        assert found[i] == "".join(out) + keys[i][at:]


@pytest.mark.parametrize("form", ["%032x\n", "é token=%032xZ /"])
def test_time_grows_with_the_number_of_keys(spark, form):
    pick = random.Random(1)
    seconds = []
    for count in (1000, 4000):
        text = "".join(form % pick.getrandbits(128) for _ in range(count))
        frame = spark.createDataFrame([(1, text)], "doc_id long, text string")
        start = time.perf_counter()
        row = scan.secret_spans(frame).first()
        clean = scan.masked(frame).first().text
        seconds.append(time.perf_counter() - start)
        assert row.spans.count(":") >= 2 * 0.9 * count and clean.count("[SECRET]") >= 0.9 * count
    assert seconds[1] < 8 * seconds[0] + 2, seconds
