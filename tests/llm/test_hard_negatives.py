"""Hard negatives against a search through all rows."""

from __future__ import annotations

import random
from math import floor, inf, isfinite, nan

import pytest
from pyspark.sql import functions as F

from tidework.llm import hard_negatives as module
from tidework.llm.common import read
from tidework.llm.hard_negatives import hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label string, anchor boolean, a long, v string, copies string"


def brute(rows: list[tuple], is_anchor, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100):
    usable = [
        (key, [floor(256 * x) for x in vector], label)
        for key, vector, label, *_ in rows
        if label is not None and vector is not None and all(x is not None and isfinite(x) for x in vector)
    ]
    found = []
    for at, (key, vector, label) in enumerate(usable):
        if not is_anchor(key):
            continue
        others = [
            (-sum(x * y for x, y in zip(vector, v)), k is None, k, same == label)
            for n, (k, v, same) in enumerate(usable)
            if n != at and len(v) == len(vector)
        ]
        mine = sorted(o for o in others if o[3])[:positives]
        for s, _, p, _ in mine:
            near = sorted(o for o in others if not o[3] and low * -s <= 100 * -o[0] <= high * -s)[:negatives]
            found += [(key, p, n, k, -s, -score) for n, (score, _, k, _) in enumerate(near, 1)]
    return sorted(found, key=str)


def some_rows(seed: int, count: int) -> list[tuple]:
    pick = random.Random(seed)
    rows = []
    for key in range(count):
        vector = [pick.choice([-1.0, 0.5, 0.25, 1.0, 2.0, 3.0]) + 1 for _ in range(pick.choice([0, 2, 3, 3, 3]))]
        rows.append((key, vector, pick.choice("xyz"), None, 1, "v", None))
    rows += [rows[10]] * 3 + [rows[20]] * 40 + [(None, [1.0, 2.0, 2.0], "x", True, None, None, None)]
    rows += [(10, [2.0, 2.0, 2.0], "y", None, 1, "v", None)]  # a key with two vectors
    rows += [(500, None, "x", None, 1, "v", "c"), (510, [1.0, None, 1.0], "x", None, 1, "v", "c")]
    rows += [(520, [1.0, nan, 1.0], "x", None, 1, "v", "c"), (530, [1.0, inf, 1.0], "y", None, 1, "v", "c")]
    rows += [(540, [1.0, 1.0, 1.0], None, None, 1, "v", "c")]
    return rows


@pytest.mark.parametrize("blocks", [None, (7, 2)])
def test_ties_repeats_and_gaps(spark, monkeypatch, blocks):
    if blocks:
        monkeypatch.setattr(module, "ROWS", blocks[0])
        monkeypatch.setattr(module, "ANCHORS", blocks[1])
        monkeypatch.setattr(module, "CELLS", 5)
    rows = some_rows(4, 90)
    found = hard_negatives(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 10 == 0)
    expected = brute(rows, lambda k: k is not None and k % 10 == 0)
    assert sorted((tuple(r) for r in found.collect()), key=str) == expected
    assert len({r[:2] for r in expected}) > 20


@pytest.mark.parametrize(("low", "high", "keep"), [(0, 100, 2), (50, 99, 3), (100, 100, 4), (90, 130, 1)])
def test_other_windows(spark, low, high, keep):
    rows = some_rows(8, 60)
    found = hard_negatives(
        spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 6 == 0, positives=3, negatives=keep, low=low, high=high
    )
    expected = brute(rows, lambda k: k is not None and k % 6 == 0, 3, keep, low, high)
    assert sorted((tuple(r) for r in found.collect()), key=str) == expected


def test_scores_are_exact_in_wide_numbers(spark):
    """Too large for floats of either size, then too large altogether."""
    rows = [(k, [float(2**18 + k), float(k % 3), 0.5], "xy"[k % 2], None, 1, "v", None) for k in range(40)]
    frame = spark.createDataFrame(rows, SCHEMA)
    found = hard_negatives(frame, F.col("vec_id") % 10 == 0, low=99)
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute(rows, lambda k: k % 10 == 0, low=99)
    with pytest.raises(Exception, match="too large for exact scores"):
        hard_negatives(frame.withColumn("embedding", F.expr("array(1e9f, 1f)")), F.col("vec_id") % 10 == 0).collect()


def test_windows_that_make_no_sense_and_empty_tables(spark):
    nothing = spark.createDataFrame([], SCHEMA)
    assert hard_negatives(nothing, F.col("vec_id") % 10 == 0).count() == 0
    with pytest.raises(ValueError, match="share"):
        hard_negatives(nothing, F.lit(True), low=90, high=80)


def test_a_frequent_row_is_no_group_of_its_own(spark):
    """A third of all rows equal: no task sees them, only their number."""
    table = read(spark, "/root/testdata/sf0.01", "embeddings")
    hot = table.where("vec_id = 100").crossJoin(spark.range(20_000)).drop("id")
    found = hard_negatives(table.where("vec_id <> 100").unionByName(hot), F.col("vec_id") == 200)
    assert 0 < found.count() <= 25
    again = hard_negatives(table.where("vec_id <> 100").unionByName(hot), F.col("vec_id") == 100)
    assert again.count() % 20_000 == 0
