"""Pivotal rounding against plain Python, and equal rows dealt over all tasks."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidework.llm import mixing

ROWS = "doc_id long, text string, source string, extra string"


def _coins(spark, orders, level):
    pairs = spark.createDataFrame([(a, b) for a in orders for b in orders], "a long, b long")
    return {(r.a, r.b): r.coin for r in pairs.select("a", "b", mixing._coin(level, F.col("a"), F.col("b")).alias("coin")).collect()}


def _folded(items, coins):
    """(open, {id: taken}): documents one after another, each paired with the one that is still open."""
    open_, done = None, {}
    for size, order, mass, name in sorted(items, reverse=True):
        if open_ is None:
            open_ = (size, order, mass, name)
            continue
        a_size, a_order, a_mass, a_name = open_
        up, down = min(a_size - a_mass, mass), min(a_mass, size - mass)
        if coins[a_order, order] * (up + down) < down:  # the open one gains ``up`` words
            a_mass, mass = a_mass + up, mass - up
        else:
            a_mass, mass = a_mass - down, mass + down
        if min(a_mass, a_size - a_mass) < 1e-9:
            done[a_name], open_ = a_mass > a_size / 2, (size, order, mass, name)
        else:
            done[name], open_ = mass > size / 2, (a_size, a_order, a_mass, a_name)
    return open_, done


@pytest.mark.parametrize("level", [0, 3])
def test_a_group_is_settled_as_in_plain_python(spark, level):
    items = [(3 + i * 7 % 23, 1000 + i * 37 % 41, (3 + i * 7 % 23) * (1 + i % 9) / 10, i) for i in range(40)]
    rows = [("s", 0, size, order, mass, (name, 0)) for size, order, mass, name in items]
    frame = spark.createDataFrame(rows, "source string, group long, size long, order long, mass double, id struct<a:long,b:int>")
    found = mixing._round(frame, level).first()
    open_, done = _folded([(s, o, m, i) for s, o, m, i in items], _coins(spark, [o for _, o, _, _ in items], level))
    assert {r.id.a: r.taken for r in found.done} == done
    assert found.open.id.a == open_[3] and found.open["size"] == open_[0] and abs(found.open.mass - open_[2]) < 1e-6
    # What is taken and what stays open is what was there, in words.
    sizes = {name: size for size, _, _, name in items}
    assert abs(sum(sizes[k] for k, taken in done.items() if taken) + open_[2] - sum(m for _, _, m, _ in items)) < 1e-6


def _documents(spark):
    rows = [(1, "the same few words", "a", str(i % 3)) for i in range(1000)]
    rows += [(i, f"{'word ' * (1 + i % 11)}{i}", "abc"[i % 3], None) for i in range(2, 2000)]
    return spark.createDataFrame(rows + [(None, None, None, None)] * 5, ROWS)


def test_equal_rows_are_counted_and_dealt_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(mixing, "EQUAL", 64)
    documents = _documents(spark)
    found = mixing.mixture(documents)
    rows = found.withColumn("task", F.spark_partition_id()).collect()
    assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in documents.collect())
    same = [r for r in rows if r.doc_id == 1]
    assert max(r.copies for r in same) - min(r.copies for r in same) <= 1
    assert len({r.task for r in same}) > 2 and max(Counter(r.task for r in same).values()) < 700
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan.replace("WindowGroupLimit", "")


def test_resampled_takes_equal_rows_as_often_as_the_mixture(spark):
    documents = _documents(spark)
    wanted = Counter()
    for r in mixing.mixture(documents).collect():
        wanted[r.doc_id] += r.copies
    rows = mixing.resampled(documents).collect()
    assert Counter(r.doc_id for r in rows) == +wanted
    again = mixing.resampled(documents.repartition(5)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
