"""Windows whose frequent keys are cut into ranges, and joins on intervals alone, against plain Python."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tests.compare import database, difference
from tests.test_joins import largest_task, shuffled, small_pieces  # noqa: F401
from tidework import (
    largest,
    last_value,
    overlap_join,
    overlap_parts,
    previous,
    row_numbers,
    running,
    sessions,
    smallest,
    sums,
)

COLUMNS = {
    "n": row_numbers(),
    "total": sums("v"),
    "low": smallest("v"),
    "high": largest("v"),
    "before": previous("v"),
    "last": last_value("v"),
}


def expected(rows: list[tuple]) -> list[tuple]:
    found, by_key = [], {}
    for row in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0)):
        by_key.setdefault(row[0], []).append(row)
    for key, some in by_key.items():
        for n, (_, at, v, _) in enumerate(some):
            known = [r[2] for r in some[: n + 1] if r[2] is not None]
            before = some[n - 1][2] if n else None
            sums_ = (sum(known), min(known), max(known), before, known[-1]) if known else (None, None, None, before, None)
            found.append((key, at, v, n + 1, *sums_))
    return sorted(found, key=str)


ROWS = st.lists(
    st.tuples(st.one_of(st.none(), st.integers(0, 2)), st.one_of(st.none(), st.integers(-5, 5))), max_size=40
)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(ROWS, st.integers(0, 80))
def test_running_columns_agree_with_plain_python(spark, pairs, frequent):
    pairs = pairs + [(1, n % 7 if n % 5 else None) for n in range(frequent)]
    places = random.Random(len(pairs)).sample(range(1000), len(pairs))
    rows = [(k, at if n else None, v, "x") for n, ((k, v), at) in enumerate(zip(pairs, places))]
    frame = spark.createDataFrame(rows, "k int, at int, v int, __key string")
    found = running(frame.withColumnRenamed("__key", "other"), "k", "at", COLUMNS)
    assert sorted((tuple(r[:3]) + tuple(r[4:]) for r in found.collect()), key=str) == expected(rows)


def test_ties_and_several_keys_and_orders(spark):
    rows = spark.range(4000).selectExpr("id % 2 AS a", "if(id % 3 = 0, 'x', string(id % 50)) AS b", "id % 4 AS day", "id AS v")
    found = running(rows, ["a", "b"], ["day", "v"], {"n": row_numbers(), "total": sums("v")})
    rows.createOrReplaceTempView("ties")
    plain = spark.sql(
        "SELECT *, bigint(row_number() OVER w) AS n, sum(v) OVER w AS total FROM ties WINDOW w AS "
        "(PARTITION BY a, b ORDER BY day, v ROWS UNBOUNDED PRECEDING)"
    )
    assert found.exceptAll(plain).count() == 0 and found.count() == 4000
    # Without a last column the order of ties is open, but it is the same each time and complete.
    open_ = running(rows, "a", "day", {"n": row_numbers()})
    assert open_.exceptAll(running(rows, "a", "day", {"n": row_numbers()})).count() == 0
    assert open_.groupBy("a", "n").count().where("count > 1").count() == 0


def test_a_key_with_a_third_of_all_rows_is_spread_over_tasks(spark, shuffled):  # noqa: F811
    rows = spark.range(0, 60_000, 1, 40).selectExpr("if(id % 3 = 0, -1, id % 9000) AS k", "id AS at", "id % 11 AS v")
    for key, found in (
        ("k", running(rows, "k", "at", {"n": row_numbers(), "total": sums("v"), "before": previous("at")})),
        ("one", running(rows.withColumn("one", F.lit("x")), "one", "at", {"n": row_numbers(), "before": previous("at")})),
        ("k", sessions(rows.withColumn("t", F.timestamp_seconds("at")), "k", "t", 2)),
    ):
        assert largest_task(found) < 10_000
        assert found.count() == 60_000
    numbered = running(rows, "k", "at", {"n": row_numbers(), "total": sums("v"), "before": previous("at")})
    hot = numbered.where("k = -1").agg(F.max("n"), F.max("total"), F.sum(F.col("at") - F.col("before")), F.countDistinct("n"))
    assert tuple(hot.first()) == (20_000, sum(i % 11 for i in range(0, 60_000, 3)), 59_997, 20_000)


def test_sessions_end_where_the_gap_is_longer(spark, shuffled):  # noqa: F811
    start = dt.datetime(2024, 1, 1)
    rows = []
    for key, gaps in (("a", [0, 60, 60, 61, 60]), (None, [0, 61]), ("b", [0])):
        at = start
        for gap in gaps:
            at += dt.timedelta(seconds=gap)
            rows.append((key, at))
    rows.append(("a", None))
    found = sessions(spark.createDataFrame(rows, "k string, t timestamp"), "k", "t", 60)
    ids = [r.session for r in found.orderBy("k", "t").collect()]
    assert ids == [1, 2, None, 1, 1, 1, 2, 2, 1]
    assert sessions(spark.createDataFrame([], "k string, t timestamp"), "k", "t", 60).count() == 0


def test_sessions_of_a_frequent_key_cross_its_ranges(spark, shuffled):  # noqa: F811
    pick, at, rows = random.Random(3), 0, []
    for _ in range(9000):
        at += pick.choice([1, 1, 1, 1, 50])
        rows.append((1, at))
    frame = spark.createDataFrame(rows, "k int, at long").withColumn("t", F.timestamp_seconds("at"))
    session, last, want = 0, None, {}
    for _, at in rows:
        session += last is None or at - last > 10
        last = want[at] = at
        want[at] = session
    assert {r.at: r.session for r in sessions(frame, "k", "t", 10).collect()} == want


def test_rows_that_may_differ_are_refused(spark):
    with pytest.raises(ValueError, match="written?|write"):
        running(spark.range(10).limit(5), "id", "id", {"n": row_numbers()})


def test_an_empty_frame_has_the_columns(spark):
    found = running(spark.range(0).selectExpr("id AS k", "id AS at", "id AS v"), "k", "at", COLUMNS)
    assert found.columns == ["k", "at", "v", *COLUMNS] and found.count() == 0


SPANS = st.lists(st.tuples(st.one_of(st.none(), st.integers(-70, 70)), st.sampled_from([None, -1, 0, 1, 2, 5, 30, 400])), max_size=25)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(SPANS, SPANS)
def test_overlaps_agree_with_plain_python(spark, a, b):
    def frame(spans):
        rows = [(i, s, None if s is None or n is None else s + n) for i, (s, n) in enumerate(spans)]
        return rows, spark.createDataFrame(rows, "id int, s long, e long")

    (left, mine), (right, theirs) = frame(a), frame(b)
    whole = lambda r: None not in r and r[1] <= r[2]
    want = [x + y for x in left for y in right if whole(x) and whole(y) and x[1] <= y[2] and y[1] <= x[2]]
    found = overlap_join(mine, theirs, ("s", "e"), ("s", "e"))
    assert found.columns == ["id", "s", "e", "id_right", "s_right", "e_right"]
    assert sorted(map(tuple, found.collect())) == sorted(want)


def test_overlaps_at_the_ends_of_the_line(spark):
    ends = spark.sql(f"SELECT * FROM VALUES (1, {-(2**63)}L, {2**63 - 1}L), (2, {2**63 - 1}L, {2**63 - 1}L), (3, -1L, 0L) AS t(i, s, e)")
    found = overlap_join(ends, ends, ("s", "e"), ("s", "e")).select("i", "i_right").collect()
    assert sorted(map(tuple, found)) == [(1, 1), (1, 2), (1, 3), (2, 1), (2, 2), (3, 1), (3, 3)]


def test_overlaps_are_found_by_equality(table, plan):
    events = table("events").select("event_id", "ts", F.expr("ts + INTERVAL 1 HOUR").alias("until"))
    text = plan(overlap_join(events, events, ("ts", "until"), ("ts", "ts")), run=False)
    assert "NestedLoop" not in text and "Cartesian" not in text


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(SPANS, SPANS, st.booleans())
def test_parts_add_up_to_the_pairs_of_plain_python(spark, a, b, grouped):
    def frame(spans):
        rows = [(i, s, None if s is None or n is None else s + n, ("x", "y", None)[i % 3]) for i, (s, n) in enumerate(spans)]
        return rows, spark.createDataFrame(rows, "id int, s long, e long, k string")

    (left, mine), (right, theirs) = frame(a), frame(b)
    want = {}
    for x in left:
        for y in right:
            if None not in x[1:3] + y[1:3] and x[1] <= x[2] and y[1] <= y[2] and x[1] <= y[2] and y[1] <= x[2]:
                want.setdefault((x[0], y[3]) if grouped else (x[0],), []).append(y[0])
    parts = overlap_parts(
        mine, theirs, ("s", "e"), ("s", "e"), ["id"], ["k"] if grouped else [], {"low": "id"}, {"high": "id"}
    )
    assert parts.columns == ["id", *(["k_right"] if grouped else []), "n", "low", "high"]
    found = parts.groupBy("id", *(["k_right"] if grouped else [])).agg(F.sum("n"), F.min("low"), F.max("high"))
    assert {tuple(r[:-3]): tuple(r[-3:]) for r in found.collect()} == {k: (len(v), min(v), max(v)) for k, v in want.items()}


def test_parts_at_the_ends_of_the_line(spark):
    ends = spark.sql(f"SELECT * FROM VALUES (1, {-(2**63)}L, {2**63 - 1}L), (2, {2**63 - 1}L, {2**63 - 1}L), (3, -1L, 0L) AS t(i, s, e)")
    parts = overlap_parts(ends, ends, ("s", "e"), ("s", "e"), ["i"], greatest={"high": "i"})
    found = parts.groupBy("i").agg(F.sum("n"), F.min("high"), F.max("high")).select("i", "sum(n)", "max(high)").collect()
    assert sorted(map(tuple, found)) == [(1, 3, 3), (2, 2, 2), (3, 2, 3)]


def test_parts_of_rows_that_all_meet_are_spread_over_tasks(spark, shuffled):  # noqa: F811
    rows = spark.range(0, 8000, 1, 20).selectExpr("id", "id AS s", "id + 20000 AS e")
    parts = overlap_parts(rows, rows, ("s", "e"), ("s", "e"), ["id"], least={"low": "id"}, greatest={"high": "id"})
    found = parts.groupBy("id").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    assert found.where("n = 8000 AND low = 0 AND high = 7999").count() == 8000
    assert largest_task(parts) < 16_000


def most_rows(df) -> int:
    """The most rows that a step of the plan made."""
    df.collect()
    open_, most = [df._jdf.queryExecution().executedPlan()], 0
    while open_:
        node = open_.pop()
        made = node.metrics().get("numOutputRows")
        most = max(most, made.get().value() if made.isDefined() else 0)
        if node.nodeName() == "AdaptiveSparkPlan":
            open_.append(node.executedPlan())
        elif node.nodeName().endswith("QueryStage"):
            open_.append(node.plan())
        else:
            children = node.children()
            open_ += [children.apply(i) for i in range(children.size())]
    return most


@pytest.mark.parametrize("name", ["range_join_binned", "range_join_mixed_lengths"])
def test_dense_events_are_joined_without_their_pairs(spark, tmp_path, name):
    events = spark.range(3000).selectExpr(
        "id AS event_id", "timestamp_millis(1704067200000 + id * 10) AS ts", "concat('t', id % 5) AS event_type"
    )
    events.toPandas().to_parquet(tmp_path / "events.parquet", coerce_timestamps="us")
    folder = str(tmp_path)
    assert difference(spark, database(folder), folder, name) is None
    # All 3,000 are within 30 seconds: 4 to 9 million pairs.
    assert most_rows(entry.queries()[name](spark, folder)) < 100_000
