import datetime as dt
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidework import rows_before, time_slices
from tidework.operators import slices


def test_same_as_one_window_over_everything(table):
    orders = table("orders")
    sliced = time_slices(orders, 1000, "o_orderdate")
    window = orders.withColumn(
        "slice_id", F.expr("cast((rank() over (order by o_orderdate) - 1) div 1000 as bigint)")
    )
    assert sliced.schema.names == window.schema.names
    assert sliced.exceptAll(window).count() == 0 and window.exceptAll(sliced).count() == 0
    sizes = [r["count"] for r in sliced.groupBy("slice_id").count().collect()]
    assert len(sizes) == 15 and sum(sizes) == 15_000


def test_rows_without_time_stay(spark):
    df = spark.sql("SELECT * FROM VALUES (TIMESTAMP'2024-01-01 00:00:00', 1), (NULL, 2) AS t(time, v)")
    assert {r.v: r.slice_id for r in time_slices(df, 10).collect()} == {1: 0, 2: None}
    with pytest.raises(ValueError, match="at least one row"):
        time_slices(df, 0)


@pytest.mark.parametrize("bits", [1, 3, 21])
def test_any_tree_gives_the_same_sums(spark, monkeypatch, bits):
    monkeypatch.setattr(slices, "_BITS", bits)
    ticks = [-9, -9, -1, 0, 0, 0, 1, 5, 8, 8, 64, 1000]
    df = spark.createDataFrame([(t,) for t in ticks], "time long")
    got = {r.tick: r["__before"] for r in rows_before(df).collect()}
    assert got == {t: sum(other < t for other in ticks) for t in ticks}


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(
        st.datetimes(dt.datetime(1960, 1, 1), dt.datetime(2100, 1, 1)).map(
            lambda t: t.replace(microsecond=t.microsecond % 3)
        ),
        min_size=1,
        max_size=30,
    ),
    st.integers(1, 7),
)
def test_against_plain_python(spark, times, n):
    times = times + times[:3]
    df = spark.createDataFrame([(t.isoformat(),) for t in times], "s string").selectExpr(
        "cast(s as timestamp_ntz) AS time"
    )
    got = Counter((r.time, r.slice_id) for r in time_slices(df, n).collect())
    assert got == Counter((t, sum(other < t for other in times) // n) for t in times)


def test_no_window_sees_all_rows_and_nodes_are_counted_once(table):
    sliced = time_slices(table("orders"), 1000, "o_orderdate")
    final = sliced.groupBy("slice_id").count()
    final.collect()
    text = final._jdf.queryExecution().executedPlan().finalPhysicalPlan().treeString()
    # Read are the rows themselves, and only the time column for leaves and for nodes.
    assert text.count("FileScan") == 3 and text.count("ReusedExchange") == 1
    assert text.count("ReadSchema: struct<o_orderdate:timestamp_ntz>") == 3
    # The only window without a partition runs over the tree's top nodes.
    assert text.count("SinglePartition") == 1
