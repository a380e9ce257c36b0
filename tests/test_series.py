import math
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidework import epoch_columns, series
from tidework.functions.values import parse_float


def same(a, b):
    return (math.isnan(a) and math.isnan(b)) or a == b


def test_wide_to_long(spark):
    df = spark.sql("SELECT 1 AS x, 2 AS y, 'a' AS label, 4.5BD AS `odd.name`")
    rows = series(df, "x", "y", "x", "odd.name", "y").collect()
    assert [(r.label, r.x, r.y) for r in rows] == [
        ("y", 1.0, 2.0),
        ("x", 1.0, 1.0),
        ("odd.name", 1.0, 4.5),
        ("y", 1.0, 2.0),
    ]
    assert series(df, "x", "y").dtypes == [("label", "string"), ("x", "double"), ("y", "double")]


def test_empty_names_are_ignored(spark):
    df = spark.sql("SELECT 1 AS x, 2 AS y")
    assert series(df, "x", "y", "", "Select a column").count() == 1
    for x, y in (("", "y"), ("x", ""), ("x", "Select a column")):
        with pytest.raises(ValueError, match="needs an x column"):
            series(df, x, y)
    with pytest.raises(ValueError, match="no column"):
        series(df, "x", "z")


@pytest.mark.parametrize(
    "text, value",
    [
        ("12abc", 12.0),
        (" -3.5e2x", -350.0),
        (".5", 0.5),
        ("1e", 1.0),
        ("1.e3.4", 1000.0),
        ("+7", 7.0),
        ("\t 4", 4.0),
        ("-Infinity!", -math.inf),
        ("abc", math.nan),
        ("", math.nan),
        ("- 1", math.nan),
        (None, math.nan),
    ],
)
def test_numeric_prefix(spark, text, value):
    df = spark.createDataFrame([(text,)], "s string")
    assert same(df.select(parse_float(df, "s").alias("v")).first().v, value)


def test_numbers_of_other_types(spark):
    df = spark.sql("SELECT CAST(NULL AS INT) AS i, true AS b, 1.25BD AS n, TIMESTAMP'2024-07-25 00:00:00' AS at, array(1) AS a")
    row = df.select(*[parse_float(df, c).alias(c) for c in df.columns]).first()
    assert math.isnan(row.i) and math.isnan(row.b) and math.isnan(row.a)
    assert row.n == 1.25 and row["at"] == 2024.0


@settings(max_examples=30, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("0123456789.eE+- xInfty", max_size=8), min_size=1, max_size=20))
def test_numeric_prefix_is_the_longest(spark, texts):
    number = re.compile(r"\s*[+-]?(Infinity|(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?)$", re.ASCII)

    def longest(text):
        for end in range(len(text), 0, -1):
            if number.match(text[:end]):
                return float(text[:end])
        return math.nan

    df = spark.createDataFrame([(t, i) for i, t in enumerate(texts)], "s string, i int")
    got = [r.v for r in df.select("i", parse_float(df, "s").alias("v")).orderBy("i").collect()]
    assert all(same(a, longest(t)) for a, t in zip(got, texts))


def test_times(spark):
    df = spark.sql(
        """SELECT * FROM VALUES
           (TIMESTAMP'2024-07-25 16:47:00.123999Z', '2024-07-25T16:47:00.123999Z', 1.5D, 7),
           (TIMESTAMP'1969-12-31 23:59:59.9999Z', '2024-07-25', double('NaN'), 8),
           (NULL, 'never', NULL, 9) AS t(time, timeText, some_TIME, n)"""
    )
    rows = series(df, "time", "timeText", "some_TIME").where("label = 'timeText'").collect()
    assert rows[0].x == rows[0].y == 1721926020123.0
    assert rows[1].x == -1.0 and rows[1].y == 1721865600000.0
    assert math.isnan(rows[2].x) and math.isnan(rows[2].y)
    numbers = series(df, "n", "some_TIME").collect()
    assert numbers[0].y == 1.5 and math.isnan(numbers[1].y) and math.isnan(numbers[2].y)


def test_epoch_columns_as_coordinates(spark):
    df = epoch_columns(spark.sql("SELECT TIMESTAMP'2024-07-25 16:47:00.123456Z' AS time"))
    rows = {r.label: r.y for r in series(df, "time", "time_ns", "time_s").collect()}
    assert rows == {"time_ns": 1721926020123.0, "time_s": 1721926020000.0}


def test_only_the_drawn_columns_are_read(table, plan):
    text = plan(series(table("lineitem"), "l_orderkey", "l_tax"))
    assert "ReadSchema: struct<l_orderkey:bigint,l_tax:double>" in text
    assert "Exchange" not in text


def test_unused_series_rows_can_be_counted(table):
    lines = table("lineitem")
    assert series(lines, "l_orderkey", "l_tax", "l_discount").groupBy("label").agg(F.count("*")).count() == 2
