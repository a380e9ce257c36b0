import datetime as dt
import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tidework.functions.literals import NEVER, comparison, parse_instant


@pytest.fixture(scope="module")
def typed(spark):
    return spark.sql(
        r"""
        SELECT * FROM VALUES
          (1, 1Y, 10000000000L, 0.1F, 0.1D, 1.50BD, true, DATE'2024-01-02', TIMESTAMP'2024-01-02 03:04:05.678901Z',
           TIMESTAMP_NTZ'2024-01-02 03:04:05.678901', 'it\'s \\ here'),
          (-3, 2Y, -1L, 2.5F, double('NaN'), -0.25BD, false, DATE'2024-01-03', TIMESTAMP'1969-12-31 23:59:59.5Z',
           TIMESTAMP_NTZ'1969-12-31 23:59:59.5', ''),
          (NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL)
        AS t(i, b, l, f, d, n, ok, day, at, local_at, s)
        """
    )


def count(df, column, op, text):
    return df.where(comparison(df, column, op, text)).count()


@pytest.mark.parametrize(
    "column, op, text, rows",
    [
        ("i", "=", "1", 1),
        ("i", "=", " 1 ", 1),
        ("i", "=", "1.0", 1),
        ("i", "=", "1.5", 0),
        ("i", "<", "1.5", 2),
        ("i", ">", "-3.5", 2),
        ("i", ">", "-3", 1),
        ("i", "=", "abc", 0),
        ("i", "<", "99999999999999999999999999999999999999999", 2),
        ("i", "<", "1e400", 2),
        ("i", "<", "NaN", 2),
        ("i", ">", "-Infinity", 2),
        ("b", "<", "2", 1),
        ("b", "<", "300", 2),
        ("l", "=", "10000000000", 1),
        ("f", "=", "0.1", 1),
        ("d", "=", "0.1", 1),
        ("d", "=", "nan", 1),
        ("d", ">", "5", 1),
        ("n", "=", "1.5", 1),
        ("n", "<", "-0.2499999", 1),
        ("ok", "=", "Yes", 1),
        ("ok", "=", "maybe", 0),
        ("day", "=", "2024-01-02", 1),
        ("day", "=", "2024-01-02T00:00:01Z", 0),
        ("day", ">", "2024-01-02T00:00:01Z", 1),
        ("day", "<", "2024-01-02T00:00:01Z", 1),
        ("at", "=", "2024-01-02T03:04:05.678901Z", 1),
        ("at", "=", "2024-01-02T05:04:05.678901999+02:00", 0),
        ("at", "=", "2024-01-02T05:04:05.678901000+02:00", 1),
        ("at", "<", "2024-01-02T05:04:05.678901999+02:00", 2),
        ("at", "<", "1970-01-01", 1),
        ("at", "<", "yesterday", 0),
        ("local_at", "=", "2024-01-02T03:04:05.678901Z", 1),
        ("local_at", "=", "2024-01-02T05:04:05.678901+02:00", 1),
        ("local_at", ">", "1969-12-31 23:59:59.5", 1),
        ("s", "=", "it's \\ here", 1),
        ("S", "=", "nothing", 0),
    ],
)
def test_comparison(typed, column, op, text, rows):
    assert count(typed, column, op, text) == rows


def test_unparsable_text_holds_for_no_row(typed):
    assert comparison(typed, "i", "<", "1.5.2") == NEVER
    assert comparison(typed, "at", ">", "2024-13-01") == NEVER


def test_unknown_and_unfit_columns(spark, typed):
    with pytest.raises(ValueError, match="no column 'x'"):
        comparison(typed, "x", "=", "1")
    with pytest.raises(ValueError, match="cannot be compared"):
        comparison(spark.sql("SELECT array(1) AS a"), "a", "=", "1")


def test_session_settings_do_not_matter(spark, typed):
    for key, value in (("spark.sql.ansi.enabled", "false"), ("spark.sql.session.timeZone", "Asia/Tokyo")):
        old = spark.conf.get(key)
        spark.conf.set(key, value)
        try:
            assert count(typed, "at", "=", "2024-01-02T03:04:05.678901Z") == 1
            assert count(typed, "local_at", "=", "2024-01-02T03:04:05.678901Z") == 1
            assert count(typed, "i", "<", "1.5") == 2
            assert count(typed, "i", "=", "abc") == 0
        finally:
            spark.conf.set(key, old)


def test_parse_instant():
    assert parse_instant("2024-07-25T16:47:00Z") == dt.datetime(2024, 7, 25, 16, 47, tzinfo=dt.timezone.utc)
    assert parse_instant("2024-07-25 18:47:00.1234567+02:00").microsecond == 123456


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.sampled_from(["=", "<", ">", "<=", ">="]),
    st.one_of(st.integers(-4, 4).map(str), st.decimals(-4, 4, places=2).map(str), st.just("-0.0"), st.just("3e0")),
)
def test_integers_compare_like_numbers(spark, op, text):
    values = list(range(-4, 5))
    df = spark.range(-4, 5).withColumnRenamed("id", "v")
    test = {
        "=": lambda v: v == float(text),
        "<": lambda v: v < float(text),
        ">": lambda v: v > float(text),
        "<=": lambda v: v <= float(text),
        ">=": lambda v: v >= float(text),
    }[op]
    if math.isfinite(float(text)):
        assert [r.v for r in df.where(comparison(df, "v", op, text)).collect()] == [v for v in values if test(v)]
