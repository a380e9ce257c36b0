import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tidework import BasicQuery, Condition, basic_to_df, basic_to_sql, transform
from tidework.operators.basic import split_columns


def rows(df):
    return sorted(map(str, df.collect()))


def test_column_list():
    assert split_columns(" a, b ,c") == ("a", "b", "c")
    assert split_columns("") == split_columns("Select columns") == ()


def test_columns_are_values_not_their_names(spark):
    df = spark.sql("SELECT 1 AS k, 's' AS `my col`, 2 AS `a``b`")
    query = BasicQuery(("my col", "a`b"), (Condition("K", "=", "1"),))
    assert basic_to_sql(query, df) == "SELECT `my col`, `a``b` FROM df\nWHERE `k` = 1"
    for got in (basic_to_df(query, df), transform(df, basic_to_sql(query, df))):
        assert got.columns == ["my col", "a`b"]
        assert tuple(got.first()) == ("s", 2)


def test_and_binds_before_or(spark):
    df = spark.sql("SELECT * FROM VALUES (1, 1, 1), (1, 0, 0), (0, 1, 1), (0, 1, 0), (0, 0, 1) AS t(a, b, c)")
    query = BasicQuery((), (Condition("a", "=", "1"), Condition("b", "=", "1", "OR"), Condition("c", "=", "1", "AND")))
    assert rows(basic_to_df(query, df)) == rows(df.where("a = 1 OR (b = 1 AND c = 1)"))
    assert basic_to_sql(query, df) == "SELECT * FROM df\nWHERE `a` = 1\nOR `b` = 1\nAND `c` = 1"


def test_conditions_without_column_or_value_are_left_out(spark):
    df = spark.sql("SELECT 1 AS a, 2 AS b")
    query = BasicQuery(
        (),
        (
            Condition("Select columns", "=", "1"),
            Condition("a", "=", " "),
            Condition("b", "~", "2", "OR"),
        ),
    )
    assert basic_to_sql(query, df) == "SELECT * FROM df\nWHERE `b` = 2"
    assert basic_to_sql(BasicQuery(), df) == "SELECT * FROM df"
    assert basic_to_df(BasicQuery(), df).count() == 1


def test_values_stay_whole(spark):
    text = "x AND y' OR '1'='1 \\"
    df = spark.createDataFrame([(text,), ("other",)], "s string")
    query = BasicQuery((), (Condition("s", "=", text),))
    assert basic_to_df(query, df).count() == 1
    assert transform(df, basic_to_sql(query, df)).count() == 1


def test_errors(spark):
    df = spark.sql("SELECT 1 AS a")
    with pytest.raises(ValueError, match="no column 'z'"):
        basic_to_df(BasicQuery(("z",)), df)
    with pytest.raises(ValueError, match="AND or OR"):
        basic_to_df(BasicQuery((), (Condition("a", "=", "1"), Condition("a", "=", "1", "XOR"))), df)


@settings(max_examples=20, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(
        st.builds(
            Condition,
            st.sampled_from(["n", "x", "s"]),
            st.sampled_from(["=", "<", ">", "?"]),
            st.sampled_from(["", "1", "2.5", "b", "2"]),
            st.sampled_from(["AND", "OR"]),
        ),
        max_size=5,
    )
)
def test_frame_and_text_agree_with_plain_python(spark, conditions):
    data = [(n, x, s) for n in (0, 1, 2, 3) for x in (1.0, 2.5) for s in ("1", "b")]
    df = spark.createDataFrame(data, "n int, x double, s string")
    query = BasicQuery((), tuple(conditions))

    def holds(row, condition):
        value, text = row["nxs".index(condition.column)], condition.value
        if condition.column != "s":
            try:
                text = float(text)
            except ValueError:
                return False
        return {"<": value < text, ">": value > text}.get(condition.operator, value == text)

    def wanted(row):
        groups = []
        for condition in (c for c in conditions if c.value):
            if not groups or condition.logic == "OR":
                groups.append([])
            groups[-1].append(holds(row, condition))
        return not groups or any(all(group) for group in groups)

    want = sorted(str(row) for row in data if wanted(row))
    assert sorted(str(tuple(r)) for r in basic_to_df(query, df).collect()) == want
    assert sorted(str(tuple(r)) for r in transform(df, basic_to_sql(query, df)).collect()) == want
