import re
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.errors import AnalysisException, ParseException

from tests.conftest import DATA
from tidework import preview, preview_frame, transform
from tidework.operators.preview import preview_rows
from tidework_checks.sql_box import SQL_BOX


def test_any_query(spark):
    df = spark.range(5)
    assert transform(df, "SELECT sum(id) AS s FROM df;").first().s == 10
    assert [r.id for r in transform(df, "SELECT id FROM df ORDER BY id DESC -- last").collect()] == [4, 3, 2, 1, 0]
    assert transform(df, "WITH a AS (SELECT id FROM df) SELECT max(id) AS m FROM a").first().m == 4
    assert transform(df, "SELECT count(*) AS n FROM other", view="other").first().n == 5


@pytest.mark.parametrize("text", ["DROP VIEW df", "SET spark.sql.ansi.enabled=false", "CREATE TABLE x (a int)"])
def test_commands_are_refused(spark, text):
    with pytest.raises(ParseException):
        transform(spark.range(1), text)


def test_errors(spark):
    with pytest.raises(ValueError, match="empty"):
        transform(spark.range(1), " ; ")
    with pytest.raises(AnalysisException):
        transform(spark.range(1), "SELECT nothing FROM df")


def test_frames_stay_bound_to_their_parent(spark):
    first = transform(spark.range(3), "SELECT count(*) AS n FROM df")
    second = transform(spark.range(7), "SELECT count(*) AS n FROM df")
    assert (first.first().n, second.first().n) == (3, 7)
    chained = transform(second, "SELECT n + 1 AS n FROM df")
    assert chained.first().n == 8


def test_concurrent_transforms(spark):
    frames = [spark.range(n) for n in range(1, 17)]
    with ThreadPoolExecutor(8) as pool:
        results = list(pool.map(lambda df: transform(df, "SELECT count(*) AS n FROM df"), frames))
    assert [r.first().n for r in results] == list(range(1, 17))


def test_filters_and_columns_reach_the_files(table, plan):
    text = plan(
        transform(table("lineitem"), "SELECT l_tax FROM (SELECT * FROM df) WHERE l_returnflag = 'R'"), run=False
    )
    assert "EqualTo(l_returnflag,R)" in text
    assert "ReadSchema: struct<l_tax:double,l_returnflag:string>" in text


@pytest.mark.parametrize(
    "columns, limit, cells, rows",
    [
        (5, None, 10_000_000, 2_000_000),
        (5, 100, 10_000_000, 100),
        (5, 100, 20, 4),
        (0, 100, 20, 0),
        (3, None, 2, 0),
        (3, -1, 20, 0),
    ],
)
def test_preview_budget(columns, limit, cells, rows):
    assert preview_rows(columns, limit, cells) == rows


def test_preview(spark):
    df = spark.range(10).selectExpr("id", "cast(id as string) AS s")
    assert preview(df, 2) == {"data": [{"id": 0, "s": "0"}, {"id": 1, "s": "1"}], "columns": ["id", "s"]}
    assert preview_frame(df, max_cells=6).count() == 3


@pytest.mark.parametrize("end", ["; -- done", " -- done\n;", " /* a; b */ ; ;", "; -- it's\n"])
def test_comments_and_semicolons_at_the_end(spark, end):
    assert transform(spark.range(3), "SELECT ';--' AS s, id FROM df" + end).first() == (";--", 0)


def test_sketches_are_not_kept_for_each_user(spark, plan):
    text = plan(SQL_BOX["sql_approx"].run(spark, DATA), run=False)
    by_user = [line for line in text.splitlines() if re.search(r"Aggregate\(keys=\[[^]]*user_id", line)]
    assert by_user and not [line for line in by_user if "approx" in line]
