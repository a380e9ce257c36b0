import datetime as dt

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tidework import join_on, transform
from tidework.operators import frequent
from tidework.operators.frequent import column_counts, frequent_keys
from tidework.operators.joins import joined_names

SCHEMA = "k int, s string, d double, time timestamp"


@pytest.fixture(autouse=True)
def small_pieces(monkeypatch):
    """A single row may be a piece, so that small frames are cut too."""
    monkeypatch.setattr(frequent, "LEAST", 1)


def at(second):
    return dt.datetime(2024, 1, 1, 0, 0, second)


@pytest.fixture(scope="module")
def left(spark):
    return spark.createDataFrame(
        [(1, "a", 1.0, at(3)), (2, None, None, at(1)), (None, "n", 3.0, at(2))], SCHEMA
    )


@pytest.fixture(scope="module")
def right(spark):
    return spark.createDataFrame([(1, "x", 10.0, at(5)), (9, "y", None, at(4)), (None, "z", 30.0, at(6))], SCHEMA)


def test_left(left, right):
    result = join_on(left, right, "k", "k", "Left Join")
    assert result.columns == ["k", "s", "d", "time", "k_right", "s_right", "d_right", "time_right"]
    assert [tuple(r) for r in result.collect()] == [
        (2, "NaN", None, at(1), None, "NaN", None, None),
        (None, "n", 3.0, at(2), None, "NaN", None, None),
        (1, "a", 1.0, at(3), 1, "x", 10.0, at(5)),
    ]


def test_outer_puts_unmatched_right_rows_first(left, right):
    rows = join_on(left, right, "k", "k", "outer").collect()
    assert [r.time for r in rows] == [None, None, at(1), at(2), at(3)]
    assert {r.s_right for r in rows[:2]} == {"y", "z"}
    assert {r.s for r in rows[:2]} == {"NaN"} and {r.d for r in rows[:2]} == {None}


@pytest.mark.parametrize(
    "how, n",
    [
        ("inner", 1),
        ("Inner Join", 1),
        ("Cross Join", 1),
        ("cross", 1),
        ("Right Join", 3),
        ("right_outer", 3),
        ("Outer Join", 5),
        ("full", 5),
        ("leftsemi", 1),
        ("left_anti", 2),
        ("anti", 2),
    ],
)
def test_counts(left, right, how, n):
    assert join_on(left, right, "k", "k", how).count() == n


def test_semi_and_anti_keep_the_left_columns(left, right):
    assert join_on(left, right, "k", "k", "semi").columns == left.columns
    assert [r.time for r in join_on(left, right, "k", "k", "anti").collect()] == [at(1), at(2)]


def test_unknown_type_is_an_error(left, right):
    with pytest.raises(AnalysisException, match="UNSUPPORTED_JOIN_TYPE"):
        join_on(left, right, "k", "k", "sideways")
    with pytest.raises(ValueError, match="no column 'z'"):
        join_on(left, right, "z", "k")


def test_time_with_time(left, right):
    result = join_on(left, right, "time", "time", "outer")
    assert [r.time for r in result.collect()] == [None, None, None, at(1), at(2), at(3)]


def test_names():
    assert list(joined_names(["k", "x", "x_right"], ["K", "x", "x_right"], "K").values()) == [
        "K_right",
        "x_right_right",
        "x_right_right_right",
    ]
    assert list(joined_names(["a"], ["b", "c"], "b").values()) == ["b", "c_right"]
    names = list(joined_names(["k", "x", "x_right"], ["k", "x", "x_right"], "k").values())
    assert len({*names, "k", "x", "x_right"}) == 6


def test_colliding_names_and_odd_names(spark):
    frame = spark.sql("SELECT 1 AS k, 2 AS x, 3 AS x_right, 4 AS `odd.name`")
    result = join_on(frame, frame, "odd.name", "odd.name", "inner", sort=False)
    assert len(set(result.columns)) == 8
    assert tuple(result.first()) == (1, 2, 3, 4, 1, 2, 3, 4)


def test_two_results_of_one_parent(table):
    events = table("events")
    a = events.where("event_type = 'click'").groupBy("user_id").count()
    b = events.where("event_type = 'view'").groupBy("user_id").count()
    result = join_on(a, b, "user_id", "user_id", "outer")
    assert result.count() == a.select("user_id").union(b.select("user_id")).distinct().count()


def test_fill_and_sort_are_optional(left, right, plan):
    result = join_on(left, right, "k", "k", "left", fill_strings=None, sort=False)
    assert {r.s for r in result.collect()} == {"a", "n", None}
    assert "rangepartitioning" not in plan(result, run=False)


def test_cross_with_keys_is_no_product(table, plan):
    result = join_on(table("orders"), table("customer"), "o_custkey", "c_custkey", "Cross Join", sort=False)
    text = plan(result)
    assert "Cartesian" not in text and "NestedLoop" not in text and "Cross" not in text


def test_semi_join_shuffles_each_right_key_once(table, plan):
    # The right keys are distinct before they meet the left rows.
    text = plan(join_on(table("customer"), table("events"), "c_custkey", "user_id", "semi"), run=False)
    assert "partial_" not in text and text.count("HashAggregate(keys=[__key") == 2


def test_outer_joins_are_salted(table, plan):
    events, customer = table("events"), table("customer")
    whole = join_on(events, customer, "user_id", "c_custkey", "outer", sort=False, salt=False)
    assert "__left" not in plan(whole, run=False)
    salted = join_on(events, customer, "user_id", "c_custkey", "outer", sort=False)
    assert "__left" in plan(salted, run=False)
    assert salted.schema.names == whole.schema.names
    assert sorted(map(str, salted.collect())) == sorted(map(str, whole.collect()))
    # Adaptive execution splits an inner join by itself, and the kept side of a left join.
    for how in ("inner", "semi"):
        assert "__left" not in plan(join_on(events, customer, "user_id", "c_custkey", how, sort=False), run=False)
    left_join = plan(join_on(events, customer, "user_id", "c_custkey", "left", sort=False), run=False)
    assert "__right_copies" in left_join and "__left_copies" not in left_join


@pytest.fixture()
def shuffled(spark):
    """Twenty plain shuffle partitions: no broadcast, no partition merged or cut at run time."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.enabled": "false",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.shuffle.partitions": "20",
    }
    old = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    yield
    for key, value in old.items():
        spark.conf.set(key, value) if value is not None else spark.conf.unset(key)


def test_both_sides_read_one_list_of_frequent_keys(spark, shuffled, table, plan, tmp_path):
    spark.range(0, 6_000, 1, 4).selectExpr("id % 3 AS k", "id AS v").write.parquet(f"{tmp_path}/hot")
    hot = spark.read.parquet(f"{tmp_path}/hot")
    result = join_on(table("customer"), hot, "c_nationkey", "k", "left", sort=False, salt=True)
    final = result.groupBy("c_nationkey").count()
    text = plan(final).split("== Initial Plan ==")
    assert "ReusedExchange [__own_key" in "".join(text) or "ReusedExchange [__other_key" in "".join(text)


def test_first_rows_are_written_before_they_are_salted(table, plan):
    some = transform(table("events"), "SELECT * FROM df LIMIT 50 OFFSET 3")
    result = join_on(table("customer"), some, "c_custkey", "user_id", "left", sort=False)
    text = plan(result, run=False)
    assert "__right" in text and "Limit" not in text
    assert result.where("user_id IS NOT NULL").count() == 50


@pytest.fixture()
def jobs(spark):
    """How many jobs a call runs."""
    tracker = spark.sparkContext.statusTracker()

    def count(call):
        spark.sparkContext.setJobGroup("counted", "")
        before = len(tracker.getJobIdsForGroup("counted"))
        result = call()
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(tracker.getJobIdsForGroup("counted")) - before, result

    return count


def test_joins_of_tables_run_no_jobs(table, jobs):
    customer = table("customer")
    some = table("events").where("event_type = 'click'").select("user_id", "value")
    grouped = transform(some, "SELECT user_id, count(*) AS n FROM df GROUP BY user_id")
    for right in (some, grouped):
        for how in ("left", "right", "outer"):
            assert jobs(lambda: join_on(customer, right, "c_custkey", "user_id", how))[0] == 0


def test_jobs_grow_with_the_number_of_joins(spark, table, jobs):
    """A chain of full joins on two columns: no join is run to count the keys of the next one."""
    hot = spark.range(3000).selectExpr("if(id % 3 = 0, 7, id) AS k", "id AS v")
    customer, nation = table("customer"), table("nation")

    def chain(count):
        joined = customer
        for n in range(count):
            right = hot.toDF(f"k{n}", f"v{n}") if n % 2 else nation.toDF(f"k{n}", f"name{n}", f"v{n}")
            joined = join_on(joined, right, "c_nationkey" if n % 2 == 0 else "c_custkey", f"k{n}", "outer", sort=False)
        return joined

    steps = [jobs(lambda: chain(count))[0] for count in (4, 6, 8)]
    assert steps[2] - steps[1] <= steps[1] - steps[0] + 2 and steps[2] <= 40, steps
    found = chain(3)
    plain = customer.join(nation.toDF("k0", "n0", "v0"), F.col("c_nationkey") == F.col("k0"), "outer")
    plain = plain.join(hot.toDF("k1", "v1"), F.col("c_custkey") == F.col("k1"), "outer")
    plain = plain.join(nation.toDF("k2", "n2", "v2"), F.col("c_nationkey") == F.col("k2"), "outer")
    sums = [F.count("*"), *[F.sum(c) for c in ("c_custkey", "c_acctbal", "k0", "k1", "k2")]]
    for mine, expected in zip(found.agg(*sums).first(), plain.agg(*sums).first()):
        assert mine == pytest.approx(expected)


def test_a_side_that_must_be_run_to_be_counted_is_written_once(table, plan, jobs):
    daily = transform(table("events"), "SELECT user_id, date(ts) AS day, count(*) AS n FROM df GROUP BY 1, 2")
    result = join_on(table("customer"), daily, "c_custkey", "user_id", "left", sort=False)
    assert "Aggregate [user_id" not in plan(result, run=False)
    assert result.where("user_id IS NOT NULL").count() == daily.count()


def test_scans_grow_with_the_number_of_joins(table, plan):
    joined, scans = table("events"), []
    for _ in range(4):
        joined = join_on(joined, table("customer"), "user_id", "c_custkey", "outer", sort=False)
        joined = joined.withColumnRenamed("c_custkey", f"key_{len(joined.columns)}")
        scans.append(joined._jdf.queryExecution().optimizedPlan().toString().count("Relation ["))
    # Each join adds its right side and the hot keys of both sides, each read for cutting and for copying.
    assert len({b - a for a, b in zip(scans, scans[1:])}) == 1 and scans[-1] <= 21, scans


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_number_keys_meet_text_keys(spark, ansi):
    old = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        numbers = spark.sql("SELECT * FROM VALUES (1L, 'a'), (2L, 'b') AS t(k, v)")
        texts = spark.sql("SELECT * FROM VALUES ('1', 'x'), ('none', 'y'), (NULL, 'z') AS t(k, w)")
        for how, count in (("inner", 1), ("left", 2), ("right", 3), ("outer", 4), ("semi", 1), ("anti", 1)):
            assert join_on(numbers, texts, "k", "k", how).count() == count
            assert join_on(texts, numbers, "k", "k", how).count() == {"left": 3, "right": 2, "anti": 2}.get(how, count)
    finally:
        spark.conf.set("spark.sql.ansi.enabled", old)


def test_joins_in_a_row_are_all_salted(table, plan):
    customer = table("customer")
    first = join_on(table("events"), customer, "user_id", "c_custkey", "outer", salt=True)
    second = join_on(first, table("orders"), "c_custkey", "o_custkey", "outer", sort=False, salt=True)
    assert plan(second, run=False).count("FullOuter") == 2
    whole = join_on(
        join_on(table("events"), customer, "user_id", "c_custkey", "outer"),
        table("orders"), "c_custkey", "o_custkey", "outer", sort=False,
    )
    sums = [F.count("*"), F.sum("event_id"), F.sum("c_custkey"), F.sum("o_orderkey_right")]
    assert second.agg(*sums).first() == whole.agg(*sums).first()


def largest_task(df):
    return df.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]


@pytest.mark.parametrize("how", ["left", "right", "outer"])
def test_a_key_with_a_third_of_all_rows_is_spread_over_tasks(spark, shuffled, how):
    hot = spark.range(0, 60_000, 1, 40).selectExpr("CASE WHEN id % 3 = 0 THEN 7 ELSE id END AS k", "id AS v")
    few = spark.range(0, 20, 1, 4).selectExpr("id AS k", "id AS w")
    sides = (hot, few) if how == "right" else (few, hot)
    salted, whole = (join_on(*sides, "k", "k", how, sort=False, salt=salt) for salt in (True, False))
    checks = [F.count("*"), *[F.sum(name) for name in salted.columns]]
    assert salted.agg(*checks).first() == whole.agg(*checks).first()
    assert largest_task(whole) > 20_000
    assert largest_task(salted) < 10_000


def test_null_keys_of_a_full_join_are_spread_over_tasks(spark, shuffled):
    rows = spark.range(0, 60_000, 1, 40).selectExpr("CASE WHEN id % 3 > 0 THEN id END AS k", "id AS v")
    few = spark.range(0, 20, 1, 4).selectExpr("id AS k", "id AS w")
    salted, whole = (join_on(rows, few, "k", "k", "outer", sort=False, salt=salt) for salt in (True, False))
    checks = [F.count("*"), *[F.sum(name) for name in salted.columns]]
    assert salted.agg(*checks).first() == whole.agg(*checks).first()
    assert largest_task(whole) > 20_000
    assert largest_task(salted) < 10_000


def test_small_tables_are_not_cut(table, monkeypatch):
    """Each of 25 nations is more than an even partition of them; no row of the other side is copied for that."""
    monkeypatch.setattr(frequent, "LEAST", 256)
    result = join_on(table("customer"), table("nation"), "c_nationkey", "n_nationkey", "outer", sort=False)
    assert result.count() == table("customer").count()
    assert frequent_keys(table("nation").select(F.col("n_nationkey").alias("__key"))).count() == 0


def test_frequent_keys_are_exact(spark):
    """The sketch only proposes; the counts decide, also where numbers are equal but written differently."""
    for rows in (
        "id % 5",
        "if(id % 3 = 0, 7, id)",
        "if(id % 2 = 0, 'x', string(id))",
        "if(id % 3 = 0, 0D, if(id % 3 = 1, -0D, double(id)))",
        "if(id % 4 = 0, double('NaN'), double(id))",
        "if(id % 4 = 0, array(1), array(id))",
        "cast(NULL AS int)",
    ):
        keys = spark.range(4000).selectExpr(f"{rows} AS __key")
        counts = {}
        for row in keys.where("__key IS NOT NULL").collect():
            counts[str(row[0]).replace("-0.0", "0.0")] = counts.get(str(row[0]).replace("-0.0", "0.0"), 0) + 1
        expected = {k: n for k, n in counts.items() if n * 8 > sum(counts.values())}
        found = frequent_keys(keys.where("__key IS NOT NULL")).collect()
        assert {str(r[0]).replace("-0.0", "0.0"): r[1] for r in found} == expected, rows


def test_counts_are_carried_through_joins(spark):
    """Frequent only by the product of both sides, only on one side, and not there at all."""
    first = spark.range(0, 900).selectExpr("if(id % 3 = 0, 1, id + 1001) AS k", "id % 7 AS other")
    second = spark.range(0, 900).selectExpr("CASE WHEN id % 3 = 0 THEN 1005 WHEN id % 3 = 1 THEN 5 ELSE id + 5000 END AS q")
    joined = join_on(first, second, "k", "q", "outer", sort=False)
    counts = column_counts(joined, "k")
    assert counts.frequent == {1: 300, 1005: 300}  # 1005 is once in the first and often in the second
    assert column_counts(joined, "q").frequent == {1005: 300, 5: 300}
    exact = {r.k: r["count"] for r in joined.where("k IS NOT NULL").groupBy("k").count().collect()}
    assert {k: exact[k] for k in counts.frequent} == counts.frequent
    assert column_counts(joined, "other").frequent  # of the table: as if each row had one partner
    texts = join_on(first.selectExpr("string(k) AS k"), second.selectExpr("string(q) AS q"), "k", "q", "outer", sort=False)
    assert column_counts(texts, "k") is None  # NULLs are filled, so NaN may be frequent now


def test_a_key_made_frequent_by_a_join_is_spread_in_the_next(spark, shuffled):
    left = spark.range(0, 300, 1, 4).selectExpr("id AS k", "id AS a")
    hot = spark.range(0, 60_000, 1, 40).selectExpr("CASE WHEN id % 3 = 0 THEN 7 ELSE id END AS q", "id AS b")
    few = spark.range(0, 20, 1, 4).selectExpr("id AS p", "id AS c")
    results = []
    for salt in (True, False):
        joined = join_on(left, hot, "k", "q", "left", sort=False, salt=salt)
        results.append(join_on(joined, few, "k", "p", "outer", sort=False, salt=salt))
    salted, whole = results
    checks = [F.count("*"), *[F.sum(name) for name in salted.columns]]
    assert salted.agg(*checks).first() == whole.agg(*checks).first()
    assert largest_task(whole) >= 20_000
    assert largest_task(salted) < 10_000


_KEYS = st.lists(st.one_of(st.none(), st.integers(0, 4)), max_size=8)


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(_KEYS, _KEYS, st.sampled_from(["left", "right", "outer"]), st.integers(0, 30))
def test_salted_and_plain_outer_joins_agree_with_plain_python(spark, a, b, how, frequent):
    a, b = a + [1] * frequent, b + [1] * (frequent // 3) + [2] * (frequent // 2)
    left = spark.createDataFrame([(k, f"l{i}") for i, k in enumerate(a)], "k int, s string")
    right = spark.createDataFrame([(k, f"r{i}") for i, k in enumerate(b)], "k int, s string")
    want = [(x, f"l{i}", y, f"r{j}") for i, x in enumerate(a) for j, y in enumerate(b) if x is not None and x == y]
    if how in ("left", "outer"):
        want += [(x, f"l{i}", None, "NaN") for i, x in enumerate(a) if x is None or x not in b]
    if how in ("right", "outer"):
        want += [(None, "NaN", y, f"r{j}") for j, y in enumerate(b) if y is None or y not in a]
    for salt in (True, False):
        got = join_on(left, right, "k", "k", how, salt=salt)
        assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
