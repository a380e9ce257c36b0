import os

import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from tidework import (
    Catalog,
    describe,
    epoch_columns,
    from_json_rows,
    join_on,
    json_keys,
    json_schema,
    presence,
    read_csv,
    read_json_rows,
    released_work,
    scan_many,
    scan_ordered,
    scan_range,
    shape,
    shapes,
    time_tags_fields,
    to_json_rows,
    transform,
    typed_json_rows,
    work_path,
    write_csv,
)

START, END = "2024-07-25T16:47:00Z", "2024-07-25T16:47:10Z"


@pytest.fixture(scope="module")
def tables(spark):
    return Catalog.from_folder(spark, DATA, {"events": "ts", "orders": "o_orderdate", "lineitem": "l_shipdate"})


def test_tables_of_a_folder(tables):
    assert len(tables.names()) == 14
    assert tables.names() == sorted(set(tables.names()))
    assert [r.table_name for r in tables.list_tables().collect()] == tables.names()
    with pytest.raises(ValueError, match="no table 'nothing'"):
        tables.table("nothing")


def test_tables_of_a_database(spark, tmp_path):
    spark.sql(f"CREATE DATABASE IF NOT EXISTS readings LOCATION '{tmp_path}/readings'")
    spark.range(3).selectExpr("id", "timestamp_seconds(id) AS time").write.mode("overwrite").saveAsTable("readings.bat")
    found = Catalog.from_database(spark, "readings")
    assert found.names() == ["bat"]
    assert scan_range(found.table("bat"), "1970-01-01T00:00:01Z", "1970-01-01T00:00:02Z").count() == 2
    spark.sql("DROP DATABASE readings CASCADE")


def test_tables_in_another_format(telemetry, spark, tmp_path):
    telemetry.write.orc(f"{tmp_path}/batteries.orc")
    found = Catalog.from_folder(spark, str(tmp_path), file_format="orc")
    assert found.names() == ["batteries"]
    assert found.scan("batteries", START, END).count() == 7


def test_describe_and_projection(telemetry):
    assert [tuple(r) for r in describe(telemetry).collect()] == [
        ("time", "time", "timestamp"),
        ("unit", "tag", "string"),
        ("voltage", "field", "double"),
        ("cycles", "field", "bigint"),
        ("note", "tag", "string"),
    ]
    assert time_tags_fields(telemetry.select("cycles", "note", "time")).columns == ["time", "note", "cycles"]


def test_range_includes_both_bounds(telemetry):
    cycles = {r.cycles for r in scan_range(telemetry, START, END).collect()}
    assert cycles == {2, 3, None, -4, 5, 6, 7}


def test_range_reaches_the_files(table, plan):
    pushed = plan(scan_range(table("events"), "2024-01-02T00:00:00Z", "2024-01-03T00:00:00Z", "ts"))
    assert "GreaterThanOrEqual(ts,2024-01-02T00:00)" in pushed
    assert "LessThanOrEqual(ts,2024-01-03T00:00)" in pushed


def test_a_table_laid_out_by_day_is_pruned(spark, table, plan, tmp_path):
    path = f"{tmp_path}/events.parquet"
    table("events").withColumn("day", F.to_date("ts")).write.partitionBy("day").parquet(path)
    found = Catalog.from_folder(spark, str(tmp_path), {"events": "ts"}, {"events": "day"})
    rows = found.scan("events", "2024-01-02T06:00:00Z", "2024-01-04T05:00:00+02:00")
    wanted = scan_range(table("events"), "2024-01-02T06:00:00Z", "2024-01-04T03:00:00Z", "ts")
    assert sorted(map(str, rows.drop("day").collect())) == sorted(map(str, wanted.collect()))
    assert {str(r.day) for r in rows.select("day").distinct().collect()} == {"2024-01-02", "2024-01-03", "2024-01-04"}
    text = plan(rows, run=False)
    assert "(day#" in text.split("PartitionFilters: [", 1)[1].split("]", 1)[0]
    assert len(rows.inputFiles()) >= 3
    assert presence(found, ["events"], "2024-01-02T06:00:00Z", "2024-01-04T03:00:00Z").first().n_rows == rows.count()


def test_empty_range_keeps_the_schema(telemetry):
    empty = scan_range(telemetry, "2030-01-01T00:00:00Z", "2031-01-01T00:00:00Z")
    assert empty.count() == 0 and empty.schema == telemetry.schema


def test_bad_bounds(telemetry):
    with pytest.raises(ValueError, match="is no time"):
        scan_range(telemetry, "", END)


def test_order(table, telemetry):
    times = [r.time for r in scan_ordered(telemetry, START, END).collect()]
    assert times == sorted(times)
    stamps = [
        r.ts for r in scan_ordered(table("events"), "2024-01-05T00:00:00Z", "2024-01-20T00:00:00Z", "ts").collect()
    ]
    assert len(stamps) > 1000 and stamps == sorted(stamps)


def test_one_frequent_time_is_sorted_by_several_tasks(spark):
    rows = spark.range(0, 40_000, 1, 16).selectExpr(
        "CASE WHEN id % 10 < 9 THEN TIMESTAMP'2024-01-01 00:00:00Z' "
        "ELSE timestamp_seconds(1704067000 + id % 200) END AS time",
        "id",
    )
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ordered = scan_ordered(rows, "2023-01-01T00:00:00Z", "2025-01-01T00:00:00Z")
        sizes = [r["count"] for r in ordered.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 40_000 and max(sizes) < 15_000
        times = [r.time for r in ordered.collect()]
        assert times == sorted(times)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)


def test_first_rows_in_order_need_no_full_sort(table, plan):
    text = plan(
        scan_ordered(table("events"), "2024-01-05T00:00:00Z", "2024-01-20T00:00:00Z", "ts").limit(5), run=False
    )
    assert "TakeOrderedAndProject" in text and "rangepartitioning" not in text


def test_scan_many_keeps_the_given_order_and_drops_empty_tables(tables):
    frames = scan_many(tables, ["orders", "events", "lineitem"], "2001-06-01T00:00:00Z", "2002-01-01T00:00:00Z", drop_empty=True)
    assert list(frames) == ["orders", "lineitem"]
    assert frames["orders"].count() > 0
    all_frames = scan_many(
        tables, ["orders", "events"], "2001-06-01T00:00:00Z", "2002-01-01T00:00:00Z", drop_empty=False
    )
    assert list(all_frames) == ["orders", "events"]


def test_presence(tables):
    rows = presence(
        tables, ["orders", "events", "lineitem"], "2024-01-01T00:00:00Z", "2024-12-31T00:00:00Z"
    ).orderBy("position")
    assert [(r.table_name, r.n_rows > 0, r.has_data) for r in rows.collect()] == [
        ("orders", False, False),
        ("events", True, True),
        ("lineitem", False, False),
    ]
    assert presence(tables, [], START, END).count() == 0


def test_presence_is_one_aggregate(tables, plan):
    text = plan(presence(tables, ["orders", "events"], "2001-01-01T00:00:00Z", "2024-12-31T00:00:00Z"), run=False)
    assert text.count("Exchange ") == 1


def test_shapes(tables, table):
    assert shape(table("lineitem")).first().asDict() == {"n_rows": table("lineitem").count(), "n_columns": 11}
    rows = {r.table_name: (r.n_rows, r.n_columns) for r in shapes(tables, ["nation", "part"]).collect()}
    assert rows == {"nation": (25, 3), "part": (2000, 6)}


def test_epoch_columns(spark):
    rows = spark.sql(
        "SELECT * FROM VALUES (TIMESTAMP'1969-12-31 23:59:59.5Z'), (TIMESTAMP'2024-07-25 16:47:00.123456Z'), (NULL) AS t(time)"
    )
    got = [(r.time_ns, r.time_s) for r in epoch_columns(rows).collect()]
    assert got == [(-500_000_000, -1), (1721926020123456000, 1721926020), (None, None)]
    with pytest.raises(ValueError, match="no time column"):
        epoch_columns(spark.sql("SELECT 1 AS time"))


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_times_without_zone_are_utc_in_any_session(spark, zone):
    # 02:30 does not exist in New York that day, 01:30 exists twice in November.
    rows = spark.sql(
        "SELECT * FROM VALUES (TIMESTAMP_NTZ'2024-03-10 02:30:00.000001'), (TIMESTAMP_NTZ'2024-11-03 01:30:00') AS t(time)"
    )
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        assert [r.time_ns for r in epoch_columns(rows).collect()] == [1710037800000001000, 1730597400000000000]
        assert epoch_columns(rows.select(F.to_date("time").alias("day")), "day").first().day_s == 1710028800
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_json_rows(telemetry, spark):
    lines = to_json_rows(telemetry)
    assert '"voltage"' not in lines.where("value LIKE '%\"cycles\":3,%'").first().value
    back = from_json_rows(lines, [r.key for r in json_keys(lines).collect()])
    assert back.columns == sorted(telemetry.columns)
    assert {t for _, t in back.dtypes} == {"string"}
    assert back.where("cycles = '3'").first().time == "2024-07-25T16:47:03.123456Z"
    named = from_json_rows(lines, ["unit", "absent"])
    assert named.columns == ["absent", "unit"] and named.where("absent IS NOT NULL").count() == 0


def test_keys_are_found_as_rows(spark):
    lines = spark.range(30).selectExpr("concat('{\"k', id, '\": 1}') AS value")
    assert json_keys(lines).count() == 30
    assert from_json_rows(lines, ["k7"]).where("k7 = '1'").count() == 1


def test_json_files(telemetry, spark, tmp_path):
    to_json_rows(telemetry).write.text(f"{tmp_path}/rows")
    found = read_json_rows(spark, f"{tmp_path}/rows", telemetry.columns)
    assert found.columns == sorted(telemetry.columns)
    assert {t for _, t in found.dtypes} == {"string"}
    assert found.count() == telemetry.count()


def test_csv(telemetry, spark, tmp_path):
    path = f"{tmp_path}/out"
    write_csv(telemetry.coalesce(1), path)
    text = spark.sparkContext.wholeTextFiles(path + "/part*").values().first()
    lines = text.strip().split("\n")
    assert lines[0] == '"time","unit","voltage","cycles","note"'
    assert lines[2] == '"2024-07-25T16:47:00","BAT1","3.6","2"," -3.5e2x"'
    assert lines[3] == '"2024-07-25T16:47:03.123456","BAT2","null","3",".5"'
    assert lines[6] == '"2024-07-25T16:47:08","BAT2","3.25","5",""'
    assert lines[7] == '"2024-07-25T16:47:09","BAT2","100","6","null"'
    assert lines[8] == '"2024-07-25T16:47:10","BAT1","1e+21","7","say ""hi"", AND go"'
    back = read_csv(spark, path, telemetry.columns)
    assert back.where("note = 'say \"hi\", AND go'").count() == 1
    assert back.where("voltage IS NULL").count() == 1


def test_numbers_as_a_browser_prints_them(spark):
    from tidework.functions.values import number_text

    cases = {
        1.0: "1",
        -2.5: "-2.5",
        0.0: "0",
        -0.0: "0",
        1e7: "10000000",
        12345678.9: "12345678.9",
        123456789012345680000.0: "123456789012345680000",
        1e21: "1e+21",
        1.5e25: "1.5e+25",
        0.001: "0.001",
        0.00012345: "0.00012345",
        0.000001: "0.000001",
        1e-7: "1e-7",
        -2.5e-9: "-2.5e-9",
        1234567.125: "1234567.125",
        0.1 + 0.2: "0.30000000000000004",
    }
    rows = spark.createDataFrame([(v,) for v in cases], "v double").select(number_text(F.col("v")).alias("t"))
    assert [r.t for r in rows.collect()] == list(cases.values())


class _Cluster:
    """Only the settings of a session on a cluster."""

    def __init__(self, **settings):
        self.conf = settings


def test_work_path_on_a_cluster_is_in_a_shared_folder():
    warehouse = _Cluster(**{"spark.master": "yarn", "spark.sql.warehouse.dir": "hdfs://lake/tables"})
    assert work_path(warehouse, "x").startswith("hdfs://lake/tables/work/x-")
    shared = _Cluster(**{"spark.master": "yarn", "spark.checkpoint.dir": "hdfs://lake/work"})
    assert work_path(shared, "x").startswith("hdfs://lake/work/x-")


def test_a_folder_of_the_drivers_own_is_no_work_folder_of_a_cluster():
    for place in ("spark-warehouse", "file:/opt/spark-warehouse"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            work_path(_Cluster(**{"spark.master": "yarn", "spark.sql.warehouse.dir": place}), "x")
        alone = _Cluster(**{"spark.master": "local[2]", "spark.sql.warehouse.dir": place})
        assert work_path(alone, "x").startswith(f"{place}/work/x-")


def test_work_is_removed_when_its_reader_is_done(spark, table, tmp_path):
    folder = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(folder))
    with released_work(spark):
        some = transform(table("events"), "SELECT * FROM df LIMIT 50")
        joined = join_on(table("customer"), some, "c_custkey", "user_id", "left", sort=False)
        joined.write.parquet(f"{tmp_path}/joined")
        assert len(set(os.listdir(folder)) - before) == 1
    assert set(os.listdir(folder)) == before


def test_work_path_is_in_the_shared_folder(spark):
    root = spark.conf.get("spark.checkpoint.dir", None)
    one, two = work_path(spark, "x"), work_path(spark, "x")
    assert one != two
    if root:
        assert one.startswith(root)


def test_epoch_columns_keep_what_is_there(spark):
    rows = spark.sql("SELECT TIMESTAMP'9999-12-31 00:00:00Z' AS time, 5 AS time_s")
    row = epoch_columns(rows).first()
    assert (row.time_s, row.time_ns, row.time_s_epoch) == (5, None, 253402214400)


def test_exported_times_are_utc_in_any_zone(spark, tmp_path):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        rows = spark.sql("SELECT TIMESTAMP'2024-11-03 05:30:00.000001Z' AS t UNION ALL SELECT TIMESTAMP'2024-11-03 06:30:00Z'")
        write_csv(rows.coalesce(1), f"{tmp_path}/zone")
        text = spark.sparkContext.wholeTextFiles(f"{tmp_path}/zone/part*").values().first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert text.split() == ['"t"', '"2024-11-03T05:30:00.000001"', '"2024-11-03T06:30:00"']


def test_json_schema_of_mixed_and_nested_values(spark):
    lines = [
        '{"b":1,"a":"x","list":[1,2.5],"odd.name":true}',
        '{"b":2,"a":3,"nested":{"e":1,"f":null},"OBJECT<VARIANT":1}',
        '{"b":null,"nested":{"e":"z"},"empty":null,"big":123456789012345678901234567890}',
        "no json", "[1]", "7", None,
    ]
    frame = spark.createDataFrame([(t,) for t in lines], "value string").repartition(4)
    kinds = {f.name: f.dataType.simpleString() for f in json_schema(frame).fields}
    assert kinds.pop("list").startswith("array<d") and kinds == {
        "a": "string", "b": "bigint", "big": "decimal(30,0)", "empty": "string", "nested": "struct<e:string,f:string>",
        "odd.name": "boolean", "OBJECT<VARIANT": "bigint",
    }
    rows = {r["b"]: r for r in typed_json_rows(frame).where("a IS NOT NULL").collect()}
    assert rows[1]["a"] == "x" and rows[2]["a"] == "3" and tuple(rows[2]["nested"]) == ("1", None)
    assert typed_json_rows(frame).count() == len(lines)
    nothing = spark.createDataFrame([("no json",)], "value string")
    assert json_schema(nothing).fields == [] and typed_json_rows(nothing).columns == []
