"""Sources, scans, conditions, joins, series and workflows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidework_checks import Registry, catalog, read
from tidework import (
    BasicQuery,
    Condition,
    Datasets,
    Join,
    Plot,
    Sql,
    Table,
    Workflow,
    basic_to_df,
    basic_to_sql,
    day_states,
    epoch_columns,
    from_json_rows,
    in_order,
    join_on,
    json_keys,
    largest,
    merge_states,
    overlap_parts,
    presence,
    preview_frame,
    previous,
    read_csv,
    read_json_rows,
    row_numbers,
    run_box,
    running,
    scan_many,
    scan_ordered,
    scan_range,
    series,
    sessions,
    shape,
    sums,
    shapes,
    time_slices,
    time_tags_fields,
    to_json_rows,
    transform,
    typed_json_rows,
    work_path,
    write_csv,
)

STEPS = Registry()

# ---- catalog ----------------------------------------------------------------

_COLUMN_COUNTS = {
    "benchmark": 2,
    "conversations": 4,
    "customer": 5,
    "documents": 5,
    "embeddings": 3,
    "events": 6,
    "labels": 3,
    "lineitem": 11,
    "nation": 3,
    "orders": 6,
    "pages": 3,
    "part": 6,
    "region": 2,
    "supplier": 4,
}


@STEPS.add(
    "list_tables",
    "\nUNION ALL\n".join(
        f"SELECT '{name}' AS table_name, count(*) AS n_rows, {n} AS n_columns FROM {name}"
        for name, n in _COLUMN_COUNTS.items()
    ),
)
def list_tables(spark, folder):
    tables = catalog(spark, folder)
    return tables.list_tables().join(shapes(tables, tables.names()).drop("position"), "table_name")


_EVENT_ROLES = {
    "event_id": ("field", "bigint"),
    "ts": ("time", "timestamp_ntz"),
    "user_id": ("field", "bigint"),
    "event_type": ("tag", "string"),
    "value": ("field", "double"),
    "props": ("tag", "string"),
}


@STEPS.add(
    "describe_events",
    "\nUNION ALL\n".join(
        f"SELECT '{c}' AS column_name, '{role}' AS role, '{kind}' AS data_type, count({c}) AS n_values FROM events"
        for c, (role, kind) in _EVENT_ROLES.items()
    ),
)
def describe_events(spark, folder):
    tables = catalog(spark, folder)
    events = tables.table("events")
    counts = events.agg(*[F.count(c).alias(c) for c in events.columns])
    filled = counts.unpivot([], counts.columns, "column_name", "n_values")
    return tables.describe("events").join(filled, "column_name")


@STEPS.add("project_time_tags_fields", "SELECT ts, event_type, props, event_id, user_id, value FROM events")
def project_time_tags_fields(spark, folder):
    return time_tags_fields(read(spark, folder, "events"), "ts")


@STEPS.add("table_shape", "SELECT count(*) AS n_rows, 11 AS n_columns FROM lineitem")
def table_shape(spark, folder):
    return shape(read(spark, folder, "lineitem"))


# ---- scans ------------------------------------------------------------------


@STEPS.add(
    "scan_range",
    "SELECT * FROM events WHERE ts >= TIMESTAMP '2024-01-02 06:00:00' AND ts <= TIMESTAMP '2024-01-27 18:30:00'",
)
def scan_range_events(spark, folder):
    return scan_range(read(spark, folder, "events"), "2024-01-02T06:00:00Z", "2024-01-27T18:30:00Z", "ts")


@STEPS.add(
    "scan_range_bounds",
    "SELECT * FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1996-02-29' AND TIMESTAMP '2000-12-31'",
)
def scan_range_bounds(spark, folder):
    return scan_range(read(spark, folder, "orders"), "1996-02-29T00:00:00Z", "2000-12-31T00:00:00Z", "o_orderdate")


@STEPS.add("scan_ordered", "SELECT * FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-01' AND TIMESTAMP '2024-12-31'")
def scan_ordered_events(spark, folder):
    return scan_ordered(read(spark, folder, "events"), "2024-01-01T00:00:00Z", "2024-12-31T00:00:00Z", "ts")


@STEPS.add(
    "time_slices",
    "SELECT *, CAST((rank() OVER (ORDER BY o_orderdate) - 1) // 1000 AS BIGINT) AS slice_id FROM orders",
)
def time_slices_orders(spark, folder):
    return time_slices(read(spark, folder, "orders"), 1000, "o_orderdate")


@STEPS.add(
    "time_slices_distinct",
    "SELECT event_id, ts, CAST((rank() OVER (ORDER BY ts) - 1) // 250 AS BIGINT) AS page FROM events",
)
def time_slices_distinct(spark, folder):
    return time_slices(read(spark, folder, "events").select("event_id", "ts"), 250, "ts", "page")


@STEPS.add(
    "scan_many_counts",
    """
    SELECT 'events' AS table_name, CAST(ts AS DATE) AS day, count(*) AS n
    FROM events WHERE ts BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '2024-12-31' GROUP BY ALL
    UNION ALL
    SELECT 'orders', CAST(o_orderdate AS DATE), count(*)
    FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '2024-12-31' GROUP BY ALL
    UNION ALL
    SELECT 'lineitem', CAST(l_shipdate AS DATE), count(*)
    FROM lineitem WHERE l_shipdate BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '2024-12-31' GROUP BY ALL
    """,
)
def scan_many_counts(spark, folder):
    tables = catalog(spark, folder)
    frames = scan_many(tables, ["events", "orders", "lineitem"], "1997-01-01T00:00:00Z", "2024-12-31T00:00:00Z", drop_empty=True)
    days = [
        df.groupBy(F.lit(name).alias("table_name"), F.to_date(tables.time_column(name)).alias("day")).agg(
            F.count(F.lit(1)).alias("n")
        )
        for name, df in frames.items()
    ]
    return reduce(DataFrame.union, days)


@STEPS.add(
    "presence",
    """
    SELECT 'orders' AS table_name, 0 AS position, count(*) AS n_rows, count(*) > 0 AS has_data
    FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '2001-06-01' AND TIMESTAMP '2024-01-15'
    UNION ALL
    SELECT 'events', 1, count(*), count(*) > 0
    FROM events WHERE ts BETWEEN TIMESTAMP '2001-06-01' AND TIMESTAMP '2024-01-15'
    UNION ALL
    SELECT 'lineitem', 2, count(*), count(*) > 0
    FROM lineitem WHERE l_shipdate BETWEEN TIMESTAMP '2001-06-01' AND TIMESTAMP '2024-01-15'
    """,
)
def presence_of_three(spark, folder):
    return presence(
        catalog(spark, folder), ["orders", "events", "lineitem"], "2001-06-01T00:00:00Z", "2024-01-15T00:00:00Z"
    )


@STEPS.add(
    "presence_partly_empty",
    """
    SELECT 'lineitem' AS table_name, 0 AS position, count(*) AS n_rows, count(*) > 0 AS has_data
    FROM lineitem WHERE l_shipdate BETWEEN TIMESTAMP '2002-01-01' AND TIMESTAMP '2024-12-31'
    UNION ALL
    SELECT 'events', 1, count(*), count(*) > 0
    FROM events WHERE ts BETWEEN TIMESTAMP '2002-01-01' AND TIMESTAMP '2024-12-31'
    """,
)
def presence_partly_empty(spark, folder):
    return presence(catalog(spark, folder), ["lineitem", "events"], "2002-01-01T00:00:00Z", "2024-12-31T00:00:00Z")


@STEPS.add("epoch_columns", "SELECT *, epoch_us(ts) * 1000 AS ts_ns, epoch_us(ts) // 1000000 AS ts_s FROM events")
def epoch_columns_events(spark, folder):
    return epoch_columns(read(spark, folder, "events"), "ts")


# ---- stored datasets, rows and files ------------------------------------------


@STEPS.add(
    "registry_reuse",
    """
    SELECT 'clicks' AS part, user_id, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY ALL
    UNION ALL
    SELECT 'high', user_id, count(*) FROM events WHERE value > 50 GROUP BY ALL
    """,
)
def registry_reuse(spark, folder):
    datasets = Datasets()
    stored = datasets.store(read(spark, folder, "events"))
    clicks = transform(
        datasets.get(stored),
        "SELECT 'clicks' AS part, user_id, count(*) AS n FROM df WHERE event_type = 'click' GROUP BY user_id",
    )
    high = transform(
        datasets.get(stored), "SELECT 'high' AS part, user_id, count(*) AS n FROM df WHERE value > 50 GROUP BY user_id"
    )
    return clicks.union(high)


@STEPS.add("preview_cell_budget", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 150")
def preview_cell_budget(spark, folder):
    return preview_frame(in_order(read(spark, folder, "orders"), "o_orderkey"), limit=1000, max_cells=900)


_EVENTS_AS_TEXT = """
    SELECT CAST(event_id AS VARCHAR) AS event_id, event_type, props,
           strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS ts, CAST(user_id AS VARCHAR) AS user_id, CAST(value AS VARCHAR) AS value
    FROM events
"""


@STEPS.add("json_rows_roundtrip", _EVENTS_AS_TEXT)
def json_rows_roundtrip(spark, folder):
    events = read(spark, folder, "events")
    return from_json_rows(to_json_rows(events), events.columns)


@STEPS.add(
    "json_rows_out",
    """
    SELECT concat('{"event_id":', event_id, ',"ts":"', strftime(ts, '%Y-%m-%dT%H:%M:%S.%f'), '","user_id":', user_id,
                  ',"event_type":"', event_type, '","value":', value, ',"props":"', replace(props, '"', '\\"'), '"}') AS value
    FROM events
    """,
)
def json_rows_out(spark, folder):
    return to_json_rows(read(spark, folder, "events"))


@STEPS.add(
    "json_rows_sql",
    """
    SELECT event_type, count(*) AS n, round(sum(value), 2) AS total, max(CAST(user_id AS VARCHAR)) AS last_user
    FROM events GROUP BY event_type
    """,
)
def json_rows_sql(spark, folder):
    events = read(spark, folder, "events")
    rows = from_json_rows(to_json_rows(events), events.columns)
    text = (
        "SELECT event_type, count(*) AS n, round(sum(cast(value AS double)), 2) AS total, max(user_id) AS last_user "
        "FROM data GROUP BY event_type"
    )
    return transform(rows, text, view="data")


@STEPS.add("json_rows_keys_found", _EVENTS_AS_TEXT)
def json_rows_keys_found(spark, folder):
    lines = to_json_rows(read(spark, folder, "events"))
    return from_json_rows(lines, [row.key for row in json_keys(lines).collect()])


@STEPS.add("json_files_roundtrip", _EVENTS_AS_TEXT)
def json_files_roundtrip(spark, folder):
    events = read(spark, folder, "events")
    path = work_path(spark, "rows")
    to_json_rows(events).write.text(path)
    return read_json_rows(spark, path, events.columns)


@STEPS.add(
    "csv_roundtrip",
    r"""
    SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, o_orderstatus,
           regexp_replace(CAST(o_totalprice AS VARCHAR), '\.0$', '') AS o_totalprice,
           strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS o_orderdate, o_orderpriority
    FROM orders
    """,
)
def csv_roundtrip(spark, folder):
    orders = read(spark, folder, "orders")
    path = work_path(spark, "csv")
    write_csv(orders, path)
    return read_csv(spark, path, orders.columns)


# ---- conditions -----------------------------------------------------------------


def basic(table: str, columns: str = "", *conditions: Condition):
    query = BasicQuery(tuple(columns.split()), conditions)
    return lambda spark, folder: basic_to_df(query, read(spark, folder, table))


STEPS.add("basic_select_all", "SELECT * FROM customer")(basic("customer"))
STEPS.add("basic_select_cols", "SELECT c_mktsegment, c_custkey FROM customer")(
    basic("customer", "c_mktsegment c_custkey")
)
STEPS.add("basic_where_eq", "SELECT * FROM events WHERE event_type = 'purchase'")(
    basic("events", "", Condition("event_type", "=", "purchase"))
)
STEPS.add("basic_where_lt", "SELECT * FROM lineitem WHERE l_quantity < 12.5")(
    basic("lineitem", "", Condition("l_quantity", "<", "12.5"))
)
STEPS.add("basic_where_gt", "SELECT l_orderkey, l_linenumber, l_tax FROM lineitem WHERE l_tax > 0.04")(
    basic("lineitem", "l_orderkey l_linenumber l_tax", Condition("l_tax", ">", "0.04"))
)
STEPS.add("basic_where_fraction", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber < 2.5")(
    basic("lineitem", "l_orderkey l_linenumber", Condition("l_linenumber", "<", "2.5"))
)
STEPS.add(
    "basic_where_or_and",
    "SELECT * FROM events WHERE event_type = 'purchase' OR event_type = 'click' AND value > 100",
)(
    basic(
        "events",
        "",
        Condition("event_type", "=", "purchase"),
        Condition("event_type", "=", "click", "OR"),
        Condition("value", ">", "100", "AND"),
    )
)
STEPS.add("basic_where_and", "SELECT event_id, value FROM events WHERE value > 20 AND user_id < 100")(
    basic("events", "event_id value", Condition("value", ">", "20"), Condition("user_id", "<", "100"))
)
STEPS.add(
    "basic_where_first_left_out", "SELECT * FROM events WHERE event_type = 'view' OR event_type = 'error'"
)(
    basic(
        "events",
        "",
        Condition("event_type", "=", ""),
        Condition("event_type", "=", "view", "AND"),
        Condition("event_type", "=", "error", "OR"),
    )
)
STEPS.add("basic_where_time", "SELECT * FROM events WHERE ts > TIMESTAMP '2024-01-10 12:00:00'")(
    basic("events", "", Condition("ts", ">", "2024-01-10T12:00:00Z"))
)
STEPS.add("basic_where_unparsable", "SELECT * FROM lineitem WHERE false OR l_returnflag = 'R'")(
    basic("lineitem", "", Condition("l_quantity", "=", "abc"), Condition("l_returnflag", "=", "R", "OR"))
)


@STEPS.add(
    "basic_sql_text",
    "SELECT o_orderkey, o_orderdate, o_totalprice FROM orders "
    "WHERE o_orderstatus = 'F' AND o_totalprice > 100000 OR o_orderdate < TIMESTAMP '1996-01-01'",
)
def basic_sql_text(spark, folder):
    orders = read(spark, folder, "orders")
    query = BasicQuery(
        ("o_orderkey", "o_orderdate", "o_totalprice"),
        (
            Condition("o_orderstatus", "=", "F"),
            Condition("o_totalprice", ">", "100000", "AND"),
            Condition("o_orderdate", "<", "1996-01-01T00:00:00Z", "OR"),
        ),
    )
    return transform(orders, basic_to_sql(query, orders))


# ---- joins ----------------------------------------------------------------------


def _events_and_customers(kind: str) -> str:
    return f"""
    SELECT event_id, ts, user_id, coalesce(event_type, 'NaN') AS event_type, value, coalesce(props, 'NaN') AS props,
           c_custkey, coalesce(c_name, 'NaN') AS c_name_right, c_nationkey AS c_nationkey_right,
           c_acctbal AS c_acctbal_right, coalesce(c_mktsegment, 'NaN') AS c_mktsegment_right
    FROM events {kind} JOIN customer ON user_id = c_custkey
    """


def _join_events_customers(how: str, **options):
    return lambda spark, folder: join_on(
        read(spark, folder, "events"), read(spark, folder, "customer"), "user_id", "c_custkey", how, **options
    )


for _name, _how, _sql in (
    ("join_inner", "inner", "INNER"),
    ("join_left", "left", "LEFT"),
    ("join_right", "right", "RIGHT"),
    ("join_outer", "outer", "FULL"),
):
    STEPS.add(_name, _events_and_customers(_sql))(_join_events_customers(_how))
for _how, _sql in (("left", "LEFT"), ("right", "RIGHT"), ("outer", "FULL")):
    STEPS.add(f"join_{_how}_salted", _events_and_customers(_sql))(_join_events_customers(_how, salt=True))

STEPS.add(
    "join_no_fill",
    "SELECT event_id, ts, user_id, event_type, value, props, c_custkey, c_name AS c_name_right, "
    "c_nationkey AS c_nationkey_right, c_acctbal AS c_acctbal_right, c_mktsegment AS c_mktsegment_right "
    "FROM events RIGHT JOIN customer ON user_id = c_custkey",
)(_join_events_customers("right", fill_strings=None))


@STEPS.add(
    "join_outer_orders",
    """
    SELECT o_orderkey, o_custkey, coalesce(o_orderstatus, 'NaN') AS o_orderstatus, o_totalprice, o_orderdate,
           coalesce(o_orderpriority, 'NaN') AS o_orderpriority, c_custkey, coalesce(c_name, 'NaN') AS c_name_right,
           c_nationkey AS c_nationkey_right, c_acctbal AS c_acctbal_right,
           coalesce(c_mktsegment, 'NaN') AS c_mktsegment_right
    FROM orders FULL JOIN customer ON o_custkey = c_custkey
    """,
)
def join_outer_orders(spark, folder):
    return join_on(
        read(spark, folder, "orders"), read(spark, folder, "customer"), "o_custkey", "c_custkey", "Outer Join"
    )


@STEPS.add(
    "join_cross_keyed",
    "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment, n_nationkey, n_name AS n_name_right, "
    "n_regionkey AS n_regionkey_right FROM customer JOIN nation ON c_nationkey = n_nationkey",
)
def join_cross_keyed(spark, folder):
    return join_on(
        read(spark, folder, "customer"), read(spark, folder, "nation"), "c_nationkey", "n_nationkey", "Cross Join"
    )


@STEPS.add(
    "join_semi", "SELECT * FROM customer WHERE EXISTS (SELECT 1 FROM events WHERE user_id = c_custkey)"
)
def join_semi(spark, folder):
    return join_on(
        read(spark, folder, "customer"), read(spark, folder, "events"), "c_custkey", "user_id", "left_semi"
    )


@STEPS.add(
    "join_anti", "SELECT * FROM customer WHERE NOT EXISTS (SELECT 1 FROM events WHERE user_id = c_custkey)"
)
def join_anti(spark, folder):
    return join_on(
        read(spark, folder, "customer"), read(spark, folder, "events"), "c_custkey", "user_id", "left_anti"
    )


@STEPS.add(
    "join_time_time",
    """
    WITH o AS (SELECT o_orderdate AS time, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ALL),
         l AS (SELECT l_shipdate AS time, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem GROUP BY ALL)
    SELECT o.time, o.n, total, l.time AS time_right, l.n AS n_right, quantity AS quantity_right
    FROM o FULL JOIN l ON o.time = l.time
    """,
)
def join_time_time(spark, folder):
    ordered = transform(
        read(spark, folder, "orders"),
        "SELECT o_orderdate AS time, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM df GROUP BY o_orderdate",
    )
    shipped = transform(
        read(spark, folder, "lineitem"),
        "SELECT l_shipdate AS time, count(*) AS n, sum(l_quantity) AS quantity FROM df GROUP BY l_shipdate",
    )
    return join_on(ordered, shipped, "time", "time", "outer")


@STEPS.add(
    "join_same_parent",
    """
    WITH p AS (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY ALL),
         c AS (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY ALL)
    SELECT p.user_id, p.n, c.user_id AS user_id_right, c.n AS n_right FROM p LEFT JOIN c ON p.user_id = c.user_id
    """,
)
def join_same_parent(spark, folder):
    events = read(spark, folder, "events")
    purchases = transform(
        events, "SELECT user_id, count(*) AS n FROM df WHERE event_type = 'purchase' GROUP BY user_id"
    )
    clicks = transform(events, "SELECT user_id, count(*) AS n FROM df WHERE event_type = 'click' GROUP BY user_id")
    return join_on(purchases, clicks, "user_id", "user_id", "left")


# ---- series -----------------------------------------------------------------------


@STEPS.add(
    "series_wide_to_long",
    """
    SELECT 'l_quantity' AS label, CAST(epoch_ms(l_shipdate) AS DOUBLE) AS x, l_quantity AS y FROM lineitem
    UNION ALL
    SELECT 'l_extendedprice', CAST(epoch_ms(l_shipdate) AS DOUBLE), l_extendedprice FROM lineitem
    """,
)
def series_wide_to_long(spark, folder):
    dated = transform(
        read(spark, folder, "lineitem"), "SELECT l_shipdate AS ship_time, l_quantity, l_extendedprice FROM df"
    )
    return series(dated, "ship_time", "l_quantity", "l_extendedprice")


@STEPS.add(
    "series_parse_float",
    """
    SELECT 'brand' AS label, CAST(p_partkey AS DOUBLE) AS x, CAST(regexp_extract(p_brand, '[0-9]+') AS DOUBLE) AS y
    FROM part
    UNION ALL
    SELECT 'size_text', CAST(p_partkey AS DOUBLE), CAST(p_size AS DOUBLE) + 0.5 FROM part
    UNION ALL
    SELECT 'p_type', CAST(p_partkey AS DOUBLE), NULL FROM part
    """,
)
def series_parse_float(spark, folder):
    texts = transform(
        read(spark, folder, "part"),
        "SELECT p_partkey, split_part(p_brand, '#', 2) AS brand, "
        "concat('  ', p_size, '.5e0 mm') AS size_text, p_type FROM df",
    )
    points = series(texts, "p_partkey", "brand", "size_text", "p_type")
    return points.withColumn("y", F.when(~F.isnan("y"), F.col("y")))


@STEPS.add(
    "series_time_ms",
    """
    SELECT 'value' AS label, CAST(epoch_us(ts) // 1000 AS DOUBLE) AS x, value AS y FROM events
    UNION ALL
    SELECT 'time_text', CAST(epoch_us(ts) // 1000 AS DOUBLE), CAST(epoch_us(ts) // 1000 AS DOUBLE) FROM events
    """,
)
def series_time_ms(spark, folder):
    timed = transform(
        read(spark, folder, "events"), "SELECT ts AS event_time, value, cast(ts AS string) AS time_text FROM df"
    )
    return series(timed, "event_time", "value", "time_text")


# ---- workflows ----------------------------------------------------------------------

# A saved workflow: a listing, two tables, a basic and an advanced SQL box, a join and a plot,
# out of order as a file may hold them.
SAVED_WORKFLOW = {
    "boxes": [
        {
            "id": "box-7",
            "type": "plot",
            "title": "Purchases per day",
            "runArgs": {"xField": "time", "yField": "total", "additionalYFields": ["n"], "parent": "box-6"},
        },
        {
            "id": "box-6",
            "type": "sql",
            "title": "Daily",
            "runArgs": {
                "sqlMode": "advanced",
                "advancedSQL": "SELECT date_trunc('DAY', ts) AS time, segment_right AS segment, count(*) AS n, "
                "round(sum(value), 2) AS total FROM df GROUP BY 1, 2",
                "parent": "box-5",
            },
        },
        {
            "id": "box-5",
            "type": "join",
            "title": "With buyers",
            "runArgs": {
                "joinType": "Left Join",
                "leftJoinColumn": "user_id",
                "rightJoinColumn": "custkey",
                "leftParent": "box-3",
                "rightParent": "box-4",
            },
        },
        {
            "id": "box-4",
            "type": "sql",
            "title": "Buyers",
            "runArgs": {
                "sqlMode": "advanced",
                "advancedSQL": "SELECT o_custkey AS custkey, "
                "CASE WHEN count(*) > 10 THEN 'frequent' ELSE 'rare' END AS segment FROM df GROUP BY o_custkey;",
                "parent": "box-2b",
            },
        },
        {
            "id": "box-3",
            "type": "sql",
            "title": "Purchases",
            "runArgs": {
                "sqlMode": "basic",
                "selectClause": "ts, user_id, value",
                "whereClause": "event_type",
                "whereOperator": "=",
                "whereValue": "purchase",
                "additionalWhere": [{"column": "value", "operator": ">", "value": "5", "logic": "AND"}],
                "parent": "box-2",
            },
        },
        {
            "id": "box-2b",
            "type": "table",
            "title": "Orders",
            "runArgs": {
                "table": "orders",
                "start_time": "1995-01-01T00:00:00Z",
                "end_time": "2005-01-01T00:00:00Z",
                "parent": "box-1",
            },
        },
        {
            "id": "box-2",
            "type": "table",
            "title": "Events",
            "runArgs": {
                "table": "events",
                "start_time": "2024-01-02T00:00:00Z",
                "end_time": "2024-01-29T00:00:00Z",
                "parent": "box-1",
            },
        },
        {"id": "box-1", "type": "database", "title": "Tables", "runArgs": {"code": ""}},
    ],
    "counters": {"boxIdCounter": 7},
}


@STEPS.add(
    "workflow_flagship",
    """
    WITH buyers AS (
        SELECT o_custkey, CASE WHEN count(*) > 10 THEN 'frequent' ELSE 'rare' END AS segment
        FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '2005-01-01' GROUP BY ALL),
    daily AS (
        SELECT CAST(ts AS DATE) AS day, coalesce(segment, 'NaN') AS segment,
               count(*) AS n, round(sum(value), 2) AS total
        FROM events LEFT JOIN buyers ON user_id = o_custkey
        WHERE ts BETWEEN TIMESTAMP '2024-01-02' AND TIMESTAMP '2024-01-29'
          AND event_type = 'purchase' AND value > 5
        GROUP BY ALL)
    SELECT 'total' AS label, CAST(epoch_ms(CAST(day AS TIMESTAMP)) AS DOUBLE) AS x, total AS y FROM daily
    UNION ALL
    SELECT 'n', CAST(epoch_ms(CAST(day AS TIMESTAMP)) AS DOUBLE), CAST(n AS DOUBLE) FROM daily
    """,
)
def workflow_flagship(spark, folder):
    return run_box(Workflow.load(SAVED_WORKFLOW), catalog(spark, folder), "box-7")


@STEPS.add(
    "workflow_two_branches",
    """
    WITH c AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events
               WHERE ts BETWEEN TIMESTAMP '2024-01-01' AND TIMESTAMP '2024-02-01' AND event_type = 'click' GROUP BY ALL),
         b AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events
               WHERE ts BETWEEN TIMESTAMP '2024-01-01' AND TIMESTAMP '2024-02-01' AND event_type = 'purchase' GROUP BY ALL)
    SELECT 'n' AS label, CAST(epoch_ms(CAST(c.day AS TIMESTAMP)) AS DOUBLE) AS x, CAST(c.n AS DOUBLE) AS y
    FROM c JOIN b ON c.day = b.day
    UNION ALL
    SELECT 'n_right', CAST(epoch_ms(CAST(c.day AS TIMESTAMP)) AS DOUBLE), CAST(b.n AS DOUBLE)
    FROM c JOIN b ON c.day = b.day
    """,
)
def workflow_two_branches(spark, folder):
    daily = "SELECT date_trunc('DAY', ts) AS time, count(*) AS n FROM df WHERE event_type = '{}' GROUP BY 1"
    workflow = Workflow.of(
        events=Table("events", "2024-01-01T00:00:00Z", "2024-02-01T00:00:00Z"),
        clicks=Sql("events", "advanced", advancedSQL=daily.format("click")),
        buys=Sql("events", "advanced", advancedSQL=daily.format("purchase")),
        both=Join("clicks", "buys", "time", "time", "Inner Join"),
        lines=Plot("both", "time", "n", ("n_right",)),
    )
    return run_box(workflow, catalog(spark, folder), "lines")


@STEPS.add(
    "workflow_table_box",
    """
    SELECT *, epoch_us(l_shipdate) * 1000 AS l_shipdate_ns, epoch_us(l_shipdate) // 1000000 AS l_shipdate_s
    FROM lineitem WHERE l_shipdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '2001-01-01'
    """,
)
def workflow_table_box(spark, folder):
    workflow = Workflow.of(items=Table("lineitem", "1996-01-01T00:00:00Z", "2001-01-01T00:00:00Z"))
    return run_box(workflow, catalog(spark, folder), "items")


# ---- what earlier forms of the operators got wrong -----------------------------------


def _in_order(df, time):
    """How many rows there are and how many come before one they should follow: within partitions, and between them."""
    placed = df.select(
        F.col(time).alias("t"), F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("i")
    )
    within = placed.select("t", "p", F.lag("t").over(Window.partitionBy("p").orderBy("i")).alias("before"))
    parts = within.groupBy("p").agg(
        F.count("*").alias("n"),
        F.count(F.when(F.col("before") > F.col("t"), 1)).alias("wrong"),
        F.min("t").alias("low"),
        F.max("t").alias("high"),
    )
    # One row for each partition.
    after = F.when(F.lag("high").over(Window.orderBy("p")) > F.col("low"), 1)
    return parts.select("n", "wrong", after.alias("late")).agg(
        F.sum("n").alias("n_rows"), (F.sum("wrong") + F.count("late")).alias("out_of_order")
    )


@STEPS.add("scan_ordered_order", "SELECT count(*)::BIGINT AS n_rows, 0::BIGINT AS out_of_order FROM events")
def scan_ordered_order(spark, folder):
    return _in_order(scan_ordered_events(spark, folder), "ts")


@STEPS.add(
    "join_time_order",
    """
    SELECT count(*)::BIGINT AS n_rows, 0::BIGINT AS out_of_order
    FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
    """,
)
def join_time_order(spark, folder):
    orders = read(spark, folder, "orders").withColumnRenamed("o_orderdate", "time")
    return _in_order(join_on(orders, read(spark, folder, "customer"), "o_custkey", "c_custkey", "inner"), "time")


@STEPS.add(
    "join_chain_outer",
    """
    WITH e AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id)
    SELECT c.c_custkey, e.n, o.orders, f.low, s.s_suppkey, n.n_nationkey
    FROM customer c FULL JOIN e ON c.c_custkey = e.user_id
    FULL JOIN (SELECT o_custkey, count(*) AS orders FROM orders GROUP BY 1) o ON c.c_custkey = o.o_custkey
    FULL JOIN (SELECT user_id, min(value) AS low FROM events GROUP BY 1) f ON c.c_custkey = f.user_id
    FULL JOIN supplier s ON c.c_custkey = s.s_suppkey
    FULL JOIN nation n ON c.c_nationkey = n.n_nationkey
    """,
)
def join_chain_outer(spark, folder):
    customer, events = read(spark, folder, "customer"), read(spark, folder, "events")
    steps = [
        (transform(events, "SELECT user_id, count(*) AS n FROM df GROUP BY 1"), "c_custkey", "user_id"),
        (
            transform(read(spark, folder, "orders"), "SELECT o_custkey, count(*) AS orders FROM df GROUP BY 1"),
            "c_custkey",
            "o_custkey",
        ),
        (
            transform(events, "SELECT user_id AS low_user, min(value) AS low FROM df GROUP BY 1"),
            "c_custkey",
            "low_user",
        ),
        (read(spark, folder, "supplier"), "c_custkey", "s_suppkey"),
        (read(spark, folder, "nation"), "c_nationkey", "n_nationkey"),
    ]
    joined = customer
    for right, mine, theirs in steps:
        joined = join_on(joined, right, mine, theirs, "outer", fill_strings=None, sort=False)
    return joined.select(
        "c_custkey",
        F.col("n_right" if "n_right" in joined.columns else "n").alias("n"),
        F.col("orders_right" if "orders_right" in joined.columns else "orders").alias("orders"),
        F.col("low_right" if "low_right" in joined.columns else "low").alias("low"),
        "s_suppkey",
        "n_nationkey",
    )


@STEPS.add(
    "join_number_with_text",
    """
    SELECT e.event_id, e.user_id, c.c_name FROM events e
    LEFT JOIN customer c ON e.user_id = c.c_custkey AND c.c_custkey % 3 <> 0
    """,
)
def join_number_with_text(spark, folder):
    texts = read(spark, folder, "customer").select(
        F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).otherwise(F.col("c_custkey").cast("string")).alias("code"),
        "c_name",
    )
    events = read(spark, folder, "events").select("event_id", "user_id")
    joined = join_on(events, texts, "user_id", "code", "left", fill_strings=None, sort=False)
    return joined.select("event_id", "user_id", F.col("c_name_right").alias("c_name"))


@STEPS.add(
    "epoch_columns_far",
    """
    SELECT o_orderkey, t, CASE WHEN year(t) > 2262 THEN NULL ELSE epoch_us(t) * 1000 END AS t_ns,
           epoch_us(t) // 1000000 AS t_s
    FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN TIMESTAMP '9999-12-31' ELSE o_orderdate END AS t FROM orders)
    """,
)
def epoch_columns_far(spark, folder):
    return epoch_columns(
        transform(
            read(spark, folder, "orders"),
            "SELECT o_orderkey, if(o_orderkey % 2 = 0, TIMESTAMP_NTZ'9999-12-31 00:00:00', o_orderdate) AS t FROM df",
        ),
        "t",
    )


_FINE = "2024-01-15T08:16:03.123456"


@STEPS.add(
    "scan_range_nanoseconds",
    f"""
    SELECT event_id, t FROM (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN TIMESTAMP '{_FINE}' ELSE ts END AS t FROM events)
    WHERE t > TIMESTAMP '{_FINE}' AND t < TIMESTAMP '2024-01-20'
    """,
)
def scan_range_nanoseconds(spark, folder):
    return scan_range(_fine_events(spark, folder), f"{_FINE}789", "2024-01-19T23:59:59.999999999Z", "t")


def _fine_events(spark, folder):
    text = f"SELECT event_id, if(event_id % 2 = 0, TIMESTAMP_NTZ'{_FINE}', ts) AS t FROM df"
    return transform(read(spark, folder, "events"), text)


@STEPS.add(
    "basic_where_nanoseconds",
    f"""
    WITH e AS (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN TIMESTAMP '{_FINE}' ELSE ts END AS t FROM events)
    SELECT 'below' AS op, event_id FROM e WHERE t <= TIMESTAMP '{_FINE}'
    UNION ALL SELECT 'above', event_id FROM e WHERE t > TIMESTAMP '{_FINE}'
    """,
)
def basic_where_nanoseconds(spark, folder):
    events = _fine_events(spark, folder)
    parts = []
    for name, op in (("below", "<"), ("above", ">"), ("same", "=")):
        found = basic_to_df(BasicQuery(["event_id"], (Condition("t", op, f"{_FINE}789"),)), events)
        parts.append(found.select(F.lit(name).alias("op"), "event_id"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@STEPS.add(
    "series_number_named_time",
    "SELECT 'value' AS label, o_totalprice AS x, o_orderkey::DOUBLE AS y FROM orders",
)
def series_number_named_time(spark, folder):
    orders = transform(read(spark, folder, "orders"), "SELECT o_totalprice AS response_time, o_orderkey AS value FROM df")
    return series(orders, "response_time", "value")


def _events_box(spark, folder, sql):
    boxes = {"all": Table("events", "2024-01-02T00:00:00Z", "2024-01-29T00:00:00Z"), "text": Sql("all", "advanced", advancedSQL=sql)}
    return run_box(Workflow.of(**boxes), catalog(spark, folder), "text")


@STEPS.add(
    "sql_topk_after_table_box",
    """
    SELECT user_id, round(sum(value), 6) AS total FROM events
    WHERE ts BETWEEN TIMESTAMP '2024-01-02' AND TIMESTAMP '2024-01-29'
    GROUP BY user_id ORDER BY total DESC, user_id LIMIT 10
    """,
)
def sql_topk_after_table_box(spark, folder):
    text = "SELECT user_id, round(sum(value), 6) AS total FROM df GROUP BY user_id ORDER BY total DESC, user_id LIMIT 10"
    return _events_box(spark, folder, text)


@STEPS.add(
    "sql_first_rows",
    """
    SELECT event_id, ts FROM events
    WHERE event_type = 'click' AND ts BETWEEN TIMESTAMP '2024-01-02' AND TIMESTAMP '2024-01-29'
    ORDER BY ts LIMIT 7 OFFSET 5
    """,
)
def sql_first_rows(spark, folder):
    return _events_box(spark, folder, "SELECT event_id, ts FROM df WHERE event_type = 'click' LIMIT 7 OFFSET 5; -- some")


# ---- raw rows of frequent keys, and joins without a key -------------------------


def _hot_events(spark, folder):
    """All events, a third of them of one user."""
    return transform(
        read(spark, folder, "events"),
        "SELECT event_id, ts, if(event_id % 3 = 0, 1, user_id) AS user_id, event_type, value, "
        "CAST(round(value * 100) AS BIGINT) AS cents FROM df",
    )


_HOT_EVENTS = """
    WITH hot AS (SELECT event_id, ts, CASE WHEN event_id % 3 = 0 THEN 1 ELSE user_id END AS user_id, event_type, value,
                        CAST(round(value * 100) AS BIGINT) AS cents FROM events)
"""


@STEPS.add(
    "window_running_hot_user",
    _HOT_EVENTS
    + """
    SELECT event_id, user_id, row_number() OVER w AS n, CAST(sum(cents) OVER w AS BIGINT) AS total,
           max(value) OVER w AS highest, lag(ts) OVER w AS before
    FROM hot WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
    """,
)
def window_running_hot_user(spark, folder):
    columns = {"n": row_numbers(), "total": sums("cents"), "highest": largest("value"), "before": previous("ts")}
    found = running(_hot_events(spark, folder), "user_id", ["ts", "event_id"], columns)
    return found.select("event_id", "user_id", *columns)


@STEPS.add(
    "session_hot_user",
    _HOT_EVENTS
    + """
    , steps AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM hot),
    numbered AS (
      SELECT *, sum(CASE WHEN ts <= before + INTERVAL 2 HOURS THEN 0 ELSE 1 END)
                OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session
      FROM steps)
    SELECT user_id, CAST(session AS BIGINT) AS session, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n,
           CAST(sum(cents) AS BIGINT) AS cents
    FROM numbered GROUP BY ALL
    """,
)
def session_hot_user(spark, folder):
    numbered = sessions(_hot_events(spark, folder), "user_id", "ts", 2 * 3600)
    return numbered.groupBy("user_id", "session").agg(
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n"), F.sum("cents").alias("cents")
    )


@STEPS.add(
    "range_join_binned",
    """
    SELECT a.event_type AS first_type, b.event_type AS then_type, count(*) AS n, max(b.event_id - a.event_id) AS apart
    FROM events a JOIN events b ON b.ts > a.ts AND b.ts <= a.ts + INTERVAL 5 MINUTES
    GROUP BY ALL
    """,
)
def range_join_binned(spark, folder):
    events = read(spark, folder, "events")
    soon = transform(
        events,
        """
        SELECT event_id, event_type, ts + INTERVAL 1 MICROSECOND AS after, ts + INTERVAL 5 MINUTES AS until FROM df
        """,
    )
    parts = overlap_parts(
        soon, events, ("after", "until"), ("ts", "ts"), ["event_id", "event_type"], ["event_type"],
        greatest={"last_id": "event_id"},
    )
    types = [F.col("event_type").alias("first_type"), F.col("event_type_right").alias("then_type")]
    return parts.groupBy(*types).agg(
        F.sum("n").alias("n"), F.max(F.col("last_id") - F.col("event_id")).alias("apart")
    )


@STEPS.add(
    "range_join_mixed_lengths",
    """
    WITH spans AS (SELECT event_id, event_type, ts,
                          ts + CASE WHEN event_id % 50 = 0 THEN INTERVAL 6 HOURS ELSE INTERVAL 40 SECONDS END AS until
                   FROM events)
    SELECT a.event_id, count(*) AS n, min(b.event_id) AS first_id
    FROM spans a JOIN spans b ON a.ts <= b.until AND b.ts <= a.until
    GROUP BY a.event_id
    """,
)
def range_join_mixed_lengths(spark, folder):
    spans = transform(
        read(spark, folder, "events"),
        "SELECT event_id, ts, ts + if(event_id % 50 = 0, INTERVAL 6 HOURS, INTERVAL 40 SECONDS) AS until FROM df",
    )
    parts = overlap_parts(
        spans, spans, ("ts", "until"), ("ts", "until"), ["event_id"], least={"first_id": "event_id"}
    )
    return parts.groupBy("event_id").agg(F.sum("n").alias("n"), F.min("first_id").alias("first_id"))


# ---- JSON with types, and states that are kept -----------------------------------


@STEPS.add(
    "json_rows_typed",
    """
    SELECT event_id AS id, CASE WHEN event_id % 3 = 0 THEN event_type ELSE CAST(event_id AS VARCHAR) END AS mixed,
           CASE WHEN event_id % 2 = 0 THEN CAST(event_id AS DOUBLE) ELSE event_id + 0.5::DOUBLE END AS number,
           CASE WHEN event_id % 5 > 0 THEN user_id END AS user_id, CASE WHEN event_id % 5 > 0 THEN event_type END AS type,
           CASE WHEN event_id % 7 = 0 THEN event_id + user_id END AS total
    FROM events
    """,
)
def json_rows_typed(spark, folder):
    lines = transform(
        read(spark, folder, "events"),
        """
        SELECT concat('{"id":', event_id, ',"mixed":', if(event_id % 3 = 0, concat('"', event_type, '"'), string(event_id)),
                      ',"number":', event_id, if(event_id % 2 = 0, '', '.5'),
                      if(event_id % 5 > 0, concat(',"by":{"user":', user_id, ',"type":"', event_type, '"}'), ''),
                      if(event_id % 7 = 0, concat(',"list":[', event_id, ',', user_id, ']'), ''), '}') AS value
        FROM df
        """,
    )
    rows = typed_json_rows(lines)
    total = F.aggregate("list", F.lit(0).cast("long"), lambda sum_, x: sum_ + x)
    return rows.select(
        "id", "mixed", F.col("number").cast("double").alias("number"), F.col("by.user").alias("user_id"),
        F.col("by.type").alias("type"), total.alias("total"),
    )


@STEPS.add(
    "json_variant",
    """
    SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS total,
           count(DISTINCT CAST(json_extract(props, '$.k') AS BIGINT)) AS kinds,
           count(*) FILTER (json_extract(props, '$.other') IS NULL) AS others
    FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) >= 20
    GROUP BY event_type
    """,
)
def json_variant(spark, folder):
    parsed = transform(read(spark, folder, "events"), "SELECT event_type, parse_json(props) AS p FROM df")
    return transform(
        parsed,
        """
        SELECT event_type, count(*) AS n, sum(k) AS total, count(DISTINCT k) AS kinds, count_if(other IS NULL) AS others
        FROM (SELECT event_type, try_variant_get(p, '$.k', 'bigint') AS k, try_variant_get(p, '$.other', 'string') AS other
              FROM df)
        WHERE k >= 20 GROUP BY event_type
        """,
    )


@STEPS.add(
    "sql_sketch_merge",
    """
    SELECT event_type, CAST(date_trunc('week', ts) AS DATE) AS start, count(*) AS n_rows, true AS users_near, true AS middle_near
    FROM events GROUP BY ALL
    """,
)
def sql_sketch_merge(spark, folder):
    events = read(spark, folder, "events")
    path = work_path(spark, "states")
    day_states(events, "ts", ["event_type"], ["user_id"], ["value"]).write.partitionBy("day").parquet(path)
    weeks = merge_states(spark.read.parquet(path), "week", ["event_type"])
    exact = transform(
        events,
        "SELECT event_type AS type, to_date(date_trunc('WEEK', ts)) AS week, user_id, value FROM df",
    )
    joined = exact.join(weeks, (F.col("type") == F.col("event_type")) & (F.col("week") == F.col("start")))
    below = F.avg((F.col("value") <= F.col("ranks_value")[0]).cast("double"))
    grouped = joined.groupBy("event_type", "start").agg(
        F.max("n_rows").alias("n_rows"),
        F.max("distinct_user_id").alias("users"),
        F.count_distinct("user_id").alias("exact"),
        below.alias("below"),
    )
    return grouped.select(
        "event_type",
        "start",
        "n_rows",
        (F.abs(F.col("users") - F.col("exact")) <= 1 + 0.04 * F.col("exact")).alias("users_near"),
        F.col("below").between(0.46, 0.54).alias("middle_near"),
    )
