"""The SQL families users write in a SQL step, each over whole tables.

Windows and sessions run on rows that were first aggregated to one per user and
day, hour or half hour, so that a user's window holds a bounded number of rows
however many events the user has.
"""

from __future__ import annotations

from tidework_checks import Registry, read
from tidework import transform

SQL_BOX = Registry()


def sql(name: str, table: str, text: str, oracle: str | None) -> None:
    """Register `text` over the table as `df`; `oracle` None means the same text over the table."""
    if oracle is None:
        oracle = text.replace("FROM df", f"FROM {table}")
    SQL_BOX.add(name, oracle)(lambda spark, folder: transform(read(spark, folder, table), text))


# ---- aggregates ---------------------------------------------------------------

sql(
    "sql_group_agg",
    "lineitem",
    """
    SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS quantity,
           round(sum(l_extendedprice), 2) AS price, round(avg(l_discount), 6) AS discount,
           min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship
    FROM df GROUP BY l_returnflag, l_linestatus
    """,
    None,
)
sql(
    "sql_having",
    "events",
    """
    SELECT user_id, count(*) AS n, round(sum(value), 2) AS total
    FROM df GROUP BY user_id HAVING count(*) > 60 AND max(value) > 100
    """,
    None,
)
sql("sql_distinct", "events", "SELECT DISTINCT user_id, event_type FROM df", None)
sql(
    "sql_count_distinct",
    "events",
    """
    SELECT event_type, count(DISTINCT user_id) AS users, count(DISTINCT cast(ts AS date)) AS days, count(*) AS n
    FROM df GROUP BY event_type
    """,
    None,
)
sql(
    "sql_approx",
    "events",
    """
    WITH a AS (
      SELECT event_type, approx_count_distinct(user_id, 0.02) AS users,
             percentile_approx(value, array(0.25, 0.5, 0.75), 10000) AS q
      FROM df GROUP BY event_type),
    e AS (
      SELECT event_type, count(user_id) AS exact
      FROM (SELECT DISTINCT event_type, user_id FROM df) GROUP BY event_type),
    s AS (
      SELECT /*+ BROADCAST(a) */ event_type, avg(if(value <= q[0], 1D, 0D)) AS low,
             avg(if(value <= q[1], 1D, 0D)) AS middle, avg(if(value <= q[2], 1D, 0D)) AS high
      FROM df JOIN a USING (event_type) GROUP BY event_type)
    SELECT event_type, abs(users - exact) <= 0.1 * exact AS users_close,
           greatest(abs(low - 0.25), abs(middle - 0.5), abs(high - 0.75)) <= 0.01 AS quartiles_close
    FROM a JOIN e USING (event_type) JOIN s USING (event_type)
    """,
    "SELECT DISTINCT event_type, true AS users_close, true AS quartiles_close FROM events",
)
sql(
    "sql_grouping_sets",
    "lineitem",
    """
    SELECT l_returnflag, l_linestatus, CAST(grouping(l_returnflag) AS INT) AS all_flags,
           count(*) AS n, sum(l_quantity) AS quantity
    FROM df GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_linestatus), ())
    """,
    None,
)
sql(
    "sql_rollup",
    "lineitem",
    """
    SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS quantity
    FROM df GROUP BY ROLLUP (l_returnflag, l_linestatus)
    """,
    None,
)
sql(
    "sql_cube",
    "orders",
    """
    SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total
    FROM df GROUP BY CUBE (o_orderstatus, o_orderpriority)
    """,
    None,
)
sql(
    "sql_pivot",
    "events",
    """
    SELECT * FROM (SELECT user_id, event_type, value FROM df)
    PIVOT (round(sum(value), 2) FOR event_type IN
        ('click' AS click, 'view' AS view, 'purchase' AS purchase, 'signup' AS signup, 'error' AS error))
    """,
    """
    SELECT user_id, round(sum(value) FILTER (event_type = 'click'), 2) AS click,
           round(sum(value) FILTER (event_type = 'view'), 2) AS "view",
           round(sum(value) FILTER (event_type = 'purchase'), 2) AS purchase,
           round(sum(value) FILTER (event_type = 'signup'), 2) AS signup,
           round(sum(value) FILTER (event_type = 'error'), 2) AS error
    FROM events GROUP BY user_id
    """,
)
sql(
    "sql_unpivot",
    "events",
    """
    SELECT event_type, metric, amount
    FROM (SELECT event_type, round(sum(value), 2) AS total, min(value) AS low, max(value) AS high
          FROM df GROUP BY event_type)
    UNPIVOT (amount FOR metric IN (total, low, high))
    """,
    """
    SELECT event_type, 'total' AS metric, round(sum(value), 2) AS amount FROM events GROUP BY ALL
    UNION ALL SELECT event_type, 'low', min(value) FROM events GROUP BY ALL
    UNION ALL SELECT event_type, 'high', max(value) FROM events GROUP BY ALL
    """,
)
sql(
    "sql_stats",
    "lineitem",
    """
    SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS sd, round(var_pop(l_quantity), 6) AS variance,
           round(corr(l_quantity, l_extendedprice), 6) AS corr, round(covar_pop(l_tax, l_discount), 8) AS cov
    FROM df GROUP BY l_returnflag
    """,
    None,
)
sql(
    "sql_collect_text",
    "events",
    """
    SELECT user_id, array_join(sort_array(collect_list(event_type)), ',') AS types
    FROM (SELECT DISTINCT user_id, event_type FROM df) GROUP BY user_id
    """,
    "SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS types FROM events GROUP BY user_id",
)
sql(
    "sql_collect_map",
    "events",
    """
    SELECT user_id, element_at(counts, 'click') AS clicks, size(map_keys(counts)) AS kinds
    FROM (SELECT user_id, map_from_entries(collect_list(struct(event_type, n))) AS counts
          FROM (SELECT user_id, event_type, count(*) AS n FROM df GROUP BY user_id, event_type)
          GROUP BY user_id)
    """,
    """
    SELECT user_id, nullif(count(*) FILTER (event_type = 'click'), 0) AS clicks,
           CAST(count(DISTINCT event_type) AS INTEGER) AS kinds
    FROM events GROUP BY user_id
    """,
)

# ---- order and sets --------------------------------------------------------------

sql(
    "sql_topk",
    "orders",
    "SELECT o_orderkey, o_totalprice FROM df ORDER BY o_totalprice DESC, o_orderkey LIMIT 25",
    None,
)
sql(
    "sql_union",
    "events",
    """
    SELECT user_id FROM df WHERE event_type = 'click' UNION SELECT user_id FROM df WHERE value > 100
    """,
    None,
)
sql(
    "sql_union_all",
    "events",
    """
    SELECT event_id, 'low' AS band FROM df WHERE value < 10
    UNION ALL SELECT event_id, 'high' FROM df WHERE value >= 10
    """,
    None,
)
sql(
    "sql_intersect",
    "events",
    """
    SELECT DISTINCT user_id FROM df WHERE event_type = 'purchase'
    INTERSECT SELECT DISTINCT user_id FROM df WHERE value > 150
    """,
    None,
)
sql(
    "sql_except",
    "events",
    """
    SELECT DISTINCT user_id FROM df EXCEPT SELECT DISTINCT user_id FROM df WHERE value > 150
    """,
    None,
)

# ---- windows ------------------------------------------------------------------------

_DAILY = """(SELECT user_id, cast(ts AS date) AS day, count(*) AS n, round(sum(value), 2) AS total
             FROM df GROUP BY user_id, cast(ts AS date)) AS daily"""

sql(
    "sql_rank",
    "events",
    f"""
    SELECT user_id, day, n,
           CAST(row_number() OVER (PARTITION BY user_id ORDER BY n DESC, day) AS INT) AS place,
           CAST(rank() OVER (PARTITION BY user_id ORDER BY n DESC) AS INT) AS rank_n,
           CAST(dense_rank() OVER (PARTITION BY user_id ORDER BY n DESC) AS INT) AS dense_n,
           CAST(ntile(4) OVER (PARTITION BY user_id ORDER BY n DESC, day) AS INT) AS quarter
    FROM {_DAILY}
    """,
    None,
)
sql(
    "sql_lag_lead",
    "events",
    f"""
    SELECT user_id, day, total, lag(total) OVER w AS before, lead(total) OVER w AS after,
           first_value(total) OVER w AS first_total,
           last_value(total) OVER (PARTITION BY user_id ORDER BY day
                                   ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_total
    FROM {_DAILY} WINDOW w AS (PARTITION BY user_id ORDER BY day)
    """,
    None,
)
sql(
    "sql_running_sum",
    "events",
    f"""
    SELECT user_id, day, round(sum(total) OVER (PARTITION BY user_id ORDER BY day
           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS so_far
    FROM {_DAILY}
    """,
    None,
)
sql(
    "sql_moving_avg",
    "events",
    f"""
    SELECT user_id, day, round(avg(n) OVER (PARTITION BY user_id ORDER BY day
           ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 6) AS week_avg
    FROM {_DAILY}
    """,
    None,
)
sql(
    "sql_range_frame",
    "events",
    f"""
    SELECT user_id, day, CAST(sum(n) OVER (PARTITION BY user_id ORDER BY day
           RANGE BETWEEN INTERVAL '3' DAY PRECEDING AND CURRENT ROW) AS BIGINT) AS recent
    FROM {_DAILY}
    """,
    None,
)
sql(
    "sql_tumbling",
    "events",
    """
    SELECT window.start AS hour, event_type, count(*) AS n, round(sum(value), 2) AS total
    FROM df GROUP BY window(ts, '1 hour'), event_type
    """,
    """
    SELECT time_bucket(INTERVAL '1 hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 2) AS total
    FROM events GROUP BY ALL
    """,
)
sql(
    "sql_sliding",
    "events",
    """
    SELECT window.start AS start, CAST(sum(n) AS BIGINT) AS n
    FROM (SELECT window.start AS quarter, count(*) AS n FROM df GROUP BY window(ts, '15 minutes'))
    GROUP BY window(quarter, '1 hour', '15 minutes')
    """,
    """
    SELECT time_bucket(INTERVAL '15 minutes', ts) - k * INTERVAL '15 minutes' AS start, count(*) AS n
    FROM events, (SELECT unnest([0, 1, 2, 3]) AS k) GROUP BY ALL
    """,
)
sql(
    "sql_date_trunc",
    "events",
    """
    SELECT cast(date_trunc('WEEK', ts) AS date) AS week, event_type, count(*) AS n
    FROM df GROUP BY cast(date_trunc('WEEK', ts) AS date), event_type
    """,
    None,
)
sql(
    "sql_session",
    "events",
    """
    SELECT user_id, session_window.start AS start, max(last_ts) AS last_ts, CAST(sum(n) AS BIGINT) AS n
    FROM (SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n
          FROM df GROUP BY user_id, window(ts, '30 minutes'))
    GROUP BY user_id, session_window(first_ts,
        make_interval(0, 0, 0, 0, 0, 30, CAST(timestampdiff(MICROSECOND, first_ts, last_ts) AS DECIMAL(18, 0)) / 1000000))
    """,
    """
    SELECT user_id, min(ts) AS start, max(ts) AS last_ts, count(*) AS n
    FROM (SELECT user_id, ts, sum(opens) OVER (PARTITION BY user_id ORDER BY ts) AS session
          FROM (SELECT user_id, ts, CASE WHEN ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts)
                                              + INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS opens FROM events))
    GROUP BY user_id, session
    """,
)

# ---- subqueries ---------------------------------------------------------------------

sql(
    "sql_scalar_subquery",
    "events",
    """
    SELECT event_type, count(*) AS n FROM df WHERE value > (SELECT avg(value) FROM df) GROUP BY event_type
    """,
    None,
)
sql(
    "sql_correlated_subquery",
    "events",
    """
    WITH daily AS (SELECT user_id, cast(ts AS date) AS day, count(*) AS n FROM df GROUP BY user_id, cast(ts AS date))
    SELECT user_id, day, n FROM daily a
    WHERE n > (SELECT avg(n) FROM daily b WHERE b.user_id = a.user_id)
    """,
    None,
)
sql(
    "sql_in_subquery",
    "events",
    """
    SELECT event_id, user_id FROM df
    WHERE user_id IN (SELECT DISTINCT user_id FROM df WHERE value > 200)
    """,
    None,
)
sql(
    "sql_exists",
    "events",
    """
    SELECT a.event_id, a.user_id FROM df a
    WHERE EXISTS (SELECT 1 FROM (SELECT DISTINCT user_id FROM df WHERE value > 180) b WHERE b.user_id = a.user_id)
    """,
    None,
)
sql(
    "sql_not_exists",
    "events",
    """
    SELECT a.event_id, a.user_id FROM df a
    WHERE NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT user_id FROM df WHERE value > 180) b WHERE b.user_id = a.user_id)
    """,
    None,
)
sql(
    "sql_cte",
    "lineitem",
    """
    WITH per_order AS (SELECT l_orderkey, sum(l_quantity) AS quantity, count(*) AS lines FROM df GROUP BY l_orderkey)
    SELECT lines, count(*) AS orders, max(quantity) AS most FROM per_order GROUP BY lines ORDER BY lines
    """,
    None,
)
# The range condition runs within one user and day: each hour joins the day it lies in,
# and an hour that reaches into the next day is there as well.
sql(
    "sql_self_range_join",
    "events",
    """
    WITH hourly AS (SELECT user_id, window.start AS hour, count(*) AS n FROM df GROUP BY user_id, window(ts, '1 hour')),
         reach AS (SELECT user_id, hour, n,
                          explode(array_distinct(array(to_date(hour), to_date(hour + INTERVAL 3 HOURS)))) AS day
                   FROM hourly)
    SELECT a.user_id, a.hour, a.n, CAST(coalesce(sum(b.n), 0) AS BIGINT) AS n_before
    FROM hourly a LEFT JOIN reach b
      ON a.user_id = b.user_id AND to_date(a.hour) = b.day
     AND b.hour >= a.hour - INTERVAL 3 HOURS AND b.hour < a.hour
    GROUP BY a.user_id, a.hour, a.n
    """,
    """
    WITH hourly AS (SELECT user_id, time_bucket(INTERVAL '1 hour', ts) AS hour, count(*) AS n FROM events GROUP BY ALL)
    SELECT a.user_id, a.hour, a.n, CAST(coalesce(sum(b.n), 0) AS BIGINT) AS n_before
    FROM hourly a LEFT JOIN hourly b
      ON a.user_id = b.user_id AND b.hour >= a.hour - INTERVAL 3 HOURS AND b.hour < a.hour
    GROUP BY a.user_id, a.hour, a.n
    """,
)

# ---- expressions -----------------------------------------------------------------------

sql(
    "sql_case_null",
    "customer",
    """
    SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal BETWEEN 0 AND 5000 THEN 'some' ELSE 'rich' END AS band,
           coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') AS segment,
           c_mktsegment IN ('MACHINERY', 'FURNITURE') AS goods, c_name LIKE '%7' AS seven,
           nullif(c_nationkey, 3) IS NULL AS third
    FROM df
    """,
    None,
)
sql(
    "sql_string_fns",
    "part",
    """
    SELECT p_partkey, upper(p_name) AS up, length(p_name) AS len, split_part(p_brand, '#', 2) AS brand,
           concat(p_type, '/', p_brand) AS label, replace(p_name, ' ', '_') AS snake,
           regexp_replace(p_brand, '[^0-9]', '') AS digits, lpad(p_type, 10, '.') AS padded,
           trim(concat('  ', p_name, ' ')) AS trimmed, reverse(p_type) AS backwards
    FROM df
    """,
    """
    SELECT p_partkey, upper(p_name) AS up, CAST(length(p_name) AS INTEGER) AS len, split_part(p_brand, '#', 2) AS brand,
           concat(p_type, '/', p_brand) AS label, replace(p_name, ' ', '_') AS snake,
           regexp_replace(p_brand, '[^0-9]', '', 'g') AS digits, lpad(p_type, 10, '.') AS padded,
           trim(concat('  ', p_name, ' ')) AS trimmed, reverse(p_type) AS backwards
    FROM part
    """,
)
sql(
    "sql_text_fns",
    "documents",
    r"""
    SELECT doc_id, length(text) AS n_chars, length(text) - length(replace(text, '\n', '')) AS breaks,
           size(split(text, ' ')) AS words, md5(text) AS digest, upper(lang) AS lang
    FROM df
    """,
    r"""
    SELECT doc_id, CAST(length(text) AS INTEGER) AS n_chars,
           CAST(length(text) - length(replace(text, chr(10), '')) AS INTEGER) AS breaks,
           CAST(len(string_split(text, ' ')) AS INTEGER) AS words, md5(text) AS digest, upper(lang) AS lang
    FROM documents
    """,
)
sql(
    "sql_date_fns",
    "orders",
    """
    SELECT o_orderkey, year(o_orderdate) AS y, quarter(o_orderdate) AS q, month(o_orderdate) AS m,
           day(o_orderdate) AS d, dayofyear(o_orderdate) AS doy, extract(HOUR FROM o_orderdate) AS h,
           cast(date_trunc('MONTH', o_orderdate) AS date) AS month_start, date_add(cast(o_orderdate AS date), 30) AS due,
           datediff(DATE'2002-01-01', cast(o_orderdate AS date)) AS age, date_format(o_orderdate, 'yyyy/MM/dd') AS text
    FROM df
    """,
    """
    SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(quarter(o_orderdate) AS INTEGER) AS q,
           CAST(month(o_orderdate) AS INTEGER) AS m, CAST(day(o_orderdate) AS INTEGER) AS d,
           CAST(dayofyear(o_orderdate) AS INTEGER) AS doy, CAST(extract(HOUR FROM o_orderdate) AS INTEGER) AS h,
           CAST(date_trunc('month', o_orderdate) AS DATE) AS month_start,
           CAST(CAST(o_orderdate AS DATE) + INTERVAL 30 DAY AS DATE) AS due,
           CAST(DATE '2002-01-01' - CAST(o_orderdate AS DATE) AS INTEGER) AS age,
           strftime(o_orderdate, '%Y/%m/%d') AS text
    FROM orders
    """,
)
sql(
    "sql_math_fns",
    "lineitem",
    """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_extendedprice, 1) AS r, floor(l_extendedprice) AS f, ceil(l_discount) AS c,
           abs(l_tax - l_discount) AS diff, round(sqrt(l_quantity), 6) AS root, round(ln(l_quantity), 6) AS log,
           pmod(l_partkey, 7) AS rest, round(power(l_quantity, 2), 2) AS square, greatest(l_tax, l_discount) AS top,
           sign(l_tax - l_discount) AS side
    FROM df
    """,
    """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_extendedprice, 1) AS r, CAST(floor(l_extendedprice) AS BIGINT) AS f,
           CAST(ceil(l_discount) AS BIGINT) AS c, abs(l_tax - l_discount) AS diff, round(sqrt(l_quantity), 6) AS root,
           round(ln(l_quantity), 6) AS log, l_partkey % 7 AS rest, round(power(l_quantity, 2), 2) AS square,
           greatest(l_tax, l_discount) AS top, CAST(sign(l_tax - l_discount) AS DOUBLE) AS side
    FROM lineitem
    """,
)
sql(
    "sql_array_fns",
    "embeddings",
    """
    SELECT vec_id, size(embedding) AS len, size(filter(embedding, x -> x > 0)) AS positive,
           array_contains(transform(embedding, x -> floor(x * 10)), 3) AS has_three,
           round(aggregate(embedding, 0D, (a, x) -> a + x * x), 4) AS norm2,
           array_max(embedding) AS top, array_position(embedding, array_max(embedding)) AS at_top
    FROM df
    """,
    """
    SELECT vec_id, CAST(len(embedding) AS INTEGER) AS len,
           CAST(len(list_filter(embedding, lambda x: x > 0)) AS INTEGER) AS positive,
           list_contains(list_transform(embedding, lambda x: floor(x * 10)), 3) AS has_three,
           round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))), 4) AS norm2,
           list_max(embedding) AS top, CAST(list_position(embedding, list_max(embedding)) AS BIGINT) AS at_top
    FROM embeddings
    """,
)
sql(
    "sql_explode",
    "embeddings",
    """
    SELECT label, place, count(*) AS n, max(x) AS top
    FROM df LATERAL VIEW posexplode(embedding) AS place, x GROUP BY label, place
    """,
    """
    SELECT label, place, count(*) AS n, max(x) AS top
    FROM (SELECT label, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS place, unnest(embedding) AS x FROM embeddings)
    GROUP BY ALL
    """,
)
sql(
    "sql_map_fns",
    "events",
    """
    SELECT event_id, array_join(map_keys(m), ',') AS names, element_at(m, 'k') AS k, size(m) AS entries,
           map_contains_key(m, 'missing') AS missing, aggregate(map_values(m), 0L, (a, x) -> a + x) AS total
    FROM (SELECT event_id, from_json(props, 'map<string,bigint>') AS m FROM df)
    """,
    """
    SELECT event_id, 'k' AS names, CAST(props->>'k' AS BIGINT) AS k, CAST(1 AS INTEGER) AS entries,
           false AS missing, CAST(props->>'k' AS BIGINT) AS total
    FROM events
    """,
)
sql(
    "sql_json_fns",
    "events",
    """
    SELECT event_id, CAST(get_json_object(props, '$.k') AS INT) AS k, from_json(props, 'k INT').k + 1 AS next_k,
           to_json(named_struct('id', event_id, 'type', event_type)) AS packed, json_object_keys(props)[0] AS name
    FROM df
    """,
    """
    SELECT event_id, CAST(props->>'k' AS INTEGER) AS k, CAST(props->>'k' AS INTEGER) + 1 AS next_k,
           concat('{"id":', event_id, ',"type":"', event_type, '"}') AS packed, json_keys(props)[1] AS name
    FROM events
    """,
)
sql(
    "sql_casts",
    "lineitem",
    """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS INT) AS quantity, CAST(l_orderkey AS STRING) AS key_text,
           CAST(l_shipdate AS DATE) AS day, try_cast(l_returnflag AS DATE) AS no_day,
           CAST(l_extendedprice AS DECIMAL(12, 2)) AS price, CAST(l_linestatus = 'O' AS INT) AS is_open
    FROM df
    """,
    """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS INT) AS quantity, CAST(l_orderkey AS VARCHAR) AS key_text,
           CAST(l_shipdate AS DATE) AS day, try_cast(l_returnflag AS DATE) AS no_day,
           CAST(l_extendedprice AS DECIMAL(12, 2)) AS price, CAST(l_linestatus = 'O' AS INT) AS is_open
    FROM lineitem
    """,
)
