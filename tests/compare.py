"""Runs queries against DuckDB on the same files: ``python tests/compare.py [folder] [name ...]``."""

from __future__ import annotations

import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import __spark_entry__ as entry  # noqa: E402

FOLDER = "/root/testdata/sf0.01"


def database(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for path in sorted(Path(folder).glob("*.parquet")):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return connection


def _kind(arrow_type) -> str:
    return str(arrow_type).replace("large_", "")


def difference(spark, connection, folder: str, name: str) -> str | None:
    """What differs between the query and its SQL, or None."""
    got = entry.queries()[name](spark, folder).toArrow()
    want = connection.sql(entry.oracle_sql()[name]).to_arrow_table()
    columns = sorted(got.column_names)
    if columns != sorted(want.column_names):
        return f"columns {columns} instead of {sorted(want.column_names)}"
    kinds = {c: (_kind(got.schema.field(c).type), _kind(want.schema.field(c).type)) for c in columns}
    wrong = {c: pair for c, pair in kinds.items() if pair[0] != pair[1]}
    if wrong:
        return f"types (ours, SQL) {wrong}"
    mine = Counter(zip(*[got.column(c).to_pylist() for c in columns]))
    theirs = Counter(zip(*[want.column(c).to_pylist() for c in columns]))
    if mine != theirs:
        only_mine, only_theirs = list((mine - theirs))[:3], list((theirs - mine))[:3]
        return f"{got.num_rows} rows for {want.num_rows}; only ours {only_mine}; only SQL {only_theirs}"
    if not got.num_rows:
        return "no rows"
    return None


if __name__ == "__main__":
    from tidework import build_session

    folder = sys.argv[1] if len(sys.argv) > 1 else FOLDER
    spark = build_session("compare", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    connection = database(folder)
    bad = 0
    for name in sys.argv[2:] or entry.oracle_sql():
        start = time.time()
        try:
            problem = difference(spark, connection, folder, name)
        except Exception as error:  # every query is reported
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        bad += problem is not None
        print(f"{name:28s} {time.time() - start:6.2f}s {'ok' if problem is None else problem}", flush=True)
    print(f"{bad} differ")
