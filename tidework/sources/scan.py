"""Scans of a closed time range, over one table or many."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidework.functions.ordering import in_order
from tidework.functions.unions import union_all
from tidework.sources.catalog import Catalog, scan_range


def scan_ordered(df: DataFrame, start: str, end: str, time: str = "time") -> DataFrame:
    """`scan_range` in time order."""
    return in_order(scan_range(df, start, end, time), time)


def scan_many(
    catalog: Catalog, tables: Sequence[str], start: str, end: str, drop_empty: bool = False
) -> dict[str, DataFrame]:
    """One lazy range scan per table, in the order given.

    ``drop_empty`` leaves tables without rows in the range out. One job looks for
    a first row of every table; it reads each split up to its first row in the
    range, and returns a name for each table at most.
    """
    frames = {name: catalog.scan(name, start, end) for name in tables}
    if drop_empty and frames:
        firsts = [df.limit(1).select(F.lit(name).alias("name")) for name, df in frames.items()]
        there = {row["name"] for row in union_all(firsts).collect()}
        frames = {name: df for name, df in frames.items() if name in there}
    return frames


def presence(catalog: Catalog, tables: Sequence[str], start: str, end: str) -> DataFrame:
    """``table_name, position, n_rows, has_data`` per table, in one job."""
    frames = [catalog.scan(name, start, end) for name in tables]
    return _count(catalog, tables, frames).withColumn("has_data", F.col("n_rows") > 0)


def shape(df: DataFrame) -> DataFrame:
    """One row: ``n_rows, n_columns``."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)))


def shapes(catalog: Catalog, tables: Sequence[str]) -> DataFrame:
    """``table_name, position, n_rows, n_columns`` per table, in one job."""
    frames = [catalog.table(name) for name in tables]
    widths = F.array(*[F.lit(len(df.columns)) for df in frames])
    return _count(catalog, tables, frames).withColumn("n_columns", F.get(widths, F.col("position")))


def _count(catalog: Catalog, tables: Sequence[str], frames: Sequence[DataFrame]) -> DataFrame:
    """Rows per frame by one aggregate over all; a marker worth nothing keeps the empty ones."""
    markers = [(name, position, 0) for position, name in enumerate(tables)]
    parts = [catalog.spark.createDataFrame(markers, "table_name string, position int, one bigint")]
    for (name, position, _), df in zip(markers, frames):
        parts.append(df.select(F.lit(name), F.lit(position), F.lit(1).cast("bigint")))
    return union_all(parts).groupBy("table_name", "position").agg(F.sum("one").alias("n_rows"))
