"""A table cut along time into slices of about equal numbers of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidework.functions.names import col, find_field
from tidework.functions.values import as_instant

# A node of the tree below has at most 2**21 children, so that is the largest
# group any task ever sorts, however the times are spread.
_BITS = 21


def time_slices(df: DataFrame, n_rows: int, time: str = "time", name: str = "slice_id") -> DataFrame:
    """Add the number of the slice each row lies in: ``(rank by time - 1) div n_rows``.

    Rows with the same time share a slice, and no row is lost: rows without a
    time get NULL.
    """
    if n_rows < 1:
        raise ValueError("a slice has at least one row")
    before = rows_before(df, time).withColumnRenamed("tick", "__tick")
    slice_id = F.expr(f"`__before` div {n_rows}")
    return (
        df.withColumn("__tick", ticks_of(df, time))
        .join(before, "__tick", "left")
        .select(*[col(c) for c in df.columns], slice_id.alias(name))
    )


def rows_before(df: DataFrame, time: str = "time") -> DataFrame:
    """``tick, __before``: per distinct time the number of rows with an earlier one.

    A running sum over a tree of times. The leaves are the distinct times with
    their row counts; a node of each level up holds 2**21 neighbouring ticks of
    the level below. From the top down, every node's sum starts from the rows
    before the node, so no task sees all rows and none sees a frequent time
    more than once.
    """
    ticks = df.select(ticks_of(df, time).alias("tick")).where("tick IS NOT NULL")
    leaves = ticks.groupBy("tick").agg(F.count(F.lit(1)).alias("n"))
    # Counted from the rows once more: reading one column again costs less than all leaves.
    middle = ticks.groupBy(_parent("tick").alias("tick")).agg(F.count(F.lit(1)).alias("n"))
    # 64-bit ticks leave at most 2**22 nodes here, some 60,000 for all dates Spark knows.
    top = middle.groupBy(_parent("tick").alias("tick")).agg(F.sum("n").alias("n"))
    before = top.select("tick", _sum_before(Window.orderBy("tick")).alias("__before"))
    for level in (middle, leaves):
        # The rows before a node stand in front of its children as one more row without a tick.
        heads = before.select(F.col("tick").alias("node"), F.lit(None).cast("bigint").alias("tick"), "__before")
        nodes = level.select(_parent("tick").alias("node"), "tick", "n").union(heads)
        within = Window.partitionBy("node").orderBy(F.col("tick").asc_nulls_first())
        before = nodes.select("tick", _sum_before(within).alias("__before")).where("tick IS NOT NULL")
    return before


def _sum_before(window: WindowSpec) -> Column:
    return F.coalesce(F.sum("n").over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def _parent(tick: str) -> Column:
    return F.shiftright(tick, _BITS)


def ticks_of(df: DataFrame, time: str) -> Column:
    field = find_field(df, time)
    if isinstance(field.dataType, T.IntegralType):
        return col(field.name).cast("bigint")
    return F.unix_micros(as_instant(df, time))
