"""Numbers, sums, previous rows and sessions along time, also where a key has more rows than a task should see.

A window's rows all go through one task. Here the rows of a frequent key are first cut into ranges of the order, about
as many as they would fill partitions; each range is a window of its own. What a range hands on to the next ones (how
many rows, their sum, the last row, how many sessions began) is one row, and these carries are summed up for all
ranges of a key.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from copy import copy
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidework.functions.names import col, find_field
from tidework.functions.ordering import row_hash
from tidework.functions.values import as_instant
from tidework.operators import frequent
from tidework.operators.frequent import frequent_keys, partitions
from tidework.plans.inspect import is_repeatable

SAMPLED = 32  # rows of the sample for each range of a frequent key


@dataclass(frozen=True)
class Running:
    """A column along the order of each key.

    ``inside``: its value within a range, from the window of the rows and the window of the rows up to each.
    ``carry``: what a range hands on, an aggregate of its rows; it is given the name of that value. ``before``: the
    carries of all earlier ranges as one, from the name of the carry and the window of earlier ranges. ``joined``: the
    value and the carry as one; also given is whether a row is the first of a later range.
    """

    inside: Callable[[WindowSpec, WindowSpec], Column]
    carry: Callable[[str], Column]
    before: Callable[[str, WindowSpec], Column]
    joined: Callable[[Column, Column, Column], Column]


def _both(merge: Callable[[Column, Column], Column]) -> Callable[[Column, Column, Column], Column]:
    """Two values as one, where either may be NULL."""
    return lambda value, carry, first: F.coalesce(merge(value, carry), value, carry)


def row_numbers() -> Running:
    """1, 2, 3 and so on."""
    return Running(
        lambda rows, _: F.row_number().over(rows).cast("long"),
        lambda name: F.max(name),
        lambda carry, earlier: F.sum(carry).over(earlier),
        lambda value, carry, _: value + F.coalesce(carry, F.lit(0)),
    )


def sums(column: str) -> Running:
    """The sum up to each row; NULL until there is a value."""
    return Running(
        lambda _, until: F.sum(col(column)).over(until),
        lambda _: F.sum(col(column)),
        lambda carry, earlier: F.sum(carry).over(earlier),
        _both(lambda a, b: a + b),
    )


def smallest(column: str) -> Running:
    return Running(
        lambda _, until: F.min(col(column)).over(until),
        lambda _: F.min(col(column)),
        lambda carry, earlier: F.min(carry).over(earlier),
        _both(F.least),
    )


def largest(column: str) -> Running:
    return Running(
        lambda _, until: F.max(col(column)).over(until),
        lambda _: F.max(col(column)),
        lambda carry, earlier: F.max(carry).over(earlier),
        _both(F.greatest),
    )


def previous(column: str) -> Running:
    """The value of the row before; NULL for the first one."""
    return Running(
        lambda rows, _: F.lag(col(column)).over(rows),
        lambda _: F.max_by(F.struct(col(column).alias("value")), F.col("__at")),
        lambda carry, earlier: F.max_by(carry, "__range").over(earlier),
        lambda value, carry, first: F.when(first, carry["value"]).otherwise(value),
    )


def last_value(column: str) -> Running:
    """The last value up to each row that is not NULL."""
    return Running(
        lambda _, until: F.last(col(column), ignorenulls=True).over(until),
        lambda _: F.max_by(col(column), F.when(col(column).isNotNull(), F.col("__at"))),
        lambda carry, earlier: F.max_by(carry, F.when(F.col(carry).isNotNull(), F.col("__range"))).over(earlier),
        lambda value, carry, _: F.coalesce(value, carry),
    )


def running(
    df: DataFrame, by: str | Sequence[str], order: str | Sequence[str], columns: dict[str, Running]
) -> DataFrame:
    """``df`` and the columns, worked out along ``order`` for the rows of each key ``by``.

    NULL keys are one key; NULLs come first in the order. Rows that are equal in the order are taken by a hash of all
    their cells, so every run gives the same rows; only rows that are equal altogether always stay in one range.
    Which keys are frequent and where their ranges begin is found out when the step is written down, by a few small
    jobs that return less than a hundred rows for each shuffle partition. All rows are then shuffled once.
    """
    ranges = _Ranges(df, by, order)
    return ranges.along(columns).rows.select(*[col(c) for c in df.columns], *columns)


def sessions(
    df: DataFrame, by: str | Sequence[str], time: str, gap_seconds: float, name: str = "session"
) -> DataFrame:
    """``df`` and the number of each row's session, from 1: a session goes on while the key's next row comes at most
    ``gap_seconds`` after its last one. Rows without a time are in none, NULL. As :func:`running` otherwise."""
    timed = _Ranges(df.where(col(time).isNotNull()), by, time).along({"__last": previous(time)})
    gap = F.unix_micros(as_instant(timed.rows, time)) - F.unix_micros(as_instant(timed.rows, "__last"))
    begins = F.coalesce(gap > gap_seconds * 1e6, F.lit(True)).cast("long")
    numbered = timed.with_column("__begins", begins).along({name: sums("__begins")}).rows
    numbered = numbered.select(*[col(c) for c in df.columns], name)
    return numbered.unionByName(df.where(col(time).isNull()).withColumn(name, F.lit(None).cast("long")))


class _Ranges:
    """Rows with the range of their key that they lie in, and the frequent keys' rows once more for their carries."""

    def __init__(self, df: DataFrame, by: str | Sequence[str], order: str | Sequence[str]) -> None:
        if not is_repeatable(df):
            raise ValueError("the rows are read several times and must be the same each time: write them down first")
        by, order = ([names] if isinstance(names, str) else list(names) for names in (by, order))
        self.by, order = ([find_field(df, name).name for name in names] for names in (by, order))
        at = F.struct(*[col(name) for name in order], row_hash(df).alias("__tie"))
        rows = df.withColumns({"__key": F.xxhash64(*[col(name) for name in self.by]), "__at": at})
        limits = _limits(rows)
        if limits is None:
            self.rows, self.hot = rows.withColumn("__range", F.lit(0)), None
        else:
            joined = rows.join(F.broadcast(limits), "__key", "left")
            self.rows = joined.withColumn("__range", place_in(F.col("__limits"), F.col("__at"))).drop("__limits")
            self.hot = self.rows.join(F.broadcast(limits.select("__key")), "__key", "left_semi")

    def _changed(self, change: Callable[[DataFrame], DataFrame]) -> _Ranges:
        changed = copy(self)
        changed.rows, changed.hot = change(self.rows), None if self.hot is None else change(self.hot)
        return changed

    def with_column(self, name: str, value: Column) -> _Ranges:
        return self._changed(lambda rows: rows.withColumn(name, value))

    def along(self, columns: dict[str, Running]) -> _Ranges:
        keys = [col(name) for name in self.by]
        within = Window.partitionBy(*keys, "__range").orderBy("__at")
        until = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        found = {f"__in_{name}": one.inside(within, until) for name, one in columns.items()}
        inside = self._changed(lambda rows: rows.withColumns({"__nth": F.row_number().over(within)} | found))
        if inside.hot is None:
            done = {name: F.col(f"__in_{name}") for name in columns}
            return inside._changed(lambda rows: rows.withColumns(done).drop("__nth", *found))

        # Frequent keys have less ranges together than twice the number of shuffle partitions, and so less carries.
        carries = {name: one.carry(f"__in_{name}").alias(name) for name, one in columns.items()}
        handed = inside.hot.groupBy(*keys, "__range").agg(*carries.values())
        earlier = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
        befores = handed.select(
            F.struct(*keys, "__range").alias("__where"),
            *[one.before(name, earlier).alias(f"__before_{name}") for name, one in columns.items()],
        )
        first = (F.col("__nth") == 1) & (F.col("__range") > 0)
        done = {
            name: one.joined(F.col(f"__in_{name}"), F.col(f"__before_{name}"), first) for name, one in columns.items()
        }

        def completed(rows: DataFrame) -> DataFrame:
            meets = F.struct(*keys, "__range").eqNullSafe(F.col("__where"))
            joined = rows.join(F.broadcast(befores), meets, "left").withColumns(done)
            return joined.drop("__nth", "__where", *found, *[f"__before_{name}" for name in columns])

        return inside._changed(completed)


def _limits(rows: DataFrame) -> DataFrame | None:
    """``__key, __limits``: where the ranges of each frequent key begin, from a sample of its rows; None without any."""
    hot = frequent_keys(rows.select("__key")).collect()
    most = partitions(rows)
    if not hot:
        return None
    spark = rows.sparkSession
    pieces = {r["__key"]: min(-(-r["__count"] * most // r["__rows"]), -(-r["__count"] // frequent.LEAST)) for r in hot}
    shares = [(r["__key"], min(1.0, SAMPLED * pieces[r["__key"]] / r["__count"])) for r in hot]
    share = spark.createDataFrame(shares, "__key long, __share double")
    sample = rows.join(F.broadcast(share), "__key").where(F.rand(7) < F.col("__share")).select("__key", "__at")
    found: dict[int, list] = {}
    for key, at in sample.collect():
        found.setdefault(key, []).append(at)
    limits = []
    for key, places in found.items():
        places.sort(key=lambda at: [(v is not None, v) for v in at])
        step = max(1, len(places) // pieces[key])
        limits.append((key, places[step::step]))
    kind = T.StructType([T.StructField("__key", T.LongType()), T.StructField("__limits", T.ArrayType(rows.schema["__at"].dataType))])
    # Sorted as Spark does, which is what the rows are compared by.
    return spark.createDataFrame(limits, kind).withColumn("__limits", F.array_sort("__limits"))


def place_in(limits: Column, at: Column) -> Column:
    """How many of the sorted limits are at or before a place, by halving the list; 0 without limits."""
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(limits) + 1)).cast("int"))
    start = F.struct(F.lit(0).alias("low"), F.size(limits).alias("high"))

    def halve(state: Column, _: Column) -> Column:
        middle = F.floor((state.low + state.high) / 2).cast("int")
        before = F.get(limits, middle) <= at
        return (
            F.when(state.low >= state.high, state)
            .when(before, F.struct((middle + 1).alias("low"), state.high.alias("high")))
            .otherwise(F.struct(state.low.alias("low"), middle.alias("high")))
        )

    return F.when(limits.isNull(), 0).otherwise(F.reduce(steps, start, halve, lambda state: state.low))
