"""Frequent values of a join key, found in tables and carried through joins without running the joins again.

A table's key column is read into a sketch of a bounded number of values (`approx_top_k`), which cannot miss a value
with more rows than an even shuffle partition; the candidates are then counted exactly. For the result of a join the
lists of both sides are merged: a value is there as often as the product of its counts says.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidework.functions.names import col
from tidework.plans.inspect import has_unique, is_plain, is_repeatable

# The sketch misses no value with more than 7 / tracked of all rows; 16 times as many are tracked as can be frequent.
MOST_TRACKED = 1_000_000
MOST_PIECES = MOST_TRACKED // 16
LEAST = 256  # rows of a piece: where tables are small, no value is worth cutting
_SKETCHED = (
    T.BooleanType, T.IntegralType, T.FloatType, T.DoubleType, T.DecimalType, T.StringType, T.DateType,
    T.TimestampType, T.TimestampNTZType,
)


def partitions(df: DataFrame) -> int:
    return min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), MOST_PIECES)


def frequent_keys(keys: DataFrame) -> DataFrame:
    """``__key, __count, __rows``: the values of a column ``__key`` that have more rows than an even shuffle partition,
    and than the least piece.

    With n partitions these are less than n values. Which ones they are does not depend on the sketch, which only
    has to hold them among its candidates, so the frame is the same whenever it is read.
    """
    most = partitions(keys)
    if isinstance(keys.schema["__key"].dataType, _SKETCHED):
        sketch = keys.agg(
            F.expr(f"approx_top_k(__key, {min(2 * most, 100_000)}, {16 * most})").alias("top"),
            F.count(F.lit(1)).alias("__rows"),
        )
        found = sketch.select("__rows", F.explode("top").alias("top")).where(F.col("top.count") * most > F.col("__rows"))
        # Numbers that are equal but written differently, as both zeros, are one value.
        candidates = found.groupBy(F.col("top.item").alias("__key")).agg(F.max("__rows").alias("__rows"))
        counted = keys.join(F.broadcast(candidates), "__key")
    else:
        counted = keys.join(F.broadcast(keys.agg(F.count(F.lit(1)).alias("__rows"))))
    counts = counted.groupBy("__key").agg(F.count(F.lit(1)).alias("__count"), F.max("__rows").alias("__rows"))
    return counts.where((F.col("__count") * most > F.col("__rows")) & (F.col("__count") > LEAST))


# The attribute of a join's result that holds its sides.
SIDES = "_tidework_sides"


def pieces_of(count: Column, rows: Column, most: int) -> Column:
    """Into how many pieces a value's rows are cut: as many as they would fill even partitions."""
    return F.least(F.ceil(count * F.lit(most) / rows), F.ceil(count / LEAST)).cast("int")


class KeyCounts:
    """How often values are in a column of a table, or of a frame that costs no more to read than one."""

    def __init__(self, df: DataFrame, name: str) -> None:
        self._frame = df.select(col(name).alias("__key")).where("__key IS NOT NULL")
        self._unique = has_unique(df, name)
        self._known: dict = {}

    def table(self, rows: list[tuple], *more: str) -> DataFrame:
        """Values of the column, and numbers, as a frame."""
        fields = [self._frame.schema["__key"], *[T.StructField(name, T.IntegerType()) for name in more]]
        return self._frame.sparkSession.createDataFrame(rows, T.StructType(fields))

    @cached_property
    def frequent(self) -> dict:
        """The frequent values and their numbers of rows: less of them than there are shuffle partitions."""
        if self._unique:
            return {}
        return {row["__key"]: row["__count"] for row in frequent_keys(self._frame).collect()}

    @cached_property
    def rows(self) -> int:
        return self._frame.count()

    def counts(self, values: Iterable) -> dict:
        """The numbers of rows of a bounded number of values."""
        self._known |= self.frequent
        if unknown := [v for v in values if v not in self._known]:
            wanted = F.broadcast(self.table([(v,) for v in unknown]))
            found = self._frame.join(wanted, "__key").groupBy("__key").count().collect()
            self._known |= dict.fromkeys(unknown, 0) | {row["__key"]: row["count"] for row in found}
        return {v: self._known[v] for v in values}

    def pieces(self) -> DataFrame | None:
        """``__key, __pieces``: into how many pieces a value's rows are cut; None if no value can be frequent."""
        if self._unique:
            return None
        pieces = pieces_of(F.col("__count"), F.col("__rows"), partitions(self._frame))
        return frequent_keys(self._frame).select("__key", pieces.alias("__pieces"))


class JoinedCounts(KeyCounts):
    """The same for the key column of a join that keeps all rows of its side.

    Counts of the side are exact; of the other side its frequent values count as often as they are there, others once.
    """

    def __init__(self, mine: KeyCounts, theirs: KeyCounts) -> None:
        self._mine = mine
        self._theirs = theirs

    def table(self, rows: list[tuple], *more: str) -> DataFrame:
        return self._mine.table(rows, *more)

    @cached_property
    def frequent(self) -> dict:
        counts = self.counts({**self._mine.frequent, **self._theirs.frequent})
        return {v: n for v, n in counts.items() if n}

    @cached_property
    def rows(self) -> int:
        before = self._mine.counts(self.frequent)
        return self._mine.rows + sum(n - before[v] for v, n in self.frequent.items())

    def counts(self, values: Iterable) -> dict:
        return {v: n * self._theirs.frequent.get(v, 1) for v, n in self._mine.counts(values).items()}

    def pieces(self) -> DataFrame | None:
        if not self.frequent:
            return None
        most = partitions(self.table([]))
        cut = [
            (v, min(-(-n * most // self.rows), -(-n // LEAST)))
            for v, n in self.frequent.items()
            if n * most > self.rows and n > LEAST
        ]
        return self.table(cut, "__pieces") if cut else None


@dataclass
class Sides:
    """The sides of a join, for the counts of its result's columns; ``names`` are the right ones' in the result."""

    left: DataFrame
    right: DataFrame
    left_key: str
    right_key: str
    keeps_left: bool
    keeps_right: bool
    names: dict[str, str]
    filled: bool
    found: dict[str, KeyCounts | None] = field(default_factory=dict)

    def counts(self, name: str) -> KeyCounts | None:
        """Of columns of a side that keeps its rows. A column that is not the key counts as if each row had one partner
        at most: its values are there, if not less often than that."""
        if name not in self.found:
            self.found[name] = self._counts(name)
        return self.found[name]

    def _counts(self, name: str) -> KeyCounts | None:
        left, right = (self.left, self.left_key, self.keeps_left), (self.right, self.right_key, self.keeps_right)
        old = {new: old for old, new in self.names.items()}.get(name)
        (mine, key, keeps), (other, other_key, _) = (left, right) if old is None else (right, left)
        name = name if old is None else old
        if not keeps or (self.filled and isinstance(mine.schema[name].dataType, T.StringType)):
            return None
        counts = column_counts(mine, name)
        if counts is None or name != key:
            return counts
        theirs = column_counts(other, other_key)
        return theirs and JoinedCounts(counts, theirs)


def column_counts(df: DataFrame, name: str) -> KeyCounts | None:
    """Counts that need no step above a table to run again; None if there are none."""
    sides = df.__dict__.get(SIDES)
    if not isinstance(df.schema[name].dataType, _SKETCHED):
        return None
    if sides is not None:
        return sides.counts(name)
    return KeyCounts(df, name) if is_repeatable(df) and (is_plain(df) or has_unique(df, name)) else None
