"""Rows whose intervals overlap, joined on no column but the intervals: each pair, or what a row's partners add up to."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidework.functions.names import col, find_field
from tidework.operators.joins import joined_names
from tidework.operators.running import largest, running, smallest, sums
from tidework.operators.slices import ticks_of


def overlap_join(
    left: DataFrame,
    right: DataFrame,
    left_interval: tuple[str, str],
    right_interval: tuple[str, str],
    suffix: str = "_right",
) -> DataFrame:
    """Pairs of rows with ``left start <= right end`` and ``right start <= left end``; both ends belong to an interval.

    Starts and ends are times or whole numbers; one column given twice makes points. Rows with a NULL bound, or that
    end before they start, meet nobody. Columns of the right side get `suffix` until their names are unique.

    The line is cut into bins at 64 scales, from one tick on, each twice the one before. An interval belongs to the
    first scale at which it touches two bins at most. A pair meets at the larger scale of the two, in the first bin
    that both touch, so it is found once, by an equality; an interval is copied to two bins at most of each scale that
    is longer and in use on the other side. Which are in use is asked when the join is written down: two small jobs,
    which return 64 numbers at most. A bin with very many rows is split by adaptive execution.

    The pairs themselves grow with the square of how densely the rows lie; to count or compare a row's partners, see
    :func:`overlap_parts`, which makes none of them.
    """
    names = joined_names(left.columns, right.columns, "", suffix)
    mine = _with_scale(left, left_interval)
    theirs = _with_scale(right.select("*"), right_interval)
    theirs = theirs.select(*[col(old).alias(new) for old, new in names.items()], "__start", "__end", "__scale")
    used = [sorted(r[0] for r in side.select("__scale").distinct().collect()) for side in (mine, theirs)]
    mine, theirs = _copied(mine, used[1], "l"), _copied(theirs, used[0], "r")
    start = F.greatest("__start_l", "__start_r")
    pairs = mine.join(
        theirs,
        (F.col("__at_l") == F.col("__at_r"))
        & (F.col("__bin_l") == F.col("__bin_r"))
        & (F.col("__at_l") == F.greatest("__scale_l", "__scale_r"))
        & (start <= F.least("__end_l", "__end_r"))
        & (F.col("__bin_l") == _bin(start, F.col("__at_l"))),
    )
    return pairs.select(*[col(name) for name in (*left.columns, *names.values())])


def overlap_parts(
    left: DataFrame,
    right: DataFrame,
    left_interval: tuple[str, str],
    right_interval: tuple[str, str],
    keep: Sequence[str],
    by: Sequence[str] = (),
    least: dict[str, str] | None = None,
    greatest: dict[str, str] | None = None,
    suffix: str = "_right",
) -> DataFrame:
    """The pairs of :func:`overlap_join` in parts: for each left row a few rows that share out its partners.

    A row has the columns `keep` of the left one and `by` of its partners, the latter with `suffix` until unique, ``n``,
    how many partners the part holds, and under the names in `least` and `greatest` the smallest and largest value of a
    right column among them. Each partner is in one part, so sums, minima and maxima over parts are those over pairs.
    A left row without partners has no parts.

    A partner either starts within the left interval, or before it and contains its start. An interval takes scale j
    if it is 2^j to 2^(j+1) ticks long, and so is the end of one bin of 2^j ticks, at most one whole bin, and the
    beginning of another. Starts that lie in such an end or beginning are running totals backward or forward along the
    bin; right intervals that contain a place are the same with the sides exchanged. So a row is copied four times for
    each scale in use on the other side at most, and a left one once for each value of `by` in the bin; the work grows
    with the rows, not with the pairs. Bins with very many rows are cut into ranges by :func:`running`, for which the
    rows must be the same each time they are read.
    """
    keep, by = ([find_field(df, name).name for name in names] for df, names in ((left, keep), (right, by)))
    totals = [(new, find_field(right, old).name, smallest) for new, old in (least or {}).items()]
    totals += [(new, find_field(right, old).name, largest) for new, old in (greatest or {}).items()]
    names = joined_names([*keep, "n", *[new for new, _, _ in totals]], by, "", suffix)
    mine, theirs = _with_bins(left, left_interval), _with_bins(right, right_interval)
    left_scales = sorted(r[0] for r in mine.select("__scale").distinct().collect())
    right_scales = sorted(r[0] for r in theirs.where("__start < __end").select("__scale").distinct().collect())

    start, end, scale, first, last = (F.col(f"__{name}") for name in ("start", "end", "scale", "first", "last"))
    middle = F.when(last - first == 2, first + 1)
    opening = F.call_function("shiftleft", middle, scale)
    back = F.bitwise_not
    # Places are sorted by tick; of those at one tick, a row of flag 1 counts those of flag 0 and not those of flag 2.
    marks = [_place(F.lit(s), lane, _bin(start, F.lit(s)), tick, 0) for s in left_scales for lane, tick in ((0, back(start)), (1, start))]
    longer = [
        _place(scale, 2, first, start, 2),
        F.when(middle.isNotNull(), _place(scale, 2, middle, opening, 0)),
        _place(scale, 3, last, back(end), 0),
    ]
    marks += [F.when(start < end, place) for place in longer]
    asked = [
        _place(scale, 0, first, back(start), 1),
        F.when(middle.isNotNull(), _place(scale, 0, middle, back(opening), 1)),
        F.when(first < last, _place(scale, 1, last, end, 1)),
    ]
    asked += [_place(F.lit(s), lane, _bin(start, F.lit(s)), tick, 1) for s in right_scales for lane, tick in ((2, start), (3, back(start)))]

    values = [col(old).alias(f"__value_{i}") for i, (_, old, _) in enumerate(totals)]
    group = [F.struct(*[col(name) for name in by]).alias("__by")] if by else []
    marks = _placed(theirs, marks, F.lit(1).cast("long").alias("__one"), *values, *group)
    asked = _placed(mine, asked, F.struct(*[col(name) for name in keep]).alias("__kept"))
    window = ["__lane", "__bin", *(["__by"] if by else [])]
    if by:
        asked = asked.join(marks.select(*window).distinct(), ["__lane", "__bin"])
    columns = {"__n": sums("__one")} | {f"__found_{i}": kind(f"__value_{i}") for i, (_, _, kind) in enumerate(totals)}
    found = running(marks.unionByName(asked, allowMissingColumns=True), window, ["__tick", "__flag"], columns)
    return found.where("__kept IS NOT NULL AND __n > 0").select(
        *[F.col("__kept")[name].alias(name) for name in keep],
        *[F.col("__by")[old].alias(new) for old, new in names.items()],
        F.col("__n").alias("n"),
        *[F.col(f"__found_{i}").alias(new) for i, (new, _, _) in enumerate(totals)],
    )


def _with_bins(df: DataFrame, interval: tuple[str, str]) -> DataFrame:
    """Rows with the scale at which their interval touches two or three bins, or is one, and the first and last bin."""
    rows = _with_scale(df, interval)
    scale = F.when(F.expr("try_subtract(__end, __start)").isNull(), 63).otherwise(F.col("__scale") - 1).cast("int")
    rows = rows.withColumn("__scale", scale)
    return rows.withColumns({"__first": _bin(F.col("__start"), F.col("__scale")), "__last": _bin(F.col("__end"), F.col("__scale"))})


def _place(scale: Column, lane: int, bin: Column, tick: Column, flag: int) -> Column:
    return F.struct((scale * 4 + lane).cast("int").alias("__lane"), bin.alias("__bin"), tick.alias("__tick"), F.lit(flag).alias("__flag"))


def _placed(df: DataFrame, places: list[Column], *more: Column) -> DataFrame:
    """A row for each of its places that is not NULL."""
    copies = df.select(F.explode(F.array_compact(F.array(*places))).alias("__place"), *more)
    names = [c for c in copies.columns if c != "__place"]
    return copies.select("__place.*", *names)


def _with_scale(df: DataFrame, interval: tuple[str, str]) -> DataFrame:
    start, end = (ticks_of(df, find_field(df, name).name) for name in interval)
    rows = df.withColumns({"__start": start, "__end": end}).where("__start <= __end")
    # A length that 64 bits don't hold belongs to the last scale.
    length = F.expr("try_subtract(__end, __start)")
    return rows.withColumn("__scale", F.when(length.isNull(), 63).otherwise(F.length(F.bin(length))).cast("int"))


def _bin(tick: Column, scale: Column) -> Column:
    return F.call_function("shiftright", tick, scale)


def _copied(df: DataFrame, others: list[int], side: str) -> DataFrame:
    """A row for each bin at its own scale and the longer ones that the other side uses."""
    scale = F.col("__scale")
    longer = F.filter(F.array(*[F.lit(s) for s in others]).cast("array<int>"), lambda s: s > scale)
    bins = F.flatten(
        F.transform(
            F.concat(F.array(scale), longer),
            lambda s: F.transform(
                F.sequence(_bin(F.col("__start"), s), _bin(F.col("__end"), s)),
                lambda bin: F.struct(s.alias("at"), bin.alias("bin")),
            ),
        )
    )
    names = [c for c in df.columns if c not in ("__start", "__end", "__scale")]
    copies = df.withColumn("__copy", F.explode(bins))
    return copies.select(
        *[col(c) for c in names],
        *[F.col(f"__{c}").alias(f"__{c}_{side}") for c in ("start", "end", "scale")],
        F.col("__copy.at").alias(f"__at_{side}"),
        F.col("__copy.bin").alias(f"__bin_{side}"),
    )
