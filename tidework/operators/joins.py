"""Two steps joined on one column pair."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidework.functions.names import col, find_field, quote
from tidework.functions.ordering import in_order, row_hash
from tidework.operators.frequent import SIDES, KeyCounts, Sides, column_counts
from tidework.session import work_path

# The join names a form offers. "Cross Join" comes with a key pair
# like all others and so gives the rows of an inner join; it runs as one.
JOIN_NAMES = {
    "Left Join": "left",
    "Right Join": "right",
    "Inner Join": "inner",
    "Outer Join": "outer",
    "Cross Join": "inner",
    "cross": "inner",
}
_LEFT = {"left", "leftouter"}
_RIGHT = {"right", "rightouter"}
_FULL = {"outer", "full", "fullouter"}
_ONE_SIDED = {"semi", "leftsemi", "anti", "leftanti"}
NULL_PIECES = 1 << 20


def join_on(
    left: DataFrame,
    right: DataFrame,
    left_on: str,
    right_on: str,
    how: str = "left",
    *,
    fill_strings: str | None = "NaN",
    sort: bool = True,
    time: str = "time",
    suffix: str = "_right",
    salt: bool = True,
) -> DataFrame:
    """Join on ``left_on = right_on``; NULL keys never match.

    * Right columns but the key get `suffix`; it is added again until a name is
      unique. The key gets it only if the left side has that name too.
    * NULLs in text columns become `fill_strings`; other types keep them.
    * The result is sorted by `time` if it has such a column.

    * Keys of a number, time or boolean and of text are compared as the former;
      text that is none meets nobody.

    Adaptive execution splits frequent keys of both sides of an inner join, but
    only of the kept side of an outer join and of no side of a full one. The
    frequent keys of the other sides are salted, by one plan for inputs of any
    size. Where such a side is a table, or chooses columns and rows of one, its
    frequent keys are found in the same lazy plan. Where it is the result of
    joins here, they are worked out from the key columns of the joined tables by
    a few small jobs. Any other side, and one that may differ when read again,
    as after a LIMIT or a sample, is written to the work folder once. Streams
    aren't salted, and ``salt=False`` leaves it out.
    """
    how = JOIN_NAMES.get(how, how)
    kind = how.lower().replace("_", "")
    left_key = find_field(left, left_on).name
    right_key = find_field(right, right_on).name
    columns = left.columns
    sides = None
    if kind in _ONE_SIDED:
        # Only the set of right keys counts, so a frequent one is reduced to one row first.
        left, mine, right, theirs = _alike(left, left_key, right, right_key)
        keys = right.select(col(theirs).alias("__key")).distinct()
        joined = left.join(keys, left[quote(mine)] == keys["__key"], how).select(*[col(c) for c in columns])
    else:
        names = joined_names(columns, right.columns, right_key, suffix)
        keep_left, keep_right = kind in _LEFT | _FULL, kind in _RIGHT | _FULL
        left, mine, right, theirs = _alike(left, left_key, right, right_key)
        cut_left = cut_right = None
        if salt and (keep_left or keep_right) and not (left.isStreaming or right.isStreaming):
            left, cut_left = _counted(left, mine) if keep_right else (left, None)
            right, cut_right = _counted(right, theirs) if keep_left else (right, None)
            sides = Sides(left, right, mine, theirs, keep_left, keep_right, names, fill_strings is not None)
        renamed = right.select(*[col(c).alias(names.get(c, c)) for c in right.columns])
        joined = _salted_join(left, renamed, mine, names.get(theirs, theirs), how, cut_left, cut_right)
        joined = joined.select(*[col(c) for c in (*columns, *names.values())])

    if fill_strings is not None:
        joined = joined.na.fill(fill_strings)
    if sort and time in joined.columns:
        joined = in_order(joined, time)
    if sides is not None:
        setattr(joined, SIDES, sides)
    return joined


def joined_names(left: list[str], right: list[str], right_key: str, suffix: str = "_right") -> dict[str, str]:
    """The right side's columns under the names they get in the result."""
    taken = {name.lower() for name in left}
    names = {}
    for old in right:
        new = old if old == right_key else old + suffix
        while new.lower() in taken:
            new += suffix
        taken.add(new.lower())
        names[old] = new
    return names


def _alike(left: DataFrame, left_key: str, right: DataFrame, right_key: str) -> tuple[DataFrame, str, DataFrame, str]:
    """Both sides and the columns to compare; text that meets another type gets a column of that type."""
    kinds = [find_field(df, key).dataType for df, key in ((left, left_key), (right, right_key))]
    found = []
    for df, key, mine, other, name in (
        (left, left_key, *kinds, "__left_key"),
        (right, right_key, *reversed(kinds), "__right_key"),
    ):
        plain = isinstance(other, (T.NumericType, T.BooleanType, T.TimestampType, T.TimestampNTZType, T.DateType))
        if isinstance(mine, T.StringType) and plain:
            df, key = df.withColumn(name, col(key).try_cast(other)), name
        found += [df, key]
    return tuple(found)


def _counted(df: DataFrame, key: str) -> tuple[DataFrame, KeyCounts]:
    """A side and the counts of its key; a side that can't be counted but by running its steps is written down first."""
    counts = column_counts(df, key)
    if counts is None:
        path = work_path(df.sparkSession, "side")
        df.write.parquet(path)
        df = df.sparkSession.read.schema(df.schema).parquet(path)
        counts = KeyCounts(df, key)
    return df, counts


def _salted_join(
    left: DataFrame,
    right: DataFrame,
    left_key: str,
    right_key: str,
    how: str,
    cut_left: KeyCounts | None,
    cut_right: KeyCounts | None,
) -> DataFrame:
    """An outer join whose frequent keys are cut into pieces.

    The rows of a frequent key get the number of their piece; the other side's
    rows of that key are copied to every piece, so that each pair meets in just
    one. A copy may find its piece empty, but never all pieces, as the key is
    frequent there: a copied row without a partner is therefore dropped, and a
    row that was not copied is kept as in any outer join.
    """
    hot_left, hot_right = (counts and counts.pieces() for counts in (cut_left, cut_right))
    # Only a full join keeps NULL keys of a side that adaptive execution does not split.
    both = cut_left is not None and cut_right is not None
    if hot_left is None and hot_right is None and not both:
        return left.join(right, left[quote(left_key)] == right[quote(right_key)], how)
    left = _cut_and_copy(left, left_key, hot_left, hot_right, "__left", "__right", both)
    right = _cut_and_copy(right, right_key, hot_right, hot_left, "__right", "__left", both)
    meets = left[quote(left_key)] == right[quote(right_key)]
    joined = left.join(right, meets & (left["__left"] == right["__left"]) & (left["__right"] == right["__right"]), how)
    if cut_right is not None:
        joined = joined.where(right["__right"].isNotNull() | (left["__right_copies"] == 1))
    if cut_left is not None:
        joined = joined.where(left["__left"].isNotNull() | (right["__left_copies"] == 1))
    return joined


def _cut_and_copy(
    df: DataFrame,
    key: str,
    own: DataFrame | None,
    other: DataFrame | None,
    piece: str,
    copy: str,
    spread_nulls: bool,
) -> DataFrame:
    """Add the piece a row belongs to by its side's frequent values, and copy it to the pieces of the other's."""
    columns = [col(c) for c in df.columns]
    own_pieces, copies = F.lit(1), F.lit(1)
    # By the row's own cells, so that it lies in the same piece whenever it is read.
    split = row_hash(df)
    if own is not None:
        pieces = own.toDF("__own_key", "__own_pieces")
        df = df.join(F.broadcast(pieces), df[quote(key)] == pieces["__own_key"], "left")
        own_pieces = F.coalesce("__own_pieces", F.lit(1))
    if spread_nulls:  # they meet nobody and may go anywhere
        own_pieces = F.when(col(key).isNull(), NULL_PIECES).otherwise(own_pieces)
    if other is not None:
        pieces = other.toDF("__other_key", "__other_pieces")
        df = df.join(F.broadcast(pieces), df[quote(key)] == pieces["__other_key"], "left")
        copies = F.coalesce("__other_pieces", F.lit(1))
    cut = F.pmod(split, own_pieces.cast("long")).cast("int") if own is not None or spread_nulls else F.lit(0)
    df = df.select(*columns, cut.alias(piece), copies.alias(f"{copy}_copies"))
    if other is None:
        return df.withColumn(copy, F.lit(0))
    return df.withColumn(copy, F.explode(F.sequence(F.lit(0), F.col(f"{copy}_copies") - 1)))
