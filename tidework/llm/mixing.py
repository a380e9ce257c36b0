"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source is wanted equally often, a fractional number of
times. Its whole part is taken for sure; for the rest, documents are paired:
one passes words to the other, in a random direction that leaves each one's
expectation as it is, until one of the two is taken or left. The other one goes
on to the next pair. Groups of documents are settled in parallel, what each
group leaves open meets in the groups of the next level, and so up a tree: a
source's total misses its target by less than one document.

All of it is built-in expressions; random directions are hashes, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tidework.llm.common import WORD, free_names, row_keys, saved

GROUP = 64  # documents settled together
EQUAL = 4096  # equal rows written out by one task at a time, at most
WEIGHTS = (3.0, 1.0, 2.0)  # repeating, for sources by code point
_OPEN = "struct<size:long,order:long,mass:double,id:struct<a:long,b:int>>"


def targets(sizes: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, documents, target) of each row (source, source_size, documents).

    The targets share ``share`` of all sizes by weight and stop at ``most``
    times their source's size; the excess is shared by weight among the others
    until none is above. Sources come by code point, null last. One row for each
    source is all that a window here sees: the sources of a mixture are a list
    that somebody gives weights to.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.get(F.array(*(F.lit(float(w)) for w in weights)), place % len(weights))
    rows = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most)
    # By cap for each unit of weight: a source is capped if the level shared by it and all later ones is above its cap.
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    later = by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    earlier = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("total", F.sum("source_size").over(everything) * share)
    rows = rows.withColumn(
        "level", (F.col("total") - F.coalesce(F.sum("cap").over(earlier), F.lit(0.0))) / F.sum("weight").over(later)
    )
    rows = rows.withColumn("capped", F.col("cap") / F.col("weight") <= F.col("level"))
    # The first source that is not capped sets the level for all that follow it.
    level = F.first(F.when(~F.col("capped"), F.col("level")), True).over(
        by_cap.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    target = F.when(F.col("capped"), F.col("cap")).otherwise(level * F.col("weight"))
    return rows.select("source", "source_size", "documents", target.alias("target"))


def _coin(level: int, *parts: Column) -> Column:
    """A number from 0 to below 1, the same in every run."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(f"coin {level}"), *parts), 11) / float(1 << 53)


def _settle(level: int):
    """The step of a fold over documents: the open one, if any, is paired with the next. ``mass`` is in words: the
    probability to be taken, times the size."""

    def step(state: Column, x: Column) -> Column:
        a = state["open"]
        room_a, room_x = a["size"] - a["mass"], x["size"] - x["mass"]
        up, down = F.least(room_a, x["mass"]), F.least(a["mass"], room_x)
        a_gains = _coin(level, a["order"], x["order"]) * (up + down) < down
        both = a["mass"] + x["mass"]
        # Whoever reaches nought or its size first is settled; the other one keeps the rest.
        a_settled = F.when(a_gains, room_a <= x["mass"]).otherwise(a["mass"] <= room_x)
        rest = F.when(
            a_gains, F.when(a_settled, both - a["size"]).otherwise(both)
        ).otherwise(F.when(a_settled, both).otherwise(both - x["size"]))
        settled = F.when(a_settled, a).otherwise(x)
        left = F.when(a_settled, x).otherwise(a)
        taken = F.when(a_settled, a_gains).otherwise(~a_gains)
        # The rest may be nought or full up to rounding: then both are settled.
        rest = F.when(rest < 1e-9, 0.0).when(rest > left["size"] - 1e-9, left["size"].cast("double")).otherwise(rest)
        kept = F.struct(left["size"].alias("size"), left["order"].alias("order"), rest.alias("mass"), left["id"].alias("id"))
        one = F.struct(settled["id"].alias("id"), taken.alias("taken"))
        return F.when(
            a.isNull(), F.struct(x.cast(_OPEN).alias("open"), state["done"].alias("done"))
        ).otherwise(F.struct(kept.cast(_OPEN).alias("open"), F.concat(state["done"], F.array(one)).alias("done")))

    return step


def _round(open_: DataFrame, level: int) -> DataFrame:
    """Folds each group: (source, group, open, done), where done has the settled documents."""
    # Large ones first, so that what stays open to the end tends to be small.
    items = F.reverse(F.array_sort(F.collect_list(F.struct("size", "order", "mass", "id"))))
    start = F.struct(
        F.lit(None).cast(_OPEN).alias("open"), F.array().cast("array<struct<id:struct<a:long,b:int>,taken:boolean>>").alias("done")
    )
    folded = open_.groupBy("source", "group").agg(items.alias("items"))
    state = F.aggregate("items", start, _settle(level))
    return folded.select("source", "group", state.alias("state")).select("source", "group", "state.open", "state.done")


def _classes(documents: DataFrame, key: str, text: str, source: str, share: float, most: float, weights: tuple[float, ...]) -> DataFrame:
    """(row_a, row_b, key, size, source_size, target, rows, all) for each set of rows equal in key, text and source:
    how many there are, and how many copies the mix takes of all of them together."""
    a, b = row_keys([key, text, source])
    words = F.size(F.regexp_extract_all(F.col(f"`{text}`"), F.lit(WORD), 0))
    rows = documents.select(
        F.col(f"`{key}`").alias("key"),
        F.col(f"`{source}`").alias("source"),
        F.coalesce(F.when(F.col(f"`{text}`").isNotNull(), words), F.lit(0)).cast("long").alias("size"),
        a.alias("row_a"),
        b.alias("row_b"),
    )
    # Rows with the same key, text and source become one, taken that many times; counted before they are shuffled.
    alike = saved(
        rows.groupBy("row_a", "row_b", "source", "size").agg(F.first("key").alias("key"), F.count("*").alias("rows")), "sizes"
    )
    sums = alike.groupBy("source").agg(
        F.sum(F.col("size") * F.col("rows")).alias("source_size"), F.sum("rows").alias("documents")
    )
    aims = saved(targets(sums, share, most, weights), "targets")
    named = F.col("d.source").eqNullSafe(F.col("t.source"))
    wanted = (
        alike.alias("d")
        .join(aims.alias("t"), named)
        .select("d.row_a", "d.row_b", "d.key", "d.source", "d.size", "d.rows", "source_size", "documents", "target")
        .withColumn("times", F.when(F.col("source_size") > 0, F.col("rows") * F.col("target") / F.col("source_size")).otherwise(0.0))
        .withColumn("whole", F.floor("times"))
    )
    wanted = saved(wanted, "wanted")
    fraction = F.col("times") - F.col("whole")
    order = F.xxhash64("row_a", "row_b", F.lit("order"))
    open_ = wanted.where((F.col("size") > 0) & (fraction > 0)).select(
        "source",
        F.pmod(order, F.ceil(F.col("documents") / GROUP).cast("long")).alias("group"),
        "size",
        order.alias("order"),
        (fraction * F.col("size")).alias("mass"),
        F.struct(F.col("row_a").alias("a"), F.col("row_b").alias("b")).alias("id"),
    )
    largest = aims.agg(F.max("documents")).first()[0] or 0
    groups, level, settled = -(-largest // GROUP), 0, None
    while True:
        folded = saved(_round(open_, level), f"level{level}")
        # What is nought or full is settled by the next step anyway; only real rests go on.
        done = folded.select(F.explode("done").alias("d")).select("d.id", "d.taken")
        settled = done if settled is None else settled.unionByName(done)
        rest = folded.where("open IS NOT NULL").select(
            "source", F.floor(F.col("group") / GROUP).cast("long").alias("group"), "open.*"
        )
        if groups <= 1:
            break
        open_, groups, level = rest, -(-groups // GROUP), level + 1
    # The last one of a source has nobody to pair with: it goes the nearer way.
    last = rest.select("id", (F.col("mass") * 2 >= F.col("size")).alias("taken"))
    settled = settled.unionByName(last).select(F.col("id.a").alias("row_a"), F.col("id.b").alias("row_b"), "taken")
    return wanted.join(settled, ["row_a", "row_b"], "left").select(
        "row_a",
        "row_b",
        "key",
        "size",
        "source_size",
        "target",
        "rows",
        F.when(F.col("size") > 0, F.col("whole") + F.when(F.coalesce("taken", F.lit(False)), 1).otherwise(0))
        .otherwise(0)
        .cast("long")
        .alias("all"),
    )


def mixture(
    documents: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    share: float = 1.5,
    most: float = 2.0,
    weights: tuple[float, ...] = WEIGHTS,
) -> DataFrame:
    """(key, size, source_size, target, taken, copies, row_a, row_b) of every row.

    ``size`` is the number of words, ``taken`` the words the mix takes: copies
    times size. A document is taken ``target / source_size`` times, rounded up
    or down at random; documents without words are never taken. Null text has
    no words, a null source is a source. Rows that are equal in key, text and
    source are settled together: their copies differ by the usual whole part
    and what one of them is given; each shows the copies of its own row.
    """
    classes = _classes(documents, key, text, source, share, most, weights)
    # Equal rows cannot be told apart here, so they are written out from their number, some thousand in a block, and
    # the blocks are dealt over all tasks. Copies are dealt evenly, the odd ones to the first rows.
    parts = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    last_block = F.floor((F.col("rows") - 1) / EQUAL)
    blocks = classes.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), last_block)))
    blocks = blocks.repartition(parts, "row_a", "row_b", "block")
    first = F.col("block") * EQUAL
    place = F.explode(F.sequence(first, F.least(first + EQUAL, F.col("rows")) - 1))
    odd = F.when(F.col("place") < F.col("all") % F.col("rows"), 1).otherwise(0)
    dealt = blocks.withColumn("place", place).withColumn("copies", F.floor(F.col("all") / F.col("rows")) + odd)
    return dealt.select(
        F.col("key").alias(key),
        "size",
        "source_size",
        "target",
        (F.col("copies") * F.col("size")).cast("long").alias("taken"),
        F.col("copies").cast("long").alias("copies"),
        "row_a",
        "row_b",
    )


def resampled(
    documents: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    share: float = 1.5,
    most: float = 2.0,
    weights: tuple[float, ...] = WEIGHTS,
) -> DataFrame:
    """The rows of ``documents`` as often as the mixture takes them, with all their columns. Rows equal in key, text and
    source are one row here, taken as often as all of them together; where other columns differ, the row whose columns
    hash lowest stands for them (columns that hold maps don't count)."""
    classes = _classes(documents, key, text, source, share, most, weights)
    a, b, row, times, each = free_names(documents, "row_a", "row_b", "row", "times", "each")
    taken = classes.where("all > 0").select(
        F.col("row_a").alias(a), F.col("row_b").alias(b), F.col("all").cast("int").alias(times)
    )
    keys = row_keys([key, text, source])
    cols = [F.col(f"`{c}`") for c in documents.columns]
    others = [
        F.col(f"`{f.name}`")
        for f in documents.schema
        if f.name not in (key, text, source) and not any(kind in f.dataType.simpleString() for kind in ("map<", "variant"))
    ]
    # One of each before the join, so that a row repeated without end is one row a task there.
    one = (
        documents.select(keys[0].alias(a), keys[1].alias(b), F.struct(*cols).alias(row), F.xxhash64(*others, F.lit(0)).alias(each))
        .groupBy(a, b)
        .agg(F.min_by(row, each).alias(row))
    )
    rows = one.join(taken, [a, b]).withColumn(each, F.explode(F.sequence(F.lit(1), F.col(times))))
    return rows.select(*(F.col(row).getField(c).alias(c) for c in documents.columns))
