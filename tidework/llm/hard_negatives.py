"""Hard negatives for retrieval: rows of another label that score nearly as high as an anchor's positives.

Each positive opens a window of scores below its own. The upper limits of an anchor's windows cut the scores into
disjoint slots. Anchors and rows meet in blocks; each block keeps the best few rows of each slot, and so do the
combiners behind it. The slots of an anchor in descending order are one list, and a window is the beginning of the
list's end that starts with its own slot: one merge answers all windows, however they overlap.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidework.llm.common import by_group, row_keys, saved

ROWS, ANCHORS = 1 << 13, 1 << 10  # of a block
CELLS = 1 << 21  # scores that are held at once
SCALE = 256  # components are rounded down to this part of one
LARGEST = 1 << 55  # scores stay below it, so that a hundred times a score is a long too


def hard_negatives(
    vectors: DataFrame,
    is_anchor: Column,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    positives: int = 5,
    negatives: int = 5,
    low: int = 80,
    high: int = 100,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of all rows where ``is_anchor``.

    Components count in 256ths, rounded down; a score is the exact inner product of two rows with as many components.
    Higher scores come first, then smaller keys, null ones last. The positives of an anchor are its best other rows of
    its label, the negatives of a positive the best rows of other labels with a score of ``low`` to ``high`` per cent
    of its own; ``rank`` counts them from 1, and a positive without any has no row.

    Rows with a null label, a null vector, or a null or non-finite component take no part. Repeated rows are rows of
    their own: a repeated anchor returns its rows as often. A table without rows gives none. Other columns, whatever
    their names, are not read. Components so large that a score may pass 2**55 are an error.
    """
    if not 0 <= low <= high:
        raise ValueError("low and high are shares of a positive's score, in per cent")
    rows = saved(_distinct(vectors, is_anchor, key, vector, label), "vectors")
    size = rows.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if("anchor").alias("anchors"), F.max(F.size("v")).alias("wide")
    ).first()
    heavy = max(1, (size["wide"] or 1) / 1024)
    blocks = max(1, math.ceil(size["rows"] * heavy / ROWS))
    anchor_blocks = max(1, math.ceil(size["anchors"] * heavy / ANCHORS))

    owner = ["anchor_id", "row_a", "row_b"]
    place = [(-F.col("score")).alias("s"), F.col("id").isNull().alias("unknown"), "id"]  # as _best orders them
    anchors = rows.where("anchor").withColumn("limits", F.expr("CAST(NULL AS array<bigint>)"))
    pairs = _scored(rows, anchors, blocks, anchor_blocks, positives, low, high, same=True)
    best = F.array_sort(F.collect_list(F.struct(*place)))
    first = saved(_best(pairs, owner, positives).groupBy(*owner).agg(best.alias("positives")), "positives")

    named = {"anchor_id": "id", "row_a": "a", "row_b": "b"}
    limits = first.withColumnsRenamed(named).withColumn("limits", F.transform("positives", lambda p: -p.s))
    limited = anchors.drop("limits").join(limits, ["id", "a", "b"])
    near = _scored(rows, limited, blocks, anchor_blocks, negatives, low, high, same=False)
    slots = F.array_sort(F.collect_list(F.struct(*place, "slot")))
    lists = _best(near, [*owner, "slot"], negatives).groupBy(*owner).agg(slots.alias("slots"))
    times = anchors.withColumnsRenamed({old: new for new, old in named.items()}).select(*owner, "copies")
    merged = first.join(lists, owner).join(times, owner)
    windows = merged.select("anchor_id", "slots", "copies", F.posexplode("positives").alias("place", "positive"))
    score = -F.col("positive.s")
    end = F.slice(F.filter("slots", lambda n: n.slot >= F.col("place")), 1, negatives)
    chosen = F.filter(end, lambda n: -n.s * 100 >= score * low)
    # Copies of an anchor in two steps, so that no list is as long as an anchor is frequent.
    many = F.sequence(F.lit(0), F.floor((F.col("copies") - 1) / 1024))
    listed = windows.select("*", F.explode(many).alias("part"))
    few = F.sequence(F.lit(1), F.least(F.lit(1024), F.col("copies") - F.col("part") * 1024))
    listed = listed.select("anchor_id", "positive", score.alias("score"), chosen.alias("chosen"), F.explode(few))
    listed = listed.select("anchor_id", "positive", "score", F.posexplode("chosen").alias("rank", "n"))
    return listed.select(
        "anchor_id",
        F.col("positive.id").alias("positive_id"),
        (F.col("rank") + 1).alias("rank"),
        F.col("n.id").alias("negative_id"),
        F.col("score").alias("positive_score"),
        (-F.col("n.s")).alias("negative_score"),
    )


def _distinct(vectors: DataFrame, is_anchor: Column, key: str, vector: str, label: str) -> DataFrame:
    """id, label, v, anchor, copies and two hashes a and b of each different row; equal rows are counted, so that
    one that is very frequent is no group of its own anywhere."""
    whole = vectors.select(
        F.col(f"`{key}`").alias("id"),
        F.col(f"`{label}`").alias("label"),
        F.col(f"`{vector}`").alias("v"),
        F.coalesce(is_anchor, F.lit(False)).alias("anchor"),
    )
    infinite = F.lit(float("inf"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != infinite))
    kept = whole.where(F.col("label").isNotNull() & F.col("v").isNotNull() & finite)
    columns = ["id", "label", "v", "anchor"]
    a, b = row_keys(columns)
    return kept.groupBy(*columns).agg(F.count(F.lit(1)).alias("copies")).select(
        *columns, "copies", a.alias("a"), b.cast("long").alias("b")
    )


def _scored(
    rows: DataFrame,
    anchors: DataFrame,
    blocks: int,
    anchor_blocks: int,
    keep: int,
    low: int,
    high: int,
    same: bool,
) -> DataFrame:
    """(anchor_id, row_a, row_b, slot, id, score): the best rows of each slot of each anchor in each pair of blocks.

    With ``same``, rows of the anchor's label other than itself, and all scores are one slot; else rows of other
    labels in the windows that the anchor's ``limits``, the scores of its positives, open.
    """
    place = F.xxhash64("a", "b", F.lit("block"))
    wide = F.size("v").cast("long").alias("wide")
    of_label = F.xxhash64("label") if same else F.lit(0).cast("long")
    row_block, anchor_block = F.pmod(place, F.lit(blocks)), F.pmod(place, F.lit(anchor_blocks))
    every_row, every_anchor = (F.explode(F.sequence(*[F.lit(k).cast("long") for k in (0, n - 1)])) for n in (blocks, anchor_blocks))
    common = ["id", "label", "v", "copies", "a", "b"]
    none = F.expr("CAST(NULL AS array<bigint>)")
    guests = anchors.select(
        *common, "limits", F.lit(True).alias("guest"), wide, of_label.alias("part"), anchor_block.alias("g"), every_row.alias("h")
    )
    hosts = rows.select(
        *common, none.alias("limits"), F.lit(False).alias("guest"), wide, of_label.alias("part"), row_block.alias("h"), every_anchor.alias("g")
    ).select(*guests.columns)

    id_type = rows.schema["id"].dataType.simpleString()

    def work(block: pa.Table) -> dict:
        return _block(block, keep, low, high, same)

    schema = f"anchor_id {id_type}, row_a long, row_b long, slot int, id {id_type}, score long"
    return by_group(guests.unionByName(hosts), ["wide", "part", "g", "h"], work, schema)


def _best(pairs: DataFrame, owner: list[str], keep: int) -> DataFrame:
    """The best rows of each owner; Spark keeps that many before the shuffle too."""
    order = Window.partitionBy(*owner).orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    return pairs.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= keep).drop("nth")


def _matrix(table: pa.Table, wide: int) -> np.ndarray:
    flat = table["v"].combine_chunks().flatten() if table.num_rows else pa.array([], pa.float64())
    numbers = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(table.num_rows, wide)
    return np.floor(numbers * SCALE)


def _block(block: pa.Table, keep: int, low: int, high: int, same: bool) -> dict:
    wide = block["wide"][0].as_py()
    labels = block["label"].combine_chunks().dictionary_encode()
    labels = labels.combine_chunks() if isinstance(labels, pa.ChunkedArray) else labels
    block = block.set_column(block.schema.get_field_index("label"), "label", labels.indices)
    guests, hosts = block.filter(block["guest"]), block.filter(pc.invert(block["guest"]))
    left, right = _matrix(guests, wide), _matrix(hosts, wide)
    bound = wide * float(np.abs(left).max(initial=0)) * float(np.abs(right).max(initial=0))
    if bound >= LARGEST:
        raise ValueError("components are too large for exact scores")
    kind = np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else np.int64
    left, right = left.astype(kind), right.astype(kind).T
    mine, theirs = (t["label"].to_numpy() for t in (guests, hosts))
    copies = hosts["copies"].to_numpy()
    # Places of the rows in order of their keys, null ones last.
    order = pc.sort_indices(hosts, sort_keys=[("id", "ascending")], null_placement="at_end").to_numpy()
    rank = np.empty(hosts.num_rows, np.int64)
    rank[order] = np.arange(hosts.num_rows)
    if same:
        own = [t.select(["a", "b"]).to_pandas().to_numpy(np.int64) for t in (guests, hosts)]
    else:
        limits = guests["limits"].to_pylist()
        most = max(map(len, limits), default=0)
        least = np.iinfo(np.int64).min
        tops = np.full((len(limits), most), least, np.int64)
        floors = np.full(len(limits), np.iinfo(np.int64).max, np.int64)
        for i, scores in enumerate(limits):
            tops[i, : len(scores)] = [s * high // 100 for s in scores]
            # A window is empty where the score is below zero, as its lower limit is above its upper one.
            floors[i] = min((-(-s * low // 100) for s in scores if -(-s * low // 100) <= s * high // 100), default=floors[i])
    found: list[tuple[np.ndarray, ...]] = []
    step = max(1, CELLS // max(1, hosts.num_rows))
    for start in range(0, guests.num_rows if hosts.num_rows else 0, step):
        part = slice(start, start + step)
        scores = left[part] @ right
        fits = (mine[part, None] == theirs) == same
        if not same and most:
            fits &= (scores <= tops[part, :1]) & (scores >= floors[part, None])
        g, h = np.nonzero(fits)
        score, times = scores[g, h].astype(np.int64), copies[h]
        g += start
        if same:
            slot = np.zeros(len(g), np.int32)
            times = times - (own[0][g] == own[1][h]).all(axis=1)
        else:
            slot = ((score[:, None] <= tops[g]).sum(axis=1) - 1).astype(np.int32)
        found.append(_first(g, h, slot, score, np.minimum(times, keep), rank, keep))
    g, h, slot, score = (np.concatenate(c) for c in zip(*found)) if found else [np.zeros(0, np.int64)] * 4
    owners, others = guests.take(pa.array(g)), hosts.take(pa.array(h))
    out = {"anchor_id": owners["id"], "row_a": owners["a"], "row_b": owners["b"], "slot": pa.array(slot, pa.int32())}
    out |= {"id": others["id"], "score": pa.array(score, pa.int64())}
    return {name: c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for name, c in out.items()}


def _first(
    g: np.ndarray, h: np.ndarray, slot: np.ndarray, score: np.ndarray, times: np.ndarray, rank: np.ndarray, keep: int
) -> tuple[np.ndarray, ...]:
    """The best of each slot of each anchor, rows as often as they are repeated."""
    order = np.lexsort((rank[h], -score, slot, g))
    order = np.repeat(order, times[order])
    g, h, slot, score = g[order], h[order], slot[order], score[order]
    starts = np.flatnonzero((np.diff(g, prepend=-1) != 0) | (np.diff(slot, prepend=-1) != 0))
    nth = np.arange(len(g)) - np.repeat(starts, np.diff(starts, append=len(g)))
    best = nth < keep
    return g[best], h[best], slot[best], score[best]
