"""Embedding near-duplicates by an inverted multi-index.

A vector's two halves are quantised by codebooks of their own; their product
grid has a cell for every pair of codewords. Each vector lies in one cell and
visits the nearest cells of the grid, in the order of the multi-sequence
traversal, as many as pairs at the threshold need to meet with the target
recall. Meetings are verified by cosine in double precision. Equal vectors of a
label are one class and compared once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidework.llm.common import by_group, saved
from tidework.llm.graph import FOUND, Links, components

BLOCK = 1024  # home vectors, and visiting ones, of a cell compared in one task
FAN = 256  # codewords that are fitted side by side
SAMPLED = 16  # vectors for each codeword that the codebooks are fitted on, at least


def _codebook(points: np.ndarray, count: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """``count`` centres of the points, fewer if they have fewer points. Beyond ``FAN``, the points are first parted
    among some centres and each part gets its share, so that the work grows with the points times the root of the count."""
    count = min(count, len(points))
    if count > FAN:
        coarse = _codebook(points, int(np.ceil(count**0.5)), rng, rounds)
        near = _nearest(points, coarse)
        if (near == near[0]).all():  # points that are all alike are parted anyhow
            near = np.arange(len(points)) % len(coarse)
        sizes = np.bincount(near, minlength=len(coarse))
        # Shares of the count by size, so that they add up to it: each part ends where its points end.
        ends = np.rint(np.cumsum(sizes) * (count / len(points))).astype(int)
        shares = np.diff(ends, prepend=0)
        return np.concatenate([_codebook(points[near == k], n, rng, rounds) for k, n in enumerate(shares) if n])
    centres = points[rng.choice(len(points), count, replace=False)]
    for _ in range(rounds):
        near = _nearest(points, centres)
        for k in range(count):
            if (near == k).any():
                centres[k] = points[near == k].mean(0)
    return centres


def _nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each point, some thousand points at a time."""
    return np.concatenate([_distances(points[i : i + 4096], centres).argmin(1) for i in range(0, len(points), 4096)])


def _distances(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((points**2).sum(1)[:, None] - 2 * points @ centres.T + (centres**2).sum(1), 0)


@dataclass
class MultiIndex:
    """Two codebooks over the halves of vectors of one dimension, and how many cells a vector visits."""

    books: tuple[np.ndarray, np.ndarray]
    visits: int

    def cells(self, vectors: np.ndarray, count: int) -> np.ndarray:
        """The ``count`` nearest cells of each vector, its own first.

        In a traversal of two sorted sequences the pair of places (i, j) comes
        after the (i + 1)(j + 1) - 1 pairs below it, so only pairs with
        (i + 1)(j + 1) <= count can be among the first.
        """
        half = vectors.shape[1] // 2
        found = []
        step = self._step()
        for low in range(0, len(vectors), step):
            some = vectors[low : low + step]
            parts = [_distances(p, b) for p, b in zip((some[:, :half], some[:, half:]), self.books)]
            orders = [_first(d, count) for d in parts]
            i, j = _reachable(orders[0].shape[1], orders[1].shape[1], count)
            sums = np.take_along_axis(parts[0], orders[0], 1)[:, i] + np.take_along_axis(parts[1], orders[1], 1)[:, j]
            best = np.argsort(sums, 1, kind="stable")[:, :count]
            first, second = np.take_along_axis(orders[0], i[best], 1), np.take_along_axis(orders[1], j[best], 1)
            found.append(first * len(self.books[1]) + second)
        return np.concatenate(found)

    def place(self, vectors: np.ndarray, others: np.ndarray) -> np.ndarray:
        """How many cells each vector visits before the other one's own: for each codeword of one half, the codewords of
        the other half that keep the sum below, by halving."""
        half = vectors.shape[1] // 2
        cells = self.cells(others, 1)[:, 0]
        out = []
        step = self._step()
        for low in range(0, len(vectors), step):
            some, own = vectors[low : low + step], cells[low : low + step]
            parts = [_distances(p, b) for p, b in zip((some[:, :half], some[:, half:]), self.books)]
            rows = np.arange(len(some))
            to = parts[0][rows, own // len(self.books[1])] + parts[1][rows, own % len(self.books[1])]
            parts[1].sort(1)
            out += [np.searchsorted(parts[1][r], to[r] - parts[0][r], "left").sum() for r in rows]
        return np.array(out, np.int64)

    def _step(self) -> int:
        """Vectors whose distances to all codewords are held at a time."""
        return max(1, (1 << 21) // max(len(b) for b in self.books))


def _first(distances: np.ndarray, count: int) -> np.ndarray:
    """The places of each row's ``count`` smallest distances, in order."""
    count = min(count, distances.shape[1])
    places = np.argpartition(distances, count - 1, 1)[:, :count]
    places.sort(1)
    order = np.argsort(np.take_along_axis(distances, places, 1), 1, kind="stable")
    return np.take_along_axis(places, order, 1)


def _reachable(first: int, second: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of places with (i + 1)(j + 1) <= count: about count times its logarithm."""
    each = np.minimum(count // np.arange(1, min(first, count) + 1), second)
    i = np.repeat(np.arange(len(each)), each)
    return i, np.arange(len(i)) - np.repeat(np.cumsum(each) - each, each)


def build_index(sample: np.ndarray, similarity: float, recall: float, codewords: int, seed: int = 7) -> MultiIndex:
    """Codebooks of the sample of unit vectors, and the visits that let ``recall`` of the pairs meet whose cosine is
    just the threshold: for each sampled vector a random partner at that angle shows how far apart their cells are."""
    rng = np.random.default_rng(seed)
    half = sample.shape[1] // 2
    books = tuple(_codebook(p, codewords, rng) for p in (sample[:, :half], sample[:, half:]))
    index = MultiIndex(books, 1)
    some = sample[:1000]
    aside = rng.normal(size=some.shape)
    aside -= (aside * some).sum(1, keepdims=True) * some
    length = np.linalg.norm(aside, axis=1, keepdims=True)
    partner = similarity * some + np.sqrt(1 - similarity**2) * aside / np.where(length > 0, length, 1)
    # A pair meets if either of the two visits the other's cell.
    after = np.minimum(index.place(some, partner), index.place(partner, some))
    index.visits = int(np.quantile(after, recall, method="higher")) + 1
    return index


def _usable(embedding: str) -> F.Column:
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.col(embedding).isNotNull() & finite & F.exists(embedding, lambda x: x != 0)


def _unit(column: pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    rows = flat.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(flat), -1)
    rows /= np.abs(rows).max(1, keepdims=True)  # so that squares of tiny or huge numbers stay in range
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def near_vectors(
    vectors: DataFrame,
    key: str = "vec_id",
    embedding: str = "embedding",
    label: str = "label",
    similarity: float = 0.98,
    recall: float = 0.9999,
    fit_rows: int = 4096,
    occupancy: int = 64,
) -> DataFrame:
    """(key, n_links, component_id, kept) of every row.

    Rows link if their labels are equal and not null and the cosine of their
    vectors is ``similarity`` or more; of different dimensions, null, zero, or
    with a null or non-finite component, a vector links with nothing.
    ``n_links`` counts the other rows linked directly, ``component_id`` is the
    smallest key reachable, ``kept`` says whether that is the row's own. The
    codebooks are fitted on the ``fit_rows`` vectors of smallest hash, or
    ``SAMPLED`` for each codeword if that is more; all rows are indexed, with
    cells of ``occupancy`` vectors or so, so codewords and sample grow with the
    root of the table. Each dimension has an index of its own. An empty table
    gives no rows; further columns of ``vectors`` are not looked at.
    """
    # Floats travel as floats; cosines are in double precision all the same.
    number = "float" if vectors.schema[embedding].dataType.simpleString() == "array<float>" else "double"
    rows = vectors.select(
        F.col(key).alias("key"), F.col(label).alias("label"), F.col(embedding).cast(f"array<{number}>").alias("vector")
    ).withColumn("usable", F.coalesce(_usable("vector") & F.col("label").isNotNull(), F.lit(False)))
    # Minus zero equals zero, so both give one class.
    plain = F.transform("vector", lambda x: x + F.lit(0.0).cast(number))
    rows = saved(
        rows.withColumn("vector", F.when(F.col("usable"), plain)).withColumn(
            "node", F.when(F.col("usable"), F.xxhash64("label", "vector"))
        ),
        "vectors",
    )
    classes = saved(
        rows.where("usable")
        .groupBy("node")
        .agg(F.min("key").alias("key"), F.count("*").alias("members"), F.min("label").alias("label"), F.min("vector").alias("vector"))
        .withColumn("dimension", F.size("vector")),
        "classes",
    )
    sizes = classes.groupBy("dimension").agg(F.count("*").alias("n")).collect()
    found = [
        _links(classes.where(F.col("dimension") == r.dimension), r.n, similarity, recall, fit_rows, occupancy)
        for r in sizes
    ]
    counted = classes.select(F.col("node"), F.col("node").alias("root"), F.lit(0).cast("long").alias("classes"), F.lit(0).cast("long").alias("members")).limit(0)
    for one in found:
        counted = counted.unionByName(one)
    counted = saved(counted, "links")
    whole = components(counted.select(F.col("root").alias("a"), F.col("node").alias("b")), "linked")
    whole = saved(whole.join(classes.select("node", "key"), "node"), "named")
    named = whole.groupBy("component").agg(F.min("key").alias("smallest"))
    totals = counted.groupBy("node").agg(F.sum("members").alias("linked"))
    infos = (
        classes.select("node", F.col("key").alias("own_key"), F.col("members").alias("own"))
        .join(totals, "node", "left")
        .join(whole.join(named, "component").select("node", "smallest"), "node", "left")
    )
    component = F.coalesce("smallest", "own_key", "key")
    return rows.select("key", "node").join(infos, "node", "left").select(
        F.col("key").alias(key),
        (F.coalesce("linked", F.lit(0)) + F.coalesce("own", F.lit(1)) - 1).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.col("key").eqNullSafe(component).alias("kept"),
    )


def codewords_for(count: int, occupancy: int) -> int:
    """Codewords of each half, so that the cells of their grid hold ``occupancy`` of ``count`` vectors or so."""
    return max(1, round((count / occupancy) ** 0.5))


def _links(
    classes: DataFrame, count: int, similarity: float, recall: float, fit_rows: int, occupancy: int
) -> DataFrame:
    """Counts of links between classes of one dimension."""
    codewords = codewords_for(count, occupancy)
    most = max(fit_rows, SAMPLED * codewords)
    sample = classes.select("vector").orderBy(F.xxhash64("node", F.lit("fit"))).limit(most).toArrow()
    index = build_index(_unit(sample["vector"]), similarity, recall, codewords)
    number, wide = (np.int32, "int") if codewords**2 < 1 << 31 else (np.int64, "long")

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cells = index.cells(_unit(batch.column(batch.num_columns - 1)), index.visits)
                lists = pa.ListArray.from_arrays(np.arange(len(cells) + 1) * cells.shape[1], pa.array(cells.ravel().astype(number)))
                yield pa.RecordBatch.from_arrays([*batch.columns, lists], ["node", "members", "label", "vector", "cells"])

    kind, array = (classes.schema[c].dataType.simpleString() for c in ("label", "vector"))
    placed = saved(
        classes.select("node", "members", "label", "vector").mapInArrow(
            visit, f"node long, members long, label {kind}, vector {array}, cells array<{wide}>"
        ),
        "placed",
    )
    met = placed.withColumn("cell", F.explode("cells")).withColumn("home", F.col("cells")[0] == F.col("cell"))
    met = met.withColumn("unit", F.xxhash64("label", "cell"))
    sizes = met.groupBy("unit").agg(
        F.ceil(F.count(F.when(F.col("home"), 1)) / BLOCK).cast("int").alias("homes"),
        F.ceil(F.count("*") / BLOCK).cast("int").alias("guests"),
    )
    # Cells nobody lives in are dropped; every home vector is a guest of its cell too.
    mine, theirs = F.hash("node", F.lit("home")), F.hash("node", F.lit("guest"))
    blocks = met.join(sizes.where("homes > 0"), "unit")
    zero = F.lit(0)
    as_guest = blocks.select(
        "unit", F.explode(F.sequence(zero, F.col("homes") - 1)).alias("i"), F.pmod(theirs, "guests").alias("j"),
        F.lit(False).alias("host"), "node", "members", "vector", "cells", "cell", "label",
    )
    as_home = blocks.where("home").select(
        "unit", F.pmod(mine, "homes").alias("i"), F.explode(F.sequence(zero, F.col("guests") - 1)).alias("j"),
        F.lit(True).alias("host"), "node", "members", "vector", "cells", "cell", "label",
    )

    def verify(group: pa.Table) -> dict[str, np.ndarray]:
        return _verify(group, similarity)

    return by_group(as_guest.unionByName(as_home), ["unit", "i", "j"], verify, FOUND)


def _verify(group: pa.Table, similarity: float) -> dict[str, np.ndarray]:
    host = group["host"].to_numpy()
    homes, guests = np.flatnonzero(host), np.flatnonzero(~host)
    nodes, members = group["node"].to_numpy(), group["members"].to_numpy()
    _, first, same = np.unique(nodes, return_index=True, return_inverse=True)
    links = Links(members[first])
    if not len(homes) or not len(guests):
        return links.found(nodes[first])
    unit = _unit(group["vector"])
    cell = group["cell"][0].as_py()
    flat = group["cells"].combine_chunks()
    cells = flat.flatten().to_numpy().reshape(len(flat), -1)
    own = cells[:, 0]
    for low in range(0, len(guests), 256):  # one product for many guests
        some = guests[low : low + 256]
        close = unit[some] @ unit[homes].T >= similarity
        for g, near in zip(some, close):
            if not near.any():
                continue
            near &= nodes[homes] != nodes[g]
            if own[g] == cell:  # both live here: the pair is met twice
                near &= nodes[homes] > nodes[g]
            elif own[g] < cell:  # if the host also visits the guest's cell, the pair counts in the lower cell
                near[near] = ~(cells[homes[near]] == own[g]).any(1)
            links.add(int(same[g]), same[homes[near]])
    return links.found(nodes[first])
