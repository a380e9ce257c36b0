"""N-gram Jaccard join by MinHash banding.

Every text is the set of its word n-grams. Texts with equal sets form one class
and are compared once. A class has ``bands`` band hashes of ``rows`` minima
each; classes that share one are candidates, and candidates are verified on
their full sets. Pairs are counted where they are found and never written out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidework.llm.common import by_group, free_names, row_keys, saved
from tidework.llm.graph import FOUND, Links, components

BLOCK = 2048  # classes compared with each other in one task
BLOCK_GRAMS = 1 << 21  # n-grams held by one side of a task, unless a single text has more


def band_count(similarity: float, rows: int, recall: float) -> int:
    """Bands that make two sets of this similarity candidates with probability ``recall``."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= 500_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def grams(text: bytes, n: int, known: WordHashes) -> np.ndarray:
    """The sorted distinct n-grams of a text as 64-bit hashes. ASCII letters count as small, words end at ASCII blanks;
    a text of fewer than ``n`` words is one n-gram, one without words none."""
    split = text.lower().split()
    words = np.fromiter(map(known.__getitem__, split), np.uint64, len(split))
    n = min(n, len(words))
    if not n:
        return words
    out = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        out = (out * np.uint64(0x9E3779B97F4A7C15)) ^ words[k : k + len(out)]
        out ^= out >> np.uint64(29)
    return np.unique(out)


def _mixers(bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(17)
    return rng.integers(0, 1 << 32, bands * rows, np.uint64).astype(np.uint32) | np.uint32(1), rng.integers(
        0, 1 << 32, bands * rows, np.uint64
    ).astype(np.uint32)


def _bands(sets: list[np.ndarray], bands: int, rows: int) -> np.ndarray:
    """Band hashes (sets x bands) of sets that all have n-grams."""
    factor, shift = _mixers(bands, rows)
    all_ = np.concatenate(sets)
    low = (all_ ^ (all_ >> np.uint64(32))).astype(np.uint32)
    starts = np.cumsum([0, *(len(s) for s in sets[:-1])])
    out = np.zeros((len(sets), bands), np.uint64)
    for k in range(bands * rows):
        mixed = low * factor[k]
        mixed ^= mixed >> np.uint32(15)
        mixed *= np.uint32(0x85EBCA6B)
        mixed += shift[k]
        least = np.minimum.reduceat(mixed, starts).astype(np.uint64)
        band = out[:, k // rows]
        band *= np.uint64(0xC2B2AE3D27D4EB4F)
        band ^= least + np.uint64(k // rows + 1)
        band ^= band >> np.uint64(31)
    return out


def signatures(documents: DataFrame, key: str, text: str, n: int, bands: int, rows: int) -> DataFrame:
    """(key, row_a, row_b, node, grams, bands) of every row; node is a hash of the n-gram set, null without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            nodes, counts, blobs = [], [], []
            group: list[np.ndarray] = []

            def flush() -> None:
                if group:
                    found = _bands(group, bands, rows)
                    blobs.extend(row.tobytes() for row in found)
                    group.clear()

            where = []
            size = 0
            for value in batch.column(3):
                found = grams(value.as_py() or b"", n, known)
                counts.append(len(found))
                nodes.append(int(np.int64(xxhash.xxh3_64_intdigest(found.tobytes()) - (1 << 63))) if len(found) else None)
                where.append(len(found) > 0)
                if len(found):
                    group.append(found)
                    size += len(found)
                    if size >= 1 << 18:
                        flush()
                        size = 0
            flush()
            filled = iter(blobs)
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:3],
                    pa.array(nodes, pa.int64()),
                    pa.array(counts, pa.int64()),
                    pa.array([next(filled) if w else None for w in where], pa.binary()),
                ],
                ["key", "row_a", "row_b", "node", "grams", "bands"],
            )

    kept = _rows(documents, key, text)
    kind = kept.schema["key"].dataType.simpleString()
    return kept.mapInArrow(run, f"key {kind}, row_a long, row_b int, node long, grams long, bands binary")


def _rows(documents: DataFrame, key: str, text: str) -> DataFrame:
    """Key, two hashes that tell a row from rows of another key or text, and the text's bytes."""
    a, b = row_keys([key, text])
    return documents.select(
        F.col(key).alias("key"), a.alias("row_a"), b.alias("row_b"), F.col(text).cast("binary").alias("text")
    )


def _candidates(classes: DataFrame, bands: int) -> tuple[DataFrame, DataFrame]:
    """(band, node) of classes that share a band hash with another one, and candidate edges from each to one of them."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int64)
                node = np.repeat(batch.column(0).to_numpy(), bands)
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(node)], ["band", "node"])

    spreaded = classes.select("node", "bands").mapInArrow(spread, "band long, node long")
    shared = spreaded.groupBy("band").agg(F.min("node").alias("hub"), F.count("*").alias("n")).where("n > 1").drop("n")
    buckets = saved(spreaded.join(shared, "band"), "buckets")
    return buckets.select("band", "node"), buckets.select(F.col("hub").alias("a"), F.col("node").alias("b"))


def _blocks(units: DataFrame) -> DataFrame:
    """Members of units larger than a block, copied to each pair of the unit's blocks: (unit, side, node, ...)."""
    sizes = units.groupBy("unit").agg(
        F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("grams") / BLOCK_GRAMS)).cast("int").alias("n")
    )
    mine = F.pmod(F.hash("node", F.lit("block")), F.col("n"))
    each = F.when(F.col("n") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("n") - 1))
    return (
        units.join(sizes, "unit")
        .withColumn("mine", mine)
        .withColumn("other", F.explode(each))
        .select(
            "unit",
            F.least("mine", "other").alias("i"),
            F.greatest("mine", "other").alias("j"),
            (F.col("mine") > F.col("other")).alias("side"),
            "band",
            "node",
        )
    )


def _pairs(marks: np.ndarray, wanted: int | None) -> np.ndarray:
    """Which rows are candidates of each other: they share a band hash and, if ``wanted`` is a hash, it is the first."""
    m, bands = marks.shape
    first = np.full((m, m), 127, np.int8)
    for k in range(bands - 1, -1, -1):
        order = np.argsort(marks[:, k], kind="stable")
        runs = np.flatnonzero(np.diff(marks[order, k].astype(np.int64), prepend=~marks[order[0], k].astype(np.int64)))
        for low, high in zip(runs, np.append(runs[1:], m)):
            if high - low > 1:
                some = order[low:high]
                first[np.ix_(some, some)] = k
    if wanted is None:
        return first < 127
    hit = np.zeros((m, m), bool)
    for k in np.flatnonzero((marks.view(np.int64) == wanted).any(0)):
        same = np.flatnonzero(marks[:, k].view(np.int64) == wanted)
        at = np.ix_(same, same)
        hit[at] = first[at] == k
    return hit


def _verify(
    rows: pa.Table, similarity: float, n: int, bands: int, known: WordHashes
) -> dict[str, np.ndarray]:
    """Compares the members of a unit, or of a pair of its blocks, on their full n-gram sets."""
    nodes, sides = rows["node"].to_numpy(), rows["side"].to_numpy()
    marks = np.frombuffer(b"".join(rows["bands"].to_pylist()), np.uint64).reshape(len(nodes), bands)
    possible = _pairs(marks, rows["band"][0].as_py())
    if rows["i"][0].as_py() != rows["j"][0].as_py():
        possible &= sides[:, None] != sides[None, :]
    possible = np.triu(possible, 1)
    links = Links(rows["members"].to_numpy())
    needed = np.flatnonzero(possible.any(0) | possible.any(1))
    if not len(needed):
        return links.found(nodes)
    texts = rows["text"]
    sets = [grams(texts[int(i)].as_py(), n, known) for i in needed]
    sizes = np.zeros(len(nodes), np.int64)
    sizes[needed] = [len(s) for s in sets]
    every, places = np.unique(np.concatenate(sets), return_inverse=True)
    ids = dict(zip(needed.tolist(), np.split(places, np.cumsum(sizes[needed])[:-1])))
    mark = np.zeros(len(every), bool)
    for i in np.flatnonzero(possible.any(1)).tolist():
        others = np.flatnonzero(possible[i])
        big, small = np.maximum(sizes[i], sizes[others]), np.minimum(sizes[i], sizes[others])
        others = others[small >= similarity * big]
        if len(others):
            mark[ids[i]] = True
            starts = np.cumsum([0, *sizes[others[:-1]]])
            common = np.add.reduceat(mark[np.concatenate([ids[j] for j in others.tolist()])].astype(np.int64), starts)
            mark[ids[i]] = False
            links.add(i, others[common >= similarity * (sizes[i] + sizes[others] - common)])
    return links.found(nodes)


def jaccard_join(
    documents: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    n: int = 5,
    similarity: float = 0.8,
    recall: float = 0.9999,
    rows: int = 6,
) -> DataFrame:
    """(key, class_id, set_id, n_links, n_class_links, row_a, row_b, component) of every row.

    ``class_id`` is the smallest key reachable by links, ``set_id`` the smallest
    key with the same n-grams, ``n_links`` the number of other rows linked
    directly, ``n_class_links`` that of other classes of equal n-grams. Sets of
    similarity ``similarity`` or more are linked, each pair found with
    probability ``recall`` or more, equal sets always. Rows without words, null
    texts among them, link with nothing and are their own class. Null keys are
    larger than all others: a class has one only if it has no other. ``row_a``
    and ``row_b`` are the row's hashes over key and text. Classes whose smallest
    keys are the same, as keys that repeat or are null, share a ``class_id``;
    ``component`` is a number of the class alone, ``row_a`` for rows without words.

    Candidates are compared within connected groups of candidates, so a text
    moves once; a group larger than a block is compared band by band instead,
    and a band larger than a block in pairs of blocks: no task holds more than
    two blocks, and work follows the pairs that share a band.
    """
    bands = band_count(similarity, rows, recall)
    known = WordHashes()
    signed = saved(signatures(documents, key, text, n, bands, rows), "signatures")
    classes = saved(
        signed.where("node IS NOT NULL")
        .groupBy("node")
        .agg(
            F.min("key").alias("key"),
            F.min(F.struct("row_a", "row_b")).alias("row"),
            F.count("*").alias("members"),
            F.min("grams").alias("grams"),
            F.min("bands").alias("bands"),
        ),
        "classes",
    )
    buckets, edges = _candidates(classes, bands)
    groups = saved(components(edges, "candidates"), "groups")
    large = groups.groupBy("component").count().where(F.col("count") > BLOCK).select("component")
    in_large = groups.join(large, "component", "left_semi").select("node")
    units = (
        groups.join(large, "component", "left_anti")
        .select(F.col("component").alias("unit"), "node", F.lit(None).cast("long").alias("band"))
        .unionByName(buckets.join(in_large, "node", "left_semi").select(F.col("band").alias("unit"), "node", "band"))
    )
    placed = _blocks(units.join(classes.select("node", "grams"), "node"))
    # The text of one row of each class that has candidates; equal rows give one text.
    held = classes.join(groups, "node", "left_semi")
    texts = (
        _rows(documents, key, text)
        .join(held.select(F.col("row.row_a"), F.col("row.row_b"), "node"), ["row_a", "row_b"])
        .groupBy("node")
        .agg(F.min("text").alias("text"))
    )
    compared = placed.join(held.select("node", "members", "bands").join(texts, "node"), "node")

    def verify(group: pa.Table) -> dict[str, np.ndarray]:
        return _verify(group, similarity, n, bands, known)

    counted = saved(by_group(compared, ["unit", "i", "j"], verify, FOUND), "links")
    whole = components(counted.select(F.col("root").alias("a"), F.col("node").alias("b")), "linked")
    whole = saved(whole.join(classes.select("node", "key"), "node"), "named")
    named = whole.groupBy("component").agg(F.min("key").alias("class_key"))
    totals = counted.groupBy("node").agg(F.sum("classes").alias("classes"), F.sum("members").alias("members"))
    infos = (
        classes.select("node", F.col("key").alias("set_key"), F.col("members").alias("own"))
        .join(totals, "node", "left")
        .join(whole.join(named, "component").select("node", "class_key", "component"), "node", "left")
    )
    return (
        signed.select("key", "node", "row_a", "row_b")
        .join(infos, "node", "left")
        .select(
            F.col("key").alias(key),
            F.coalesce("class_key", "set_key", "key").alias("class_id"),
            F.coalesce("set_key", "key").alias("set_id"),
            (F.coalesce("members", F.lit(0)) + F.coalesce("own", F.lit(1)) - 1).cast("long").alias("n_links"),
            F.coalesce("classes", F.lit(0)).cast("long").alias("n_class_links"),
            "row_a",
            "row_b",
            F.coalesce("component", "node", "row_a").alias("component"),
        )
    )


def one_of_each(documents: DataFrame, key: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """The rows of ``documents`` less near copies: of each class the row with the smallest key, one of equal rows.

    A class keeps the row of its smallest row hash among those of its smallest
    key, or among all if none has a key, whether or not other classes have the
    same key. Rows without words are classes of their own: all stay, less those
    that repeat key and text.
    """
    found = jaccard_join(documents, key, text, **settings)
    stay = (
        found.groupBy("component")
        .agg(F.min(F.struct(F.col(key).isNull().alias("no_key"), F.col(key).alias("key"), "row_a", "row_b")).alias("row"))
        .select("row.row_a", "row.row_b")
    )
    a, b = free_names(documents, "row_a", "row_b")
    keys = row_keys([key, text])
    kept = documents.withColumns({a: keys[0], b: keys[1]})
    stay = stay.select(F.col("row_a").alias(a), F.col("row_b").alias(b))
    return kept.join(stay, [a, b], "left_semi").dropDuplicates([a, b]).drop(a, b)
