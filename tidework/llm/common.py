"""What several operators share: folds, row keys, bounded samples, and tables handed from one job to the next."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidework.session import work_path

# The blanks between words, as the queries' contracts give them.
BLANK = r"\x20\x09-\x0D"
WORD = rf"[^{BLANK}]+"


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def fold(key: str, parts: int) -> Column:
    """crc32 of the key as text, modulo ``parts``; a null key counts as empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % parts


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared work folder and read back: a lost executor costs no more than the later steps."""
    spark = df.sparkSession
    path = work_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names with as many underscores before them as keep them apart from the columns of ``df``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def row_keys(columns: Sequence[str]) -> tuple[Column, Column]:
    """Two hashes that identify a row by all of its columns; equal rows have equal keys, and neither is ever null."""
    cols = [F.col(f"`{c}`") for c in columns]
    return F.xxhash64(*cols), F.hash(*cols)


def smallest_by_hash(rows: DataFrame, key: str, stratum: str, count: int) -> DataFrame:
    """About ``count`` rows of each stratum, those whose key hashes lowest, and never more than twice as many.

    The strata are classes of a model, which holds weights for each of them on
    the driver anyway, so their sizes may pass through it too.
    """
    sizes = {r[0]: r[1] for r in rows.groupBy(stratum).count().collect()}
    place = (F.xxhash64(F.col(key).cast("string"), F.lit("sample")).cast("double") / 2.0**64) + 0.5
    share = F.lit(0.0)
    for value, size in sizes.items():
        if value is not None:
            share = F.when(F.col(stratum) == F.lit(value), min(1.0, count / size)).otherwise(share)
    return rows.where(place < share)


PIECES = 8  # of a long text that a model is fitted on


def spread_pieces(text: Column, longest: int) -> Column:
    """A binary text as it is, or, if it has more bytes than ``longest``, evenly spread pieces of it, one after another."""
    size, wide = F.octet_length(text), longest // PIECES
    starts = [F.floor((size - wide).cast("long") * i / (PIECES - 1)).cast("int") + 1 for i in range(PIECES)]
    pieces = F.concat(*[F.substring(text, start, F.lit(wide)) for start in starts])
    return F.when(size <= longest, text).otherwise(pieces)


def labelled_texts(
    documents: DataFrame, picked: DataFrame, key: str, text: str, label: str, longest: int
) -> list[tuple]:
    """(label, key, bytes) of the picked rows, in order of the key.

    A text of more than ``longest`` bytes is there as pieces of together that length, spread evenly from its beginning
    to its end, so that a class of long texts is learned as well. ``picked`` is a bounded sample, so broadcasting it and
    collecting its texts are bounded too.
    """
    ids = F.broadcast(picked.groupBy(F.col(key).alias("_k")).agg(F.min(label).alias("_y")))
    found = (
        documents.select(F.col(key).alias("_k"), spread_pieces(F.col(text).cast("binary"), longest).alias("_t"))
        .where(F.col("_t").isNotNull())
        .join(ids, "_k")
        .groupBy("_k", "_y")
        .agg(F.min("_t").alias("_t"))
        .toArrow()
    )
    rows = zip(found["_y"].to_pylist(), found["_k"].to_pylist(), found["_t"].to_pylist())
    return sorted(rows, key=lambda r: (str(r[1]), r[2]))


def worker_cache(name: str, make: Callable):
    """An object a Python worker keeps between tasks."""
    kept = sys.modules.setdefault("tidework_worker_cache", types.ModuleType("tidework_worker_cache")).__dict__
    if name not in kept:
        kept[name] = make()
    return kept[name]


def by_group(df: DataFrame, keys: list[str], work: Callable[[pa.Table], dict], schema: str) -> DataFrame:
    """``work`` on the rows of each group, one group after another in a task, so that many small groups cost little.

    The keys are numbers without nulls. A task holds one group and one batch at a time.
    """
    names = [field.split()[0] for field in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        last = None
        out: list[dict] = []
        size = 0

        def finish() -> None:
            nonlocal size
            if held:
                found = work(pa.concat_tables(held))
                held.clear()
                if len(found[names[0]]):
                    out.append(found)
                    size += len(found[names[0]])

        def batch_of() -> pa.RecordBatch:
            nonlocal size
            arrays = ([o[n] if isinstance(o[n], pa.Array) else pa.array(o[n]) for o in out] for n in names)
            joined = [pa.concat_arrays(a) for a in arrays]
            out.clear()
            size = 0
            return pa.RecordBatch.from_arrays(joined, names)

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            values = [batch.column(batch.schema.get_field_index(k)).to_numpy() for k in keys]
            change = np.zeros(batch.num_rows, bool)
            for v in values:
                change[1:] |= v[1:] != v[:-1]
            starts = np.flatnonzero(change)
            edges = [0, *starts.tolist(), batch.num_rows]
            for low, high in zip(edges[:-1], edges[1:]):
                now = tuple(v[low] for v in values)
                if now != last:
                    finish()
                    last = now
                held.append(table.slice(low, high - low))
            if size >= 1 << 16:
                yield batch_of()
        finish()
        if out:
            yield batch_of()

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)
