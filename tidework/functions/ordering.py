"""Global order that holds up when very many rows share one time."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidework.functions.names import col, find_field


def in_order(df: DataFrame, *columns: str) -> DataFrame:
    """Sort by the columns, ascending, NULLs first.

    Spark sorts by range partitions, and rows with equal keys all go to one of
    them. Where a row comes from is therefore the last sort key: it cuts a
    frequent time into as many ranges as needed and is the same whenever a row
    is read, so filters above the sort still reach the files.
    """
    if df.isStreaming:
        raise ValueError("a stream has no global order; leave the sort out")
    keys = [col(find_field(df, name).name) for name in columns]
    return df.orderBy(*keys, *_origin(df))


def _origin(df: DataFrame) -> list[Column]:
    """File and block of a row where the frame reads files; else a hash of its cells."""
    origin = [F.col("_metadata.file_path"), F.col("_metadata.file_block_start")]
    if "_metadata" not in df.columns:
        try:
            df.orderBy(*origin).schema
            return origin
        except AnalysisException:
            pass
    return [row_hash(df)]


def row_hash(df: DataFrame) -> Column:
    """A number from a row's cells, maps left out."""
    cells = [col(f.name) for f in df.schema.fields if not _has_map(f.dataType)]
    return F.xxhash64(*cells) if cells else F.lit(0).cast("long")


def _has_map(kind: T.DataType) -> bool:
    if isinstance(kind, (T.MapType, T.VariantType)):
        return True
    if isinstance(kind, T.ArrayType):
        return _has_map(kind.elementType)
    return isinstance(kind, T.StructType) and any(_has_map(f.dataType) for f in kind.fields)
