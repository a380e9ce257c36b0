"""Rows as JSON text, one object per row."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidework.functions.names import col, quote

_WHOLE_TIMES = {
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}


def to_json_rows(df: DataFrame) -> DataFrame:
    """One text column `value`, a JSON object per row; NULL cells are left out."""
    return df.select(F.to_json(F.struct(*[col(name) for name in df.columns]), _WHOLE_TIMES).alias("value"))


def json_keys(lines: DataFrame) -> DataFrame:
    """The distinct keys of JSON objects, one text column, as rows ``key``."""
    return lines.select(F.explode(F.json_object_keys(col(lines.columns[0]))).alias("key")).distinct()


def from_json_rows(lines: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A frame of JSON objects, one text column, as columns of text in alphabetical order.

    Nested values are JSON text; a line that is no object gives a row of NULLs.
    Where the columns aren't known, :func:`json_keys` finds them.
    """
    text = col(lines.columns[0])
    schema = _text_columns(columns)
    if not schema.fields:
        return lines.select()
    return lines.select(F.from_json(text, schema).alias("row")).select("row.*")


def read_json_rows(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Files of JSON objects, one per line, as columns of text in alphabetical order, like :func:`from_json_rows`."""
    return from_json_rows(spark.read.text(path), columns)


def json_schema(lines: DataFrame) -> T.StructType:
    """The columns of JSON objects, one text column, with their types, by one job that merges the lines' schemas.

    Whole numbers are BIGINT, or DECIMAL where they need more digits, or numbers that fit neither DOUBLE; objects are
    structs and lists arrays of what they hold. Values of several types, and keys that only ever are null, are text,
    the former as JSON. Keys stand in alphabetical order. Lines that are no object are left out.
    """
    value = f"try_parse_json({quote(lines.columns[0])})"
    objects = lines.where(F.expr(f"startswith(schema_of_variant({value}), 'OBJECT')"))
    found = objects.select(F.expr(f"schema_of_variant_agg({value})")).first()[0]
    # Names that need it stand between backticks, with backticks in them doubled.
    parts = re.split(r"(`(?:[^`]|``)*`)", found)
    for n in range(0, len(parts), 2):
        parts[n] = re.sub(r"\bVARIANT\b|\bVOID\b", "STRING", re.sub(r"\bOBJECT<", "STRUCT<", parts[n]))
    schema = T.DataType.fromDDL("".join(parts)) if "<" in found else T.StructType()
    return schema if isinstance(schema, T.StructType) else T.StructType()


def typed_json_rows(lines: DataFrame, schema: T.StructType | None = None) -> DataFrame:
    """A frame of JSON objects, one text column, as typed columns; :func:`json_schema` finds them where they aren't given.

    A line that is no object gives a row of NULLs, as does a value that does not fit a given type.
    """
    schema = json_schema(lines) if schema is None else schema
    if not schema.fields:
        return lines.select()
    row = F.from_json(col(lines.columns[0]), schema)
    return lines.select(row.alias("row")).select("row.*")


def _text_columns(columns: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(name, T.StringType()) for name in sorted(columns)])
