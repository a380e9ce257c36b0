"""Column names: look-up and quoting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def quote(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(quote(name))


def find_field(df: DataFrame, name: str) -> T.StructField:
    """The column called `name`; upper and lower case differ only if both exist."""
    fields = df.schema.fields
    same = [f for f in fields if f.name == name]
    if not same:
        same = [f for f in fields if f.name.lower() == name.lower()]
    if not same:
        raise ValueError(f"no column {name!r}; there are: {', '.join(df.columns)}")
    if len(same) > 1:
        raise ValueError(f"column {name!r} is not unique")
    return same[0]
