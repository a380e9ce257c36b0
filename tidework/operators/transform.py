"""SQL over one step's rows."""

from __future__ import annotations

import re
import threading

from pyspark.sql import DataFrame

# A view's name is shared by the whole session, and a frame is bound to the view
# when `spark.sql` analyses the text, so both happen under one lock.
_ONE_AT_A_TIME = threading.Lock()


def transform(df: DataFrame, sql: str, view: str = "df") -> DataFrame:
    """Run a query over `df`, which the text knows as `view`.

    Any query Spark understands will do; commands such as DROP or SET are
    refused, because the text stands inside a FROM clause.
    """
    query = _without_end(sql)
    if not query:
        raise ValueError("the SQL text is empty")
    with _ONE_AT_A_TIME:
        df.createOrReplaceTempView(view)
        return df.sparkSession.sql(f"SELECT * FROM (\n{query}\n)")


# Quoted text, comments, and whatever else has a character that counts.
_PARTS = re.compile(r"""'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|`[^`]*`|(?P<skip>--[^\n]*|/\*.*?\*/|[\s;]+)|.""", re.DOTALL)


def _without_end(sql: str) -> str:
    """The text up to its last character that is neither blank nor semicolon nor part of a comment."""
    end = 0
    for part in _PARTS.finditer(sql):
        if part["skip"] is None:
            end = part.end()
    return sql[:end].lstrip()
