"""Queries built from form fields: a column list and simple conditions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from tidework.functions.literals import comparison
from tidework.functions.names import col, find_field, quote

# The operators and links a form offers, and its text for "nothing chosen".
OPERATORS = ("=", "<", ">")
LINKS = ("AND", "OR")
NOTHING_CHOSEN = "Select columns"


@dataclass(frozen=True)
class Condition:
    column: str
    operator: str = "="
    value: str = ""
    logic: str = "AND"

    @property
    def usable(self) -> bool:
        return bool(_chosen(self.column) and self.value.strip())


@dataclass(frozen=True)
class BasicQuery:
    """`columns` empty means all. Conditions without a column or a value are left out.

    Conditions are linked without parentheses, so AND binds before OR; the link
    of the first one that is left has nothing to link to and does not count.
    """

    columns: tuple[str, ...] = ()
    conditions: tuple[Condition, ...] = ()


def split_columns(text: str) -> tuple[str, ...]:
    """``"a, b"`` to names; nothing chosen gives none."""
    return tuple(name.strip() for name in _chosen(text).split(",") if name.strip())


def basic_columns(query: BasicQuery, df: DataFrame) -> list[str]:
    return [find_field(df, name).name for name in query.columns] if query.columns else df.columns


def basic_where(query: BasicQuery, df: DataFrame) -> str:
    """The conditions as SQL text with literals of the columns' types; empty if there are none."""
    lines = []
    for condition in query.conditions:
        if not condition.usable:
            continue
        link = condition.logic.strip() or "AND"
        if link not in LINKS:
            raise ValueError(f"conditions are linked with AND or OR, not {link!r}")
        operator = condition.operator.strip()
        test = comparison(
            df, condition.column.strip(), operator if operator in OPERATORS else "=", condition.value.strip()
        )
        lines.append(f"{link} {test}" if lines else test)
    return "\n".join(lines)


def basic_to_df(query: BasicQuery, df: DataFrame) -> DataFrame:
    where = basic_where(query, df)
    if where:
        df = df.where(where)
    return df.select(*[col(name) for name in basic_columns(query, df)]) if query.columns else df


def basic_to_sql(query: BasicQuery, df: DataFrame, view: str = "df") -> str:
    """The same query as SQL text over `view`, each further condition on a line of its own."""
    columns = ", ".join(quote(name) for name in basic_columns(query, df)) if query.columns else "*"
    text = f"SELECT {columns} FROM {view if view.isidentifier() else quote(view)}"
    where = basic_where(query, df)
    return f"{text}\nWHERE {where}" if where else text


def _chosen(text: str) -> str:
    text = (text or "").strip()
    return "" if text == NOTHING_CHOSEN else text
