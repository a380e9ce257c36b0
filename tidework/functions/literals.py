"""Text typed by a user, turned into a comparison that fits the column's type.

The text is parsed once, on the driver, into a literal of the column's own type.
The column itself is never cast, so the comparison reaches the parquet reader,
and the result does not depend on the session's ANSI setting. Text that cannot
be read as the column's type gives a condition that holds for no row.
"""

from __future__ import annotations

import datetime as dt
import math
import re
from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidework.functions.names import find_field, quote

NEVER = "false"

_NUMBER = re.compile(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", re.ASCII)
_NOT_FINITE = {"nan": math.nan, "inf": math.inf, "infinity": math.inf}
# The words Spark itself reads as booleans.
_TRUE = {"t", "true", "y", "yes", "1"}
_FALSE = {"f", "false", "n", "no", "0"}

_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def parse_instant(text: str) -> dt.datetime:
    """ISO text to a UTC instant; without a zone it is UTC, digits after microseconds are cut."""
    value = dt.datetime.fromisoformat(text.strip())
    if value.tzinfo is None:
        return value.replace(tzinfo=dt.timezone.utc)
    return value.astimezone(dt.timezone.utc)


# Digits a time has beyond microseconds.
_FINER = re.compile(r"(:\d{2}[.,]\d{6})(\d+)", re.ASCII)


def _finer_than_micros(text: str) -> bool:
    found = _FINER.search(text)
    return bool(found and found[2].strip("0"))


def comparison(df: DataFrame, column: str, op: str, text: str) -> str:
    """SQL text for ``column op text`` where op is one of = < > <= >=."""
    field = find_field(df, column)
    name, kind = quote(field.name), field.dataType
    if isinstance(kind, T.StringType):
        return f"{name} {op} {string_literal(text)}"
    text = text.strip()
    if isinstance(kind, T.BooleanType):
        word = text.lower()
        if word not in _TRUE | _FALSE:
            return NEVER
        return f"{name} {op} {str(word in _TRUE).lower()}"
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        try:
            moment = parse_instant(text)
        except (ValueError, OverflowError):
            return NEVER
        if isinstance(kind, T.DateType):
            finer = _finer_than_micros(text)
            return _whole_step(name, op, moment == _midnight(moment) and not finer, *_days_around(moment, finer))
        # A finer time lies between two steps of the column.
        finer = _finer_than_micros(text)
        try:
            above = moment + dt.timedelta(microseconds=1) if finer else moment
        except OverflowError:
            return NEVER
        return _whole_step(name, op, not finer, _timestamp_literal(moment, kind), _timestamp_literal(above, kind))
    if isinstance(kind, T.NumericType):
        return _number(name, op, text, kind)
    raise ValueError(f"column {column!r} of type {kind.simpleString()} cannot be compared with text")


def string_literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _timestamp_literal(moment: dt.datetime, kind: T.DataType) -> str:
    text = moment.replace(tzinfo=None).isoformat(sep=" ")
    if isinstance(kind, T.TimestampNTZType):
        return f"TIMESTAMP_NTZ'{text}'"
    return f"TIMESTAMP'{text}+00:00'"


def _midnight(moment: dt.datetime) -> dt.datetime:
    return moment.replace(hour=0, minute=0, second=0, microsecond=0)


def _days_around(moment: dt.datetime, finer: bool) -> tuple[str, str]:
    day = moment.date()
    after = day if moment == _midnight(moment) and not finer else day + dt.timedelta(days=1)
    return f"DATE'{day}'", f"DATE'{after}'"


def _number(name: str, op: str, text: str, kind: T.DataType) -> str:
    special = _NOT_FINITE.get(text.lower().lstrip("+-"))
    if special is None and not _NUMBER.fullmatch(text):
        return NEVER
    if special is not None:
        value = -special if text.startswith("-") else special
        return f"{name} {op} double('{value}')"
    if isinstance(kind, T.FloatType):
        return f"{name} {op} float('{text}')"
    exact = Decimal(text)
    if isinstance(kind, T.DoubleType) or abs(exact.adjusted()) > 30:
        return f"{name} {op} double('{text}')"
    if isinstance(kind, T.DecimalType):
        plain = f"{exact:f}"
        if sum(c.isdigit() for c in plain) > 38:
            return f"{name} {op} double('{text}')"
        return f"{name} {op} {plain}BD"
    below = math.floor(exact)
    return _whole_step(name, op, exact == below, str(below), str(math.ceil(exact)))


def _whole_step(name: str, op: str, exact: bool, below: str, above: str) -> str:
    """Compare a column of whole steps (integers, days, microseconds) with a value that may lie between two."""
    if op == "=":
        return f"{name} = {below}" if exact else NEVER
    return f"{name} {op} {above if op in ('<', '>=') else below}"
