"""Column expressions: epoch numbers, plot coordinates, export text.

All are built-in Spark expressions, so they stay in generated code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidework.functions.names import col, find_field

# Fixed value: the longest numeric prefix a browser's parseFloat accepts.
FLOAT_PREFIX = r"^[\s\p{Z}\x{FEFF}]*([+-]?(?:Infinity|(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?))"

_TIMES = (T.TimestampType, T.TimestampNTZType, T.DateType)
_UTC_NAMES = {"UTC", "Etc/UTC", "Z", "GMT", "Etc/GMT", "UCT", "Zulu", "+00:00"}


def _nan() -> Column:
    return F.lit(float("nan"))


def as_instant(df: DataFrame, name: str) -> Column:
    """The time column as TIMESTAMP; times without a zone are UTC, whatever the session's zone is."""
    field = find_field(df, name)
    value = col(field.name)
    if isinstance(field.dataType, T.TimestampType):
        return value
    if not isinstance(field.dataType, _TIMES):
        raise ValueError(f"column {name!r} is no time column")
    return _utc_instant(df, value.cast("timestamp_ntz"))


def _utc_instant(df: DataFrame, local: Column) -> Column:
    if df.sparkSession.conf.get("spark.sql.session.timeZone") in _UTC_NAMES:
        return local.cast("timestamp")
    parts = [F.year(local), F.month(local), F.day(local), F.hour(local), F.minute(local)]
    return F.make_timestamp(*parts, F.extract(F.lit("SECOND"), local), F.lit("UTC"))


# Kept with a column through selections, so that a plot knows its unit.
EPOCH_UNIT = "tidework.epoch"


def epoch_columns(df: DataFrame, time: str = "time") -> DataFrame:
    """Add ``<time>_ns``, nanoseconds since the epoch, and ``<time>_s``, whole seconds rounded down.

    A name that is taken gets ``_epoch`` until it is free. Times that have no
    64-bit number of nanoseconds, before 1677 or after 2262, have NULL.
    """
    moment = as_instant(df, time)
    taken = {name.lower() for name in df.columns}

    def free(name: str) -> str:
        while name.lower() in taken:
            name += "_epoch"
        return name

    nanos = F.try_multiply(F.unix_micros(moment), F.lit(1000).cast("long"))
    added = [(free(f"{time}_ns"), "ns", nanos), (free(f"{time}_s"), "s", F.unix_seconds(moment))]
    return df.select("*", *(value.alias(name, metadata={EPOCH_UNIT: unit}) for name, unit, value in added))


def parse_float(df: DataFrame, name: str) -> Column:
    """A double: numbers as they are, text by its longest numeric prefix, all else NaN."""
    field = find_field(df, name)
    value, kind = col(field.name), field.dataType
    if isinstance(kind, T.NumericType):
        number = value.cast("double")
    elif isinstance(kind, T.StringType):
        # A cast that fails is slow, as Spark throws for each row; no match gives "", so skip it.
        number = F.nullif(F.regexp_extract(value, FLOAT_PREFIX, 1), F.lit("")).try_cast("double")
    elif isinstance(kind, _TIMES):
        # The text of a time starts with its year.
        number = F.year(value).cast("double")
    else:
        return _nan()
    return F.coalesce(number, _nan())


def epoch_millis(df: DataFrame, name: str) -> Column:
    """Milliseconds since the epoch as a double, finer digits cut; NaN where there is no time."""
    field = find_field(df, name)
    value, kind = col(field.name), field.dataType
    if isinstance(kind, _TIMES):
        moment = as_instant(df, name)
    elif isinstance(kind, T.StringType):
        # Text that names no zone is UTC, whatever the session's zone is.
        zoned = value.rlike(r":[0-9]{1,2}.*[A-Za-z+\-]")
        moment = F.when(zoned, value.try_cast("timestamp")).otherwise(_utc_instant(df, value.try_cast("timestamp_ntz")))
    elif isinstance(kind, T.NumericType):
        return _number_of(value.cast("double"), (field.metadata or {}).get(EPOCH_UNIT))
    else:
        return _nan()
    return F.coalesce(F.unix_millis(moment).cast("double"), _nan())


def _number_of(value: Column, unit: str | None) -> Column:
    """Epoch columns as milliseconds, any other number as it is."""
    if unit is None:
        return F.coalesce(value, _nan())
    millis = value / F.lit(1e6) if unit == "ns" else value * F.lit(1e3)
    # FLOOR gives an integer, which has no NaN.
    return F.when(value.isNull() | F.isnan(value), _nan()).otherwise(F.floor(millis).cast("double"))


def plot_value(df: DataFrame, name: str) -> Column:
    """A plot coordinate; a column with "time" in its name holds times, any other numbers."""
    return epoch_millis(df, name) if "time" in name.lower() else parse_float(df, name)


def _utc_clock(df: DataFrame, moment: Column) -> Column:
    """An instant as the clock shows it in UTC, without a zone."""
    if df.sparkSession.conf.get("spark.sql.session.timeZone") in _UTC_NAMES:
        return moment.cast("timestamp_ntz")
    seconds = (F.unix_micros(moment).cast("decimal(20,0)") / F.lit(1_000_000)).cast("decimal(18,6)")
    return F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)


def iso_text(moment: Column) -> Column:
    """``2024-07-25T16:47:00``, with six more digits only if there are microseconds."""
    text = F.translate(moment.cast("string"), " ", "T")
    return F.when(F.length(text) > 19, F.rpad(text, 26, "0")).otherwise(text)


def number_text(value: Column) -> Column:
    """A double as a browser prints it: no ``.0``, plain digits from 1e-6 up to 1e21."""
    size = F.abs(value)
    java = value.cast("string")

    def plain(scale: int) -> Column:
        return _trim_zeros(value.try_cast(f"decimal(38,{scale})").cast("string"))

    exponent = F.regexp_replace(F.regexp_replace(java, r"\.0E", "e"), "E", "e")
    exponent = F.regexp_replace(exponent, r"e([0-9])", "e+$1")
    return (
        F.when(value.isNull(), F.lit(None).cast("string"))
        .when(F.isnan(value) | (size == float("inf")), java)
        .when(size == 0, F.lit("0"))
        .when((size >= 1e-3) & (size < 1e7), F.regexp_replace(java, r"\.0$", ""))
        .when((size >= 1) & (size < 1e21), plain(17))
        .when((size >= 1e-6) & (size < 1), plain(30))
        .otherwise(exponent)
    )


def _trim_zeros(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")


def export_text(df: DataFrame, name: str) -> Column:
    """A cell of an exported file as text; NULL stays NULL."""
    field = find_field(df, name)
    value, kind = col(field.name), field.dataType
    if isinstance(kind, T.TimestampType):
        return iso_text(_utc_clock(df, value))
    if isinstance(kind, T.TimestampNTZType):
        return iso_text(value)
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return number_text(value.cast("double"))
    if isinstance(kind, T.DecimalType):
        return _trim_zeros(value.cast("string")) if kind.scale else value.cast("string")
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(value)
    return value.cast("string")
