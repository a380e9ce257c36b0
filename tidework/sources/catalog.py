"""Tables by name: list them, describe them, read them."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tidework.functions.literals import NEVER, comparison, parse_instant
from tidework.functions.names import col, find_field

TIME, TAG, FIELD = "time", "tag", "field"


def column_roles(df: DataFrame, time: str = "time") -> list[tuple[str, str, str]]:
    """(name, role, type): the time column, text columns as tags, all others as fields."""
    time_name = find_field(df, time).name
    roles = []
    for field in df.schema.fields:
        if field.name == time_name:
            role = TIME
        else:
            role = TAG if isinstance(field.dataType, T.StringType) else FIELD
        roles.append((field.name, role, field.dataType.simpleString()))
    return roles


def describe(df: DataFrame, time: str = "time") -> DataFrame:
    """One row per column: ``column_name, role, data_type``."""
    return df.sparkSession.createDataFrame(
        column_roles(df, time), "column_name string, role string, data_type string"
    )


def time_tags_fields(df: DataFrame, time: str = "time") -> DataFrame:
    """The columns in the order time, tags, fields."""
    roles = column_roles(df, time)
    return df.select(*[col(name) for wanted in (TIME, TAG, FIELD) for name, role, _ in roles if role == wanted])


def scan_range(df: DataFrame, start: str, end: str, time: str = "time", day: str | None = None) -> DataFrame:
    """Rows with ``start <= time <= end``; both bounds are ISO text, UTC unless they name a zone.

    `day` names a partition column that holds the UTC date of `time`: its
    bounds keep Spark from even listing the files of other days.
    """
    bounds = [comparison(df, time, ">=", start), comparison(df, time, "<=", end)]
    for text, bound in zip((start, end), bounds):
        if bound == NEVER:
            raise ValueError(f"{text!r} is no time")
    if day is not None:
        first, last = (str(parse_instant(text).date()) for text in (start, end))
        bounds += [comparison(df, day, ">=", first), comparison(df, day, "<=", last)]
    return df.where(" AND ".join(bounds))


class Catalog:
    """Time-series tables of a folder or of a Spark database.

    `time_columns` names the time column of tables where it is not ``time``,
    `day_columns` the partition column of tables laid out by UTC date.
    A table's files are listed once, when it is first used; where `schemas` has
    its columns, none is opened for them.
    """

    def __init__(
        self,
        spark: SparkSession,
        locations: Mapping[str, str],
        time_columns: Mapping[str, str] | None = None,
        day_columns: Mapping[str, str] | None = None,
        file_format: str | None = "parquet",
        schemas: Mapping[str, T.StructType] | None = None,
    ):
        self.spark = spark
        self._locations = dict(locations)
        self._time_columns = dict(time_columns or {})
        self._day_columns = dict(day_columns or {})
        self._format = file_format
        self._schemas = dict(schemas or {})
        self._frames: dict[str, DataFrame] = {}

    @classmethod
    def from_folder(
        cls,
        spark: SparkSession,
        folder: str,
        time_columns: Mapping[str, str] | None = None,
        day_columns: Mapping[str, str] | None = None,
        file_format: str = "parquet",
        schemas: Mapping[str, T.StructType] | None = None,
    ) -> Catalog:
        """Each entry ``NAME.<format>`` of the folder, file or directory, is the table NAME."""
        jvm = spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(folder)
        entries = root.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(root)
        suffix = "." + file_format
        locations = {}
        for entry in entries:
            path = entry.getPath()
            if path.getName().endswith(suffix):
                locations[path.getName().removesuffix(suffix)] = path.toString()
        return cls(spark, locations, time_columns, day_columns, file_format, schemas)

    @classmethod
    def from_database(
        cls,
        spark: SparkSession,
        database: str | None = None,
        time_columns: Mapping[str, str] | None = None,
        day_columns: Mapping[str, str] | None = None,
    ) -> Catalog:
        tables = [t for t in spark.catalog.listTables(database) if not t.isTemporary]
        locations = {t.name: ".".join([*(t.namespace or []), t.name]) for t in tables}
        return cls(spark, locations, time_columns, day_columns, None)

    def names(self) -> list[str]:
        return sorted(self._locations)

    def list_tables(self) -> DataFrame:
        return self.spark.createDataFrame([(name,) for name in self.names()], "table_name string")

    def table(self, name: str) -> DataFrame:
        if name not in self._frames:
            location = self._location(name)
            if self._format:
                reader = self.spark.read.format(self._format)
                if name in self._schemas:
                    reader = reader.schema(self._schemas[name])
                self._frames[name] = reader.load(location)
            else:
                self._frames[name] = self.spark.table(location)
        return self._frames[name]

    def stream(self, name: str) -> DataFrame:
        """The table as a stream of the files or rows added to it."""
        location = self._location(name)
        if not self._format:
            return self.spark.readStream.table(location)
        return self.spark.readStream.format(self._format).schema(self.table(name).schema).load(location)

    def time_column(self, name: str) -> str:
        self._location(name)
        return self._time_columns.get(name, "time")

    def scan(self, name: str, start: str, end: str, stream: bool = False) -> DataFrame:
        """The table's rows in a closed time range."""
        rows = self.stream(name) if stream else self.table(name)
        return scan_range(rows, start, end, self.time_column(name), self._day_columns.get(name))

    def describe(self, name: str) -> DataFrame:
        return describe(self.table(name), self.time_column(name))

    def _location(self, name: str) -> str:
        if name not in self._locations:
            raise ValueError(f"no table {name!r}")
        return self._locations[name]
