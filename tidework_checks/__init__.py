"""Queries that exercise every operator, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tidework import Catalog

TIME_COLUMNS = {"events": "ts", "orders": "o_orderdate", "lineitem": "l_shipdate"}


@dataclass(frozen=True)
class Check:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


def catalog(spark: SparkSession, folder: str) -> Catalog:
    return Catalog.from_folder(spark, folder, TIME_COLUMNS)


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


class Registry(dict):
    def add(self, name: str, sql: str | None) -> Callable:
        def register(run: Callable) -> Callable:
            if name in self:
                raise ValueError(f"two checks are called {name!r}")
            self[name] = Check(run, sql)
            return run

        return register
