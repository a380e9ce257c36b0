"""The step-by-step interface: each call stores a lazy frame and shows a preview of it."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tidework.functions.values import epoch_columns
from tidework.operators.joins import join_on
from tidework.operators.preview import ROWS_SHOWN, preview
from tidework.plans.step import Datasets
from tidework.sources.catalog import Catalog


# The names of requests and of their fields.


class Workbench:
    """Requests for tables, scans, SQL steps and joins, answered with ``dataset_id`` and ``preview``.

    `limit` bounds the preview only; the stored frame always covers all rows.
    """

    def __init__(self, catalog: Catalog, datasets: Datasets | None = None):
        self.catalog = catalog
        self.datasets = datasets or Datasets()

    def measurements(self) -> list[str]:
        return self.catalog.names()

    def query_table(self, table: str, start_time: str, end_time: str, limit: int | None = ROWS_SHOWN) -> dict:
        time = self.catalog.time_column(table)
        rows = epoch_columns(self.catalog.scan(table, start_time, end_time), time)
        return self._answer(rows, time, limit)

    def sql_transform(self, parent_dataset_id: str, sql: str, limit: int | None = ROWS_SHOWN) -> dict:
        return self._answer(self.datasets.step(parent_dataset_id).transformed(sql), None, limit)

    def sql_join(
        self,
        left_dataset_id: str,
        right_dataset_id: str,
        left_join_column: str,
        right_join_column: str,
        join_type: str,
        limit: int | None = ROWS_SHOWN,
    ) -> dict:
        left, right = self.datasets.step(left_dataset_id).rows, self.datasets.step(right_dataset_id).rows
        rows = join_on(left, right, left_join_column, right_join_column, join_type, sort=False)
        return self._answer(rows, "time" if "time" in rows.columns else None, limit)

    def dataset(self, dataset_id: str, limit: int | None = ROWS_SHOWN) -> dict:
        return preview(self.datasets.get(dataset_id), limit)

    def _answer(self, rows: DataFrame, order: str | None, limit: int | None) -> dict:
        dataset_id = self.datasets.store(rows, order)
        return {"dataset_id": dataset_id, "preview": self.dataset(dataset_id, limit)}
