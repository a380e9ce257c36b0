"""What a step hands on: its rows, and how its result is ordered."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame

from tidework.functions.ordering import in_order
from tidework.operators.transform import transform
from tidework.plans.inspect import keeps_first_rows


@dataclass(frozen=True)
class Step:
    """Rows without order, and the column the result is sorted by.

    Children work on the rows: a sort below a filter keeps it from the files, and
    below a join or an aggregate it would cost a shuffle and change nothing.
    """

    rows: DataFrame
    order: str | None = None

    @property
    def result(self) -> DataFrame:
        if self.order is None or self.rows.isStreaming:
            return self.rows
        return in_order(self.rows, self.order)

    def transformed(self, sql: str, view: str = "df") -> DataFrame:
        """A SQL text over the rows; over the ordered rows if its plan keeps only the first of them."""
        over_rows = transform(self.rows, sql, view)
        if self.order is None or self.rows.isStreaming or not keeps_first_rows(over_rows, view):
            return over_rows
        return transform(self.result, sql, view)


class Datasets:
    """Lazy frames by name. Names are given by the caller or count upwards: ``dataset-1``, ``dataset-2`` and so on."""

    def __init__(self) -> None:
        self._steps: dict[str, Step] = {}
        self._numbered = 0

    def __iter__(self) -> Iterator[str]:
        return iter(self._steps)

    def store(self, df: DataFrame, order: str | None = None, name: str | None = None) -> str:
        """Keeps the frame, and which column it is sorted by when read as a result. A name that is taken is an error."""
        while name is None or (name in self._steps and name == f"dataset-{self._numbered}"):
            self._numbered += 1
            name = f"dataset-{self._numbered}"
        if name in self._steps:
            raise ValueError(f"there is a dataset {name!r} already")
        self._steps[name] = Step(df, order)
        return name

    def step(self, name: str) -> Step:
        try:
            return self._steps[name]
        except KeyError:
            raise ValueError(f"no dataset {name!r}") from None

    def get(self, name: str) -> DataFrame:
        return self.step(name).result

    def remove(self, name: str) -> None:
        self.step(name)
        self._steps.pop(name)
