"""Plot series in long form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidework.functions.names import find_field
from tidework.functions.values import plot_value

# Fixed value: a form's text for "nothing chosen".
NOTHING_CHOSEN = "Select a column"


def series(df: DataFrame, x: str, *ys: str) -> DataFrame:
    """``label, x, y``: one labelled series per y column, x and y as doubles.

    Columns with "time" in their name give epoch milliseconds, others numbers;
    what is neither gives NaN. Empty names among `ys` are ignored.
    """
    chosen = [y for y in ys if _chosen(y)]
    if not _chosen(x) or not chosen:
        raise ValueError("a plot needs an x column and at least one y column")
    labels = [find_field(df, y).name for y in chosen]
    # Values travel under their position, as the same column may be drawn twice.
    points = df.select(
        plot_value(df, x).alias("x"), *[plot_value(df, y).alias(str(i)) for i, y in enumerate(chosen, start=1)]
    )
    long = points.unpivot("x", [str(i) for i in range(1, len(chosen) + 1)], "position", "y")
    label = F.element_at(F.array(*[F.lit(name) for name in labels]), F.col("position").cast("int"))
    return long.select(label.alias("label"), "x", "y")


def _chosen(name: str | None) -> bool:
    return bool(name and name.strip() and name != NOTHING_CHOSEN)
