"""Bounded previews: the first rows of a frame, by two bounds that the caller sets."""

from __future__ import annotations

from pyspark.sql import DataFrame

MAX_CELLS = 10_000_000
ROWS_SHOWN = 100


def preview_rows(n_columns: int, limit: int | None = None, max_cells: int = MAX_CELLS) -> int:
    """How many rows a preview may have, so that rows times columns stay within `max_cells`. No columns, no rows."""
    bounds = [0] if n_columns == 0 else [max_cells // n_columns]
    if limit is not None:
        bounds.append(limit)
    return max(0, min(bounds))


def preview_frame(df: DataFrame, limit: int | None = ROWS_SHOWN, max_cells: int = MAX_CELLS) -> DataFrame:
    return df.limit(preview_rows(len(df.columns), limit, max_cells))


def preview(df: DataFrame, limit: int | None = ROWS_SHOWN, max_cells: int = MAX_CELLS) -> dict:
    """``{"columns": [names], "data": [one mapping per row]}``. Only here rows come to
    the driver; of columns with one name, a mapping holds the last."""
    shown = preview_frame(df, limit, max_cells)
    places = {name: place for place, name in enumerate(shown.columns)}
    cells = shown.collect()
    table = [{name: row[place] for name, place in places.items()} for row in cells]
    return {"columns": list(shown.columns), "data": table}
