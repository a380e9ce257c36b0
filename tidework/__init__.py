"""Time-series workflows as lazy Spark plans."""

from tidework.functions.ordering import in_order
from tidework.functions.values import epoch_columns
from tidework.operators.basic import BasicQuery, Condition, basic_to_df, basic_to_sql
from tidework.operators.joins import join_on
from tidework.operators.overlaps import overlap_join, overlap_parts
from tidework.operators.preview import preview, preview_frame
from tidework.operators.running import (
    largest,
    last_value,
    previous,
    row_numbers,
    running,
    sessions,
    smallest,
    sums,
)
from tidework.operators.series import series
from tidework.operators.sketches import day_states, merge_states
from tidework.operators.slices import rows_before, time_slices
from tidework.operators.transform import transform
from tidework.plans.spec import Box, Join, Plot, Sql, Table, Tables, Workflow
from tidework.plans.step import Datasets
from tidework.plans.workbench import Workbench
from tidework.plans.workflow import run_box, run_workflow
from tidework.session import build_session, release_work, released_work, work_path
from tidework.sources.catalog import Catalog, describe, scan_range, time_tags_fields
from tidework.sources.export import read_csv, write_csv
from tidework.sources.rows import (
    from_json_rows,
    json_keys,
    json_schema,
    read_json_rows,
    to_json_rows,
    typed_json_rows,
)
from tidework.sources.scan import presence, scan_many, scan_ordered, shape, shapes
from tidework.streaming.flow import append_available

__all__ = [
    "BasicQuery",
    "Box",
    "Catalog",
    "Condition",
    "Datasets",
    "Join",
    "Plot",
    "Sql",
    "Table",
    "Tables",
    "Workbench",
    "Workflow",
    "append_available",
    "basic_to_df",
    "basic_to_sql",
    "build_session",
    "day_states",
    "describe",
    "epoch_columns",
    "from_json_rows",
    "in_order",
    "join_on",
    "json_keys",
    "json_schema",
    "largest",
    "last_value",
    "merge_states",
    "overlap_join",
    "overlap_parts",
    "presence",
    "preview",
    "preview_frame",
    "previous",
    "read_csv",
    "read_json_rows",
    "release_work",
    "released_work",
    "row_numbers",
    "rows_before",
    "run_box",
    "run_workflow",
    "running",
    "scan_many",
    "scan_ordered",
    "scan_range",
    "series",
    "sessions",
    "shape",
    "shapes",
    "smallest",
    "sums",
    "time_slices",
    "time_tags_fields",
    "to_json_rows",
    "transform",
    "typed_json_rows",
    "work_path",
    "write_csv",
]
