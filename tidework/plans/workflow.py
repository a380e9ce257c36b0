"""Workflows run as one lazy plan per box."""

from __future__ import annotations

from collections.abc import Collection, Iterable
from graphlib import CycleError, TopologicalSorter

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.storagelevel import StorageLevel

from tidework.functions.names import find_field
from tidework.functions.values import epoch_columns
from tidework.operators.basic import basic_to_df
from tidework.operators.joins import join_on
from tidework.operators.series import series
from tidework.plans.spec import BoxArgs, Join, Plot, Sql, Table, Tables, Workflow
from tidework.plans.step import Step
from tidework.sources.catalog import Catalog


def run_workflow(
    workflow: Workflow,
    catalog: Catalog,
    targets: Iterable[str] | None = None,
    *,
    streams: Collection[str] = (),
    persist_shared: StorageLevel | None = None,
    persisted: list[DataFrame] | None = None,
    errors: dict[str, Exception] | None = None,
) -> dict[str, DataFrame]:
    """A lazy frame per box, in dependency order.

    * `targets`: only these boxes and what they need are built.
    * `streams`: tables to read as streams; what comes from them is not sorted.
    * `persist_shared`: rows of boxes with several children are kept at that level;
      `persisted`, a list, gets their frames, to be unpersisted after use.
    * `errors`: if given, a box that cannot be built is noted here, as is every box
      that needs it, and the others are built; otherwise the first one raises.

    A cycle or a missing parent always raises.
    """
    shared = set(workflow.shared()) if persist_shared else set()
    steps: dict[str, Step] = {}
    for box_id in _dependency_order(workflow, targets):
        args = workflow.boxes[box_id].args
        try:
            for parent in args.parents:
                if parent not in steps:
                    raise ValueError(f"its parent {parent!r} failed")
            step = _build(args, catalog, steps, streams)
        except (ValueError, AnalysisException) as error:
            if errors is None:
                raise ValueError(f"box {box_id!r}: {error}") from error
            errors[box_id] = error
            continue
        if box_id in shared:
            step = Step(step.rows.persist(persist_shared), step.order)
            if persisted is not None:
                persisted.append(step.rows)
        steps[box_id] = step
    return {box_id: step.result for box_id, step in steps.items()}


def run_box(workflow: Workflow, catalog: Catalog, box_id: str, *, streams: Collection[str] = ()) -> DataFrame:
    """One box's frame; of the others only those it needs are built."""
    return run_workflow(workflow, catalog, [box_id], streams=streams)[box_id]


def _dependency_order(workflow: Workflow, targets: Iterable[str] | None) -> list[str]:
    needed: dict[str, list[str]] = {}
    open_ids = list(workflow.boxes if targets is None else targets)
    while open_ids:
        box_id = open_ids.pop()
        if box_id in needed:
            continue
        if box_id not in workflow.boxes:
            raise ValueError(f"no box {box_id!r}")
        parents = workflow.boxes[box_id].args.parents
        for parent in parents:
            if parent not in workflow.boxes:
                raise ValueError(f"box {box_id!r} needs {parent!r}, which does not exist")
        needed[box_id] = list(parents)
        open_ids.extend(parents)
    try:
        return list(TopologicalSorter(needed).static_order())
    except CycleError as error:
        raise ValueError(f"boxes wait for each other: {' -> '.join(error.args[1])}") from error


def _build(args: BoxArgs, catalog: Catalog, steps: dict[str, Step], streams: Collection[str]) -> Step:
    match args:
        case Tables():
            return Step(catalog.list_tables())
        case Table():
            if not args.table:
                raise ValueError("choose a table")
            time = catalog.time_column(args.table)
            rows = catalog.scan(args.table, args.start_time, args.end_time, stream=args.table in streams)
            # Times alone decide the order, so the derived columns need not go through a sort.
            return Step(epoch_columns(rows, time), time)
        case Sql():
            parent = steps[args.parent]
            if not args.is_basic:
                return Step(parent.transformed(args.advancedSQL))
            rows = basic_to_df(args.basic_query(), parent.rows)
            return Step(rows, parent.order if parent.order in rows.columns else None)
        case Join():
            left, right = steps[args.leftParent].rows, steps[args.rightParent].rows
            find_field(left, args.leftJoinColumn)
            find_field(right, args.rightJoinColumn)
            rows = join_on(left, right, args.leftJoinColumn, args.rightJoinColumn, args.joinType, sort=False)
            return Step(rows, "time" if "time" in rows.columns else None)
        case Plot():
            # A line is drawn in row order, so the points come from the sorted result.
            return Step(series(steps[args.parent].result, args.xField, args.yField, *args.additionalYFields))
    raise ValueError(f"unknown box arguments {args!r}")
