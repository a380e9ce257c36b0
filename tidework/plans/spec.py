"""Workflows as saved: boxes with arguments, linked to their parents."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import asdict, dataclass, field

from tidework.operators.basic import BasicQuery, Condition, split_columns


# The fields of these classes are named as in saved files.


@dataclass(frozen=True)
class Tables:
    """Lists the catalog's tables."""

    code: str = ""

    @property
    def parents(self) -> tuple[str, ...]:
        return ()


@dataclass(frozen=True)
class Table:
    """One table's rows in a closed time range. `parent` is the listing it was chosen from, if any."""

    table: str = ""
    start_time: str = ""
    end_time: str = ""
    parent: str | None = None

    @property
    def parents(self) -> tuple[str, ...]:
        return (self.parent,) if self.parent else ()


@dataclass(frozen=True)
class Sql:
    parent: str | None = None
    sqlMode: str = "basic"
    basicSQL: str = ""
    advancedSQL: str = ""
    selectClause: str = ""
    whereClause: str = ""
    whereOperator: str = "="
    whereValue: str = ""
    additionalWhere: tuple[Mapping[str, str], ...] = ()

    @property
    def parents(self) -> tuple[str | None, ...]:
        return (self.parent,)

    @property
    def is_basic(self) -> bool:
        return self.sqlMode in ("basic", "")

    def basic_query(self) -> BasicQuery:
        first = Condition(self.whereClause, self.whereOperator, self.whereValue)
        more = [
            Condition(
                row.get("column") or "", row.get("operator") or "=", row.get("value") or "", row.get("logic") or "AND"
            )
            for row in self.additionalWhere
        ]
        return BasicQuery(split_columns(self.selectClause), (first, *more))


@dataclass(frozen=True)
class Join:
    leftParent: str | None = None
    rightParent: str | None = None
    leftJoinColumn: str = ""
    rightJoinColumn: str = ""
    joinType: str = "Left Join"

    @property
    def parents(self) -> tuple[str | None, ...]:
        return (self.leftParent, self.rightParent)


@dataclass(frozen=True)
class Plot:
    parent: str | None = None
    xField: str = ""
    yField: str = ""
    additionalYFields: tuple[str, ...] = ()

    @property
    def parents(self) -> tuple[str | None, ...]:
        return (self.parent,)


BoxArgs = Tables | Table | Sql | Join | Plot
# Box types as saved. The listing box is saved under the name of its data source.
_KINDS = {"table": Table, "sql": Sql, "join": Join, "plot": Plot}
LISTING = "database"


@dataclass(frozen=True)
class Box:
    id: str
    args: BoxArgs
    title: str = ""


@dataclass(frozen=True)
class Workflow:
    boxes: Mapping[str, Box] = field(default_factory=dict)

    @classmethod
    def of(cls, **args: BoxArgs) -> Workflow:
        """A workflow written in Python: ``Workflow.of(readings=Table(...), hot=Sql(parent="readings", ...))``."""
        return cls({name: Box(name, value) for name, value in args.items()})

    @classmethod
    def load(cls, saved: str | Mapping, listing: str = LISTING) -> Workflow:
        """A saved workflow, as JSON text or already parsed; `listing` is the type its listing boxes are saved under."""
        spec = json.loads(saved) if isinstance(saved, str) else saved
        boxes: dict[str, Box] = {}
        for entry in spec["boxes"]:
            if entry["id"] in boxes:
                raise ValueError(f"two boxes are called {entry['id']!r}")
            boxes[entry["id"]] = Box(entry["id"], _read_args(entry, listing), entry.get("title", ""))
        return cls(boxes)

    def dump(self, listing: str = LISTING) -> str:
        """The saved form of the workflow, which :meth:`load` reads back to an equal one."""
        names = {kind: name for name, kind in _KINDS.items()} | {Tables: listing}
        boxes = [
            {"id": box.id, "type": names[type(box.args)], "title": box.title, "runArgs": asdict(box.args)}
            for box in self.boxes.values()
        ]
        return json.dumps({"boxes": boxes}, ensure_ascii=False)

    def shared(self) -> list[str]:
        """Boxes with two or more children: the ones worth persisting."""
        uses = [parent for box in self.boxes.values() for parent in box.args.parents]
        return [box_id for box_id in self.boxes if uses.count(box_id) > 1]


def _read_args(entry: Mapping, listing: str) -> BoxArgs:
    args = entry.get("runArgs") or {}
    kind = _KINDS.get(entry["type"])
    if entry["type"] == listing:
        kind = Tables
    if kind is None:
        raise ValueError(f"box {entry['id']!r} has the unknown type {entry['type']!r}")
    known = {}
    for name in kind.__dataclass_fields__:
        value = args.get(name)
        if value is not None and value != "":
            known[name] = tuple(value) if isinstance(value, list) else value
    return kind(**known)
