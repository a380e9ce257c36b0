"""What an analysed plan says about a frame."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame

_FIRST_ROWS = {"GlobalLimit", "LocalLimit", "Offset", "Tail"}
# Below these the order of rows makes no difference to the first ones, or is made anew.
_ORDERLESS = {"Aggregate", "Sort", "Join", "Window", "Distinct", "Except", "Intersect", "Pivot"}

# What chooses columns and rows of a table.
_PLAIN = {"Project", "Filter", "SubqueryAlias", "View", "Union"}


def _children(node) -> Iterator:
    children = node.children()
    for i in range(children.size()):
        yield children.apply(i)


def _subqueries(node) -> Iterator:
    found = node.subqueries()
    for i in range(found.size()):
        yield found.apply(i)


def is_repeatable(df: DataFrame) -> bool:
    """Whether reading the frame again must give the same rows: no first rows without an order, no sample, no chance."""
    if df.isStreaming:
        return False
    open_ = [df._jdf.queryExecution().analyzed()]
    while open_:
        node = open_.pop()
        if node.nodeName() in _FIRST_ROWS | {"Sample"} or not node.deterministic():
            return False
        open_ += _children(node)
    return True


def is_plain(df: DataFrame) -> bool:
    """Whether reading the frame again costs no more than reading its tables: columns and rows are chosen, no more."""
    open_ = [df._jdf.queryExecution().analyzed()]
    while open_:
        node = open_.pop()
        children = list(_children(node))
        if children and node.nodeName() not in _PLAIN:
            return False
        open_ += children
    return True


def has_unique(df: DataFrame, name: str) -> bool:
    """Whether the plan says that no value is twice in a column: it is all that rows were grouped by."""
    node = df._jdf.queryExecution().analyzed()
    wanted = node.output().apply(df.columns.index(name)).exprId()
    while True:
        kind = node.nodeName()
        if kind in ("Project", "Aggregate"):
            listed = node.projectList() if kind == "Project" else node.aggregateExpressions()
            for i in range(listed.size()):
                one = listed.apply(i)
                if one.exprId().equals(wanted):
                    source = one.child() if one.nodeName() == "Alias" else one
                    break
            else:
                return False
            if source.nodeName() != "AttributeReference":
                return False
            wanted = source.exprId()
            if kind == "Aggregate":
                groups = node.groupingExpressions()
                one = groups.apply(0) if groups.size() == 1 else None
                return one is not None and one.nodeName() == "AttributeReference" and one.exprId().equals(wanted)
        elif kind == "Distinct":
            return node.output().size() == 1
        elif kind not in ("Filter", "SubqueryAlias", "View", "Sort"):
            return False
        node = next(_children(node))


def keeps_first_rows(result: DataFrame, view: str) -> bool:
    """Whether a query keeps the first rows of its view by LIMIT or OFFSET, so that their order matters."""

    def walk(node, first: bool) -> bool:
        name = node.nodeName()
        if name == "View":
            return first
        if any(walk(part, False) for part in _subqueries(node)):
            return True
        first = (first or name in _FIRST_ROWS) and name not in _ORDERLESS
        return any(walk(child, first) for child in _children(node))

    return walk(result._jdf.queryExecution().analyzed(), False)
