"""Links between nodes: counted inside a task, and joined into connected components across tasks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidework.llm.common import saved


class Links:
    """The links one task finds between its nodes: a count per node and a spanning forest, never the pairs."""

    def __init__(self, sizes: np.ndarray) -> None:
        self.sizes = sizes
        self.parent = np.arange(len(sizes))
        self.classes = np.zeros(len(sizes), np.int64)
        self.members = np.zeros(len(sizes), np.int64)

    def root(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def add(self, i: int, others: np.ndarray) -> None:
        """Links node i with each of the others, all of them new."""
        if not len(others):
            return
        self.classes[i] += len(others)
        self.members[i] += self.sizes[others].sum()
        self.classes[others] += 1
        self.members[others] += self.sizes[i]
        mine = self.root(i)
        for j in others[self.parent[others] != mine]:
            other = self.root(int(j))
            if other != mine:
                low, mine_high = (mine, other) if mine < other else (other, mine)
                self.parent[mine_high] = low
                mine = low

    def found(self, nodes: np.ndarray) -> dict[str, np.ndarray]:
        """For each node with links: a node of its tree, and how many classes and members it links with."""
        has = np.flatnonzero(self.classes)
        roots = np.array([self.root(int(i)) for i in has], np.int64)
        return {
            "node": nodes[has],
            "root": nodes[roots] if len(has) else nodes[:0],
            "classes": self.classes[has],
            "members": self.members[has],
        }


FOUND = "node long, root long, classes long, members long"


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) of all nodes on an edge (a, b); a component is named by its smallest node.

    Alternating large and small stars: every round links each node's larger
    neighbours, then its smaller ones, to the smallest node around. A round
    shuffles rows of two numbers; frequent nodes are aggregated before the
    shuffle and their join is split by adaptive execution. Each round is a
    table in the shared folder. It ends when a round changes nothing.
    """
    edges = saved(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), name)
    before = _state(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        around = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = both.where("b > a").join(around, "a").select(F.col("low").alias("a"), "b")
        # An edge (a, b) with a < b: b's smaller neighbours meet at the smallest of them.
        large = large.where("a <> b").distinct()
        below = large.groupBy("b").agg(F.min("a").alias("low"))
        meet = F.explode(F.array("a", "b")).alias("node")
        small = large.join(below, "b").select(F.col("low"), meet)
        edges = saved(small.where("low <> node").select(F.col("low").alias("a"), F.col("node").alias("b")).distinct(), name)
        after = _state(edges)
        if after == before:
            break
        before = after
    stars = edges.select(F.col("b").alias("node"), F.col("a").alias("component"))
    hubs = edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    return stars.unionByName(hubs)


def _state(edges: DataFrame) -> tuple:
    """A number of edges and a sum over them that tell whether a round has changed anything."""
    mixed = F.xxhash64("a", "b")
    return tuple(edges.agg(F.count("*"), F.sum(mixed.bitwiseAND(F.lit((1 << 31) - 1))), F.bit_xor(mixed)).first())
