"""One frame of many."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """All rows, columns by position. Pairs are joined level by level, since Spark
    analyses a whole plan again with every union on top of it."""
    level = list(frames)
    while len(level) > 1:
        level = [a.union(b) for a, b in zip(level[::2], level[1::2])] + level[len(level) - len(level) % 2 :]
    return level[0]
