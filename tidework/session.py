"""Session settings the library is designed for, and the shared work folder."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from urllib.parse import urlparse

from pyspark.sql import SparkSession

# Skewed join keys and uneven partitions are left to adaptive execution, so it
# must be on; it may hash instead of sort where every partition of a side turns
# out small. The rest keeps results independent of the machine's time zone and
# keeps a large "first n rows in order" from being sorted in one task.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64MB",
    "spark.sql.execution.topKSortFallbackThreshold": "1000",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "tidework", master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


# Tables that jobs of this process handed to others and nobody removed yet.
_held: list[str] = []


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path for data one job hands to another; :func:`release_work` removes what lies there.

    It lies in the folder the cluster names in ``spark.checkpoint.dir``. Where that is unset, it lies in the warehouse,
    the other folder all executors share; a warehouse on the driver's own disk is none on a cluster, and so an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        warehouse = spark.conf.get("spark.sql.warehouse.dir")
        alone = spark.conf.get("spark.master").startswith("local")
        if not alone and urlparse(warehouse).scheme in ("", "file"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
        root = os.path.join(warehouse, "work")
    path = os.path.join(root, f"{name}-{uuid.uuid4().hex}")
    _held.append(path)
    return path


def release_work(spark: SparkSession, since: int = 0) -> int:
    """Remove the tables that lie at the paths given out, from number ``since`` on, and return how many there were.

    For results that are written or read to the end: what reads these tables again afterwards fails.
    """
    held = [_held.pop() for _ in range(len(_held) - since)]
    removed = 0
    for path in held:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        removed += place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    return removed


@contextmanager
def released_work(spark: SparkSession) -> Iterator[None]:
    """``with released_work(spark): frame.write...``: tables that were written inside are removed at the end."""
    before = len(_held)
    try:
        yield
    finally:
        release_work(spark, before)
