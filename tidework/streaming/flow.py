"""Workflow steps on streams.

Scans, conditions, SQL without aggregation over all time, joins that keep the
stream's side, and series work on a streaming frame as they are. What needs all
rows at once does not: global order, and joins that keep a table's unmatched
rows. Spark refuses those when the stream starts; `in_order` already when the
plan is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def append_available(
    df: DataFrame, path: str, checkpoint: str, file_format: str = "parquet", partition_by: list[str] | None = None
) -> StreamingQuery:
    """Append the rows that have come since the last run, then stop.

    The checkpoint folder remembers what was read, so a run that was cut short
    goes on without loss or repetition. Both folders must be shared storage.
    """
    writer = df.writeStream.format(file_format).outputMode("append").option("checkpointLocation", checkpoint)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    return writer.trigger(availableNow=True).start(path)
