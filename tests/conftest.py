from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tidework import build_session  # noqa: E402

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.sql.maxMetadataStringLength": "10000",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("work")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def table(spark):
    return lambda name: spark.read.parquet(f"{DATA}/{name}.parquet")


@pytest.fixture(scope="session")
def telemetry(spark):
    """Ten seconds of battery readings with all the awkward cells."""
    return spark.sql(
        r"""
        SELECT * FROM VALUES
          (TIMESTAMP'2024-07-25 16:46:59.999999Z', 'BAT1', 3.7D, 1L, '12abc'),
          (TIMESTAMP'2024-07-25 16:47:00Z', 'BAT1', 3.6D, 2L, ' -3.5e2x'),
          (TIMESTAMP'2024-07-25 16:47:03.123456Z', 'BAT2', NULL, 3L, '.5'),
          (TIMESTAMP'2024-07-25 16:47:03.123456Z', 'BAT1', double('NaN'), NULL, '1e'),
          (TIMESTAMP'2024-07-25 16:47:07Z', NULL, 3.5D, -4L, 'abc'),
          (TIMESTAMP'2024-07-25 16:47:08Z', 'BAT2', 3.25D, 5L, ''),
          (TIMESTAMP'2024-07-25 16:47:09Z', 'BAT2', 100.0D, 6L, NULL),
          (TIMESTAMP'2024-07-25 16:47:10Z', 'BAT1', 1e21D, 7L, 'say "hi", AND go'),
          (TIMESTAMP'2024-07-25 16:47:10.000001Z', 'BAT1', 3.3D, 8L, 'late')
        AS t(time, unit, voltage, cycles, note)
        """
    )


@pytest.fixture(scope="session")
def plan():
    """The final plan of a frame as text, after running it."""

    def text(df, run: bool = True) -> str:
        if run:
            df.collect()
        return df._jdf.queryExecution().executedPlan().toString()

    return text
