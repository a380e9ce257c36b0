import pytest

from tests.conftest import DATA
from tidework import Catalog, Workbench


@pytest.fixture(scope="module")
def bench(spark):
    return Workbench(Catalog.from_folder(spark, DATA, {"events": "ts", "orders": "o_orderdate"}))


def test_a_session(bench):
    assert "events" in bench.measurements()
    scan = bench.query_table("events", "2024-01-02T00:00:00Z", "2024-01-03T00:00:00Z", limit=1000)
    assert scan["preview"]["columns"][-2:] == ["ts_ns", "ts_s"]
    times = [row["ts"] for row in scan["preview"]["data"]]
    assert len(times) == 339 and times == sorted(times)

    clicks = bench.sql_transform(scan["dataset_id"], "SELECT user_id, count(*) AS n FROM df GROUP BY user_id", limit=5)
    assert len(clicks["preview"]["data"]) == 5
    joined = bench.sql_join(scan["dataset_id"], clicks["dataset_id"], "user_id", "user_id", "left", limit=3)
    assert joined["preview"]["columns"][-2:] == ["user_id_right", "n_right"]
    assert len(bench.dataset(joined["dataset_id"])["data"]) == 100
    assert len(bench.dataset(joined["dataset_id"], None)["data"]) == 339

    bench.datasets.remove(joined["dataset_id"])
    for call in (bench.dataset, bench.datasets.remove):
        with pytest.raises(ValueError, match="no dataset"):
            call(joined["dataset_id"])
    with pytest.raises(ValueError, match="no dataset 'x'"):
        bench.sql_transform("x", "SELECT 1")


def test_an_empty_range_is_an_empty_table(bench):
    scan = bench.query_table("events", "2030-01-02T00:00:00Z", "2030-01-03T00:00:00Z")
    assert scan["preview"]["data"] == [] and "value" in scan["preview"]["columns"]


def test_a_step_over_a_table_reaches_the_files(bench, plan):
    scan = bench.query_table("events", "2024-01-02T00:00:00Z", "2024-01-03T00:00:00Z", limit=1)
    clicks = bench.sql_transform(scan["dataset_id"], "SELECT value FROM df WHERE event_type = 'click'", limit=1)
    text = plan(bench.datasets.get(clicks["dataset_id"]), run=False)
    assert "EqualTo(event_type,click)" in text and "props" not in text and "Exchange" not in text
    assert "rangepartitioning" in plan(bench.datasets.get(scan["dataset_id"]), run=False)
