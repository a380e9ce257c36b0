"""The pipeline stage by stage, and the queries that SQL can express."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from tests.compare import FOLDER, database, difference
from tests.llm.conftest import FOLDER as SMALL
from tests.llm.test_operators import _brute, _components
from tidework.llm.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, name):
    assert difference(spark, database(FOLDER), FOLDER, name) is None


def test_all_queries_are_registered():
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())
    assert {name.split("_")[0] for name in QUERIES} == {f"op{i}" for i in range(1, 14)}


def test_pipeline(spark, documents):
    rows = documents
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r for r in rows.collect()}
        rows = stage(spark, rows, SMALL)
        assert rows.columns == documents.columns
        kept[name] = rows.collect()
        if name == "ngram_jaccard_join":
            classes = _components(before, _brute({k: r.text for k, r in before.items()}))
            assert {r.doc_id for r in kept[name]} == set(classes.values())
        elif name == "secret_scans":
            assert {r.doc_id for r in kept[name]} == set(before)
        rows = spark.createDataFrame(kept[name], documents.schema)
    pieces = corpus_pipeline.STAGES[-1][1](spark, rows, SMALL).collect()
    whole = corpus_pipeline.run(spark, SMALL).collect()
    key = lambda r: (r.doc_id, r.piece, r.ids_crc32, r.length)
    assert sorted(map(key, pieces)) == sorted(map(key, whole))
