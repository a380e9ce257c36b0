"""The next document of every row by plain Python: ties, null keys, repeated rows, many ranges; likeness of shifted texts."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidework.llm import fingerprints


@pytest.fixture()
def many_ranges(spark):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    yield lambda n: spark.conf.set("spark.sql.shuffle.partitions", str(n))
    spark.conf.set("spark.sql.shuffle.partitions", old)


def edited(text: str, after: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def order(spark, texts: set[str]) -> dict[str, tuple]:
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.xxhash64("t"), F.hash("t")).collect()
    return {r[0]: (r[1], r[2]) for r in rows}


def check(spark, rows: list[tuple]) -> None:
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    hashes = order(spark, {t or "" for _, t in rows})
    rows = [(k, t or "") for k, t in rows]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, *hashes[r[1]]), reverse=True)
    want = Counter(
        (k, len(t), hashlib.sha256(edited(t, rows[(n + 1) % len(rows)][1]).encode()).hexdigest()) for n, (k, t) in enumerate(rows)
    )
    found = fingerprints.edited_fingerprints(frame).select("doc_id", "n_chars", "edited_sha256").collect()
    assert Counter(map(tuple, found)) == want


@pytest.mark.parametrize("ranges", [1, 7, 60])
def test_next_rows_with_ties_and_null_keys(spark, many_ranges, ranges):
    many_ranges(ranges)
    pick = random.Random(ranges)
    words = ["one", "two\n", "drei", "漢字", ""]
    rows = [(pick.choice([None, 5, 7, pick.randrange(900)]), " ".join(pick.choices(words, k=pick.randint(0, 9)))) for _ in range(400)]
    check(spark, rows + [(pick.randrange(9), None)] * 3)
    check(spark, rows[:1])
    check(spark, [(None, f"text {i}") for i in range(300)])


@pytest.mark.parametrize("ranges", [4, 30])
def test_next_rows_of_equal_rows(spark, many_ranges, ranges):
    """More equal rows than a list of copies holds, beside others of their key, at both ends and in the middle."""
    many_ranges(ranges)
    others = [(i, f"text of {i}") for i in range(1500)]
    check(spark, others + [(700, "the same words again")] * 2500)
    check(spark, others + [(None, "the same words again")] * 900)
    check(spark, [(3, "only this")] * 40)


@pytest.mark.parametrize("keys", ["CASE WHEN id % 3 > 0 THEN id END", "if(id % 3 = 0, 7, id)", "if(id % 3 = 0, NULL, 7)"])
def test_rows_of_one_key_are_spread_over_ranges(spark, many_ranges, keys):
    many_ranges(20)
    rows = spark.range(0, 6000, 1, 8).selectExpr(f"{keys} AS id", "string(hash(id)) AS text", "bigint(1) AS times")
    place = F.struct(F.col("id").isNotNull().alias("known"), "id", F.xxhash64("text").alias("a"), F.hash("text").alias("b"))
    follow = fingerprints._neighbours(rows.withColumn("place", place))
    largest = follow.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert follow.count() == 6000 and largest < 1800


def test_more_ranges_than_rows_of_a_file(spark, documents, many_ranges):
    many_ranges(211)
    few = fingerprints.edited_fingerprints(documents).collect()
    many_ranges(8)
    assert sorted(map(tuple, few)) == sorted(map(tuple, fingerprints.edited_fingerprints(documents).collect()))


def test_many_ranges_are_planned(spark, many_ranges):
    many_ranges(3000)
    rows = [(i % 900, f"some text {i}") for i in range(1000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    plan = fingerprints.edited_fingerprints(frame)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") <= 3


def test_a_word_in_front_leaves_texts_alike(spark):
    pick = random.Random(8)
    words = ["river", "stone", "cloud", "and", "the", "over", "brown", "field", "of", "small", "was", "never", "walked"]
    text = " ".join(pick.choice(words) for _ in range(900))
    rows = [(2, "Added " + text), (1, text), (0, " ".join(pick.choice(words) + "x" for _ in range(900)))]
    found = {r.doc_id: r.near_next for r in fingerprints.edited_fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[2] > 0.9 and found[1] < 0.4


def test_no_rows_and_other_columns(spark, nothing, awkward):
    assert fingerprints.edited_fingerprints(nothing).count() == 0
    clash = awkward.withColumns({"place": F.lit(1), "times": F.lit(2), "range": F.lit(3), "id": F.lit("x"), "mine": F.lit(0)})
    assert fingerprints.edited_fingerprints(clash).exceptAll(fingerprints.edited_fingerprints(awkward)).count() == 0
