"""Long texts are learned from, in pieces of a bounded length."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from tidework.llm import language, quality
from tidework.llm.common import PIECES, fold, labelled_texts, spread_pieces


def test_pieces_are_spread_over_the_text(spark):
    texts = [bytes(range(256)) * n for n in (0, 1, 3, 40)]
    frame = spark.createDataFrame([(i, bytearray(t)) for i, t in enumerate(texts)], "id int, t binary")
    found = dict(frame.select("id", spread_pieces(F.col("t"), 800)).collect())
    for i, text in enumerate(texts):
        if len(text) <= 800:
            assert bytes(found[i]) == text
        else:
            starts = [(len(text) - 100) * k // (PIECES - 1) for k in range(PIECES)]
            assert bytes(found[i]) == b"".join(text[s : s + 100] for s in starts) and len(found[i]) == 800
    assert starts[0] == 0 and starts[-1] == len(texts[-1]) - 100


def test_a_long_labelled_text_is_not_left_out(spark):
    documents = spark.createDataFrame([(1, "short"), (2, "long " * 10_000), (3, None)], "doc_id long, text string")
    picked = spark.createDataFrame([(1, 0), (2, 1), (3, 1)], "doc_id long, y int")
    rows = labelled_texts(documents, picked, "doc_id", "text", "y", 1000)
    assert [(y, k, len(t)) for y, k, t in rows] == [(0, 1, 5), (1, 2, 1000)]


def test_a_language_that_is_in_long_texts_only_is_predicted(spark):
    pick = random.Random(2)
    kinds = {"aa": "kalo mira sote vanu".split(), "bb": "xhyr quoz bjark fflim".split()}
    rows = []
    for i in range(160):
        lang = "bb" if i % 4 == 0 else "aa"
        count = 5000 if lang == "bb" else 30
        rows.append((i, " ".join(pick.choice(kinds[lang]) for _ in range(count)), lang))
    documents = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = language.language_ids(documents).join(documents, "doc_id").where(F.col("held_out"))
    assert found.where("lang = 'bb'").count() >= 5
    assert found.where("lang_pred <> lang").count() == 0


def test_a_label_of_long_texts_only_is_learned(spark):
    pick = random.Random(3)
    rows = []
    for i in range(150):
        good = i % 3 > 0
        words = ["river", "stone", "walked", "over", "the"] if good else ["$$", "CLICK", "###", "!!!", "buy"]
        rows.append((i, " ".join(pick.choice(words) for _ in range(60 if good else 9000)), int(good)))
    documents = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    found = quality.quality_scores(documents.select("doc_id", "text"), documents.selectExpr("doc_id", "quality", "0 AS toxic"))
    wrong = found.join(documents, "doc_id").where(fold("doc_id", 3) == 1).where("predicted <> quality").count()
    assert wrong == 0
