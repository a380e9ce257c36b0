"""The queries of this subpackage: each applies an operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidework.llm import (
    embedding_dedup,
    fingerprints,
    hard_negatives,
    interpolation,
    language,
    mixing,
    ngram_join,
    packing,
    periodic_runs,
    quality,
    secret_scan,
    token_counts,
    toxicity,
)
from tidework.llm.common import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    def register(run: Callable) -> Callable:
        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return run

    return register


@query("op1_quality_convolution")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality_scores(read(spark, folder, "documents"), read(spark, folder, "labels"))


@query("op2_secret_randomness")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return secret_scan.secret_spans(read(spark, folder, "documents"))


@query("op3_deleted_interpolation")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return interpolation.interpolated_scores(read(spark, folder, "documents"))


@query("op4_multiset_fingerprint", fingerprints.sql())
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.edited_fingerprints(read(spark, folder, "documents"))


@query("op5_language_kernel")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return language.language_ids(read(spark, folder, "documents"))


@query("op6_pivotal_mixing")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mixture(read(spark, folder, "documents")).drop("row_a", "row_b")


@query("op7_best_two_fit_packing")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(read(spark, folder, "documents"))


@query("op8_toxicity_unlabelled")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity_scores(read(spark, folder, "documents"), read(spark, folder, "labels"))


# Every pair is found with probability 0.9999 or more; the SQL compares all pairs that share an n-gram.
NGRAM_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
grams AS (
  SELECT DISTINCT doc_id, hash(array_to_string(w[i:i + least(5, len(w)) - 1], ' ')) AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c
  FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT x, y, c = p.n AND c = q.n AS same FROM pairs JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
  WHERE c >= 0.8 * (p.n + q.n - c)),
edges AS (SELECT x, y, same FROM links UNION ALL SELECT y, x, same FROM links),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, b.y FROM reach r JOIN edges b ON r.y = b.x),
least_of AS (SELECT x AS doc_id, min(y) AS class_id FROM reach GROUP BY x),
sets AS (SELECT d.doc_id, least(d.doc_id, min(b.y)) AS set_id
         FROM documents d LEFT JOIN edges b ON b.x = d.doc_id AND b.same GROUP BY d.doc_id),
counts AS (SELECT b.x AS doc_id, count(*) AS n_links,
                  count(DISTINCT s.set_id) FILTER (NOT same) AS n_class_links
           FROM edges b JOIN sets s ON s.doc_id = b.y GROUP BY b.x)
SELECT d.doc_id, class_id, set_id, coalesce(n_links, 0) AS n_links, coalesce(n_class_links, 0) AS n_class_links
FROM documents d JOIN least_of USING (doc_id) JOIN sets USING (doc_id) LEFT JOIN counts USING (doc_id)
"""


@query("op9_ngram_jaccard_join", NGRAM_SQL)
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.jaccard_join(read(spark, folder, "documents")).drop("row_a", "row_b", "component")


VECTOR_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
least_of AS (SELECT x AS vec_id, min(y) AS component_id FROM reach GROUP BY x),
counts AS (SELECT x AS vec_id, count(*) AS n_links FROM links GROUP BY x)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM least_of LEFT JOIN counts USING (vec_id)
"""


@query("op10_embedding_multi_index", VECTOR_SQL)
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return embedding_dedup.near_vectors(read(spark, folder, "embeddings"))


# All pairs of equal words of a text, no further apart than a third of it; neighbours of one distance are a run.
RUNS_SQL = r"""
WITH hashes AS (
  SELECT doc_id, text, xor(list_reduce(list_prepend(4294967295, list_transform(
           string_split(doc_id::VARCHAR, ''), lambda d: ascii(d)::BIGINT)),
           lambda sum, byte: list_reduce(list_prepend(xor(sum, byte), range(8)),
             lambda bits, k: xor(bits // 2, 3988292384 * (bits % 2)))), 4294967295) AS h
  FROM documents),
plain AS (
  SELECT doc_id, h, h // 10 AS g, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'),
           lambda x: x <> '') AS w, len(w) AS n FROM hashes),
loops AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN g % n ELSE n END AS a, (n - a) // (3 + g % 8) + 1 AS p FROM plain),
words AS (
  SELECT doc_id, n, i, CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % p + 1] END AS word
  FROM (SELECT *, unnest(range(n)) AS i FROM loops)),
pairs AS (
  SELECT x.doc_id, x.i, y.i - x.i AS q
  FROM words x JOIN words y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 3 * (y.i - x.i) <= x.n),
stretches AS (
  SELECT doc_id, q, min(i) AS s, count(*) + q AS len
  FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM pairs)
  GROUP BY doc_id, q, island HAVING count(*) + q >= greatest(24, 3 * q)),
runs AS (SELECT doc_id, s, len, min(q) AS q FROM stretches GROUP BY ALL),
most AS (
  SELECT a.* FROM runs a WHERE NOT EXISTS (
    SELECT 1 FROM runs b WHERE b.doc_id = a.doc_id AND (b.len * a.q > a.len * b.q
      OR b.len * a.q = a.len * b.q AND (b.s < a.s OR b.s = a.s AND b.q < a.q)))),
listed AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q) AS lines
  FROM runs GROUP BY doc_id),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM words w
  WHERE NOT EXISTS (SELECT 1 FROM runs r WHERE r.doc_id = w.doc_id AND w.i >= r.s + r.q AND w.i < r.s + r.len)
  GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, s AS start, len AS length, q AS period,
       1000 * len // q AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256,
       sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM documents d LEFT JOIN most USING (doc_id) LEFT JOIN listed USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


@query("op11_periodic_runs", RUNS_SQL)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    documents = periodic_runs.with_loops(read(spark, folder, "documents"))
    return periodic_runs.digests(periodic_runs.periodic_runs(documents))


NEGATIVES_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e, len(embedding) AS wide
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_dot_product(a.e, b.e)::BIGINT AS score
  FROM v a JOIN v b ON a.wide = b.wide AND a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER w)::INTEGER AS rank, id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scores USING (anchor_id)
WHERE NOT same AND 100 * score BETWEEN 80 * positive_score AND 100 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)
QUALIFY row_number() OVER w <= 5
"""


@query("op12_hard_negatives", NEGATIVES_SQL)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    sevenths = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = read(spark, folder, "embeddings").withColumn("label", sevenths)
    return hard_negatives.hard_negatives(vectors, F.col("vec_id") % 100 == 0)


@query("op13_token_counts")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.token_counts(read(spark, folder, "documents"))
