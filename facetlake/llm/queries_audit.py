"""Queries of hard negatives and of the filter interaction audit, and their SQL."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetlake.llm.common import table
from facetlake.llm.interaction import audit_text_filters
from facetlake.llm.negatives import mine_negatives


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    moved = F.when(F.pmod("vec_id", F.lit(7)) == 0, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label"))
    return mine_negatives(vectors.select("vec_id", "embedding", moved.alias("label")))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_text_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op12_hard_negatives": op12_hard_negatives, "op13_filter_audit": op13_filter_audit}

OP12_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.rid AS a, a.vec_id AS anchor_id, b.rid AS b, b.vec_id AS vec_id, a.label = b.label AS same,
    list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i]))::BIGINT AS score
  FROM v a JOIN v b ON a.rid <> b.rid WHERE a.vec_id % 50 = 0),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id) <= 5),
n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.vec_id) AS rank,
    s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
  FROM p JOIN s ON p.a = s.a AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""

_ORDERS = ", ".join(f"('{''.join(p)}')" for p in permutations("ABCDE"))
_COUNT = "coalesce(sum({c}) FILTER ({test}), 0)::BIGINT"
_BEFORE = "(mask & before) = 0"

OP13_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(source, '') AS part, coalesce(text, '') AS x,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
least AS (SELECT x, min(doc_id) AS first FROM d GROUP BY x),
lab AS (SELECT doc_id, max((coalesce(quality, 0) = 1)::INT) AS good, max((coalesce(toxic, 0) = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
m AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    (len(words) < 50)::INT + 2 * (100 * len(list_distinct(words)) < 65 * len(words))::INT
    + 4 * (100 * (length(x) - length(regexp_replace(x, '[A-Z]', '', 'g'))) > 5 * length(x))::INT
    + 8 * regexp_matches(x, '[#$%&*|]')::INT + 16 * coalesce(first < d.doc_id, false)::INT AS mask
  FROM d JOIN least USING (x) LEFT JOIN lab ON d.doc_id = lab.doc_id),
cells AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, mask),
orders(filter_order) AS (VALUES {_ORDERS}),
steps AS (SELECT filter_order, step, substr(filter_order, step, 1) AS f, substr(filter_order, 1, step - 1) AS earlier FROM orders, range(1, 6) r(step)),
coded AS (
  SELECT filter_order, step, f, 1 << (ascii(f) - 65) AS bit,
    list_sum(list_transform([0, 1, 2, 3, 4], lambda i: CASE WHEN contains(earlier, chr((65 + i)::INT)) THEN 1 << i ELSE 0 END))::INT AS before
  FROM steps),
r AS (
  SELECT part, filter_order, step::INT AS step, f,
    {_COUNT.format(c="n", test=f"{_BEFORE} AND (mask & bit) = 0")} AS kept,
    {_COUNT.format(c="n", test=f"{_BEFORE} AND (mask & bit) <> 0")} AS removed,
    {_COUNT.format(c="n", test="(mask & before) <> 0 AND (mask & bit) <> 0")} AS redundant,
    {_COUNT.format(c="n", test="mask = bit")} AS unique_fails,
    {_COUNT.format(c="good", test=f"{_BEFORE} AND (mask & bit) <> 0")} AS good_lost,
    {_COUNT.format(c="toxic", test=f"{_BEFORE} AND (mask & bit) <> 0")} AS toxic_lost
  FROM cells, coded GROUP BY part, filter_order, step, f)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM r
"""

ORACLE = {"op12_hard_negatives": OP12_SQL, "op13_filter_audit": OP13_SQL}
