"""Tables as the operators want them: parts as papers with facets, events as behaviour.

A part's name words, type, brand and size class are its five facets. Small parts
have no brand evidence and large ones no size class, so that empty facets occur.
An event is a reaction of its user to the part with the number in its properties.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetlake.functions import text as T

REACTIONS = {"error": "dislike", "view": "view", "click": "click", "signup": "save", "purchase": "like"}
CUTOFF, RECENT, UNTIL = "2024-01-20 00:00:00", "2024-01-10 00:00:00", "2024-01-31 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def part_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("paper_id"), F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("text"))


def part_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    name = F.split("p_name", " ")
    facets = [("problem", F.get(name, F.lit(0))), ("task", F.get(name, F.lit(1))), ("method", F.col("p_type")), ("dataset", F.when(F.col("p_size") > 3, F.col("p_brand"))), ("contribution", F.when(F.col("p_size") <= 45, F.concat(F.lit("size"), F.floor(F.col("p_size") / 10).cast("string"))))]
    long = part.select(F.col("p_partkey").alias("paper_id"), F.inline(F.array(*[F.struct(F.lit(f).alias("facet"), c.alias("concept")) for f, c in facets])))
    return long.filter("concept is not null").select("paper_id", "facet", T.normalized(F.lower("concept")).alias("concept"))


def reactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.create_map(*[x for k, v in REACTIONS.items() for x in (F.lit(k), F.lit(v))])
    return table(spark, sf_dir, "events").select("event_id", "user_id", F.get_json_object("props", "$.k").cast("bigint").alias("paper_id"), F.element_at(kinds, F.col("event_type")).alias("interaction_type"), F.col("ts").cast("timestamp").alias("ts"))


def timed_cases(spark: SparkSession, sf_dir: str, cutoff: str = CUTOFF, until: str = UNTIL) -> tuple[DataFrame, DataFrame]:
    """Users with their cutoff, and their candidates: what they react to from the cutoff on."""
    rows = reactions(spark, sf_dir)
    cut, end = F.to_timestamp(F.lit(cutoff)), F.to_timestamp(F.lit(until))
    users = rows.select("user_id").distinct().select(F.col("user_id").alias("case_id"), "user_id", cut.alias("cutoff"), end.alias("until"))
    pool = rows.filter((F.col("ts") >= cut) & (F.col("ts") < end)).select("user_id", "paper_id").distinct()
    return users, users.join(pool.hint("merge"), "user_id").select("case_id", "user_id", "cutoff", "until", "paper_id")


WEIGHT_SQL = "CASE event_type WHEN 'error' THEN -1 WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'signup' THEN 2 WHEN 'purchase' THEN 3 END"
BASE_SQL = f"""
concepts AS (
  SELECT paper_id, facet, array_to_string(regexp_extract_all(lower(concept), '[\\p{{L}}\\p{{M}}\\p{{N}}_]+'), ' ') AS concept FROM (
    SELECT p_partkey AS paper_id, 'problem' AS facet, string_split(p_name, ' ')[1] AS concept FROM part
    UNION ALL SELECT p_partkey, 'task', string_split(p_name, ' ')[2] FROM part
    UNION ALL SELECT p_partkey, 'method', p_type FROM part
    UNION ALL SELECT p_partkey, 'dataset', p_brand FROM part WHERE p_size > 3
    UNION ALL SELECT p_partkey, 'contribution', 'size' || (p_size // 10) FROM part WHERE p_size <= 45) WHERE concept IS NOT NULL),
facet_names AS (SELECT unnest(['problem', 'task', 'method', 'dataset', 'contribution']) AS facet),
reactions AS (
  SELECT event_id, user_id, (props->>'k')::BIGINT AS paper_id, {WEIGHT_SQL} AS w,
    CASE event_type WHEN 'error' THEN 'dislike' WHEN 'view' THEN 'view' WHEN 'click' THEN 'click' WHEN 'signup' THEN 'save' ELSE 'like' END AS interaction_type, ts FROM events),
pool AS (SELECT DISTINCT user_id, paper_id FROM reactions WHERE ts >= TIMESTAMP '{CUTOFF}' AND ts < TIMESTAMP '{UNTIL}'),
seen AS (SELECT * FROM reactions WHERE ts < TIMESTAMP '{CUTOFF}')
"""
#: Words of two characters or more, as Spark's Unicode classes see them.
TOKENS_SQL = r"regexp_extract_all(array_to_string(regexp_extract_all(lower({0}), '[\p{{L}}\p{{M}}\p{{N}}_]+'), ' '), '[\p{{L}}\p{{M}}\p{{N}}_]{{2,}}')"


def tokens_sql(column: str) -> str:
    return TOKENS_SQL.format(column)
