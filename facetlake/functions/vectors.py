"""Sparse vectors as long tables (key columns, term, weight) and dense ones as arrays.

Joins of tables that grow with the input ask for a merge: Spark's estimate of exploded or
well-compressed rows is far too low, and it would broadcast them through the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def unit(vectors: DataFrame, keys: Sequence[str], weight: str = "weight") -> DataFrame:
    """L2-normalised weights; zero weights, and so zero vectors, have no rows."""
    norm = F.sqrt(F.sum(F.col(weight) * F.col(weight)).over(Window.partitionBy(*keys)))
    return vectors.filter(F.col(weight) != 0).withColumn(weight, F.col(weight) / norm)


def tfidf(documents: DataFrame, keys: Sequence[str], tokens: str = "tokens", times: str | None = None) -> DataFrame:
    """(keys, term, weight): counts times ln((1 + N) / (1 + df)) + 1, L2-normalised.

    N counts all documents, also those without a token. Terms are counted before
    they are shuffled; N is a scalar subquery. A document stands for as many as ``times`` says.
    """
    each = F.col(times) if times else F.lit(1)
    terms = documents.select(*keys, each.alias("times"), F.explode(tokens).alias("term")).groupBy(*keys, "term").agg(F.count("*").alias("n"), F.first("times").alias("times"))
    seen = terms.groupBy("term").agg(F.sum("times").alias("df"))
    total = documents.agg(F.coalesce(F.sum(each), F.lit(0)).alias("total")).scalar()
    weight = F.col("n") * (F.log((1 + F.col("total")) / (1 + F.col("df"))) + 1)
    return unit(terms.join(seen.hint("shuffle_hash"), "term").withColumn("total", total).select(*keys, "term", weight.alias("weight")), keys)


def normalized(weights: DataFrame, keys: Sequence[str], weight: str = "weight") -> tuple[DataFrame, DataFrame]:
    """(weights that add up to 1 under each key, keys that can't be normalised: a negative or missing weight, or no positive one)."""
    rows = Window.partitionBy(*keys)
    total = F.sum(weight).over(rows)
    bad = weights.groupBy(*keys).agg(F.sum(weight).alias("total"), F.min(weight).alias("least"), F.count_if(F.col(weight).isNull()).alias("missing"))
    wrong = bad.filter((F.col("missing") > 0) | (F.col("least") < 0) | ~(F.coalesce("total", F.lit(0.0)) > 0)).select(*keys)
    return weights.withColumn(weight, F.try_divide(F.col(weight), total)), wrong


def one_hot(concepts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Unit vectors with equal weights on a key's distinct terms."""
    return unit(concepts.select(*keys, "term").distinct().withColumn("weight", F.lit(1.0)), keys)


def dots(left: DataFrame, right: DataFrame, on: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Sums of products by ``keep`` columns; keys without a common term have no row."""
    a, b = left.withColumnRenamed("weight", "weight_a"), right.withColumnRenamed("weight", "weight_b")
    return a.join(b.hint("merge"), list(on)).groupBy(*keep).agg(F.sum(F.col("weight_a") * F.col("weight_b")).alias("score"))


def dense_dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def clipped(cosine: Column) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))


def decay(age_seconds: Column, half_life_days: float) -> Column:
    return F.pow(F.lit(2.0), -age_seconds / (86400.0 * half_life_days))


def age(cutoff: Column, time: Column) -> Column:
    """Seconds, with microseconds, from ``time`` to ``cutoff``."""
    return (F.unix_micros(cutoff) - F.unix_micros(time)) / F.lit(1e6)


def hashed_unit(*parts: Column | str) -> Column:
    """A number in [0, 1) that depends on its parts alone (the first 52 bits of their MD5)."""
    text = F.concat_ws(":", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))
