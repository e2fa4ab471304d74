"""Quality gates: each is a DataFrame of violations; ``require_none`` turns one into an error."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class GateError(ValueError):
    """A gate found violations."""


def require_none(violations: DataFrame, message: str) -> None:
    """Raise with up to three violations; reads no more than those."""
    if found := violations.limit(3).collect():
        raise GateError(f"{message}: {[r.asDict() for r in found]}")


def violations(df: DataFrame, **rules: Column) -> DataFrame:
    """(rule, n_violations) for each rule; a null counts as a violation. One pass over the data."""
    counted = df.agg(*[F.count_if(~F.coalesce(c, F.lit(False))).alias(name) for name, c in rules.items()])
    return counted.select(F.inline(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("n_violations")) for n in rules])))


def concept_list(column: str) -> Column:
    """A list of trimmed, nonempty concepts, each once whatever its case; empty lists are fine, null is not."""
    trimmed = F.forall(column, lambda c: (F.trim(c) == c) & (c != ""))
    once = F.size(F.array_distinct(F.transform(column, F.lower))) == F.size(column)
    return F.col(column).isNotNull() & trimmed & once


def bad_pools(cases: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """(cases whose pool has another size, repeated papers of a pool)."""
    return cases.groupBy("case_id").count().filter(F.col("count") != size), repeated(cases, ["case_id", "paper_id"])


def check_schema(df: DataFrame, wanted: dict[str, str]) -> None:
    """Exactly these columns, of these types."""
    if (got := dict(df.dtypes)) != wanted:
        raise GateError(f"schema differs: {got} instead of {wanted}")


def repeated(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).count().filter("count > 1")


def conflicting(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys whose rows are not all the same; identical repeats are allowed."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("a"), F.max(F.struct(*rest)).alias("b")).filter("not (a <=> b)").select(*keys)


def once(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row a key, after the gate that repeats are identical."""
    require_none(conflicting(df, keys), "rows with one key differ")
    return df.dropDuplicates(list(keys))


def orphans(child: DataFrame, parent: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``child`` whose key is not in ``parent``."""
    return child.join(parent.select(*keys).distinct(), list(keys), "left_anti")


def differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of either side that the other lacks, as often as it lacks them; side says which has them."""
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.select(*left.columns).exceptAll(left).withColumn("side", F.lit("right")))


def split_leaks(rows: DataFrame, anchor: str, split: str = "split") -> DataFrame:
    """Anchors in more than one split."""
    return rows.groupBy(anchor).agg(F.min(split).alias("a"), F.max(split).alias("b")).filter("a <> b").select(anchor)


def temporal_leaks(history: DataFrame, holdout: DataFrame, user: str = "user_id", ts: str = "ts") -> DataFrame:
    """Users whose latest history is not before their earliest holdout, or who are on one side only."""
    h = history.groupBy(user).agg(F.max(ts).alias("last_seen"))
    o = holdout.groupBy(user).agg(F.min(ts).alias("first_held"))
    return h.join(o, user, "full_outer").filter("last_seen is null or first_held is null or last_seen >= first_held")


def not_increasing(rows: DataFrame, keys: Sequence[str], order: Sequence[str], ts: str = "ts") -> DataFrame:
    """Rows not later than the row before them under the same key."""
    before = F.lag(ts).over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("before", before).filter(F.col(ts) <= F.col("before"))


def bad_parents(rows: DataFrame, child: str, parent: str, same: Sequence[str], ts: str = "ts") -> DataFrame:
    """Rows that name a parent which is missing, differs in ``same``, or is not earlier."""
    parents = rows.select(F.col(child).alias("p_id"), *[F.col(c).alias(f"p_{c}") for c in same], F.col(ts).alias("p_ts"), F.lit(True).alias("known"))
    joined = rows.filter(F.col(parent).isNotNull()).join(parents, F.col(parent) == F.col("p_id"), "left")
    agree = F.col("known") & (F.col("p_ts") < F.col(ts))
    for c in same:
        agree &= F.col(c).eqNullSafe(F.col(f"p_{c}"))
    return joined.filter(~F.coalesce(agree, F.lit(False))).select(*rows.columns)


def incomplete(predictions: DataFrame, cases: DataFrame, models: Sequence[str]) -> DataFrame:
    """(case_id, model, paper_id) that a ranking lacks, has twice or should not have; models is a short list."""
    wanted = cases.select("case_id", "paper_id").withColumn("model", F.explode(F.array(*map(F.lit, models))))
    got = predictions.groupBy("case_id", "model", "paper_id").agg(F.count("*").alias("n"))
    return wanted.withColumn("wanted", F.lit(True)).join(got, ["case_id", "model", "paper_id"], "full_outer").filter("wanted is null or n is null or n > 1").select("case_id", "model", "paper_id")


def bad_rankings(rows: DataFrame) -> DataFrame:
    """Rows of (case_id, model, paper_id, score, rank) with a score that is not finite or out of order."""
    order = Window.partitionBy("case_id", "model").orderBy("rank")
    before, item = F.lag("score").over(order), F.lag("paper_id").over(order)
    wrong = (F.col("score") > before) | ((F.col("score") == before) & (F.col("paper_id") < item))
    odd = F.isnan("score") | F.col("score").isin(float("inf"), float("-inf")) | F.col("score").isNull()
    return rows.withColumn("wrong", odd | F.coalesce(wrong, F.lit(False))).filter("wrong").drop("wrong")
