"""A whole experiment validated as one table of violations (name, rule, key).

Each table is read at most twice: once as the heads that others refer to (a row a key, with
how often the key occurs), once with all rules marked on its rows side by side. So a broken
experiment shows all its faults at once, and ``require_valid`` is one job.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facetlake.operators.gates import GateError
from facetlake.operators.profiles import BEHAVIORS

SIDES = ("train", "dev", "test")


def marked(df: DataFrame, name: str, key: Column, rules: Mapping[str, Column]) -> DataFrame:
    """(name, rule, key) for each row and rule that doesn't hold; a null counts as broken."""
    broken = F.filter(F.array(*[F.when(~F.coalesce(holds, F.lit(False)), rule) for rule, holds in rules.items()]), lambda r: r.isNotNull())
    return df.select(F.lit(name).alias("name"), F.explode(broken).alias("rule"), key.cast("string").alias("key"))


def heads(df: DataFrame, key: str, columns: Sequence[str], prefix: str) -> DataFrame:
    """A row for each key: how often it occurs (n), and the least row's columns under the prefix."""
    least = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"), F.min(F.struct(*columns)).alias("head"))
    return least.select(F.col(key).alias(f"{prefix}_key"), F.col("n").alias(f"{prefix}_n"), *[F.col(f"head.{c}").alias(f"{prefix}_{c}") for c in columns])


def repeated(found: DataFrame, name: str, prefix: str) -> DataFrame:
    return found.filter(F.col(f"{prefix}_n") > 1).select(F.lit(name).alias("name"), F.lit("repeated_id").alias("rule"), F.col(f"{prefix}_key").cast("string").alias("key"))


def log_violations(searches: DataFrame, exposures: DataFrame, interactions: DataFrame, size: int | None = None) -> DataFrame:
    """The rules of a log: every id once; a parent search earlier in its session; an exposure after its own search, with
    ``size`` distinct papers; a reaction of a known kind after the exposure that showed its paper; times that rise in a session.

    searches: query_id, user_id, session_id, parent_query_id, ts; exposures: exposure_id, user_id, session_id, query_id,
    paper_ids, ts; interactions: user_id, paper_id, interaction_type, session_id, exposure_id, ts.
    """
    who = ["user_id", "session_id", "ts"]
    asked, shown = heads(searches, "query_id", who, "q"), heads(exposures, "exposure_id", [*who, "paper_ids"], "x")
    after = lambda p: F.col(f"{p}_user_id").eqNullSafe(F.col("user_id")) & F.col(f"{p}_session_id").eqNullSafe(F.col("session_id")) & (F.col(f"{p}_ts") < F.col("ts"))
    parents = searches.join(asked, F.col("parent_query_id") == F.col("q_key"), "left")
    of_searches = marked(parents, "searches", F.col("query_id"), {"bad_parent": F.col("parent_query_id").isNull() | after("q")})
    own = exposures.join(asked, F.col("query_id") == F.col("q_key"), "left")
    papers = {"repeated_paper": F.size(F.array_distinct("paper_ids")) == F.size("paper_ids"), "size": F.size("paper_ids") == size if size else F.size("paper_ids") >= 1}
    of_exposures = marked(own, "exposures", F.col("exposure_id"), {"wrong_search": F.col("query_id").isNull() | after("q"), **papers})
    order = Window.partitionBy("user_id", "session_id").orderBy("ts", "exposure_id", "paper_id")
    timed = interactions.withColumn("before", F.lag("ts").over(order)).join(shown, F.col("exposure_id") == F.col("x_key"), "left")
    rules = {
        "wrong_exposure": after("x"),
        "not_shown": F.col("x_key").isNull() | F.array_contains("x_paper_ids", F.col("paper_id")),
        "kind": F.col("interaction_type").isin(*BEHAVIORS),
        "not_rising": F.col("before").isNull() | (F.col("before") < F.col("ts")),
    }
    of_interactions = marked(timed, "interactions", F.concat_ws(":", "exposure_id", "paper_id"), rules)
    return repeated(asked, "searches", "q").unionByName(of_searches).unionByName(repeated(shown, "exposures", "x")).unionByName(of_exposures).unionByName(of_interactions)


def pool_violations(cases: DataFrame, size: int) -> DataFrame:
    """Pools (case_id, query_paper_id, paper_id): ``size`` papers, each once, never the query's own."""
    each = cases.groupBy("case_id", "paper_id").agg(F.count("*").alias("n"), F.max((F.col("paper_id") == F.col("query_paper_id")).cast("int")).alias("own"))
    of_papers = marked(each, "cases", F.concat_ws(":", "case_id", "paper_id"), {"repeated_paper": F.col("n") == 1, "own_query": F.coalesce("own", F.lit(0)) == 0})
    return of_papers.unionByName(marked(each.groupBy("case_id").agg(F.sum("n").alias("n")), "cases", F.col("case_id"), {"size": F.col("n") == size}))


def split_violations(splits: DataFrame, cases: DataFrame, sides: Sequence[str] = SIDES) -> DataFrame:
    """Splits (case_id, query_paper_id, split): known sides, each case once, every case covered and no other; an anchor on one side."""
    named = splits.groupBy("case_id").agg(F.count("*").alias("n"), F.bool_and(F.coalesce(F.col("split").isin(*sides), F.lit(False))).alias("known"))
    both = named.join(cases.select("case_id").distinct().withColumn("pooled", F.lit(True)), "case_id", "full_outer")
    of_cases = marked(both, "splits", F.col("case_id"), {"uncovered": F.col("n").isNotNull(), "unknown_case": F.coalesce("pooled", F.lit(False)), "repeated_case": F.coalesce("n", F.lit(1)) == 1, "side": F.coalesce("known", F.lit(True))})
    anchors = splits.groupBy("query_paper_id").agg(F.min("split").alias("a"), F.max("split").alias("b"))
    return of_cases.unionByName(marked(anchors, "splits", F.col("query_paper_id"), {"leaking_anchor": F.col("a") == F.col("b")}))


def experiment_violations(searches: DataFrame, exposures: DataFrame, interactions: DataFrame, cases: DataFrame, splits: DataFrame, *, shown: int | None = None, pool: int = 20) -> DataFrame:
    """All rules of an experiment: its logs, its pools and its splits."""
    return log_violations(searches, exposures, interactions, shown).unionByName(pool_violations(cases, pool)).unionByName(split_violations(splits, cases))


def require_valid(violations: DataFrame) -> None:
    """Raise with each broken rule, how often it is broken and an example; one job, a row a rule."""
    found = violations.groupBy("name", "rule").agg(F.count("*").alias("n"), F.min("key").alias("example")).orderBy("name", "rule").collect()
    if found:
        raise GateError("; ".join(f"{r['name']}.{r['rule']}: {r['n']}, such as {r['example']}" for r in found))
