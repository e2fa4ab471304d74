"""Composed gates over whole datasets. Each function raises GateError at the first rule that is broken."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetlake.operators import gates as G
from facetlake.operators.facets import FACETS, arrays, retrieval_grade, session_grade
from facetlake.operators.profiles import BEHAVIORS, labels

# Id patterns and the sources of papers.
PAPER_ID, USER_ID = "^P[0-9]{6}$", "^U[0-9]{4}$"


def _all_hold(df: DataFrame, name: str, **rules) -> None:
    G.require_none(G.violations(df, **rules).filter("n_violations > 0"), f"{name} break rules")


def check_papers(papers: DataFrame, pattern: str = PAPER_ID) -> None:
    """Ids of the right form, once each; text present; years in range or null."""
    text = lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""
    _all_hold(papers, "papers", id=F.regexp_like("paper_id", F.lit(pattern)), title=text("title"), abstract=text("abstract"), year=F.col("year").isNull() | F.col("year").between(1000, 2100))
    G.require_none(G.repeated(papers, ["paper_id"]), "papers repeat an id")


def check_facets(facets: DataFrame, papers: DataFrame) -> None:
    """Five lists of distinct, trimmed, nonempty concepts of known papers."""
    good = lambda f: F.col(f).isNotNull() & F.forall(f, lambda c: (F.trim(c) == c) & (c != "")) & (F.size(F.array_distinct(F.transform(f, lambda c: F.lower(c)))) == F.size(f))
    _all_hold(facets, "facets", **{f: good(f) for f in FACETS})
    G.require_none(G.orphans(facets, papers, ["paper_id"]), "facets of an unknown paper")
    G.require_none(G.repeated(facets, ["paper_id"]), "facets repeat a paper")


def check_id_map(id_map: DataFrame, papers: DataFrame, audit: DataFrame) -> None:
    """Every paper has one primary source record; active records are included in the audit, and the other way round."""
    G.require_none(G.repeated(id_map, ["source", "source_id"]), "the id map repeats a record")
    primaries = id_map.filter("primary").groupBy("paper_id").count()
    G.require_none(papers.join(primaries, "paper_id", "left").filter("count is null or count <> 1"), "a paper needs one primary record")
    G.require_none(G.differences(id_map.filter("active").select("source", "source_id"), audit.filter("included").select("source", "source_id")), "id map and audit differ")


def check_profiles(profiles: DataFrame, concepts: DataFrame) -> None:
    """latent profiles: user_id, facet, concept, weight in [-1, 1] and known concepts; importance: non-negative and 1 in sum."""
    _all_hold(profiles, "profiles", weight=F.col("weight").between(-1, 1), facet=F.col("facet").isin(*FACETS))
    G.require_none(G.orphans(profiles, concepts, ["facet", "concept"]), "a profile names an unknown concept")


def check_importance(importance: DataFrame) -> None:
    sums = importance.groupBy("user_id").agg(F.sum("importance").alias("total"), F.min("importance").alias("least"), F.count_distinct("facet").alias("n"))
    _all_hold(sums, "importance", total=F.abs(F.col("total") - 1) < 1e-6, least=F.col("least") >= 0, facets=F.col("n") == len(FACETS))


def check_logs(searches: DataFrame, exposures: DataFrame, interactions: DataFrame, size: int | None = None) -> None:
    """Search, exposure and reaction in this order, of one user and session; the paper was shown; times rise inside a session.

    searches: query_id, user_id, session_id, parent_query_id, ts; exposures:
    exposure_id, user_id, session_id, query_id, paper_ids, ts; interactions:
    user_id, paper_id, interaction_type, session_id, exposure_id, ts.
    """
    for df, key in ((searches, "query_id"), (exposures, "exposure_id")):
        G.require_none(G.repeated(df, [key]), f"{key} is repeated")
    G.require_none(G.bad_parents(searches, "query_id", "parent_query_id", ["user_id", "session_id"]), "a parent search must come first in the same session")
    shown = exposures.filter(F.col("query_id").isNotNull()).join(searches.select("query_id", F.col("user_id").alias("s_user"), F.col("session_id").alias("s_session"), F.col("ts").alias("s_ts")), "query_id", "left")
    G.require_none(shown.filter("s_ts is null or s_user <> user_id or s_session <> session_id or s_ts >= ts").select("exposure_id"), "an exposure must follow its own search")
    distinct = F.size(F.array_distinct("paper_ids")) == F.size("paper_ids")
    _all_hold(exposures, "exposures", papers=distinct & (F.size("paper_ids") >= 1), size=F.size("paper_ids") == size if size else F.lit(True))
    joined = interactions.join(exposures.select("exposure_id", "paper_ids", F.col("user_id").alias("x_user"), F.col("session_id").alias("x_session"), F.col("ts").alias("x_ts")), "exposure_id", "left")
    bad = joined.filter("x_ts is null or x_user <> user_id or x_session <> session_id or x_ts >= ts or not array_contains(paper_ids, paper_id)")
    G.require_none(bad.select("exposure_id", "paper_id"), "a reaction must follow the exposure that showed its paper")
    _all_hold(interactions, "interactions", kind=F.col("interaction_type").isin(*BEHAVIORS))
    G.require_none(G.not_increasing(interactions, ["user_id", "session_id"], ["ts", "exposure_id"]), "reactions of a session must rise in time")


def check_pools(cases: DataFrame, size: int, anchor: str | None = None) -> None:
    """Pools (case_id, paper_id) of one size without repeats or the anchor itself."""
    G.require_none(G.repeated(cases, ["case_id", "paper_id"]), "a pool repeats a paper")
    G.require_none(cases.groupBy("case_id").count().filter(F.col("count") != size), "a pool has another size")
    if anchor:
        G.require_none(cases.filter(F.col(anchor) == F.col("paper_id")), "a pool holds its own query")


def check_retrieval(cases: DataFrame, graded: DataFrame, concepts: DataFrame, splits: DataFrame, size: int, sides: Sequence[str] = ("train", "dev", "test")) -> None:
    """Labels computed again from the concepts; every anchor on one side. cases: case_id, query_paper_id, paper_id; graded: case_id, paper_id, grade; splits: case_id, query_paper_id, split."""
    check_pools(cases, size, "query_paper_id")
    maps = arrays(concepts)
    at = lambda c: maps.select(F.col("paper_id").alias(c), F.col("concepts").alias(f"c_{c}"))
    again = cases.join(at("query_paper_id"), "query_paper_id", "left").join(at("paper_id"), "paper_id", "left").select("case_id", "paper_id", F.round(retrieval_grade(F.col("c_query_paper_id"), F.col("c_paper_id")), 6).alias("grade"))
    G.require_none(G.differences(graded.select("case_id", "paper_id", F.round("grade", 6).alias("grade")), again), "labels differ from their rule")
    _all_hold(splits, "splits", side=F.col("split").isin(*sides))
    G.require_none(G.split_leaks(splits, "query_paper_id"), "an anchor is on two sides")
    G.require_none(G.differences(splits.select("case_id"), cases.select("case_id").distinct()), "splits don't cover the cases once each")


def check_temporal(history: DataFrame, holdout: DataFrame, cases: DataFrame, graded: DataFrame) -> None:
    """History ends before holdout; labels are what the holdout says. cases: case_id, user_id, cutoff, until, paper_id."""
    G.require_none(G.temporal_leaks(history, holdout), "history reaches into the holdout")
    both = G.once(history.unionByName(holdout), ["user_id", "paper_id", "ts"])
    G.require_none(G.differences(graded.select("case_id", "paper_id", "grade"), labels(cases, both)), "labels differ from later behaviour")


def check_sessions(rows: DataFrame, exposures: DataFrame, concepts: DataFrame) -> None:
    """Session labels computed again; no paper of a case's exposures is in its pool. rows: case_id, query_paper_id, focus, direction, paper_id, grade; exposures: case_id, paper_ids."""
    seen = exposures.select("case_id", F.explode("paper_ids").alias("paper_id"))
    G.require_none(rows.join(seen, ["case_id", "paper_id"], "left_semi").select("case_id", "paper_id"), "a candidate was already shown")
    maps = arrays(concepts)
    at = lambda c: maps.select(F.col("paper_id").alias(c), F.col("concepts").alias(f"c_{c}"))
    grade = F.lit(0)
    for f in FACETS:
        grade = F.when(F.col("focus") == f, session_grade(F.col("c_query_paper_id"), F.col("c_paper_id"), f, F.col("direction"))).otherwise(grade)
    again = rows.join(at("query_paper_id"), "query_paper_id", "left").join(at("paper_id"), "paper_id", "left").select("case_id", "paper_id", grade.alias("grade"))
    G.require_none(G.differences(rows.select("case_id", "paper_id", "grade"), again), "labels differ from their rule")
