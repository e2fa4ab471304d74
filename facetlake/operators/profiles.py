"""User profiles from time-ordered behaviour: text and facet profiles, decay, recency, popularity."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facetlake.functions import text as T
from facetlake.functions import vectors as V
from facetlake.operators.facets import FACETS
from facetlake.operators.gates import require_none
from facetlake.operators.intervals import interval_totals
from facetlake.operators.scorers import as_model, scorer

#: Weight of each behaviour; grades are the weights, never below 0.
BEHAVIOR_WEIGHTS = {"dislike": -1, "view": 0, "click": 1, "save": 2, "like": 3}
BEHAVIORS = ("dislike", "view", "click", "save", "like")


def behavior_weight(kind: Column) -> Column:
    return F.element_at(F.create_map(*[x for k, w in BEHAVIOR_WEIGHTS.items() for x in (F.lit(k), F.lit(w))]), kind)


def behavior(score: Column, thresholds: tuple[float, ...] = (-0.25, 0.05, 0.2, 0.4)) -> Column:
    """The behaviour of an affinity score: a score equal to a threshold counts above it."""
    level = sum((F.when(score >= t, 1).otherwise(0) for t in thresholds), F.lit(0))
    return F.element_at(F.array(*map(F.lit, BEHAVIORS)), level + 1)


def affinity(profile: DataFrame, importance: DataFrame, concepts: DataFrame) -> DataFrame:
    """(user_id, paper_id, affinity): importance times the mean preference for a paper's concepts of a facet, added up; papers without a known concept have no row.

    profile: user_id, facet, concept, weight; importance: user_id, facet, importance.
    """
    own = concepts.select("paper_id", "facet", "concept").distinct()
    sizes = own.groupBy("paper_id", "facet").agg(F.count("*").alias("n"))
    hits = own.join(profile, ["facet", "concept"]).groupBy("user_id", "paper_id", "facet").agg(F.sum("weight").alias("w"))
    rows = hits.join(sizes, ["paper_id", "facet"]).join(importance, ["user_id", "facet"])
    return rows.groupBy("user_id", "paper_id").agg(F.sum(F.col("importance") * F.col("w") / F.col("n")).alias("affinity"))


def user_table(history: DataFrame) -> DataFrame:
    """(user_id, n_events, n_positive, first_ts, last_ts) of a history: user_id, interaction_type, ts."""
    positive = behavior_weight(F.col("interaction_type")) > 0
    return history.groupBy("user_id").agg(F.count("*").alias("n_events"), F.count_if(positive).alias("n_positive"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def visible(history: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """Rows of ``history`` strictly before their user's cutoff: an equi-join with a range predicate. cutoffs: case_id, user_id, cutoff."""
    return history.join(cutoffs.select("case_id", "user_id", "cutoff").hint("merge"), "user_id").filter("ts < cutoff")


def check_no_future(rows: DataFrame) -> None:
    """Scorers never see a row at or after the cutoff: that is an error, not a filter."""
    require_none(rows.filter("ts >= cutoff"), "a future event reached the profile builder")


def interval_weights(cases: DataFrame, history: DataFrame, *, half_life_days: float | None = None, **layout) -> DataFrame:
    """(case_id, paper_id, n, weight, grade) of a user's reactions from ``since`` (null: all) to before ``until``: how many,
    their weights added up (decayed to ``until``), the best one (at least 0). Neither many cutoffs a user nor
    a user with most of the events makes a large group: see ``intervals``.
    """
    weight = behavior_weight(F.col("interaction_type"))
    return interval_totals(cases, history, ["paper_id"], {"weight": weight}, {"grade": F.greatest(F.lit(0), weight)}, half_life_days=half_life_days, **layout)


def time_weight(half_life_days: float | None) -> Column:
    return V.decay(V.age(F.col("cutoff"), F.col("ts")), half_life_days) if half_life_days else F.lit(1.0)


def text_profiles(rows: DataFrame, vectors: DataFrame, *, half_life_days: float | None = None, recent_start: Column | None = None) -> DataFrame:
    """(case_id, term, weight), unit norm, from visible rows (case_id, paper_id, interaction_type, ts, cutoff). Rows before recent_start are dropped."""
    used = rows if recent_start is None else rows.filter(F.col("ts") >= recent_start)
    weight = behavior_weight(F.col("interaction_type")) * time_weight(half_life_days)
    summed = used.withColumn("w", weight).filter("w <> 0").groupBy("case_id", "paper_id").agg(F.sum("w").alias("w"))
    raw = summed.join(vectors.hint("merge"), "paper_id").groupBy("case_id", "term").agg(F.sum(F.col("w") * F.col("weight")).alias("weight"))
    return V.unit(raw, ["case_id"])


def facet_profiles(rows: DataFrame, concepts: DataFrame, searches: DataFrame | None = None, *, half_life_days: float | None = None, recent_start: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Vectors (case_id, facet, concept, weight) and importance (case_id, facet, importance).

    An event spreads its weight evenly over the paper's concepts of each facet; a
    search (case_id, facet, concept, sign, ts, cutoff) adds its sign. Rows before
    recent_start weigh 0 but are kept, so their user still has a profile.
    Importance is a facet's share of all absolute weight, 1/5 each without any.
    """
    when = lambda w: w if recent_start is None else F.when(F.col("ts") >= recent_start, w).otherwise(F.lit(0.0))
    sizes = concepts.groupBy("paper_id", "facet").agg(F.count("*").alias("n_concepts"))
    shares = concepts.join(sizes.hint("merge"), ["paper_id", "facet"]).select("paper_id", "facet", "concept", (1.0 / F.col("n_concepts")).alias("share"))
    by_paper = rows.groupBy("case_id", "paper_id").agg(F.sum(when(behavior_weight(F.col("interaction_type")) * time_weight(half_life_days))).alias("w"))
    evidence = by_paper.join(shares.hint("merge"), "paper_id").select("case_id", "facet", "concept", (F.col("w") * F.col("share")).alias("weight"))
    if searches is not None:
        evidence = evidence.unionByName(searches.select("case_id", "facet", "concept", (F.col("sign") * when(time_weight(half_life_days))).alias("weight")))
    raw = evidence.groupBy("case_id", "facet", "concept").agg(F.sum("weight").alias("weight"))
    mass = raw.groupBy("case_id", "facet").agg(F.sum(F.abs("weight")).alias("mass"))
    users = rows.select("case_id").distinct() if searches is None else rows.select("case_id").unionByName(searches.select("case_id")).distinct()
    every = users.withColumn("facet", F.explode(F.array(*map(F.lit, FACETS)))).join(mass.hint("merge"), ["case_id", "facet"], "left")
    total = F.sum("mass").over(Window.partitionBy("case_id"))
    importance = every.select("case_id", "facet", F.when(F.coalesce(total, F.lit(0.0)) > 0, F.coalesce("mass", F.lit(0.0)) / total).otherwise(1.0 / len(FACETS)).alias("importance"))
    return V.unit(raw, ["case_id", "facet"]), importance


def profile_scores(cases: DataFrame, vectors: DataFrame, importance: DataFrame, concepts: DataFrame) -> DataFrame:
    """Sum over facets of importance times the profile's product with the candidate's unit concepts; cases: case_id, paper_id."""
    hot = V.one_hot(concepts.withColumnRenamed("concept", "term"), ["paper_id", "facet"])
    weighted = vectors.join(importance.hint("merge"), ["case_id", "facet"]).select("case_id", "facet", F.col("concept").alias("term"), (F.col("weight") * F.col("importance")).alias("weight"))
    candidates = cases.select("case_id", "paper_id").join(hot.hint("merge"), "paper_id")
    scores = V.dots(candidates, weighted, ["case_id", "facet", "term"], ["case_id", "paper_id"])
    return cases.select("case_id", "paper_id").join(scores.hint("merge"), ["case_id", "paper_id"], "left")


def popularity(rows: DataFrame) -> DataFrame:
    """(paper_id, popularity): summed weights, negative ones as 0."""
    return rows.groupBy("paper_id").agg(F.sum(F.greatest(F.lit(0), behavior_weight(F.col("interaction_type")))).alias("popularity"))


def labels(cases: DataFrame, history: DataFrame) -> DataFrame:
    """(case_id, paper_id, grade): the best weight in [cutoff, until), never below 0; cases: case_id, user_id, cutoff, until, paper_id.

    An item not observed has grade 0 in the candidate pool, and is no negative evidence elsewhere.
    """
    seen = cases.join(history.hint("merge"), ["user_id", "paper_id"], "left").filter("ts is null or (ts >= cutoff and ts < until)")
    grades = seen.groupBy("case_id", "paper_id").agg(F.max(F.greatest(F.lit(0), behavior_weight(F.col("interaction_type")))).alias("grade"))
    return cases.select("case_id", "paper_id").join(grades.hint("merge"), ["case_id", "paper_id"], "left").select("case_id", "paper_id", F.coalesce("grade", F.lit(0)).alias("grade"))


def with_queries(history: DataFrame, searches: DataFrame) -> DataFrame:
    """History, and every search as a click on itself: the query is a document of its own."""
    return history.unionByName(searches.select("user_id", F.col("query_id").alias("paper_id"), F.lit("click").alias("interaction_type"), "ts"))


def search_text_vectors(papers: DataFrame, searches: DataFrame, fold: Callable[[Column], Column] = F.lower) -> DataFrame:
    """Text vectors of papers and searches under one IDF."""
    both = papers.select("paper_id", "text").unionByName(searches.select(F.col("query_id").alias("paper_id"), "text"))
    return V.tfidf(both.withColumn("tokens", T.tokens(fold(F.col("text")))), ["paper_id"])


def _spread(scores: DataFrame, cases: DataFrame) -> DataFrame:
    return cases.select("case_id", "paper_id").join(scores.hint("merge"), "paper_id", "left").select("case_id", "paper_id", F.col("popularity").cast("double").alias("score"))


@scorer("preference", "popularity")
def by_popularity(cases, rows, all_rows, **_) -> DataFrame:
    return _spread(popularity(all_rows), cases)


@scorer("preference", "text_history")
def by_text(cases, rows, text_vectors, **_) -> DataFrame:
    profile = text_profiles(rows, text_vectors)
    scores = V.dots(cases.select("case_id", "paper_id").join(text_vectors.hint("merge"), "paper_id"), profile, ["case_id", "term"], ["case_id", "paper_id"])
    return cases.select("case_id", "paper_id").join(scores.hint("merge"), ["case_id", "paper_id"], "left")


@scorer("preference", "facet_no_search")
def by_facets(cases, rows, concepts, **_) -> DataFrame:
    return profile_scores(cases, *facet_profiles(rows, concepts), concepts)


@scorer("preference", "facet_history")
def by_facets_and_search(cases, rows, concepts, searches=None, **_) -> DataFrame:
    return profile_scores(cases, *facet_profiles(rows, concepts, searches), concepts)


@scorer("temporal", "popularity")
def temporal_popularity(cases, rows, all_rows, **_) -> DataFrame:
    return _spread(popularity(all_rows), cases)


@scorer("temporal", "static")
def static(cases, rows, concepts, searches=None, **_) -> DataFrame:
    return profile_scores(cases, *facet_profiles(rows, concepts, searches), concepts)


@scorer("temporal", "recent")
def recent(cases, rows, concepts, searches=None, recent_start=None, **_) -> DataFrame:
    return profile_scores(cases, *facet_profiles(rows, concepts, searches, recent_start=recent_start), concepts)


@scorer("temporal", "decay")
def decayed(cases, rows, concepts, searches=None, half_life_days=30.0, **_) -> DataFrame:
    return profile_scores(cases, *facet_profiles(rows, concepts, searches, half_life_days=half_life_days), concepts)


def score_all(experiment: str, cases: DataFrame, **inputs) -> DataFrame:
    from facetlake.operators.scorers import REGISTRY

    out = None
    for model, f in REGISTRY[experiment].items():
        part = as_model(f(cases=cases, **inputs), model)
        out = part if out is None else out.unionByName(part)
    return out
