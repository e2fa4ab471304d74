"""Scorers: DataFrames in, a long ranking table (case_id, model, paper_id, score) out.

``REGISTRY`` holds the scorers by experiment, so a user's own function of the
same shape can be added and is evaluated like the rest.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetlake.functions import text as T
from facetlake.functions import vectors as V
from facetlake.operators.facets import FACETS, FIXED_WEIGHTS
from facetlake.storage import written

REGISTRY: dict[str, dict[str, Callable[..., DataFrame]]] = {"retrieval": {}, "preference": {}, "direction": {}, "temporal": {}}


def scorer(experiment: str, name: str):
    """Register a scorer under its model name."""

    def add(f):
        REGISTRY[experiment][name] = f
        return f

    return add


def as_model(scores: DataFrame, model: str) -> DataFrame:
    return scores.select("case_id", F.lit(model).alias("model"), "paper_id", F.coalesce("score", F.lit(0.0)).alias("score"))


# --- retrieval by example ---------------------------------------------------


def joint_vectors(papers: DataFrame, concepts: DataFrame, fold: Callable[[Column], Column] = F.lower, times: DataFrame | None = None) -> DataFrame:
    """(paper_id, part, term, weight) with one IDF over whole texts and facet documents.

    Every annotated paper has five facet documents, empty ones included; a
    facet's document is its concepts in order. part is "text" or a facet.
    times: (paper_id, times) for papers that stand for several that say the same.
    """
    whole = papers.select("paper_id", F.lit("text").alias("part"), "text")
    joined = concepts.groupBy("paper_id", "facet").agg(F.concat_ws(" ", F.sort_array(F.collect_set("concept"))).alias("text"))
    every = concepts.select("paper_id").distinct().withColumn("facet", F.explode(F.array(*map(F.lit, FACETS))))
    of_facets = every.join(joined.hint("merge"), ["paper_id", "facet"], "left").select("paper_id", F.col("facet").alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    documents = whole.unionByName(of_facets).withColumn("tokens", T.tokens(fold(F.col("text"))))
    if times is None:
        return V.tfidf(documents, ["paper_id", "part"])
    return V.tfidf(documents.join(times.hint("merge"), "paper_id"), ["paper_id", "part"], times="times")


def part_cosines(cases: DataFrame, vectors: DataFrame) -> DataFrame:
    """(case_id, paper_id, part, score) for parts with a common term; cases: case_id, query_paper_id, paper_id."""
    anchors = cases.select("case_id", "query_paper_id").distinct().join(vectors.withColumnRenamed("paper_id", "query_paper_id").hint("merge"), "query_paper_id").select("case_id", "part", "term", "weight")
    candidates = cases.select("case_id", "paper_id").join(vectors.hint("merge"), "paper_id").select("case_id", "paper_id", "part", "term", "weight")
    return V.dots(candidates, anchors, ["case_id", "part", "term"], ["case_id", "paper_id", "part"])


def vector_maps(vectors: DataFrame) -> DataFrame:
    """(paper_id, vectors): a map from part to its terms and weights; empty parts are absent."""
    by = vectors.groupBy("paper_id", "part").agg(F.map_from_entries(F.collect_list(F.struct("term", "weight"))).alias("v"))
    return by.groupBy("paper_id").agg(F.map_from_entries(F.collect_list(F.struct("part", "v"))).alias("vectors"))


def map_cosine(anchor: Column, paper: Column, part: str) -> Column:
    """The cosine of a pair that has both sides' ``vector_maps``, 0 without a common term; weights are positive, so above 0 with one."""
    a, p = F.try_element_at(anchor, F.lit(part)), F.try_element_at(paper, F.lit(part))
    return F.coalesce(F.aggregate(F.map_entries(p), F.lit(0.0), lambda s, x: s + x["value"] * F.coalesce(F.try_element_at(a, x["key"]), F.lit(0.0))), F.lit(0.0))


def part_sums(cases: DataFrame, cosines: DataFrame) -> DataFrame:
    """(case_id, paper_id, text and the facets): the cosines of a pair side by side, 0 for parts without a common term."""
    parts = ("text", *FACETS)
    sums = cosines.groupBy("case_id", "paper_id").agg(*[F.sum(F.when(F.col("part") == p, F.col("score"))).alias(p) for p in parts])
    return cases.select("case_id", "paper_id").join(sums.hint("merge"), ["case_id", "paper_id"], "left").fillna(0.0, list(parts))


def retrieval_columns(seed: str = "42", weights: dict[str, float] = FIXED_WEIGHTS) -> dict[str, Column]:
    """The models as columns over pairs with their cosines side by side (case_id, paper_id, text and the facets)."""
    return {
        "random": V.hashed_unit(seed, F.col("case_id"), F.col("paper_id")),
        "text_tfidf": F.col("text"),
        "equal_facets": sum((F.col(f) / len(FACETS) for f in FACETS), F.lit(0.0)),
        "weighted_facets": sum((F.col(f) * w for f, w in weights.items()), F.lit(0.0)),
    }


@scorer("retrieval", "random")
def random_order(cases: DataFrame, cosines: DataFrame, seed: str = "42", **_) -> DataFrame:
    return cases.select("case_id", "paper_id", retrieval_columns(seed)["random"].alias("score"))


@scorer("retrieval", "text_tfidf")
def text_tfidf(cases: DataFrame, cosines: DataFrame, *, sums: DataFrame, **_) -> DataFrame:
    return sums.select("case_id", "paper_id", retrieval_columns()["text_tfidf"].alias("score"))


@scorer("retrieval", "equal_facets")
def equal_facets(cases: DataFrame, cosines: DataFrame, *, sums: DataFrame, **_) -> DataFrame:
    return sums.select("case_id", "paper_id", retrieval_columns()["equal_facets"].alias("score"))


@scorer("retrieval", "weighted_facets")
def weighted_facets(cases: DataFrame, cosines: DataFrame, *, sums: DataFrame, weights: dict[str, float] = FIXED_WEIGHTS, **_) -> DataFrame:
    return sums.select("case_id", "paper_id", retrieval_columns(weights=weights)["weighted_facets"].alias("score"))


def score_retrieval(papers: DataFrame, concepts: DataFrame, cases: DataFrame, fold: Callable[[Column], Column] = F.lower, **options) -> DataFrame:
    """All registered retrieval models over the same cosines, which are written once, as rows and side by side."""
    cases = written(cases, "cases")
    cosines = written(part_cosines(cases, joint_vectors(papers, concepts, fold)), "cosines")
    sums = written(part_sums(cases, cosines), "part-sums")
    out = None
    for model, f in REGISTRY["retrieval"].items():
        part = as_model(f(cases, cosines, sums=sums, **options), model)
        out = part if out is None else out.unionByName(part)
    return out
