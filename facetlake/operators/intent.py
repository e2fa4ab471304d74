"""Session intent: directions from matched feedback and queries, and scores by direction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facetlake.operators.facets import FACETS, overlap_state
from facetlake.operators.profiles import behavior_weight
from facetlake.operators.scorers import REGISTRY, as_model, scorer


def feedback_pairs(exposures: DataFrame, reactions: DataFrame) -> DataFrame:
    """Two-paper exposures with a reaction to both: case_id, exposure_id, a, b, w_a, w_b.

    exposures: case_id, exposure_id, paper_ids; reactions: case_id, exposure_id, paper_id, interaction_type.
    """
    two = exposures.filter(F.size("paper_ids") == 2).select("case_id", "exposure_id", F.col("paper_ids")[0].alias("a"), F.col("paper_ids")[1].alias("b"))
    w = reactions.select("case_id", "exposure_id", "paper_id", behavior_weight(F.col("interaction_type")).alias("w"))
    side = lambda c: w.select("case_id", "exposure_id", F.col("paper_id").alias(c), F.col("w").alias(f"w_{c}"))
    return two.join(side("a").hint("merge"), ["case_id", "exposure_id", "a"]).join(side("b").hint("merge"), ["case_id", "exposure_id", "b"]).select("case_id", "exposure_id", "a", "b", "w_a", "w_b")


def contrasts(pairs: DataFrame, anchors: DataFrame, papers: DataFrame) -> DataFrame:
    """(case_id, facet, contrast): pairs alike in all other facets, of which one shares the anchor's facet.

    anchors: case_id, query_paper_id; papers: paper_id, concepts (map from facet to concepts).
    The contrast is the reaction to the different paper less that to the same one.
    """
    at = lambda c: papers.select(F.col("paper_id").alias(c), F.col("concepts").alias(f"c_{c}")).hint("merge")
    full = pairs.join(anchors.hint("merge"), "case_id").join(at("query_paper_id"), "query_paper_id").join(at("a"), "a").join(at("b"), "b")
    states = F.array(*[F.struct(F.lit(f).alias("facet"), *[overlap_state(F.col("c_query_paper_id"), F.col(f"c_{x}"), f).alias(f"same_{x}") for x in "ab"]) for f in FACETS])
    seen = full.select("case_id", "w_a", "w_b", states.alias("states"))
    apart = F.size(F.filter("states", lambda s: ~s["same_a"].eqNullSafe(s["same_b"])))
    each = seen.select("case_id", "w_a", "w_b", apart.alias("apart"), F.inline("states"))
    value = F.when(F.col("same_a"), F.col("w_b") - F.col("w_a")).otherwise(F.col("w_a") - F.col("w_b"))
    return each.filter("apart = 1 and same_a <> same_b").select("case_id", "facet", value.alias("contrast"))


def behavior_directions(found: DataFrame, margin: float = 0.25, minimum: int = 2) -> DataFrame:
    """(case_id, facet, direction, confidence) from contrasts: their sum over n + 2 must reach the margin."""
    delta = F.sum("contrast") / (F.count("*") + 2)
    by = found.groupBy("case_id", "facet").agg(F.count("*").alias("n"), delta.alias("delta")).filter((F.col("n") >= minimum) & (F.abs("delta") >= margin))
    return by.select("case_id", "facet", F.when(F.col("delta") > 0, "different").otherwise("similar").alias("direction"), F.least(F.lit(1.0), F.abs("delta") / 3).alias("confidence"))


def query_directions(mentions: DataFrame, anchors: DataFrame, concepts: DataFrame) -> DataFrame:
    """(case_id, facet, direction, confidence) from the latest query that names an anchor's concept.

    mentions: case_id, query_id, ts, facet, concept, sign. Excluding wins within a query; a concept that the anchor lacks says nothing.
    """
    own = anchors.join(concepts.hint("merge"), F.col("query_paper_id") == F.col("paper_id")).select("case_id", "facet", "concept")
    hits = mentions.join(own.hint("merge"), ["case_id", "facet", "concept"]).groupBy("case_id", "facet", "ts", "query_id").agg(F.min("sign").alias("sign"))
    last = hits.groupBy("case_id", "facet").agg(F.max_by("sign", F.struct("ts", "query_id")).alias("sign"))
    return last.select("case_id", "facet", F.when(F.col("sign") < 0, "different").otherwise("similar").alias("direction"), F.when(F.col("sign") < 0, 1.0).otherwise(0.8).alias("confidence"))


def directions(anchors: DataFrame, behavior: DataFrame, queries: DataFrame | None = None, context: str = "problem") -> DataFrame:
    """All facets of all cases: queries over behaviour over the context's own "similar", else "unknown"."""
    every = anchors.select("case_id").withColumn("facet", F.explode(F.array(*map(F.lit, FACETS))))
    b = behavior.select("case_id", "facet", F.col("direction").alias("b_dir"), F.col("confidence").alias("b_conf"))
    joined = every.join(b.hint("merge"), ["case_id", "facet"], "left")
    q_dir, q_conf = F.lit(None).cast("string"), F.lit(None).cast("double")
    if queries is not None:
        joined = joined.join(queries.select("case_id", "facet", F.col("direction").alias("q_dir"), F.col("confidence").alias("q_conf")).hint("merge"), ["case_id", "facet"], "left")
        q_dir, q_conf = F.col("q_dir"), F.col("q_conf")
    own = F.col("facet") == context
    return joined.select("case_id", "facet", F.coalesce(q_dir, F.col("b_dir"), F.when(own, "similar"), F.lit("unknown")).alias("direction"), F.coalesce(q_conf, F.col("b_conf"), F.when(own, 1.0), F.lit(0.0)).alias("confidence"))


def intent_scores(cases: DataFrame, cosines: DataFrame, filled: DataFrame, weights: DataFrame, found: DataFrame, context: str = "problem") -> DataFrame:
    """(case_id, paper_id, score) of candidates under weights and directions.

    cosines: case_id, paper_id, part, score; filled: paper_id, facet (non-empty
    ones); weights: case_id, facet, importance; found: case_id, facet, direction.
    -1 out of context or where an active facet is missing; an unknown direction
    counts as similar; without an active facet the context's cosine.
    """
    every = cases.select("case_id", "query_paper_id", "paper_id").withColumn("facet", F.explode(F.array(*map(F.lit, FACETS))))
    has = lambda c, name: filled.select(F.col("paper_id").alias(c), "facet", F.lit(True).alias(name)).hint("merge")
    rows = (
        every.join(has("query_paper_id", "on_anchor"), ["query_paper_id", "facet"], "left")
        .join(has("paper_id", "on_paper"), ["paper_id", "facet"], "left")
        .join(cosines.withColumnRenamed("part", "facet").hint("merge"), ["case_id", "paper_id", "facet"], "left")
        .join(weights.hint("merge"), ["case_id", "facet"], "left")
        .join(found.select("case_id", "facet", "direction").hint("merge"), ["case_id", "facet"], "left")
    )
    s = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("score", F.lit(0.0))))
    w = F.coalesce("importance", F.lit(0.0))
    active = F.col("on_anchor") & (F.coalesce("direction", F.lit("unknown")) != "ignore") & (w != 0)
    active = F.coalesce(active, F.lit(False))
    value = w * F.when(F.col("direction") == "different", 1 - s).otherwise(s)
    near = F.max(F.when(F.col("facet") == context, F.coalesce("score", F.lit(0.0))))
    by = rows.groupBy("case_id", "paper_id").agg(near.alias("near"), F.count_if(active & F.col("on_paper").isNull()).alias("missing"), F.sum(F.when(active, value)).alias("num"), F.sum(F.when(active, w)).alias("den"))
    return by.select("case_id", "paper_id", F.when((F.col("near") <= 0) | (F.col("missing") > 0), -1.0).otherwise(F.coalesce(F.try_divide("num", "den"), F.col("near"))).alias("score"))


def _all(anchors: DataFrame, direction: str) -> DataFrame:
    return anchors.select("case_id", F.explode(F.array(*map(F.lit, FACETS))).alias("facet"), F.lit(direction).alias("direction"))


def equal_weights(anchors: DataFrame) -> DataFrame:
    return anchors.select("case_id", F.explode(F.array(*map(F.lit, FACETS))).alias("facet"), F.lit(1.0 / len(FACETS)).alias("importance"))


@scorer("direction", "fixed_similar")
def fixed_similar(cases, cosines, filled, anchors, **_):
    return intent_scores(cases, cosines, filled, equal_weights(anchors), _all(anchors, "similar"))


@scorer("direction", "profile_similar")
def profile_similar(cases, cosines, filled, anchors, importance, **_):
    return intent_scores(cases, cosines, filled, importance, _all(anchors, "similar"))


@scorer("direction", "direction_behavior")
def direction_behavior(cases, cosines, filled, anchors, importance, behavior, **_):
    return intent_scores(cases, cosines, filled, importance, directions(anchors, behavior))


@scorer("direction", "direction_search")
def direction_search(cases, cosines, filled, anchors, importance, behavior, queries, **_):
    return intent_scores(cases, cosines, filled, importance, directions(anchors, behavior, queries))


def oracle_scores(cases, cosines, filled, truth_weights, truth_directions) -> DataFrame:
    """The privileged row: the evaluator's own truth in place of an estimate; never a registered scorer."""
    return as_model(intent_scores(cases, cosines, filled, truth_weights, truth_directions), "oracle").withColumn("privileged", F.lit(True))


def score_directions(**inputs) -> DataFrame:
    out = None
    for model, f in REGISTRY["direction"].items():
        part = as_model(f(**inputs), model)
        out = part if out is None else out.unionByName(part)
    return out


def direction_metrics(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """Accuracy and coverage of a case's active facets (those not ignored)."""
    t = truth.filter("direction <> 'ignore'").select("case_id", "facet", F.col("direction").alias("truth"))
    rows = t.join(predicted.select("case_id", "facet", "direction"), ["case_id", "facet"], "left").withColumn("direction", F.coalesce("direction", F.lit("unknown")))
    return rows.groupBy("case_id").agg(F.avg(F.when(F.col("truth") == F.col("direction"), 1.0).otherwise(0.0)).alias("direction_accuracy"), F.avg(F.when(F.col("direction").isin("similar", "different"), 1.0).otherwise(0.0)).alias("direction_coverage"))


def importance_error(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """Mean absolute difference of importance over the facets."""
    joined = truth.join(predicted.withColumnRenamed("importance", "predicted"), ["case_id", "facet"])
    return joined.groupBy("case_id").agg(F.avg(F.abs(F.col("importance") - F.col("predicted"))).alias("importance_mae"))


def compliance(ranked_rows: DataFrame, k: int) -> DataFrame:
    """Share of grade 2 in the first k."""
    return ranked_rows.filter(F.col("rank") <= k).groupBy("case_id", "model").agg(F.avg(F.when(F.col("grade") == 2, 1.0).otherwise(0.0)).alias(f"compliance_{k}"))


def signature_pairs(rows: DataFrame, group: list[str], side: str, order: Column) -> DataFrame:
    """The i-th row of side "left" with the i-th of side "right" inside each group; rows: group, side, paper_id."""
    n = rows.withColumn("n", F.row_number().over(Window.partitionBy(*group, side).orderBy(order, "paper_id")))
    pick = lambda s: n.filter(F.col(side) == s).select(*group, "n", F.col("paper_id").alias(f"{s}_id"))
    return pick("left").join(pick("right"), [*group, "n"])
