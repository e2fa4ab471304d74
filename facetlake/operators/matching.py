"""Extracted labels against reference labels: exact, canonical and embedding matches, one to one."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetlake.functions import rules
from facetlake.functions import vectors as V
from facetlake.functions.metrics import prf, prf_by_facet
from facetlake.operators.gates import require_none
from facetlake.storage import written


#: Labels of one connected group that are assigned in one task; a larger group is an error.
MOST_LABELS = 4_000


def least_cost(cost: np.ndarray) -> np.ndarray:
    """The column of each row in a one-to-one choice of least total cost; rows are no more than columns.

    Shortest augmenting paths with potentials: a row at a time is added along the path of least
    reduced cost, a column a step, each step one pass over the columns as an array.
    """
    rows, columns = cost.shape
    of_row, of_column = np.zeros(rows), np.zeros(columns)
    owner = np.full(columns, -1)
    for row in range(rows):
        reach, via, done = np.full(columns, np.inf), np.full(columns, -1), np.zeros(columns, bool)
        at, far, path = row, 0.0, []
        while True:
            new = far + cost[at] - of_row[at] - of_column
            closer = ~done & (new < reach)
            reach[closer], via[closer] = new[closer], at
            column = int(np.argmin(np.where(done, np.inf, reach)))
            far = reach[column]
            done[column] = True
            path.append((column, far))
            if owner[column] < 0:
                break
            at = owner[column]
        of_row[row] += far
        for c, d in path[:-1]:
            of_row[owner[c]] += far - d
            of_column[c] -= far - d
        while True:  # the path's columns change hands, from its end to the new row
            at = via[column]
            held = np.flatnonzero(owner == at)
            owner[column] = at
            if at == row:
                break
            column = int(held[0])
    out = np.full(rows, -1)
    out[owner[owner >= 0]] = np.flatnonzero(owner >= 0)
    return out


def assign(pairs: list[tuple[str, str, float]]) -> list[tuple[str, str, float]]:
    """The one-to-one choice with most pairs, then the greatest sum; pairs: (left, right, score); ties go by name.

    Pairs that aren't offered cost more than all scores together, so that the choice has as few of them as it can.
    """
    lefts, rights = sorted({a for a, _, _ in pairs}), sorted({b for _, b, _ in pairs})
    if len(lefts) > len(rights):
        return sorted((a, b, s) for b, a, s in assign([(b, a, s) for a, b, s in pairs]))
    if max(len(lefts), len(rights)) > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} labels hang together")
    scores = {(a, b): s for a, b, s in pairs}
    place = {a: i for i, a in enumerate(lefts)}, {b: j for j, b in enumerate(rights)}
    worst = 1.0 + (max(scores.values(), default=0.0) - min(scores.values(), default=0.0)) * (len(lefts) + 1)
    cost = np.full((len(lefts), len(rights)), worst - min(0.0, min(scores.values(), default=0.0)))
    for (a, b), score in scores.items():
        cost[place[0][a], place[1][b]] = -score
    chosen = zip(lefts, (rights[j] for j in least_cost(cost)), strict=True)
    return sorted((a, b, scores[a, b]) for a, b in chosen if (a, b) in scores)


def hanging_together(pairs: DataFrame, keys: list[str], column: str = "together") -> DataFrame:
    """The pairs with the least left label that each is connected with, through pairs of its group; pairs with a null key go.

    Each round a label takes the least name among its partners' partners; rounds are written tables
    and end when no name changes. Groups that a threshold has cut into pieces are solved piece by piece.
    """
    now = written(pairs.withColumn(column, F.col("left")), "together")
    while True:
        by_right = now.groupBy(*keys, "right").agg(F.min(column).alias("near"))
        by_left = now.join(by_right, [*keys, "right"]).groupBy(*keys, "left").agg(F.min("near").alias("near"))
        further = by_left.join(by_left.select(*keys, F.col("left").alias("near"), F.col("near").alias("next")), [*keys, "near"]).select(*keys, "left", F.least("near", "next").alias("near"))
        new = written(now.join(further, [*keys, "left"]).select(*pairs.columns, F.col("near").alias(column), (F.col("near") != F.col(column)).alias("moved")), "together")
        if not new.agg(F.bool_or("moved")).first()[0]:
            return new.drop("moved")
        now = new.drop("moved")


def assign_groups(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs (keys, left, right, score) chosen within each group of keys, a connected piece of a group in one task."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        found = assign(list(zip(rows["left"], rows["right"], rows["score"].astype(float), strict=True)))
        out = pd.DataFrame(found, columns=["left", "right", "score"])
        for k in keys:
            out[k] = rows[k].iloc[0]
        return out[[*keys, "left", "right", "score"]]

    schema = ", ".join([*[f"{k} {pairs.schema[k].dataType.simpleString()}" for k in keys], "left string, right string, score double"])
    return hanging_together(pairs.select(*keys, "left", "right", "score"), keys).groupBy(*keys, "together").applyInPandas(run, schema)


def exact_counts(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """(paper_id, facet, tp, fp, fn) from labels (paper_id, facet, key)."""
    g = gold.select("paper_id", "facet", "key").distinct().withColumn("in_gold", F.lit(1))
    p = predicted.select("paper_id", "facet", "key").distinct().withColumn("in_pred", F.lit(1))
    both = g.join(p, ["paper_id", "facet", "key"], "full_outer")
    return both.groupBy("paper_id", "facet").agg(F.count_if(F.col("in_gold").isNotNull() & F.col("in_pred").isNotNull()).alias("tp"), F.count_if(F.col("in_gold").isNull()).alias("fp"), F.count_if(F.col("in_pred").isNull()).alias("fn"))


def match_labels(gold: DataFrame, predicted: DataFrame, embeddings: DataFrame, sources: DataFrame | None = None, threshold: float = 0.85) -> tuple[DataFrame, DataFrame]:
    """Matched pairs and guard reasons of labels (paper_id, facet, label, key).

    Equal keys match first. Only labels left over meet the embeddings (label,
    embedding: unit vectors): a pair's score is its guarded cosine, pairs at the
    threshold or above compete, and each (paper, facet) gets the largest, then
    best, one-to-one choice.
    """
    on = ["paper_id", "facet"]
    exact = gold.join(predicted.select(*on, "key", F.col("label").alias("right")), [*on, "key"]).select(*on, F.col("label").alias("left"), "right", F.lit(1.0).alias("score"), F.lit("exact").alias("match_type"))
    rest_g = gold.join(predicted.select(*on, "key"), [*on, "key"], "left_anti").select(*on, F.col("label").alias("left"))
    rest_p = predicted.join(gold.select(*on, "key"), [*on, "key"], "left_anti").select(*on, F.col("label").alias("right"))
    vec = lambda c: embeddings.select(F.col("label").alias(c), F.col("embedding").alias(f"v_{c}"))
    pairs = rest_g.join(rest_p, on).join(vec("left"), "left", "left").join(vec("right"), "right", "left")
    cosine = F.coalesce(V.clipped(V.dense_dot(F.col("v_left"), F.col("v_right"))), F.lit(0.0))
    pairs = pairs.select(*on, "left", "right", cosine.alias("cosine"))
    pairs = pairs.join(sources.select("paper_id", "source"), "paper_id", "left") if sources is not None else pairs.withColumn("source", F.lit(""))

    def run(batches):
        for rows in batches:
            found = [rules.pair_score(a, b, f, c, s or "") for a, b, f, c, s in zip(rows["left"], rows["right"], rows["facet"], rows["cosine"], rows["source"], strict=True)]
            yield rows.assign(score=[x[0] for x in found], match_type=[x[1] for x in found], blocked=[x[2] for x in found])[[*on, "left", "right", "score", "match_type", "blocked"]]

    kind = pairs.schema["paper_id"].dataType.simpleString()
    scored = pairs.mapInPandas(run, f"paper_id {kind}, facet string, left string, right string, score double, match_type string, blocked string")
    chosen = assign_groups(scored.filter(F.col("score") >= threshold).select(*on, "left", "right", "score"), on)
    typed = chosen.join(scored.select(*on, "left", "right", "match_type"), [*on, "left", "right"])
    return exact.unionByName(typed), scored.filter("blocked is not null").groupBy("blocked").count()


def evaluate(gold: DataFrame, predicted: DataFrame, embeddings: DataFrame | None = None, sources: DataFrame | None = None, threshold: float = 0.85) -> DataFrame:
    """Counts and P, R, F1 per facet, micro and macro; with embeddings, labels that differ may match and guards apply.

    Every predicted paper must be a reference's, else it is an error; a reference
    without a prediction misses all its labels.
    """
    require_none(predicted.select("paper_id").distinct().join(gold.select("paper_id"), "paper_id", "left_anti"), "a prediction for a paper without a reference")
    if embeddings is None:
        return prf_by_facet(exact_counts(gold, predicted))
    matched, _ = match_labels(gold, predicted, embeddings, sources, threshold)
    return prf_by_facet(match_counts(gold, predicted, matched))


def match_counts(gold: DataFrame, predicted: DataFrame, matched: DataFrame) -> DataFrame:
    """(paper_id, facet, tp, fp, fn) given the matched pairs."""
    n = lambda df, c: df.groupBy("paper_id", "facet").agg(F.count("*").alias(c))
    joined = n(gold, "g").join(n(predicted, "p"), ["paper_id", "facet"], "full_outer").join(n(matched, "tp"), ["paper_id", "facet"], "left").fillna(0, ["g", "p", "tp"])
    return joined.select("paper_id", "facet", "tp", (F.col("p") - F.col("tp")).alias("fp"), (F.col("g") - F.col("tp")).alias("fn"))


def check_gold(gold: DataFrame, silver_ids: DataFrame, expected: int, held_out: str = "P000001") -> None:
    """Reviewed references only: known papers, once each, reviewed, with a reviewer's name where a person reviewed."""
    if (n := gold.count()) != expected:
        raise ValueError(f"gold count must be {expected}; got {n}")
    require_none(gold.join(silver_ids.select("paper_id"), "paper_id", "left_anti"), "gold paper absent from silver")
    require_none(gold.filter(F.col("paper_id") == held_out), "the prompt-development paper can't be in held-out gold")
    require_none(gold.groupBy("paper_id").count().filter("count > 1"), "duplicate gold paper")
    kind = F.coalesce("reviewer_type", F.lit("human"))
    require_none(gold.filter((F.coalesce("review_status", F.lit("")) != "reviewed") | ~kind.isin("human", "ai") | ((kind == "human") & (F.coalesce(F.trim("reviewer"), F.lit("")) == ""))), "gold review incomplete")


def compare_arms(labels: DataFrame, gold: DataFrame, arm: str = "arm") -> DataFrame:
    """Micro P, R, F1 of each arm's exact matches; an arm without a label for a paper still misses its gold."""
    g = gold.select("paper_id", "facet", "key").distinct()
    p = labels.select(arm, "paper_id", "facet", "key").distinct()
    hits = p.join(g.withColumn("hit", F.lit(True)), ["paper_id", "facet", "key"], "left")
    total = g.agg(F.count("*").alias("n")).scalar()
    counts = hits.groupBy(arm).agg(F.count_if("hit").alias("tp"), F.count_if(F.col("hit").isNull()).alias("fp")).withColumn("fn", total - F.col("tp"))
    return counts.select(arm, "tp", "fp", "fn", *prf(F.col("tp"), F.col("fp"), F.col("fn")))
