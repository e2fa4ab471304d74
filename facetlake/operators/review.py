"""Reviewed label sets: multi-sentence grounding, training targets, split reports, lineage gates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facetlake.functions import rules as R
from facetlake.operators import gates as G
from facetlake.operators.extraction import best_attempt
from facetlake.operators.facets import FACETS
from facetlake.operators.sampling import draw, sample


def joined_evidence(items: DataFrame, evidence: DataFrame) -> DataFrame:
    """Items (paper_id, facet, index, concept, evidence_ids) with their sentences in source order as one text.

    Ids must be known, distinct and in order; n_missing counts what is not.
    """
    each = items.select("*", F.posexplode("evidence_ids").alias("i", "evidence_id")).join(evidence.select("paper_id", "evidence_id", "evidence"), ["paper_id", "evidence_id"], "left")
    place = F.when(F.startswith("evidence_id", F.lit("T")), -1).otherwise(F.substring("evidence_id", 2, 9).cast("int"))
    found = each.withColumn("place", place).groupBy("paper_id", "facet", "index", "concept").agg(
        F.array_sort(F.collect_list(F.struct("i", "place", "evidence"))).alias("parts"), F.count_if(F.col("evidence").isNull()).alias("n_unknown")
    )
    places = F.transform("parts", lambda p: p["place"])
    ordered = places == F.array_sort(F.array_distinct(places))
    return found.select("paper_id", "facet", "index", "concept", F.array_join(F.transform("parts", lambda p: p["evidence"]), " ").alias("evidence"), (F.col("n_unknown") + F.when(ordered, 0).otherwise(1)).alias("n_missing"))


def ordered_words(concept: Column, evidence: Column) -> Column:
    """Whether a label's words stand in a text in their order."""
    return R.column(lambda c, e: R.tightest(R.tokens(c), R.tokens(e)) is not None, "boolean")(concept, evidence)


def targets(gold: DataFrame) -> DataFrame:
    """(paper_id, answer): the training answer as JSON, facets in order, items as they are listed. gold: paper_id, facet, index, concept, evidence_id."""
    by = gold.groupBy("paper_id", "facet").agg(F.transform(F.array_sort(F.collect_list(F.struct("index", "concept", "evidence_id"))), lambda x: F.struct(x["concept"].alias("concept"), x["evidence_id"].alias("evidence_id"))).alias("items"))
    wide = by.groupBy("paper_id").agg(F.map_from_entries(F.collect_list(F.struct("facet", "items"))).alias("m"))
    empty = F.slice(F.array(F.struct(F.lit("").alias("concept"), F.lit("").alias("evidence_id"))), 1, 0)
    return wide.select("paper_id", F.to_json(F.struct(F.col("paper_id"), *[F.coalesce(F.try_element_at("m", F.lit(f)), empty).alias(f) for f in FACETS])).alias("answer"))


def newest_valid(attempts: DataFrame) -> DataFrame:
    """One attempt a paper: the last valid review; without one, the attempt with most items, then as the score ranks."""
    review = (F.col("stage") == "review") & F.col("valid")
    last = attempts.filter(review).withColumn("n", F.row_number().over(Window.partitionBy("paper_id").orderBy(F.desc("attempt")))).filter("n = 1").drop("n")
    rest = attempts.join(last.select("paper_id"), "paper_id", "left_anti")
    most = rest.withColumn("most", F.max("n_items").over(Window.partitionBy("paper_id"))).filter("n_items = most").drop("most")
    return last.unionByName(best_attempt(most))


def features(labels: DataFrame, lengths: DataFrame, cutoffs: Sequence[float]) -> DataFrame:
    """(paper_id, features) for stratification: facets present, facets with several labels, length class, origin. lengths: paper_id, n_chars, origin."""
    counts = labels.groupBy("paper_id", "facet").agg(F.count("*").alias("n"))
    marks = counts.groupBy("paper_id").agg(F.flatten(F.collect_list(F.when(F.col("n") > 1, F.array(F.concat(F.lit("has_"), "facet"), F.concat(F.lit("many_"), "facet"))).otherwise(F.array(F.concat(F.lit("has_"), "facet"))))).alias("m"))
    level = sum((F.when(F.col("n_chars") > c, 1).otherwise(0) for c in cutoffs), F.lit(0))
    base = lengths.select("paper_id", F.array(F.concat(F.lit("length_"), level.cast("string")), F.concat(F.lit("origin_"), "origin")).alias("b"))
    return base.join(marks, "paper_id", "left").select("paper_id", F.array_sort(F.concat("b", F.coalesce("m", F.array().cast("array<string>")))).alias("features"))


def split_report(labels: DataFrame, splits: DataFrame) -> DataFrame:
    """Papers with a facet, with several labels in it, and labels, by split and facet. splits: paper_id, split."""
    counts = splits.join(labels, "paper_id", "left").groupBy("split", "paper_id", "facet").agg(F.count("concept").alias("n"))
    return counts.filter("facet is not null").groupBy("split", "facet").agg(F.count_if(F.col("n") > 0).alias("n_present"), F.count_if(F.col("n") > 1).alias("n_multiple"), F.sum("n").alias("n_concepts"))


def eligible(rows: DataFrame, held_out: DataFrame, development: str = "P000001") -> DataFrame:
    """Reviewed examples fit for training: not held out by id or by text, not the development paper, one a text. rows: paper_id, title, abstract."""
    key = F.sha2(F.lower(F.concat_ws("\u0001", "title", "abstract")), 256)
    keyed = rows.withColumn("text_key", key)
    kept = keyed.filter(F.col("paper_id") != development).join(held_out.select("paper_id"), "paper_id", "left_anti").join(held_out.select(key.alias("text_key")).distinct(), "text_key", "left_anti")
    return kept.withColumn("n", F.row_number().over(Window.partitionBy("text_key").orderBy("paper_id"))).filter("n = 1").drop("n", "text_key")


def check_no_leak(splits: DataFrame, texts: DataFrame) -> None:
    """No paper and no text on two sides. splits: paper_id, split; texts: paper_id, title, abstract."""
    G.require_none(G.split_leaks(splits, "paper_id"), "a paper is on two sides")
    keyed = splits.join(texts, "paper_id").withColumn("text_key", F.sha2(F.lower(F.concat_ws("\u0001", "title", "abstract")), 256))
    G.require_none(G.split_leaks(keyed, "text_key"), "a text is on two sides")


def check_reviews(decisions: DataFrame, labels: DataFrame) -> None:
    """Lineage of reviewed labels: every label decided once, by someone other than its author, with a reason for what is not kept. decisions: paper_id, facet, concept, decision, author, reviewer, reason."""
    key = ["paper_id", "facet", "concept"]
    G.require_none(G.repeated(decisions, key), "a label is decided twice")
    G.require_none(G.differences(decisions.select(*key), labels.select(*key).distinct()), "decisions and labels differ")
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    wrong = blank("author") | blank("reviewer") | (F.col("author") == F.col("reviewer")) | ~F.col("decision").isin("keep", "edit", "remove") | ((F.col("decision") != "keep") & blank("reason"))
    G.require_none(decisions.filter(F.coalesce(wrong, F.lit(True))), "a decision lacks an independent reviewer or a reason")


def merged_groups(groups: Sequence[DataFrame], expected: DataFrame) -> DataFrame:
    """Reviewed groups as one: apart from each other, together the expected papers."""
    out = groups[0]
    for g in groups[1:]:
        G.require_none(out.join(g.select("paper_id"), "paper_id", "left_semi").select("paper_id"), "groups share a paper")
        out = out.unionByName(g)
    G.require_none(G.differences(out.select("paper_id").distinct(), expected.select("paper_id").distinct()), "groups don't cover the expected papers")
    return out


def freeze(reviewed: DataFrame, n: int, batches: int, seed: str) -> DataFrame:
    """n reviewed papers drawn by hash and dealt into batches."""
    chosen = sample(reviewed.select("paper_id").distinct(), n, seed, ["paper_id"])
    return chosen.withColumn("batch", F.pmod(F.row_number().over(Window.orderBy(draw(seed, "paper_id"))) - 1, F.lit(batches)).cast("int"))
