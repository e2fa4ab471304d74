"""Facet concepts: the long table (paper_id, facet, concept) and predicates on concept sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetlake.functions import text as T

#: The five facets, in their order, and the fixed weights of the weighted scorer.
FACETS = ("problem", "task", "method", "dataset", "contribution")
FIXED_WEIGHTS = {"problem": 0.4, "task": 0.2, "method": 0.2, "dataset": 0.1, "contribution": 0.1}


def concept_sets(facets: DataFrame, metadata: DataFrame | None = None, *, faithful: bool = True) -> DataFrame:
    """(paper_id, facet, concept) from (paper_id, one array column a facet).

    Concepts are normalized and distinct, empty ones go. Papers whose metadata
    say that a fallback was used, or list errors, are dropped as a whole: they
    are missing, not empty.
    """
    if metadata is not None:
        bad = metadata.filter(F.coalesce("fallback_used", F.lit(False)) | (F.coalesce(F.size("validation_errors"), F.lit(0)) > 0))
        facets = facets.join(bad.select("paper_id"), "paper_id", "left_anti")
    long = facets.select("paper_id", F.inline(F.array(*[F.struct(F.lit(f).alias("facet"), F.col(f).alias("concepts")) for f in FACETS])))
    concept = F.explode("concepts").alias("concept")
    fold = T.fold if faithful else F.lower
    return long.select("paper_id", "facet", concept).withColumn("concept", T.normalized(fold(F.col("concept")))).filter("concept <> ''").distinct()


def arrays(concepts: DataFrame) -> DataFrame:
    """(paper_id, concepts): a map from facet to its sorted concepts; empty facets are absent."""
    by = concepts.groupBy("paper_id", "facet").agg(F.sort_array(F.collect_set("concept")).alias("c"))
    return by.groupBy("paper_id").agg(F.map_from_entries(F.collect_list(F.struct("facet", "c"))).alias("concepts"))


def facet_relevance(query: Column, candidate: Column) -> Column:
    """2 for equal sets, 1 for overlapping, 0 for apart, null if either is empty or missing."""
    some = (F.coalesce(F.size(query), F.lit(0)) > 0) & (F.coalesce(F.size(candidate), F.lit(0)) > 0)
    overlap = F.arrays_overlap(query, candidate)
    # most pairs are alike or apart; only overlapping ones are sorted
    same = F.sort_array(F.array_distinct(query)) == F.sort_array(F.array_distinct(candidate))
    return F.when(some, F.when(query == candidate, 2).when(~overlap, 0).when(same, 2).when(overlap, 1).otherwise(0))


def retrieval_grade(query: Column, candidate: Column, weights: dict[str, float] = FIXED_WEIGHTS) -> Column:
    """Weighted sum of the facets' relevances over maps of concepts; an undefined one adds 0."""
    return sum((F.lit(w) * F.coalesce(facet_relevance(F.try_element_at(query, F.lit(f)), F.try_element_at(candidate, F.lit(f))), F.lit(0)) for f, w in weights.items()), F.lit(0.0))


def overlap_state(anchor: Column, paper: Column, facet: str) -> Column:
    """Null if either side has no concept in the facet, else whether they share one."""
    a, p = F.try_element_at(anchor, F.lit(facet)), F.try_element_at(paper, F.lit(facet))
    return F.when(a.isNotNull() & p.isNotNull() & (F.size(a) > 0) & (F.size(p) > 0), F.arrays_overlap(a, p))


def signature(anchor: Column, paper: Column, but: str) -> Column:
    """The overlap states in all other facets, as text with one sign each: "1", "0" or "-"."""
    return F.concat(*[F.coalesce(F.when(overlap_state(anchor, paper, f), "1").otherwise(F.when(overlap_state(anchor, paper, f).isNotNull(), "0")), F.lit("-")) for f in FACETS if f != but])


def session_grade(anchor: Column, candidate: Column, focus: str, direction: Column, context: str = "problem") -> Column:
    """2 in context and in the wanted direction, 1 in context only, 0 otherwise or where evidence is missing."""
    near, same = overlap_state(anchor, candidate, context), overlap_state(anchor, candidate, focus)
    has = F.coalesce(F.size(F.try_element_at(candidate, F.lit(context))), F.lit(0)) > 0
    near = F.coalesce(near, F.lit(False))
    return F.when(~has | same.isNull(), 0).when(near & (same == (direction == "similar")), 2).when(near, 1).otherwise(0)


def postings(concepts: DataFrame) -> DataFrame:
    """The inverted index, one row a concept: (facet, concept, n_papers)."""
    return concepts.groupBy("facet", "concept").agg(F.count_distinct("paper_id").alias("n_papers"))


def index(concepts: DataFrame) -> DataFrame:
    """The inverted index as rows (facet, concept, paper_id), each once: a common concept is many rows, never one large list."""
    return concepts.select("facet", "concept", "paper_id").distinct()


#: Papers with at most so many concepts are counted by their subsets (2 ** 6 of them at most).
NARROW = 6


def sharing_counts(anchors: DataFrame, concepts: DataFrame) -> DataFrame:
    """(anchor_id, n): how many other papers share a concept with the anchor in any facet; anchors without any are left out.

    No pair of papers is made for narrow sides: how many papers hold all concepts of a set is counted once for each
    set, and an anchor adds up the counts of its own sets, odd ones less even ones (inclusion and exclusion).
    Papers or anchors with more than ``NARROW`` concepts meet by ``sharing``.
    """
    own = concepts.select("paper_id", F.struct("facet", "concept").alias("c")).distinct().groupBy("paper_id").agg(F.array_sort(F.collect_list("c")).alias("own"))
    narrow = F.size("own") <= NARROW
    none = F.array().cast("array<array<struct<facet: string, concept: string>>>")
    grown = F.aggregate("own", F.concat(none, F.array(F.array().cast("array<struct<facet: string, concept: string>>"))), lambda sets, c: F.concat(sets, F.transform(sets, lambda s: F.concat(s, F.array(c)))))
    subsets = lambda rows, *keep: rows.filter(narrow).select(*keep, F.explode(F.filter(grown, lambda s: F.size(s) > 0)).alias("part"))
    # equal papers are counted together before they are spread over their subsets
    held = subsets(own.groupBy("own").agg(F.count("*").alias("alike")), "alike").groupBy("part").agg(F.sum("alike").alias("holding"))
    asked = anchors.join(own.hint("merge"), F.col("anchor_id") == F.col("paper_id")).select("anchor_id", "own")
    signed = F.sum(F.when(F.size("part") % 2 == 1, F.col("holding")).otherwise(-F.col("holding")))
    counted = subsets(asked, "anchor_id").join(held.hint("merge"), "part").groupBy("anchor_id").agg((signed - 1).alias("n"))
    wide = own.filter(~narrow).select("paper_id")
    of = lambda rows: concepts.join(rows.hint("merge"), "paper_id", "left_semi")
    # narrow anchors with wide papers, and wide anchors with all
    small, large = asked.filter(narrow).select("anchor_id"), asked.filter(~narrow).select("anchor_id")
    own_of = lambda some: concepts.join(some.select(F.col("anchor_id").alias("paper_id")).hint("merge"), "paper_id", "left_semi")
    beside = _shared(own_of(small), of(wide)).unionByName(_shared(own_of(large), concepts)).groupBy("anchor_id").agg(F.count("*").alias("n"))
    return counted.unionByName(beside).groupBy("anchor_id").agg(F.sum("n").alias("n")).filter("n > 0")


def _shared(own: DataFrame, concepts: DataFrame) -> DataFrame:
    left = own.select(F.col("paper_id").alias("anchor_id"), "facet", "concept")
    return left.join(concepts.hint("merge"), ["facet", "concept"]).filter("paper_id <> anchor_id").select("anchor_id", "paper_id").distinct()


def sharing(anchors: DataFrame, concepts: DataFrame) -> DataFrame:
    """(anchor_id, paper_id) of other papers that share a concept with the anchor in any facet."""
    own = anchors.join(concepts, anchors.anchor_id == concepts.paper_id).select("anchor_id", "facet", "concept")
    return own.join(concepts, ["facet", "concept"]).filter("paper_id <> anchor_id").select("anchor_id", "paper_id").distinct()
