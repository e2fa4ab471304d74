"""Search texts as concepts: "facet: phrase; ..." with included and excluded concepts.

The vocabulary stays a table: whole phrases meet it by equality; the words of the rest
walk a trie of all concepts, kept as a table of prefix hashes, a word deeper each round.
Places are running sums of word lengths. Overlapping hits are settled longest concept
first, among those that hang together.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facetlake.functions import text as T
from facetlake.operators.facets import FACETS
from facetlake.storage import written

#: Phrases around a concept, and what excludes the concept that follows it.
LEADS = "^(alternatives to |more papers using )"
ENDING = " papers$"
#: Hits of a run that are settled in its array; longer runs get a mark for each character.
SHORT_RUN = 64
EXCLUDES_BEFORE = r"(without|excluding|alternatives? to|instead of|not using)\s*$"


def segments(searches: DataFrame, fold: Callable[[Column], Column]) -> DataFrame:
    """A row for each segment and facet it may speak of: seg, facet, content."""
    split = searches.select("*", F.posexplode(F.split("text", ";")).alias("seg", "segment"))
    head = T.normalized(fold(F.substring_index("segment", ":", 1)))
    named = F.contains("segment", F.lit(":")) & head.isin(*FACETS)
    tail = F.expr("substring(segment, instr(segment, ':') + 1)")
    facets = F.when(named, F.array(head)).otherwise(F.array(*map(F.lit, FACETS)))
    return split.select("*", F.explode(facets).alias("facet"), T.normalized(fold(F.when(named, tail).otherwise(F.col("segment")))).alias("content")).drop("segment")


def trie(vocabulary: DataFrame) -> DataFrame:
    """(facet, depth, prefix, concept): a row for each beginning of a concept, named by a chained hash of its words; concept where one ends."""
    words = vocabulary.withColumn("words", F.split("concept", " "))
    start = F.struct(F.lit(0).cast("long").alias("prefix"), F.lit(0).alias("depth"), F.array().cast("array<struct<depth: int, prefix: bigint>>").alias("steps"))

    def grown(state: Column, word: Column) -> Column:
        prefix, depth = _chained(state["prefix"], word), state["depth"] + 1
        return F.struct(prefix.alias("prefix"), depth.alias("depth"), F.concat(state["steps"], F.array(F.struct(depth.alias("depth"), prefix.alias("prefix")))).alias("steps"))

    walked = words.select("facet", "concept", F.size("words").alias("n"), F.inline(F.aggregate("words", start, grown, lambda state: state["steps"])))
    return walked.groupBy("facet", "depth", "prefix").agg(F.max(F.when(F.col("depth") == F.col("n"), F.col("concept"))).alias("concept"))


def _chained(prefix: Column, word: Column) -> Column:
    return F.xxhash64(prefix, word)


def trie_hits(words: DataFrame, vocabulary: DataFrame, row: list[str]) -> DataFrame:
    """(row, facet, i, concept) for every concept that begins at word i; words: row, facet, i, word.

    The trie is walked from all words at once: at depth d the beginnings still in the trie meet
    their next word by position, and the trie by the prefix grown by it. Few words begin a
    concept, so what is left shrinks at once; rounds end when nothing is left.
    """
    index = written(trie(vocabulary), "trie")
    at_depth = lambda rows, d: written(rows.join(index.filter(F.col("depth") == d).drop("depth").hint("merge"), ["facet", "prefix"]), "trie-walk")
    live = at_depth(words.select(*row, "facet", "i", F.col("i").alias("last"), _chained(F.lit(0).cast("long"), F.col("word")).alias("prefix")), 1)
    found, depth = live, 1
    while not live.isEmpty():
        depth += 1
        following = words.select(*row, "facet", F.col("i").alias("last"), "word")
        grown = live.drop("concept").withColumn("last", F.col("last") + 1).join(following.hint("merge"), [*row, "facet", "last"])
        live = at_depth(grown.select(*row, "facet", "i", "last", _chained(F.col("prefix"), F.col("word")).alias("prefix")), depth)
        found = found.unionByName(live)
    return found.filter("concept is not null").select(*row, "facet", "i", "concept")


def longest_first(hits: DataFrame, row: list[str]) -> DataFrame:
    """Of overlapping hits (row, at, concept, ...) the longest, then the first by concept and place.

    Only hits that hang together by overlaps are settled together; a window over the places tells where a new run begins.
    """
    end = F.col("at") + F.length("concept")
    before = Window.partitionBy(*row).orderBy("at", F.desc(F.length("concept")), "concept").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*row).orderBy("at", F.desc(F.length("concept")), "concept").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    apart = F.coalesce(F.max(end).over(before) <= F.col("at"), F.lit(True)).cast("int")
    others = [c for c in hits.columns if c not in (*row, "at", "concept")]
    runs = hits.withColumn("apart", apart).withColumn("run", F.sum("apart").over(upto)).withColumn("n", F.count("*").over(Window.partitionBy(*row, "run"))).drop("apart")
    runs = written(runs, "runs")
    listed = runs.filter(F.col("n") <= SHORT_RUN).groupBy(*row, "run").agg(F.array_sort(F.collect_list(F.struct((-F.length("concept")).alias("less"), "concept", "at", *others))).alias("hits"))
    ends = lambda s: s["at"] - s["less"]
    free = lambda taken, s: ~F.exists(taken, lambda t: (t["at"] < ends(s)) & (s["at"] < ends(t)))
    kept = F.aggregate("hits", F.slice("hits", 1, 0), lambda taken, s: F.when(free(taken, s), F.concat(taken, F.array(s))).otherwise(taken))
    short = listed.select(*row, F.inline(kept)).select(*hits.columns)
    long = runs.filter(F.col("n") > SHORT_RUN).select(*hits.columns, "run")
    settled = long.groupBy(*row, "run").applyInPandas(_settled, long.schema).select(*hits.columns)
    return short.unionByName(settled)


def _settled(rows: pd.DataFrame) -> pd.DataFrame:
    """The same choice for a long run (part of one text), with a mark for each character."""
    length = rows["concept"].str.len()
    rows = rows.assign(_length=length).sort_values(["_length", "concept", "at"], ascending=[False, True, True])
    first = int(rows["at"].min())
    taken, keep = np.zeros(int((rows["at"] + rows["_length"]).max()) - first, bool), np.zeros(len(rows), bool)
    for i, (at, n) in enumerate(zip((rows["at"] - first).tolist(), rows["_length"].tolist(), strict=True)):
        if not taken[at : at + n].any():
            taken[at : at + n] = keep[i] = True
    return rows[keep].drop(columns="_length")


def mentions(searches: DataFrame, concepts: DataFrame, fold: Callable[[Column], Column] = F.lower) -> DataFrame:
    """The columns of ``searches`` (text among them), facet, concept, sign: 1 for included, -1 for excluded concepts."""
    keys, row = [c for c in searches.columns if c != "text"], ["search_row", "seg", "facet"]
    vocabulary = written(concepts.select("facet", "concept").distinct(), "vocabulary")
    own = written(searches.withColumn("search_row", F.monotonically_increasing_id()), "searches")
    seg = written(segments(own.select("search_row", "text"), fold).withColumn("direct", F.regexp_replace(F.regexp_replace("content", LEADS, ""), ENDING, "")).select(*row, "content", "direct"), "segments")
    whole = vocabulary.withColumnRenamed("concept", "direct").hint("merge")
    sign = F.when(F.startswith("content", F.lit("alternatives to ")), -1).otherwise(1)
    direct = seg.join(whole, ["facet", "direct"]).select("search_row", "facet", F.col("direct").alias("concept"), sign.alias("sign"))
    split = seg.join(whole, ["facet", "direct"], "left_anti").select(*row, F.posexplode(F.split("content", " ")).alias("i", "word"))
    ahead = Window.partitionBy(*row).orderBy("i")
    at = F.coalesce(F.sum(F.length("word") + 1).over(ahead.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int")
    #: What excludes a concept has at most two words.
    led_by = F.concat(F.coalesce(F.lag("word", 2).over(ahead), F.lit("")), F.lit(" "), F.coalesce(F.lag("word", 1).over(ahead), F.lit("")), F.lit(" "))
    words = written(split.select(*row, "i", "word", at.alias("at"), led_by.alias("led_by")), "search-words")
    hits = trie_hits(words.select(*row, "i", "word"), vocabulary, ["search_row", "seg"]).join(words.select(*row, "i", "at", "led_by").hint("merge"), [*row, "i"]).drop("i")
    found = longest_first(hits, row).select("search_row", "facet", "concept", F.when(F.regexp_like("led_by", F.lit(EXCLUDES_BEFORE)), -1).otherwise(1).alias("sign"))
    return own.select("search_row", *keys).join(direct.unionByName(found).hint("merge"), "search_row").drop("search_row").distinct()
