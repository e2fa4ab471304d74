"""Mixing sources to target weights by distributed prefix sums (DataFrame functions only).

Every document gets a hash-random key, of its id and text. Within its source, documents are ordered
by that key; the key's leading digits deal a source into ranges, so a source
with a third of all rows is many groups. Sums of the ranges are made first
(map-side combined), their prefix sums give each range its offset, and a window
inside the range finishes the prefix sum of sizes. A source's budget is cut
from that order exactly: whole epochs first, then the documents in front of the
cut, the last one in part.

Defined results: a null text has size 0; a null source is a source of its own,
after all others; null or repeated ids and repeated rows are ordinary rows
(equal keys are ordered by id, then size); an empty table gives no rows; other
columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facetlake.llm.common import words_of, written

#: Hexadecimal digits of the key that deal a source into ranges: 16 ** 3 ranges.
RANGE_DIGITS = 3


def source_targets(sizes: DataFrame, weights: tuple[int, ...], max_epochs: int) -> DataFrame:
    """Targets of sources from (src, src_null, source_size): shares by weight, stopped at max_epochs times the size.

    Sources ordered by cap per weight are capped from the front; the rest share
    what is left by weight. That is the fixed point of resharing the excess.
    The table has one row a source.
    """
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), F.pmod(F.col("rank") - 1, F.lit(len(weights))).cast("int") + 1).cast("long")
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy("src_null", "src"))).withColumn("weight", w).withColumn("cap", F.col("source_size") * max_epochs)
    every = Window.partitionBy()
    front = Window.orderBy(F.col("cap") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    left = ranked.select(
        "*",
        F.sum("source_size").over(every).alias("total"),
        F.sum("weight").over(every).alias("all_w"),
        F.coalesce(F.sum("cap").over(front), F.lit(0)).alias("cap_before"),
        F.coalesce(F.sum("weight").over(front), F.lit(0)).alias("w_before"),
    ).withColumn("capped", F.col("cap") * 1.0 <= F.col("weight") * ((F.col("total") - F.col("cap_before")) / (F.col("all_w") - F.col("w_before"))))
    rest = left.select(
        "*",
        F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(every), F.lit(0)).alias("cap_sum"),
        F.coalesce(F.sum(F.when(F.col("capped"), F.col("weight"))).over(every), F.lit(0)).alias("w_sum"),
    )
    share = F.try_divide(F.col("total") - F.col("cap_sum"), F.col("all_w") - F.col("w_sum"))
    return rest.select("src", "src_null", "source_size", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("weight") * share).alias("target"))


def mix_plan(docs: DataFrame, *, text: str = "text", source: str = "source", doc_id: str = "doc_id", weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3, seed: str = "mix", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, and the columns in ``carry``.

    ``taken`` counts words, repeats included; a source's add up to its rounded
    target. ``carry`` columns travel with the rows (for a later join or sink).
    """
    digest = F.coalesce(F.md5(F.col(text).cast("binary")), F.lit("null"))
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("null")), F.lit(":"), digest))
    base = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.col(source).alias("source"),
        F.coalesce(F.col(source), F.lit("")).alias("src"),
        F.col(source).isNull().alias("src_null"),
        F.size(words_of(F.col(text))).cast("long").alias("size"),
        key.alias("key"),
        *[F.col(c).alias(f"carry_{c}") for c in carry],
    ).withColumn("range", F.substring("key", 1, RANGE_DIGITS))
    base = written(base, "mix-sizes")
    group = ["src", "src_null", "range"]
    ranges = written(base.groupBy(*group).agg(F.sum("size").alias("range_size")), "mix-ranges")
    targets = source_targets(ranges.groupBy("src", "src_null").agg(F.sum("range_size").alias("source_size")), weights, max_epochs)
    before = Window.partitionBy("src", "src_null").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.withColumn("offset", F.coalesce(F.sum("range_size").over(before), F.lit(0))).join(targets, ["src", "src_null"]).select(*group, "offset", "source_size", "target")
    inside = Window.partitionBy(*group).orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = base.join(offsets, group).withColumn("start", F.col("offset") + F.sum("size").over(inside) - F.col("size"))
    return placed.select("doc_id", "source", "size", "source_size", "target", _taken(F.col("size"), F.col("start"), F.col("source_size"), F.col("target")).alias("taken"), *[F.col(f"carry_{c}").alias(c) for c in carry])


def _taken(size: Column, start: Column, source_size: Column, target: Column) -> Column:
    """Whole epochs, and of one more what lies before the cut."""
    budget = F.round(target).cast("long")
    epochs = F.when(source_size > 0, F.floor(budget / source_size)).otherwise(0).cast("long")
    rest = budget - epochs * source_size
    return (epochs * size + F.greatest(F.lit(0).cast("long"), F.least(size, rest - start))).cast("long")


def mix(docs: DataFrame, *, text: str = "text", **options) -> DataFrame:
    """The mixed corpus with the columns of ``docs``: a row for each started pass over a document.

    A document of which the cut takes a part is given whole if that part is at
    least half of it. Documents without words carry nothing to the mix and go.
    """
    columns = docs.columns
    plan = mix_plan(docs.select(F.struct(*[F.col(c) for c in columns]).alias("row"), *[F.col(c).alias(f"use_{c}") for c in ("doc_id", "source")], F.col(text).alias("use_text")), doc_id="use_doc_id", source="use_source", text="use_text", carry=("row",), **options)
    times = F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
    return plan.withColumn("times", times).filter("times > 0").select(F.explode(F.array_repeat(F.col("row"), F.col("times"))).alias("row")).select("row.*")
