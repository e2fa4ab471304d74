"""Deterministic sampling, quotas and splits: draws depend on a seed and an id, never on partitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw(seed: str, *ids: str) -> Column:
    """The order of a draw: an MD5 of the seed and the ids."""
    return F.md5(F.concat_ws(":", F.lit(seed), *[F.col(i).cast("string") for i in ids]))


def sample(rows: DataFrame, n: int, seed: str, ids: Sequence[str]) -> DataFrame:
    """n rows without replacement: a distributed top-n by draw."""
    return rows.withColumn("_draw", draw(seed, *ids)).orderBy("_draw", *ids).limit(n).drop("_draw")


def sample_each(rows: DataFrame, n: int, group: Sequence[str], seed: str, ids: Sequence[str]) -> DataFrame:
    """n rows of each group without replacement."""
    order = Window.partitionBy(*group).orderBy(draw(seed, *group, *ids), *ids)
    return rows.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= n).drop("_n")


def candidate_sample(pools: DataFrame, count: int, positive_fraction: float, hard_fraction: float, seed: str) -> DataFrame:
    """(case_id, paper_id, kind, place) from pools (case_id, paper_id, kind: positive, hard or easy).

    Positives: the rounded share, at least 1, at most what there is and count - 1,
    and enough that the negatives can fill the rest. Hard negatives: the rounded
    share of the rest. The remaining negatives may be hard too. A case with an
    empty side or too small a pool gets no rows. Rounding is half to even.
    """
    sizes = pools.groupBy("case_id").agg(F.count_if(F.col("kind") == "positive").alias("n_pos"), F.count_if(F.col("kind") == "hard").alias("n_hard"), F.count_if(F.col("kind") != "positive").alias("n_neg"))
    ok = sizes.filter((F.col("n_pos") > 0) & (F.col("n_neg") > 0) & (F.col("n_pos") + F.col("n_neg") >= count))
    half_even = lambda c: F.bround(c, 0).cast("int")
    wanted = F.greatest(F.lit(1), F.least(F.col("n_pos").cast("int"), F.lit(count - 1), half_even(F.lit(count * positive_fraction))))
    quota = ok.withColumn("take_pos", F.greatest(wanted, F.lit(count) - F.col("n_neg").cast("int"))).withColumn("take_neg", F.lit(count) - F.col("take_pos")).withColumn("take_hard", F.least(F.col("n_hard").cast("int"), half_even(F.col("take_neg") * hard_fraction)))
    drawn = pools.withColumn("_draw", draw(seed, "case_id", "paper_id"))
    by_kind = Window.partitionBy("case_id", "kind").orderBy("_draw", "paper_id")
    # a case takes at most count of a kind, its first ones: later ones are dropped before the shuffle
    first = drawn.withColumn("_in_kind", F.row_number().over(by_kind)).filter(F.col("_in_kind") <= count)
    rows = first.join(quota.hint("merge"), "case_id")
    rows = rows.withColumn("_first", ((F.col("kind") == "positive") & (F.col("_in_kind") <= F.col("take_pos"))) | ((F.col("kind") == "hard") & (F.col("_in_kind") <= F.col("take_hard"))))
    rest = Window.partitionBy("case_id", F.col("_first") | (F.col("kind") == "positive")).orderBy("_draw", "paper_id")
    chosen = rows.withColumn("_rest", F.row_number().over(rest)).filter(F.col("_first") | ((F.col("kind") != "positive") & (F.col("_rest") <= F.col("take_neg") - F.col("take_hard"))))
    place = F.row_number().over(Window.partitionBy("case_id").orderBy(F.md5(F.concat(F.lit("place:"), "_draw")), "paper_id"))
    return chosen.withColumn("place", place).select("case_id", "paper_id", "kind", "place")


def grouped_splits(rows: DataFrame, anchor: str, seed: str, shares: tuple[float, float] = (0.7, 0.85)) -> DataFrame:
    """Adds split (train, dev, test): all rows of an anchor are on one side; floor(n * share) anchors by draw.

    Anchors are ranked over ranges of their draws, so no task sees them all.
    """
    from facetlake.storage import numbered

    anchors = rows.select(anchor).distinct().withColumn("_draw", draw(seed, anchor))
    ranked = numbered(anchors, ["_draw", anchor], "_place")
    total = ranked.agg(F.count("*").alias("n")).scalar()
    side = F.when(F.col("_place") <= F.floor(total * shares[0]), "train").when(F.col("_place") <= F.floor(total * shares[1]), "dev").otherwise("test")
    return rows.join(ranked.select(anchor, side.alias("split")), anchor)


def largest_remainder(weights: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """(key, quota): whole numbers that add up to total, in proportion; leftovers to the largest remainders, then by key."""
    exact = F.col(weight) * total / F.sum(weight).over(Window.partitionBy())
    rows = weights.withColumn("exact", exact).withColumn("low", F.floor("exact"))
    left = F.lit(total) - F.sum("low").over(Window.partitionBy())
    order = Window.partitionBy().orderBy(F.desc(F.col("exact") - F.col("low")), key)
    return rows.withColumn("quota", F.col("low") + F.when(F.row_number().over(order) <= left, 1).otherwise(0)).select(key, "quota")


def shards(rows: DataFrame, n: int, order: list[str]) -> DataFrame:
    """Adds shard: the place in order, modulo n."""
    from facetlake.storage import numbered

    return numbered(rows, order, "_place").withColumn("shard", F.pmod(F.col("_place") - 1, F.lit(n)).cast("int")).drop("_place")


def places(rows: DataFrame, order: list[str], first: int, last: int) -> DataFrame:
    """Rows at 1-based places first to last, both included."""
    from facetlake.storage import numbered

    return numbered(rows, order, "place").filter(F.col("place").between(first, last))


def one_per(rows: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_n = 1").drop("_n")


def teacher_sample(papers: DataFrame, excluded: Sequence[DataFrame], n: int, batches: int, seed: str) -> DataFrame:
    """n papers (paper_id, title), none excluded by id or title, one a title, dealt into batches."""
    kept = papers
    for x in excluded:
        kept = kept.join(x.select("paper_id"), "paper_id", "left_anti").join(x.select("title").distinct(), "title", "left_anti")
    chosen = sample(one_per(kept, ["title"], ["paper_id"]), n, seed, ["paper_id"])
    #: n is a parameter, so the window sees a bounded sample
    return chosen.withColumn("batch", F.pmod(F.row_number().over(Window.orderBy(draw(seed, "paper_id"))) - 1, F.lit(batches)).cast("int"))


def stratify(records: list[tuple[str, frozenset[str]]], sizes: dict[str, int], seed: str) -> dict[str, str]:
    """Iterative multilabel stratification of (id, features), the rarest feature first.

    Each record goes to the split that still lacks most of the feature, then has
    most room. Greedy and sequential by nature: meant for reviewed sets that one
    process holds (hundreds of records), see ``stratified``.
    """
    import hashlib

    coin = lambda *x: hashlib.md5(":".join((seed, *x)).encode()).hexdigest()
    total = len(records)
    left = {i: f for i, f in records}
    room = dict(sizes)
    lack = {s: {} for s in sizes}
    for _, features in records:
        for f in features:
            for s in sizes:
                lack[s][f] = lack[s].get(f, 0) + sizes[s] / total
    out: dict[str, str] = {}
    while left:
        counts: dict[str, int] = {}
        for features in left.values():
            for f in features:
                counts[f] = counts.get(f, 0) + 1
        rare = min(counts, key=lambda f: (counts[f], f)) if counts else None
        ids = sorted((i for i in left if rare is None or rare in left[i]), key=lambda i: coin(i))
        for i in ids:
            side = max((s for s in sizes if room[s] > 0), key=lambda s: (lack[s].get(rare, 0), room[s], coin(i, s)))
            out[i] = side
            room[side] -= 1
            for f in left.pop(i):
                lack[side][f] -= 1
    return out


def stratified(records: DataFrame, sizes: dict[str, int], seed: str) -> DataFrame:
    """(paper_id, split) of records (paper_id, features array): one group, as the sizes are fixed numbers."""
    import pandas as pd

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        found = stratify([(i, frozenset(f)) for i, f in zip(rows["paper_id"], rows["features"], strict=True)], sizes, seed)
        return pd.DataFrame({"paper_id": list(found), "split": list(found.values())})

    return records.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(run, "paper_id string, split string")
