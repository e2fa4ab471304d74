"""Ranking and extraction metrics.

Two ranking conventions are kept apart by name. ``graded_metrics``: gain
2^grade - 1, null without a positive. ``linear_metrics`` and
``binary_metrics``: gain equal to the grade, 0 without a positive.
Input is always a long table (case columns, rank from 1, grade).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(scores: DataFrame, case: Sequence[str], item: str = "paper_id", score: str = "score") -> DataFrame:
    """rank: by score, greatest first, then by item."""
    order = Window.partitionBy(*case).orderBy(F.desc(score), F.asc(item))
    return scores.withColumn("rank", F.row_number().over(order))


def top(scores: DataFrame, k: int, case: Sequence[str], item: str = "paper_id", score: str = "score") -> DataFrame:
    return ranked(scores, case, item, score).filter(F.col("rank") <= k)


def _ideal(rows: DataFrame, case: Sequence[str], grade: str) -> DataFrame:
    return rows.withColumn("ideal", F.row_number().over(Window.partitionBy(*case).orderBy(F.desc(grade), F.asc("rank"))))


def _dcg(gain: Column, rank: Column, k: int) -> Column:
    return F.sum(F.when(rank <= k, gain / F.log2(rank + 1.0)).otherwise(0.0))


def graded_metrics(rows: DataFrame, case: Sequence[str], ks: Sequence[int], grade: str = "grade") -> DataFrame:
    """ndcg_k, recall_k, precision_k and mrr_k of each case; all but precision null without a positive."""
    gain, positive = F.pow(F.lit(2.0), F.col(grade)) - 1, F.col(grade) > 0
    n, total = F.count_if(positive), F.count("*")
    out = []
    for k in ks:
        in_top = F.count_if(positive & (F.col("rank") <= k))
        first = F.min(F.when(positive & (F.col("rank") <= k), F.col("rank")))
        out += [
            F.when(n > 0, F.try_divide(_dcg(gain, F.col("rank"), k), _dcg(gain, F.col("ideal"), k))).alias(f"ndcg_{k}"),
            F.when(n > 0, in_top / n).alias(f"recall_{k}"),
            F.coalesce(F.try_divide(in_top, F.least(F.lit(k), total)), F.lit(0.0)).alias(f"precision_{k}"),
            F.when(n > 0, F.coalesce(1.0 / first, F.lit(0.0))).alias(f"mrr_{k}"),
        ]
    return _ideal(rows, case, grade).groupBy(*case).agg(*out)


def graded_metrics_of_top(tops: DataFrame, grades: DataFrame, case: Sequence[str], model: str, ks: Sequence[int]) -> DataFrame:
    """``graded_metrics`` of each case and model from what they depend on, without a row for each item.

    tops: (case, model, rank, grade) of the first rows of each ranking, as many as the largest k;
    grades: (case, grade, n), how many items of the case have a grade, whatever their model.
    """
    gain, positive = F.pow(F.lit(2.0), F.col("grade")) - 1, F.col("grade") > 0
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*case).orderBy(F.desc("grade")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    places = lambda k: F.sequence(F.col("before") + 1, F.least(F.col("before") + F.col("n"), F.lit(k).cast("long")))
    discount = lambda k: F.aggregate(places(k), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1.0))
    best = [F.sum(F.when(F.col("before") < k, gain * discount(k)).otherwise(0.0)).alias(f"best_{k}") for k in ks]
    totals = grades.withColumn("before", before).groupBy(*case).agg(F.sum("n").alias("total"), F.sum(F.when(positive, F.col("n")).otherwise(0)).alias("n"), *best)
    each = []
    for k in ks:
        hit = positive & (F.col("rank") <= k)
        each += [_dcg(gain, F.col("rank"), k).alias(f"dcg_{k}"), F.count_if(hit).alias(f"in_top_{k}"), F.min(F.when(hit, F.col("rank"))).alias(f"first_{k}")]
    out = []
    for k in ks:
        in_top = F.col(f"in_top_{k}")
        out += [
            F.when(F.col("n") > 0, F.try_divide(f"dcg_{k}", f"best_{k}")).alias(f"ndcg_{k}"),
            F.when(F.col("n") > 0, in_top / F.col("n")).alias(f"recall_{k}"),
            F.coalesce(F.try_divide(in_top, F.least(F.lit(k), F.col("total"))), F.lit(0.0)).alias(f"precision_{k}"),
            F.when(F.col("n") > 0, F.coalesce(1.0 / F.col(f"first_{k}"), F.lit(0.0))).alias(f"mrr_{k}"),
        ]
    return tops.groupBy(*case, model).agg(*each).join(totals.hint("merge"), list(case)).select(*case, model, *out)


def linear_metrics(rows: DataFrame, case: Sequence[str], ks: Sequence[int], grade: str = "grade") -> DataFrame:
    """dcg_k (gain over log2(rank + 1)) and ndcg_k (gain over log2(rank), ranks 1 and 2 undiscounted); 0 without a positive."""
    late = lambda rank: F.when(rank <= 2, 1.0).otherwise(F.log2(rank.cast("double")))
    total = lambda rank, k, discount: F.sum(F.when(rank <= k, F.col(grade) / discount).otherwise(0.0))
    out = []
    for k in ks:
        rank, ideal = F.col("rank"), F.col("ideal")
        out += [total(rank, k, F.log2(rank + 1.0)).alias(f"dcg_{k}"), F.coalesce(F.try_divide(total(rank, k, late(rank)), total(ideal, k, late(ideal))), F.lit(0.0)).alias(f"ndcg_{k}")]
    return _ideal(rows, case, grade).groupBy(*case).agg(*out)


def binary_metrics(rows: DataFrame, case: Sequence[str], ks: Sequence[int], hit: Column) -> DataFrame:
    """reciprocal_rank, r_precision, average_precision, precision_k and recall_k; 0 without a hit, precision_k null for fewer than k rows."""
    hits = F.sum(F.when(hit, 1).otherwise(0)).over(Window.partitionBy(*case).orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    marked = rows.withColumn("hit", F.when(hit, 1).otherwise(0)).withColumn("hits", hits)
    last = F.max(F.when(F.col("hit") == 1, F.col("rank")))
    n = F.sum("hit")
    out = [
        F.coalesce(1.0 / F.min(F.when(F.col("hit") == 1, F.col("rank"))), F.lit(0.0)).alias("reciprocal_rank"),
        F.coalesce(F.try_divide(n, last), F.lit(0.0)).alias("r_precision"),
        F.coalesce(F.avg(F.when(F.col("hit") == 1, F.col("hits") / F.col("rank"))), F.lit(0.0)).alias("average_precision"),
    ]
    for k in ks:
        in_top = F.sum(F.when(F.col("rank") <= k, F.col("hit")).otherwise(0))
        out += [F.when(F.count("*") >= k, in_top / k).alias(f"precision_{k}"), F.coalesce(F.try_divide(in_top, n), F.lit(0.0)).alias(f"recall_{k}")]
    return marked.groupBy(*case).agg(*out)


def grouped_summary(details: DataFrame, keys: Sequence[str], groups: Column, metrics: Sequence[str]) -> DataFrame:
    """Mean and number of defined values by ``keys`` and group; every row counts in "overall" too."""
    spread = details.withColumn("group_name", F.explode(F.array_distinct(F.concat(F.array(F.lit("overall")), groups))))
    out = [x for m in metrics for x in (F.avg(m).alias(m), F.count(m).alias(f"n_{m}"))]
    return spread.groupBy(*keys, "group_name").agg(F.count("*").alias("n_cases"), *out)


def fold_means(details: DataFrame, keys: Sequence[str], fold: str, metrics: Sequence[str]) -> DataFrame:
    """Mean of the folds' means."""
    return details.groupBy(*keys, fold).agg(*[F.avg(m).alias(m) for m in metrics]).groupBy(*keys).agg(*[F.avg(m).alias(m) for m in metrics])


def prf(tp: Column, fp: Column, fn: Column) -> list[Column]:
    """precision, recall, f1; null where the denominator is zero."""
    return [F.try_divide(tp, tp + fp).alias("precision"), F.try_divide(tp, tp + fn).alias("recall"), F.try_divide(2 * tp, 2 * tp + fp + fn).alias("f1")]


def f2(tp: Column, fp: Column, fn: Column) -> Column:
    return F.coalesce(F.try_divide(5 * tp, 5 * tp + 4 * fn + fp), F.lit(0.0))


def prf_by_facet(counts: DataFrame, facet: str = "facet") -> DataFrame:
    """P, R, F1 of each facet, of their sum (micro), and the mean of defined F1 (macro)."""
    sums = [F.sum(c).alias(c) for c in ("tp", "fp", "fn")]
    by = counts.groupBy(facet).agg(*sums)
    micro = counts.agg(*sums).select(F.lit("micro").alias(facet), "tp", "fp", "fn")
    scored = by.unionByName(micro).select(facet, "tp", "fp", "fn", *prf(F.col("tp"), F.col("fp"), F.col("fn")))
    macro = by.select(*prf(F.col("tp"), F.col("fp"), F.col("fn"))).agg(F.avg("f1").alias("f1")).select(F.lit("macro").alias(facet), "f1")
    return scored.unionByName(macro, allowMissingColumns=True)


def two_label_f1(rows: DataFrame, keys: Sequence[str], predicted: str, truth: str, labels: Sequence[str] = ("similar", "different")) -> DataFrame:
    """Mean F1 over the labels, pooled over all rows of a key; a label that neither side has counts 0 out of the mean."""
    parts = []
    for label in labels:
        p, t = F.col(predicted) == label, F.col(truth) == label
        parts.append(F.try_divide(2 * F.count_if(p & t), F.count_if(p) + F.count_if(t)))
    mean = sum((F.coalesce(p, F.lit(0.0)) for p in parts), F.lit(0.0)) / len(labels)
    return rows.groupBy(*keys).agg(mean.alias("macro_f1"))
