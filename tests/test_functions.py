import math

import pytest
from pyspark.sql import functions as F

from facetlake.functions import metrics as M
from facetlake.functions import text as T
from facetlake.functions import vectors as V


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first().asDict()


def test_text(spark):
    got = one(
        spark,
        folded=T.normalized(T.fold(F.lit("Straße ＡＢＣ ﬁne café"))),
        key=T.label_key(T.fold(F.lit("  C++  and\tC# "))),
        concept=T.concept_key(F.lit("c++ is not c# ++")),
        tokens=T.tokens(F.lit("a bc def 中文")),
        doi=T.doi(F.lit(" HTTPS://dx.doi.org/10.1/AB ")),
        doi2=T.doi(F.lit("doi: 10.1/x")),
        year=T.numeric_id(F.lit("2024")),
        no_year=T.numeric_id(F.lit("20x4")),
        far_year=T.numeric_id(F.lit("9999")),
        path=T.safe_path(F.lit("top/a/b.json")),
        climbing=T.safe_path(F.lit("top/../b.json")),
        absolute=T.safe_path(F.lit("/a/b")),
        zone=T.iso_utc(T.zoned_time(F.lit("2026-01-01T01:00:00+01:00"))),
        naive=T.zoned_time(F.lit("2026-01-01T01:00:00")),
    )
    assert got["folded"] == "strasse abc fine café" and got["key"] == "c++ and c#" and got["concept"] == "c++ is not c# ++"
    assert got["tokens"] == ["bc", "def", "中文"] and got["doi"] == "10.1/ab" and got["doi2"] == "10.1/x"
    assert (got["year"], got["no_year"], got["far_year"]) == (2024, None, None)
    assert (got["path"], got["climbing"], got["absolute"]) == ("a/b.json", None, None)
    assert got["zone"] == "2026-01-01T00:00:00Z" and got["naive"] is None


def test_terms_are_whole_words(spark):
    n = F.lit("graph networks and subgraph")
    got = one(spark, a=T.has_term(n, "graph"), b=T.has_term(n, "network"), c=T.has_term(n, "sub"), d=T.has_term(n, "networks and"))
    assert got == {"a": True, "b": True, "c": False, "d": True}


def test_evidence_keeps_examples_together(spark):
    from facetlake.operators.extraction import sources

    text = "We use data, e.g. images. It works! See E. g. this. Done?  Yes"
    rows = spark.range(1).select(F.inline(T.evidence(F.lit("Title"), F.lit(text)))).collect()
    assert [(r.evidence_id, r.evidence) for r in rows] == [(k, v) for k, (_, v) in sources("Title", text).items()]
    assert [r.evidence for r in rows] == ["Title", "We use data, e.g. images.", "It works!", "See E. g. this.", "Done?", "Yes"]


def test_tfidf_by_hand(spark):
    docs = spark.createDataFrame([("a", ["alpha", "alpha", "beta"]), ("b", ["beta"]), ("c", [])], "id string, tokens array<string>")
    got = {(r.id, r.term): r.weight for r in V.tfidf(docs, ["id"]).collect()}
    alpha, beta = 2 * (math.log(4 / 2) + 1), math.log(4 / 3) + 1
    assert got["a", "alpha"] == pytest.approx(alpha / math.hypot(alpha, beta)) and got["b", "beta"] == pytest.approx(1) and len(got) == 3


def ranking(spark, grades):
    return spark.createDataFrame([("q", i + 1, g) for i, g in enumerate(grades)], "case_id string, rank int, grade int")


def test_graded_metrics_by_hand(spark):
    got = M.graded_metrics(ranking(spark, [2, 1, 0]), ["case_id"], [1, 10]).first()
    assert (got.ndcg_10, got.recall_1, got.precision_10, got.mrr_10) == (pytest.approx(1), pytest.approx(0.5), pytest.approx(2 / 3), 1)
    swapped = M.graded_metrics(ranking(spark, [1, 2]), ["case_id"], [2]).first()
    assert swapped.ndcg_2 == pytest.approx((1 + 3 / math.log2(3)) / (3 + 1 / math.log2(3)))
    second = M.graded_metrics(ranking(spark, [0, 2]), ["case_id"], [2]).first()
    assert second.mrr_2 == 0.5
    none = M.graded_metrics(ranking(spark, [0, 0]), ["case_id"], [2]).first()
    assert (none.ndcg_2, none.recall_2, none.mrr_2, none.precision_2) == (None, None, None, 0)


def test_linear_and_binary_metrics(spark):
    rows = ranking(spark, [3, 2, 3, 0, 0, 1, 2, 2, 3, 0])
    got = M.linear_metrics(rows, ["case_id"], [1, 2, 10]).first()
    assert got.dcg_1 == 3 and got.dcg_2 == pytest.approx(4.2618595071429155)
    late = [3, 2, 3, 0, 0, 1, 2, 2, 3, 0]
    total = lambda g: sum(x / (1 if i < 2 else math.log2(i + 1)) for i, x in enumerate(g))
    assert got.ndcg_10 == pytest.approx(total(late) / total(sorted(late, reverse=True)))
    hits = M.binary_metrics(ranking(spark, [0, 1, 1, 0]), ["case_id"], [2, 5], F.col("grade") == 1).first()
    assert (hits.reciprocal_rank, hits.r_precision, hits.precision_2, hits.precision_5, hits.recall_2) == (0.5, pytest.approx(2 / 3), 0.5, None, 0.5)
    assert hits.average_precision == pytest.approx((1 / 2 + 2 / 3) / 2)
    none = M.binary_metrics(ranking(spark, [0]), ["case_id"], [1], F.col("grade") == 1).first()
    assert (none.reciprocal_rank, none.average_precision, none.recall_1) == (0, 0, 0)


def test_prf_and_macro(spark):
    rows = spark.createDataFrame([("task", 1, 2, 2), ("method", 0, 0, 0)], "facet string, tp int, fp int, fn int")
    got = {r.facet: r for r in M.prf_by_facet(rows).collect()}
    assert got["task"].f1 == pytest.approx(1 / 3) and got["method"].f1 is None and got["macro"].f1 == pytest.approx(1 / 3) and got["micro"].tp == 1


def test_decay_and_draws(spark):
    age = V.age(F.to_timestamp(F.lit("2026-01-08 00:00:00")), F.to_timestamp(F.lit("2026-01-01 00:00:00")))
    got = one(spark, w=V.decay(age, 7.0), x=V.hashed_unit("s", F.lit(1)), y=V.hashed_unit("s", F.lit(1)), c=V.clipped(F.lit(1.00001)))
    assert got["w"] == pytest.approx(0.5) and got["x"] == got["y"] and 0 <= got["x"] < 1 and got["c"] == 1
