"""Plans and large groups that a reviewer's fourth round found."""

import hashlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from facetlake import registry


@pytest.fixture(scope="module")
def repeated(spark, sf, tmp_path_factory):
    """Parts sixty times with shifted keys: many parts say the same, and cases have 2,000 candidates."""
    at = str(tmp_path_factory.mktemp("repeated"))
    part = spark.read.parquet(f"{sf}/part.parquet")
    n = part.agg(F.max("p_partkey")).first()[0] + 1
    shifted = part.crossJoin(spark.range(60)).withColumn("p_partkey", F.col("p_partkey") + F.col("id") * n).drop("id")
    shifted.coalesce(1).write.parquet(f"{at}/part.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{at}/part.parquet/*.parquet'")
    for name in ("events",):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return at, con


def shuffled_rows(spark, run):
    """Rows that the stages of ``run`` wrote to shuffles."""
    store = spark.sparkContext._jsc.sc().statusStore()
    jobs = lambda: {store.jobsList(None).apply(i).jobId() for i in range(store.jobsList(None).size())}
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    before = jobs()
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    ids = [store.job(j).stageIds() for j in jobs() - before]
    stages = {x.apply(i) for x in ids for i in range(x.size())}
    return sum(store.lastStageAttempt(s).shuffleWriteRecords() for s in stages)


def test_metrics_shuffle_no_row_for_each_pair(spark, same, repeated):
    at, con = repeated
    pairs = con.execute("SELECT count(*) FROM part a JOIN part b USING (p_type) WHERE a.p_partkey % 50 = 0 AND a.p_partkey <> b.p_partkey").fetchone()[0]
    rows = shuffled_rows(spark, lambda: same(registry.QUERIES["grouped_metric_summary"](spark, at), con, registry.ORACLE["grouped_metric_summary"]))
    assert 0 < rows < pairs


def test_first_words_are_those_of_md5():
    from facetlake.functions.digests import LONGEST, first_words

    rng = np.random.default_rng(3)
    for before, after in ((4, 1), (9, 6), (20, 19), (30, LONGEST - 30)):
        heads, tails = rng.integers(32, 127, (5, before), dtype=np.uint8), rng.integers(32, 127, (7, after), dtype=np.uint8)
        wanted = [[int(hashlib.md5(h.tobytes() + t.tobytes()).hexdigest()[:8], 16) for t in tails] for h in heads]
        assert first_words(heads, tails).tolist() == wanted
    with pytest.raises(ValueError):
        first_words(np.zeros((1, LONGEST), np.uint8), np.zeros((1, 1), np.uint8))


def test_hashed_top_equals_a_sort_of_all_draws(spark, monkeypatch):
    """Rounded to two digits, so that ties go by paper; pieces are smaller than a group."""
    from facetlake.operators import draws

    monkeypatch.setattr(draws, "CASES", 10)
    papers = [(p, "ab"[p % 2] if p % 7 else None) for p in [*range(3, 400), *range(99_990, 100_010)]]
    cases = [(g, f"Q{p}", p) for p, g in papers if p % 11 == 0]
    unit = lambda c, p: round(int(hashlib.md5(f"s:{c}:{p}".encode()).hexdigest()[:13], 16) / 2**52, 2)
    wanted = {(c, p, i + 1) for g, c, q in cases if g for i, p in enumerate(sorted((p for p, h in papers if h == g and p != q), key=lambda p: (-unit(c, p), p))[:5])}
    found = draws.hashed_top(spark.createDataFrame(cases, "g string, case_id string, query_paper_id long"), spark.createDataFrame(papers, "paper_id long, g string"), "g", 5, "s", 2)
    assert {(r.case_id, r.paper_id, r.rank) for r in found.collect()} == wanted


def test_metrics_of_top_equal_those_of_all_rows(spark):
    from facetlake.functions import metrics as M

    rng = np.random.default_rng(8)
    rows = [(f"c{c}", m, p, float(rng.integers(0, 4)), [0.0, 0.0, 0.2, 0.4, 2.0][(p * (c + 3)) % 5] if c else 0.0) for c in range(6) for m in "xy" for p in range(1, [3, 4, 7, 12, 30, 11][c])]
    ranked = M.ranked(spark.createDataFrame(rows, "case_id string, model string, paper_id long, score double, grade double"), ["case_id", "model"]).cache()
    grades = ranked.filter("model = 'x'").groupBy("case_id", "grade").agg(F.count("*").alias("n"))
    whole = M.graded_metrics(ranked, ["case_id", "model"], (5, 10))
    short = M.graded_metrics_of_top(ranked.filter("rank <= 10"), grades, ["case_id"], "model", (5, 10))
    plain = lambda df: {(r.case_id, r.model): [None if x is None else round(x, 9) for x in r[2:]] for r in df.select("case_id", "model", *whole.columns[2:]).collect()}
    assert plain(short) == plain(whole)


def test_completeness_shuffles_no_row_for_each_prediction(spark, same, repeated):
    at, con = repeated
    pairs = con.execute("SELECT count(*) FROM part a JOIN part b USING (p_type) WHERE a.p_partkey % 50 = 0 AND a.p_partkey <> b.p_partkey").fetchone()[0]
    rows = shuffled_rows(spark, lambda: same(registry.QUERIES["prediction_completeness"](spark, at), con, registry.ORACLE["prediction_completeness"]))
    assert 0 < rows < pairs


def test_arrays_of_rankings_are_checked_as_the_gates_do(spark):
    from facetlake.functions import digests
    from facetlake.operators import rankings

    head, tail = np.frombuffer(b"42:Q50:", np.uint8)[None], np.frombuffer(b"123", np.uint8)[None]
    assert digests.units(head, tail)[0, 0] == int(hashlib.md5(b"42:Q50:123").hexdigest()[:13], 16) / 2**52
    papers, at = np.array([3, 5, 8, 9]), np.array([0, 0, 2, 3])  # paper 3 twice, 5 lacking
    score = np.array([[0.5, 0.5, np.inf, 0.1], [0.5, 0.5, np.nan, 0.1]])
    assert rankings._checked(score, at, papers, np.ones(4, int)) == (4, 2)
    assert rankings._checked(score[:1], at, papers, np.array([0, 0, 1, 1])) == (1, 1)
