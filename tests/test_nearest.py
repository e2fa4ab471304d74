"""Top-k searches against full scoring."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from facetlake.functions import vectors as V
from facetlake.operators import nearest


def drawn_sparse(spark, n, seed):
    """Texts of words with Zipf-like frequencies, a fifth of them edits of an earlier one, one with common words only."""
    rng = np.random.default_rng(seed)
    texts = [[f"t{x}" for x in rng.zipf(1.3, int(rng.integers(1, 60))) if x < 400] or ["t1"] for _ in range(n)]
    for i in range(0, n, 5):
        texts[i] = [w if rng.random() < 0.8 else "own" for w in texts[i // 2]]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, ["t1"], ["t1"], ["only"]])], "id long, tokens array<string>")
    return V.tfidf(docs, ["id"]).filter("weight > 0").cache()


@pytest.mark.parametrize(("n", "k", "seed"), [(400, 5, 100), (400, 30, 1), (60, 10, 2000)])
def test_sparse_equals_full_scoring(spark, n, k, seed):
    v = drawn_sparse(spark, n, 7)
    queries = v.filter(f"id % 7 = 0 or id >= {n}").withColumnRenamed("id", "query")
    got = {(r.query, r["rank"]): (r.id, round(r.score, 6)) for r in nearest.top_sparse(queries, v, k, seed=seed).collect()}
    dense: dict[int, dict[str, float]] = {}
    for r in v.collect():
        dense.setdefault(r.id, {})[r.term] = r.weight
    want = {}
    for q in sorted(r["query"] for r in queries.select("query").distinct().collect()):
        scored = sorted((-round(sum(w * dense[d][t] for t, w in dense[q].items() if t in dense[d]), 6), d) for d in dense if d != q and dense[q].keys() & dense[d].keys())
        want |= {(q, i + 1): (d, -s) for i, (s, d) in enumerate(scored[:k])}
    assert got == want


def test_sparse_reads_less_than_full_scoring(spark, monkeypatch):
    v = drawn_sparse(spark, 800, 3)
    queries = v.filter("id % 5 = 0").withColumnRenamed("id", "query")
    reads, read = [], nearest._read
    monkeypatch.setattr(nearest, "_read", lambda chosen, postings: reads.append((r := read(chosen, postings)).count()) or r)
    nearest.top_sparse(queries, v, 1, seed=200).count()
    assert sum(reads) < 0.75 * nearest.postings_read(queries, v)


@pytest.mark.parametrize(("queries", "slices"), [(1024, 65_536), (3, 20)])
def test_dense_equals_full_scoring(spark, monkeypatch, queries, slices):
    monkeypatch.setattr(nearest, "QUERIES", queries)
    monkeypatch.setattr(nearest, "SLICE", slices)
    rng = np.random.default_rng(2)
    rows = rng.normal(size=(90, 6))
    rows[10:20] = rows[3]
    rows /= np.linalg.norm(rows, axis=1)[:, None]
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rows)] + [(90, None)], "id long, vector array<double>").repartition(6)
    got = sorted(tuple(r) for r in nearest.top_dense(df.filter("id % 10 = 3 or id > 80"), df, 4).select("query", "rank", "id", F.round("score", 5).alias("score")).collect())
    want = []
    for q in [*range(3, 90, 10), *range(81, 90)]:
        scored = sorted((-float(np.round(rows[q] @ rows[i], 5)), i) for i in range(90) if i != q)[:4]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    assert got == sorted(set(want))
    assert nearest.top_dense(df.filter("id < 0"), df, 4).count() == 0 and nearest.top_dense(df, df.filter("id < 0"), 4).count() == 0


@pytest.mark.parametrize(("k", "piece", "size"), [(5, 300, 1000), (300, 10, 40), (1, 10**6, 10**6)])
def test_texts_equal_full_scoring(spark, k, piece, size):
    """Also with copies, texts without a word, rows without an id and ids with several rows."""
    rng = np.random.default_rng(4)
    texts = [[f"t{x}" for x in rng.zipf(1.3, int(rng.integers(1, 60))) if x < 400] for _ in range(200)]
    rows = [*enumerate([*texts, ["t1"], ["only"], [], None]), *[(300 + i, texts[7]) for i in range(40)], (None, ["t1", "t2"]), (None, ["t2"]), (7, ["t3", "t9"]), (14, texts[3])]
    docs = spark.createDataFrame(rows, "id long, tokens array<string>").repartition(3)
    found = nearest.top_texts(docs, F.col("id") % 7 == 0, k, piece=piece, size=size)
    v = V.tfidf(docs, ["id"])
    scores = V.dots(v.filter("id % 7 = 0").withColumnRenamed("id", "query"), v, ["term"], ["query", "id"]).filter("query <> id").withColumn("score", F.round("score", 6))
    from facetlake.functions.metrics import top

    assert sorted(map(tuple, found.select("query", "id", "score", "rank").collect())) == sorted(map(tuple, top(scores, k, ["query"], "id").select("query", "id", "score", "rank").collect()))
