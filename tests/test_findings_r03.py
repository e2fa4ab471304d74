"""Odd inputs and plans that a reviewer's third round found."""

import pytest

from facetlake import registry


def test_source_quality_has_the_word_ends_of_its_sql(spark, same, tmp_path):
    import duckdb

    texts = ["elleêan elleêan", "chllaía", "it ends with", "with a\n\n", "of\x0b", "of ", "of ", "naïve_of", "9of", "ça", None, "", "the end"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    same(registry.QUERIES["source_quality"](spark, str(tmp_path)), con, registry.ORACLE["source_quality"])


@pytest.mark.parametrize("name", ["facet_importance", "facet_profiles", "static_profile_scores", "recent_profile_scores", "decay_profile_scores", "direction_estimates", "direction_macro_f1", "facet_vectors", "intent_scores", "preference_metrics"])
def test_nothing_that_grows_is_broadcast(spark, sf, name):
    plan = registry.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Join" in plan and "BroadcastExchange" not in plan


def test_sharing_counts_equal_brute_force_and_make_no_pairs(spark):
    from facetlake.operators import facets as A

    rows = [(p, f, f"{f}{(p * k) % 5}") for p in range(60) for f, k in (("task", 1), ("method", 2), ("dataset", 3)) if (p + k) % 7]
    rows += [(p, "task", f"task{i}") for p in (3, 11, 90) for i in range(9)] + [(91, "task", "alone")]
    of = {p: {(f, c) for q, f, c in rows if q == p} for p, _, _ in rows}
    anchors = [0, 3, 6, 10, 90, 91, 99]
    expected = {a: n for a in anchors if (n := sum(1 for p in of if p != a and of[p] & of.get(a, set())))}
    concepts = spark.createDataFrame(rows, "paper_id long, facet string, concept string")
    found = A.sharing_counts(spark.createDataFrame([(a,) for a in anchors], "anchor_id long"), concepts)
    assert {r.anchor_id: r.n for r in found.collect()} == expected


def test_pairs_are_not_shuffled_to_get_their_concepts(spark, sf):
    from facetlake.queries import retrieval

    plan = retrieval.facet_relevance(spark, sf)._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert "BroadcastExchange" not in plan and "p_type" in joins[0]  # the topmost join makes the pairs


def test_candidate_sample_drops_late_draws_before_the_shuffle(spark):
    from facetlake.operators import sampling as K

    kinds = {"a": (30, 50, 300), "b": (1, 40, 0), "c": (60, 1, 3), "d": (0, 9, 90), "e": (5, 2, 400)}
    rows = [(case, 1000 * i + n, kind) for case, sizes in kinds.items() for i, (kind, size) in enumerate(zip(("positive", "hard", "easy"), sizes, strict=True)) for n in range(size)]
    found = K.candidate_sample(spark.createDataFrame(rows, "case_id string, paper_id long, kind string"), 20, 0.2, 0.5, "s")
    assert "WindowGroupLimit" in found._jdf.queryExecution().executedPlan().toString()
    got = {}
    for r in found.collect():
        got.setdefault(r.case_id, []).append(r.kind)
    assert {c: len(k) for c, k in got.items()} == {"a": 20, "b": 20, "c": 20, "e": 20}
    assert got["a"].count("positive") == 4 and got["b"].count("positive") == 1 and got["c"].count("positive") == 16


def test_repeats_of_large_groups_have_few_spans_a_suffix(spark):
    """Texts around one passage, in groups too large to sort: a span for each of few halves, not one for each window."""
    import numpy as np
    from pyspark.sql import functions as F

    from facetlake.llm import repeats

    rng = np.random.default_rng(5)
    random = lambda n: bytes(rng.integers(97, 123, n, dtype=np.uint8))
    passage = random(300)
    end = lambda i: bytes([97 + i])  # noqa: E731  no two texts agree beside the passage
    rows = [(i, i, random(249) + end(i) + passage + end(i) + random(249)) for i in range(24)]
    found = repeats.repeated_spans(spark.createDataFrame(rows, "k1 long, k2 long, data binary"), group=4).collect()
    covered = [{x for s in r.spans for x in range(s.start, s.end)} for r in found]
    assert len(found) == 24 and all(c == set(range(250, 550)) for c in covered)
    assert max(len(r.spans) for r in found) <= 16


def test_scored_pairs_are_joined_with_nothing(spark, sf):
    """Cosines and grades come with the pairs: no join has the pairs' key."""
    from facetlake.queries import retrieval

    for rows in (retrieval.judged(spark, sf), retrieval.part_cosine_rows(spark, sf)):
        joins = [line for line in rows._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in line]
        assert joins and not any("case_id" in line for line in joins)


def test_similar_documents_shuffle_no_row_for_each_posting(spark, sf, tmp_path, monkeypatch):
    """No written table has a row for each word of each text, as the index of postings had."""
    from facetlake import storage
    from facetlake.operators import nearest
    from facetlake.queries import texts

    sizes, kept = {}, storage.written
    counted = lambda df, name: sizes.update({name: (out := kept(df, name)).count()}) or out
    monkeypatch.setattr(nearest, "written", counted)
    monkeypatch.setattr(texts, "written", counted, raising=False)
    assert texts.document_similarity_topk(spark, sf).count() > 0
    postings = texts.tfidf_vectors(spark, sf).count()
    assert sizes and max(sizes.values()) < postings / 2
