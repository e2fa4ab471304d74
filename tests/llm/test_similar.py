"""The pipeline's near-duplicate stage against all pairs of shingle sets."""

import os
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from facetlake.llm import simhash


def brute_heads(docs):
    """Least id of each group linked by five-word shingle sets with a Jaccard similarity of 0.8 or more."""
    words = ["".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split() for _, t in docs]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in words]
    root = list(range(len(docs)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or 0.8 * max(len(a), len(b)) <= min(len(a), len(b)) and len(a & b) / len(a | b) >= 0.8:
                root[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        least[top(i)] = min(d, least.get(top(i), d))
    return set(least.values())


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_stage_drops_every_near_copy(spark, sf, size):
    path = f"{os.path.dirname(sf)}/{size}"
    table = spark.read.parquet(f"{path}/documents.parquet")
    heads = brute_heads([(r.doc_id, r.text) for r in table.collect()])
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, table, path).collect()) == sorted(heads)


@pytest.mark.parametrize(("rounds", "held"), [(0, 512), (1, 4), (2, 512), (0, 3)])
def test_groups_and_chains(spark, monkeypatch, rounds, held):
    """Copies of a text with edits, some similar to others of the group only, beside texts that share a passage."""
    monkeypatch.setattr(simhash, "HELD", held)
    monkeypatch.setattr(simhash, "STREAMED", 2 * held)
    rng = np.random.default_rng(21)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 100_000, n)]
    base, shared, texts = word(200), word(80), []
    for k in range(40):
        copy = list(base)
        for at in rng.integers(0, 200, k % 6):
            copy[at] = f"e{k}"
        texts.append(copy)
    chain = word(200)
    for k in range(12):
        chain = chain[15:] + word(15)
        texts.append(chain)
    texts += [word(60) + shared + word(60) for _ in range(20)] + [["Few", "words"], ["few", "WORDS"], [], []]
    docs = [(i, " ".join(t)) for i, t in enumerate(texts)]
    heads = brute_heads(docs)
    assert 20 < len(heads) < 60
    kept = simhash.keep_one(spark.createDataFrame(docs, "doc_id int, text string").repartition(3), rounds=rounds)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(heads)


@pytest.mark.parametrize(("copies", "rounds", "original"), [(30, 2, True), (300, 2, True), (3000, 2, True), (300, 0, True), (300, 2, False)])
def test_extended_copies_of_one_text(spark, copies, rounds, original):
    """Copies at 0.876 to their original and 0.794 to each other: one row with the original, all without it."""
    rng = np.random.default_rng(5)
    base = [f"w{x}" for x in rng.integers(0, 10**9, 202)]
    texts = [base] * original + [[*base, "plus", "two", *[f"own{k}x{i}" for i in range(26)]] for k in range(copies)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    kept = [r.doc_id for r in simhash.keep_one(docs, rounds=rounds).collect()]
    assert kept == [0] if original else len(kept) == copies


def test_similar_on_odd_documents(odd_docs, no_docs):
    kept = simhash.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter({1: 1, 2: 1, 5: 1, 7: 1, 8: 2, None: 1})
    assert simhash.keep_one(no_docs).count() == 0
