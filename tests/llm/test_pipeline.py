"""The pipeline against the same stages in plain Python, each on its own input."""

import hashlib
from collections import defaultdict

import corpus_pipeline
from facetlake.llm import decontaminate, langid
from facetlake.llm.queries_free import tokenizer_file
from tests.llm.test_free import brute_tokens
from tests.llm.test_native import fill
from tests.llm.test_similar import brute_heads


def plain_mix(docs):
    sizes = {i: len(t.split()) for i, (_, t, _) in enumerate(docs)}
    by_source = defaultdict(list)
    for i, (d, _, s) in enumerate(docs):
        by_source[s].append(i)
    names = sorted(by_source)
    targets = fill([sum(sizes[i] for i in by_source[s]) for s in names], [1 + k % 3 for k in range(len(names))])
    out = []
    for s, target in zip(names, targets, strict=True):
        total, at = sum(sizes[i] for i in by_source[s]), 0
        epochs, rest = divmod(int(target + 0.5), total)
        for i in sorted(by_source[s], key=lambda i: md5(f"mix:{docs[i][0]}:{md5(docs[i][1])}")):
            taken = epochs * sizes[i] + max(0, min(sizes[i], rest - at))
            at += sizes[i]
            out += [docs[i]] * int(taken / sizes[i] + 0.5)
    return out


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


def test_pipeline_matches_plain_python(spark, sf):
    from tokenizers import Tokenizer

    table = spark.read.parquet(f"{sf}/documents.parquet")
    docs = [(r.doc_id, r.text, r.source) for r in table.collect()]
    model = langid.fit(table)
    docs = [d for d in docs if (p := model.predict(d[1]))[0] != "und" and p[1] >= model.threshold]
    assert len(docs) > 0.95 * table.count()
    heads = brute_heads([(d, t) for d, t, _ in docs])
    docs = [d for d in docs if d[0] in heads]
    matcher = decontaminate.Matcher([(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()])
    docs = [d for d in docs if not matcher.find(d[1])]
    want = brute_tokens([(d, t) for d, t, _ in sorted(plain_mix(docs))], Tokenizer.from_file(tokenizer_file()))
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf).collect()), key=lambda r: r[1]) == want


def test_every_stage_on_odd_documents(spark, sf, odd_docs, no_docs):
    for name, stage in corpus_pipeline.STAGES:
        for docs in (odd_docs, no_docs):
            out = stage(spark, docs, sf)
            assert out.count() <= 3 * docs.count()
            assert name == "token_shards" or out.columns == docs.columns
