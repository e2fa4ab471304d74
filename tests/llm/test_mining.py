"""License scans, hard negatives and the filter audit against brute force, and on odd rows."""

import math
import random
import re
from collections import defaultdict
from itertools import permutations

import pytest

from facetlake.llm import interaction, licenses, negatives


# --- license scans ----------------------------------------------------------


def test_license_words_and_places(spark):
    texts = [
        "Under the MIT License. under-the-mit license, UNDER THE MIT LICENSES",
        "Apache License, Version 2.0 -- CC BY-NC 4.0; cc by nc",
        "Über the mité license İ",
        "",
        None,
        "filler " * 30_000 + "apache license version 2 " + "tail " * 30_000 + "cc by nc",
    ]
    found = {r.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [found[i].n_words for i in range(6)] == [12, 13, 5, 0, 0, 60_007]
    assert [(found[i].n_base, found[i].first_word, found[i].last_word, found[i].base_labels) for i in range(6)] == [
        (2, 0, 4, "mit"),
        (3, 0, 10, "apache-2,cc-by-nc"),
        (0, None, None, ""),
        (0, None, None, ""),
        (0, None, None, ""),
        (2, 30_000, 60_004, "apache-2,cc-by-nc"),
    ]
    assert found[0].score == 1 and found[3].score == 0 and found[3].labels == ""


def test_edited_notices(spark):
    body = licenses.TEMPLATES[0][1].split()
    dropped = " ".join(body[:11] + ["whoever", "he", "is"] + body[14:])
    no_key = " ".join("x" if w == "granted" else w for w in body)
    docs = [(1, "see below " + dropped), (2, no_key), (3, " ".join(body[:9])), (4, "the GNU General Public License, version 3"), (5, "Licensed under the GNU General Public License, version 3")]
    found = {r.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert found[1].labels == "mit" and 0.8 <= found[1].score < 1 and found[1].base_labels == ""
    assert found[2].labels == "" and found[3].labels == "" and found[4].labels == "gpl-3"
    assert found[5].labels == "gpl-3" and found[5].score == 1


def test_index_misses_no_passage(spark):
    """Random passages over a small vocabulary against all starts of all templates."""
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(12)]
    templates = tuple((f"l{n}", " ".join(p := rng.choices(vocabulary, k=rng.randint(3, 9))), (" ".join(p[:2]),)) for n in range(8))
    docs = [(d, " ".join(rng.choices(vocabulary, [2] * 6 + [1] * 6, k=rng.randint(0, 80)))) for d in range(60)]
    docs += [(60 + n, "a " + " ".join(w if rng.random() < 0.85 else "zz" for w in t[1].split())) for n, t in enumerate(templates * 4)]
    made = licenses.prepared(templates, (("w0 w1", "base"),), 0.7)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    weight = {w: max(1, round(1000 * math.log((len(docs) + 1) / max(1, sum(w in t.split() for _, t in docs))))) for w in vocabulary}
    assert licenses.weights(df, vocabulary, "text") == weight
    wanted = set()
    for doc_id, text in docs:
        words = text.split()
        for label, passage, keys, share, _ in made:
            total = sum(weight[w] for w in passage)
            for start in range(len(words)):
                same = [start + i < len(words) and words[start + i] == w for i, w in enumerate(passage)]
                agreed = sum(weight[w] for w, s in zip(passage, same, strict=True) if s)
                if all(same[k] for k in keys) and agreed >= (round(1000 * share) * total + 999) // 1000:
                    wanted.add((doc_id, label, start, round(agreed / total, 9)))
    rows = licenses.passages(df, templates=templates, phrases=(("w0 w1", "base"),), share=0.7).filter("label is not null").collect()
    assert {(r.doc_id, r.label, r.start, round(r.agreed, 9)) for r in rows} == wanted and len(wanted) > 40


def test_licenses_on_odd_rows(odd_docs, no_docs):
    assert licenses.scan_licenses(odd_docs).count() == odd_docs.count()
    assert licenses.scan_licenses(no_docs).count() == 0
    with pytest.raises(ValueError):
        licenses.prepared((("x", "word " * 65, ("word",)),), (), 0.8)
    with pytest.raises(ValueError):
        licenses.prepared((("x", "a b", ("b a",)),), (), 0.8)


# --- hard negatives ---------------------------------------------------------


def brute_negatives(rows, every=50, most=5, least=3):
    rows = [(i, v, tuple(math.floor(256 * x) for x in e), lab) for i, (v, e, lab) in enumerate(rows) if v is not None and lab is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for i, v, e, lab in rows:
        if v % every:
            continue
        scored = sorted(((-dot(e, f), w, j, k) for j, w, f, k in rows if j != i))
        for s, w, _, _ in [x for x in scored if x[3] == lab][:most]:
            fit = [x for x in scored if x[3] != lab and 50 * -s <= 100 * -x[0] <= 95 * -s][:least]
            out += [(v, w, n + 1, x[1], -s, -x[0]) for n, x in enumerate(fit)]
    return sorted(out)


def drawn(n, dims, labels, seed=1):
    rng = random.Random(seed)
    return [(i, [rng.gauss(0.2, 0.3) for _ in range(dims)], rng.choice(labels)) for i in range(n)]


SCHEMA = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize(("dims", "labels"), [(5, [1]), (40, [1, 1, 1, 2, 3]), (70, list(range(300)))])
def test_negatives_against_brute_force(spark, monkeypatch, dims, labels):
    for name, size in (("TALL", 3), ("WIDE", 16), ("CHUNK", 8), ("CHUNKS", 6)):
        monkeypatch.setattr(negatives, name, size)
    rows = [(i, [float(f"{x:.3f}") for x in e], lab) for i, e, lab in drawn(300, dims, labels)]
    df = spark.createDataFrame(rows, SCHEMA.replace("float", "double"))
    got = sorted(tuple(r) for r in negatives.mine_negatives(df, every=20).collect())
    assert got == brute_negatives(rows, every=20) and (got or len(labels) != 5)


def test_negatives_on_odd_rows(spark):
    rows = drawn(120, 6, [0, 1])
    odd = [(None, [0.1] * 6, 0), (200, None, 0), (250, [0.1] * 6, None), (300, [0.1, None], 0), (350, [float("nan")] * 6, 1), (400, [float("inf")] * 6, 1), (450, [], 0), (50, [0.3] * 6, 0), (50, [0.3] * 6, 0), (100, [0.3] * 6, 1)]
    every = [(v, e, lab, 1, 2, 3, 4) for v, e, lab in rows + odd + [(450, [1e30] * 6, 0)]]
    df = spark.createDataFrame(every, SCHEMA + ", number long, block long, score long, n int")
    kept = [(v, e and [x and float(spark_float(x)) for x in e], lab) for v, e, lab in rows + odd]
    assert sorted(tuple(r) for r in negatives.mine_negatives(df).collect()) == brute_negatives(kept)
    assert negatives.mine_negatives(df.filter("false")).count() == 0
    assert negatives.mine_negatives(df.filter("vec_id = 50")).count() == 0


def spark_float(x):
    import numpy as np

    return np.float32(x)


def test_products_beyond_floating_point():
    import numpy as np

    left = np.array([[(1 << 24) - 1] * 64])
    assert negatives._product(left, left).tolist() == [[64 * ((1 << 24) - 1) ** 2]]


# --- filter audit -----------------------------------------------------------


def brute_audit(docs, labels):
    good, toxic = ({d for d, q, t in labels if (q, t)[k] == 1} for k in (0, 1))
    rows = []
    for doc_id, text, source in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        copy = doc_id is not None and any(d is not None and d < doc_id and (t or "") == text for d, t, _ in docs)
        fails = {
            "A": len(words) < 50,
            "B": 100 * len(set(words)) < 65 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)),
            "E": copy,
        }
        rows.append((source or "", {f for f in fails if fails[f]}, doc_id in good, doc_id in toxic))
    out = []
    for part in {r[0] for r in rows}:
        mine, removed_by = [r for r in rows if r[0] == part], defaultdict(int)
        steps = []
        for order in permutations("ABCDE"):
            left = mine
            for place, f in enumerate(order):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                removed_by[f] += len(gone)
                every = sum(f in r[1] for r in mine)
                steps.append((part, "".join(order), place + 1, len(left), len(gone), every - len(gone), sum(r[1] == {f} for r in mine), sum(r[2] for r in gone), sum(r[3] for r in gone), f))
        out += [(*s[:-1], removed_by[s[-1]]) for s in steps]
    return sorted(out)


def test_audit_against_brute_force(spark):
    rng = random.Random(5)
    docs = [(rng.choice([None, *range(60)]), rng.choice([None, "", "Aa " * 60, "x # y", *[" ".join(rng.choices(["a", "b", "CC", "d$", *map(str, range(80))], k=rng.randint(1, 120))) for _ in range(6)]]), rng.choice([None, "", "s", "t"])) for _ in range(150)]
    labels = [(rng.choice([None, *range(60)]), rng.choice([None, 0, 1]), rng.choice([None, 0, 1])) for _ in range(80)]
    got = interaction.audit_text_filters(spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(7), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert sorted(tuple(r) for r in got.collect()) == brute_audit(docs, labels)


def test_audit_on_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 0, "x"), (1, 0, 1, "y"), (None, 1, 1, "z")], "doc_id long, quality int, toxic int, text string")
    plain = [(r.doc_id, r.text, r.source) for r in odd_docs.collect()]
    got = interaction.audit_text_filters(odd_docs, labels)
    assert sorted(tuple(r) for r in got.collect()) == brute_audit(plain, [(1, 1, 0), (1, 0, 1)])
    assert interaction.audit_text_filters(no_docs, labels).count() == 0


def test_swaps_visit_every_order():
    for n in range(1, 7):
        order, seen = list(range(n)), {tuple(range(n))}
        for at in interaction.swaps(n):
            order[at], order[at + 1] = order[at + 1], order[at]
            seen.add(tuple(order))
        assert len(seen) == len(interaction.swaps(n)) + 1 == math.factorial(n)
