import itertools

import pytest
from pyspark.sql import functions as F

from facetlake.operators import corpus, facets, gates, generators, intent, matching, profiles, sampling
from facetlake.operators.search import mentions

FACETS = facets.FACETS


def catalog(spark, n=400):
    """Papers whose facets follow their number."""
    i = F.col("id")
    of = lambda p, e: F.concat(F.lit(p), F.expr(e).cast("string"))
    cells = [("problem", of("p", "id % 4")), ("task", of("t", "id % 5")), ("method", of("m", "(id div 4) % 4")), ("dataset", of("d", "id % 3")), ("contribution", of("c", "id % 7"))]
    return spark.range(n).select(F.format_string("P%06d", i + 1).alias("paper_id"), F.inline(F.array(*[F.struct(F.lit(f).alias("facet"), c.alias("concept")) for f, c in cells])))


def test_concept_sets_drop_flagged_papers(spark):
    rows = spark.createDataFrame([("P1", ["Ａlpha ", "alpha", ""], [], [], [], []), ("P2", ["x"], [], [], [], []), ("P3", ["x"], [], [], [], [])], "paper_id string, " + ", ".join(f"{f} array<string>" for f in FACETS))
    meta = spark.createDataFrame([("P1", False, []), ("P2", True, []), ("P3", False, ["bad"])], "paper_id string, fallback_used boolean, validation_errors array<string>")
    assert [tuple(r) for r in facets.concept_sets(rows, meta).collect()] == [("P1", "problem", "alpha")]


def test_relevance_and_session_grades(spark):
    got = spark.range(1).select(
        *[facets.facet_relevance(F.array(*map(F.lit, a)).cast("array<string>"), F.array(*map(F.lit, b)).cast("array<string>")).alias(f"r{i}") for i, (a, b) in enumerate([("ab", "ba"), ("ab", "bc"), ("a", "b"), ("", "a")])]
    ).first()
    assert tuple(got) == (2, 1, 0, None)
    maps = spark.createDataFrame([({"problem": ["p"], "task": ["t"]}, {"problem": ["p"], "task": ["u"]}, {"problem": ["p"]})], "a map<string,array<string>>, b map<string,array<string>>, c map<string,array<string>>")
    g = lambda x, way: facets.session_grade(F.col("a"), F.col(x), "task", F.lit(way))
    assert tuple(maps.select(g("b", "different"), g("b", "similar"), g("c", "different")).first()) == (2, 1, 0)


def history(spark, rows):
    return spark.createDataFrame(rows, "case_id string, paper_id string, interaction_type string, ts string, cutoff string").withColumn("ts", F.to_timestamp("ts")).withColumn("cutoff", F.to_timestamp("cutoff"))


def test_facet_profiles(spark):
    concepts = spark.createDataFrame([("a", "task", "x"), ("a", "task", "y"), ("b", "method", "z")], "paper_id string, facet string, concept string")
    rows = history(spark, [("u", "a", "like", "2026-03-01", "2026-04-01"), ("u", "b", "dislike", "2026-03-31", "2026-04-01")])
    vec, imp = profiles.facet_profiles(rows, concepts)
    got = {(r.facet, r.concept): r.weight for r in vec.collect()}
    assert got["task", "x"] == pytest.approx(0.5**0.5) and got["method", "z"] == -1
    assert {r.facet: r.importance for r in imp.collect()} == {"task": 0.75, "method": 0.25, "problem": 0, "dataset": 0, "contribution": 0}
    recent, share = profiles.facet_profiles(rows, concepts, recent_start=F.to_timestamp(F.lit("2026-04-01")))
    assert recent.count() == 0 and {r.importance for r in share.collect()} == {0.2}
    with pytest.raises(gates.GateError):
        profiles.check_no_future(history(spark, [("u", "a", "like", "2026-04-01", "2026-04-01")]))


def test_future_rows_change_no_profile(spark):
    concepts = catalog(spark, 20)
    base = spark.createDataFrame([("u", "P000001", "like", "2026-01-01"), ("u", "P000002", "click", "2026-01-05")], "user_id string, paper_id string, interaction_type string, ts string").withColumn("ts", F.to_timestamp("ts"))
    cases = spark.createDataFrame([("u", "u", "2026-02-01")], "case_id string, user_id string, cutoff string").withColumn("cutoff", F.to_timestamp("cutoff"))
    more = base.unionByName(base.withColumn("ts", F.to_timestamp(F.lit("2026-02-01"))))
    rows = lambda h: sorted(map(tuple, profiles.facet_profiles(profiles.visible(h, cases), concepts)[0].collect()))
    assert rows(base) == rows(more)


def test_directions_from_matched_feedback(spark):
    cells = {"q": ("p", "t", "m", "d", "c"), "s": ("p", "t", "m", "d", "c"), "x": ("p", "t", "n", "d", "c")}
    concepts = spark.createDataFrame([(i, f, v) for i, row in cells.items() for f, v in zip(FACETS, row, strict=True)], "paper_id string, facet string, concept string")
    exposures = spark.createDataFrame([("k", f"e{i}", ["s", "x"]) for i in range(2)], "case_id string, exposure_id string, paper_ids array<string>")
    reacted = spark.createDataFrame([("k", f"e{i}", p, r) for i in range(2) for p, r in (("s", "click"), ("x", "like"))], "case_id string, exposure_id string, paper_id string, interaction_type string")
    anchors = spark.createDataFrame([("k", "q")], "case_id string, query_paper_id string")
    found = intent.contrasts(intent.feedback_pairs(exposures, reacted), anchors, facets.arrays(concepts))
    assert [tuple(r) for r in found.collect()] == [("k", "method", 2)] * 2
    by = intent.behavior_directions(found)
    got = {r.facet: (r.direction, r.confidence) for r in intent.directions(anchors, by).collect()}
    assert got["method"] == ("different", pytest.approx(1 / 3)) and got["problem"] == ("similar", 1) and got["task"] == ("unknown", 0)
    said = spark.createDataFrame([("k", "1", 1, "method", "m", 1), ("k", "2", 2, "method", "m", -1), ("k", "3", 3, "method", "zzz", 1)], "case_id string, query_id string, ts int, facet string, concept string, sign int")
    q = intent.query_directions(said, anchors, concepts)
    assert [tuple(r) for r in q.collect()] == [("k", "method", "different", 1.0)]


def test_intent_scores(spark):
    cases = spark.createDataFrame([("k", "q", p) for p in ("near", "miss", "far")], "case_id string, query_paper_id string, paper_id string")
    cosines = spark.createDataFrame([("k", "near", "problem", 0.5), ("k", "near", "task", 0.2), ("k", "miss", "problem", 0.5)], "case_id string, paper_id string, part string, score double")
    filled = spark.createDataFrame([("q", "problem"), ("q", "task"), ("near", "problem"), ("near", "task"), ("miss", "problem"), ("far", "problem"), ("far", "task")], "paper_id string, facet string")
    weights = spark.createDataFrame([("k", "task", 1.0)], "case_id string, facet string, importance double")
    way = spark.createDataFrame([("k", "task", "different")], "case_id string, facet string, direction string")
    got = {r.paper_id: r.score for r in intent.intent_scores(cases, cosines, filled, weights, way).collect()}
    assert got == {"near": pytest.approx(0.8), "miss": -1, "far": -1}
    alone = intent.intent_scores(cases.filter("paper_id = 'near'"), cosines, filled, weights.withColumn("importance", F.lit(0.0)), way)
    assert alone.first().score == 0.5


def test_search_parser(spark):
    vocabulary = spark.createDataFrame([("x", "method", c) for c in ("graph", "graph network", "svm")] + [("x", "task", "graph")], "paper_id string, facet string, concept string")
    texts = ["method: graph papers", "alternatives to SVM papers", "method: we like graph network without svm", "task: graph; method: more papers using svm papers", "method: subgraph"]
    rows = mentions(spark.createDataFrame(list(enumerate(texts)), "query_id int, text string"), vocabulary).collect()
    got = {}
    for r in rows:
        got.setdefault(r.query_id, set()).add((r.facet, r.concept, r.sign))
    assert got == {0: {("method", "graph", 1)}, 1: {("method", "svm", -1)}, 2: {("method", "graph network", 1), ("method", "svm", -1)}, 3: {("task", "graph", 1), ("method", "svm", 1)}}


# --- corpus ------------------------------------------------------------------


def records(spark, rows):
    df = spark.createDataFrame(rows, "source string, source_id string, title string, abstract string, identifiers map<string,string>")
    return df.withColumn("year", F.lit(2020)).withColumn("scope_evidence", F.array(F.lit("x")))


def no_ids(spark):
    return spark.createDataFrame([], "source string, source_id string, paper_id string, identifiers map<string,string>, content_sha256 string, active boolean, `primary` boolean")


def test_resolution_keeps_ids(spark):
    rows = [("a", "1", "Title", "Text", {"doi": "10.1"}), ("b", "1", "Other", "Words", {"doi": "10.1"}), ("b", "2", "TITLE", "text", {"s2orc": "9"}), ("b", "3", "Title", "Different", {"s2orc": "8"})]
    papers, ids, conflicts = corpus.resolve(records(spark, rows), no_ids(spark))
    got = {(r.source, r.source_id): r.paper_id for r in ids.collect()}
    assert got["a", "1"] == got["b", "1"] == got["b", "2"] == "P000001" and got["b", "3"] == "P000002" and papers.count() == 2
    assert [(r.source_id, r.conflicting_paper_ids) for r in conflicts.collect()] == [("3", ["P000001"])]
    more = records(spark, [*rows[1:], ("Z", "0", "New", "Paper", {"s2orc": "7"})])
    _, later, _ = corpus.resolve(more, ids)
    after = {(r.source, r.source_id): (r.paper_id, r.active) for r in later.collect()}
    assert after["b", "3"] == ("P000002", True) and after["Z", "0"] == ("P000003", True) and after["a", "1"] == ("P000001", False) and after["b", "1"][0] == "P000001"


@pytest.mark.parametrize(
    "change",
    [
        [("a", "1", "Title", "Changed", {"doi": "10.1"})],
        [("a", "1", "Title", "Text", {"doi": "10.1"})] * 2,
        [("a", "1", "Title", "Text", {"doi": "10.1"}), ("a", "2", "T2", "X2", {"doi": "10.2"}), ("b", "9", "Q", "R", {"doi": "10.1", "arxiv_id": "z"}), ("c", "1", "V", "W", {"doi": "10.2", "arxiv_id": "z"})],
    ],
)
def test_resolution_refuses(spark, change):
    _, ids, _ = corpus.resolve(records(spark, [("a", "1", "Title", "Text", {"doi": "10.1"})]), no_ids(spark))
    with pytest.raises(gates.GateError):
        corpus.resolve(records(spark, change), ids)


def test_adapt_classify_override(spark):
    raw = spark.createDataFrame([("7", "A  graph\n paper", ["One.", "Two. "], {"year": "2019", "doi": "DOI: 10.1/X", "arxiv_id": ""})], "doc_id string, title string, abstract array<string>, metadata map<string,string>")
    got = corpus.adapt(raw, "s", source_id="doc_id", metadata="metadata").first()
    assert (got.title, got.abstract, got.year, got.identifiers) == ("A graph paper", "One. Two.", 2019, {"s2orc": "7", "doi": "10.1/x"})
    texts = [("1", "Graphs", "x"), ("2", "None", "We use graphs. By method."), ("3", "None", "A graph method works. Yes."), ("4", "None", "nothing"), ("5", "Graph", " ")]
    rows = spark.createDataFrame([("s", i, t, a) for i, t, a in texts], "source string, source_id string, title string, abstract string")
    found = corpus.classify(rows, terms=("graph",), markers=("method",), trusted=("t",))
    assert {r.source_id: r.reason for r in found.collect()} == {"1": "it_term_in_title", "2": "review_pending", "3": "it_method_in_abstract", "4": "no_explicit_it_evidence", "5": "missing_title_or_abstract"}
    decided = spark.createDataFrame([("s", "4", True, "me", "why")], "source string, source_id string, include boolean, reviewer string, review_reason string")
    assert {r.source_id for r in corpus.override(found, decided).filter("included").collect()} == {"1", "3", "4"}
    with pytest.raises(gates.GateError):
        corpus.override(found, decided.withColumn("reviewer", F.lit(" ")))


# --- matching ----------------------------------------------------------------


def test_large_assignment_is_quick_and_pieces_are_apart(spark):
    import time

    import numpy as np

    scores = np.random.default_rng(4).random((500, 500))
    began = time.time()
    columns = matching.least_cost(-scores)
    assert time.time() - began < 5 and sorted(columns) == list(range(500))
    #: No swap of two rows' columns does better.
    now = scores[np.arange(500), columns]
    assert (scores[:, columns] + scores[:, columns].T <= now[:, None] + now[None] + 1e-9).all()
    chain = [("g", f"l{i}", f"r{i + d}", 1.0) for i in range(30) for d in (0, 1)] + [("g", "x", "y", 0.5), ("h", "l0", "r0", 1.0)]
    found = matching.hanging_together(spark.createDataFrame(chain, "g string, left string, right string, score double"), ["g"])
    assert {(r.g, r.left, r.together) for r in found.collect()} == {("g", f"l{i}", "l0") for i in range(30)} | {("g", "x", "x"), ("h", "l0", "l0")}
    with pytest.raises(ValueError):
        matching.assign([("a", f"b{j}", 1.0) for j in range(matching.MOST_LABELS + 1)])


def brute_assign(pairs):
    lefts, rights = sorted({a for a, _, _ in pairs}), sorted({b for _, b, _ in pairs})
    score = {(a, b): s for a, b, s in pairs}
    best = (0, 0.0)
    for r in range(1, min(len(lefts), len(rights)) + 1):
        for left in itertools.combinations(lefts, r):
            for right in itertools.permutations(rights, r):
                if all(p in score for p in zip(left, right, strict=True)):
                    best = max(best, (r, round(sum(score[p] for p in zip(left, right, strict=True)), 9)))
    return best


def test_assignment_is_best():
    import random

    rng = random.Random(4)
    for _ in range(60):
        pairs = [(f"l{a}", f"r{b}", rng.randint(1, 9) / 10) for a in range(rng.randint(1, 4)) for b in range(rng.randint(1, 4)) if rng.random() < 0.7]
        got = matching.assign(pairs)
        assert len({a for a, _, _ in got}) == len({b for _, b, _ in got}) == len(got)
        assert (len(got), round(sum(s for _, _, s in got), 9)) == brute_assign(pairs)


def test_match_labels(spark):
    label = lambda rows: spark.createDataFrame(rows, "paper_id string, facet string, label string, key string")
    gold = label([("P", "task", "exact", "exact"), ("P", "task", "near one", "near one"), ("P", "contribution", "gains 5%", "gains 5%")])
    predicted = label([("P", "task", "EXACT", "exact"), ("P", "task", "close one", "close one"), ("P", "contribution", "gains 7%", "gains 7%")])
    vectors = spark.createDataFrame([("near one", [1.0, 0.0]), ("close one", [0.9, 0.4358899]), ("gains 5%", [1.0, 0.0]), ("gains 7%", [1.0, 0.0])], "label string, embedding array<float>")
    matched, blocked = matching.match_labels(gold, predicted, vectors)
    assert {(r.left, r.right, r.match_type) for r in matched.collect()} == {("exact", "EXACT", "exact"), ("near one", "close one", "embedding")}
    assert [tuple(r) for r in blocked.collect()] == [("numeric_mismatch", 1)]
    counts = {r.facet: (r.tp, r.fp, r.fn) for r in matching.match_counts(gold, predicted, matched).collect()}
    assert counts == {"task": (2, 0, 0), "contribution": (0, 1, 1)}


# --- sampling and generators -------------------------------------------------


def test_candidate_quotas(spark):
    rows = [("k", f"{kind}{i}", kind) for kind, n in (("positive", 9), ("hard", 3), ("easy", 30)) for i in range(n)] + [("none", f"h{i}", "hard") for i in range(50)] + [("small", "a", "positive"), ("small", "b", "easy")]
    got = sampling.candidate_sample(spark.createDataFrame(rows, "case_id string, paper_id string, kind string"), 20, 0.25, 0.5, "s").collect()
    kinds = [r.kind for r in got]
    assert {r.case_id for r in got} == {"k"} and kinds.count("positive") == 5 and len(got) == 20 == len({r.paper_id for r in got}) and kinds.count("hard") == 3
    assert sorted(r.place for r in got) == list(range(1, 21))


def test_splits_and_stratification(spark):
    rows = spark.range(100).select((F.col("id") % 40).cast("string").alias("q"), "id")
    split = sampling.grouped_splits(rows, "q", "s")
    sides = split.groupBy("split").agg(F.count_distinct("q").alias("n")).collect()
    assert {r.split: r.n for r in sides} == {"train": 28, "dev": 6, "test": 6} and gates.split_leaks(split, "q").count() == 0
    records = spark.createDataFrame([(f"P{i}", ["rare"] if i < 3 else ["often"]) for i in range(30)], "paper_id string, features array<string>")
    got = {r.paper_id: r.split for r in sampling.stratified(records, {"train": 20, "dev": 5, "test": 5}, "s").collect()}
    assert len(got) == 30 and sorted(map(list(got.values()).count, ("train", "dev", "test"))) == [5, 5, 20] and len({got[f"P{i}"] for i in range(3)}) >= 1


def test_retrieval_generator(spark):
    config = generators.Config(num_queries=8, candidates=10)
    labels, splits = generators.build_retrieval(catalog(spark), config)
    rows = labels.collect()
    assert 0 < len({r.case_id for r in rows}) <= 8 and all(r.paper_id != r.case_id for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r.case_id, []).append(r)
    assert all(len(v) == 10 and sum(r.kind == "positive" for r in v) >= 1 for v in by.values()) and splits.count() == len(by)
    assert sorted(map(tuple, generators.build_retrieval(catalog(spark), config)[0].collect())) == sorted(map(tuple, rows))


def test_behavior_generators(spark):
    config = generators.Config(events_per_user=8, history_events=5, events_per_period=4, sessions_per_user=2)
    papers = facets.arrays(catalog(spark, 60))
    users = spark.createDataFrame([(f"U{i:04}",) for i in range(3)], "user_id string")
    events = generators.simulate(users, papers, config)
    rows = events.collect()
    reactions = [r for r in rows if r.kind == "reaction"]
    assert len(reactions) == 24 and all(len({r.paper_id for r in reactions if r.user_id == u}) == 8 for u in ("U0000", "U0001", "U0002"))
    assert all(r.paper_id in x.papers for r in reactions for x in rows if x.kind == "exposure" and x.event_id == r.event_id)
    sides = generators.split_history(events, config).filter("kind = 'reaction'").groupBy("user_id", "side").count().collect()
    assert {(r.side, r["count"]) for r in sides} == {("history", 5), ("holdout", 3)}
    assert sorted(map(str, generators.simulate(users.repartition(3), papers, config).collect())) == sorted(map(str, rows))
    drift = generators.simulate_drift(users, papers, config).filter("kind = 'reaction'")
    assert drift.count() == 3 * 4 * 4
    sessions = generators.build_sessions(users, catalog(spark), config)
    assert sessions.filter("grade = 2").count() > 0 and sessions.filter("paper_id = query_paper_id").count() == 0
    with pytest.raises(ValueError):
        generators.Config(noise=2.0).check()


def test_gates_notice_changes(spark):
    rows = spark.createDataFrame([("U1", "S", 1, "2026-01-01"), ("U1", "S", 2, "2026-01-02")], "user_id string, session_id string, n int, ts string")
    assert gates.not_increasing(rows, ["user_id", "session_id"], ["n"]).count() == 0
    assert gates.not_increasing(rows.withColumn("ts", F.lit("2026-01-01")), ["user_id", "session_id"], ["n"]).count() == 1
    assert gates.orphans(rows, rows.filter("n = 1"), ["n"]).count() == 1
    assert gates.temporal_leaks(rows.filter("n = 1"), rows.filter("n = 2")).count() == 0 and gates.temporal_leaks(rows, rows).count() == 1
    assert {r.side for r in gates.differences(rows, rows.filter("n = 1")).collect()} == {"left"}
    assert gates.once(rows.unionByName(rows), ["user_id", "n"]).count() == 2
    with pytest.raises(gates.GateError):
        gates.once(rows, ["user_id"])
    with pytest.raises(gates.GateError):
        gates.check_schema(rows, {"user_id": "string"})
    got = {r.rule: r.n_violations for r in gates.violations(rows, first=F.col("n") == 1, none=F.lit(None).cast("boolean")).collect()}
    assert got == {"first": 1, "none": 2}
    case = spark.createDataFrame([("k", "a"), ("k", "b")], "case_id string, paper_id string")
    scored = case.withColumn("model", F.lit("m")).withColumn("score", F.lit(1.0))
    assert gates.incomplete(scored, case, ["m"]).count() == 0 and gates.incomplete(scored.filter("paper_id = 'a'"), case, ["m"]).count() == 1
    assert gates.bad_rankings(scored.withColumn("rank", F.when(F.col("paper_id") == "a", 2).otherwise(1))).count() == 1


def brute_hits(content, vocabulary):
    """Longest concepts first, then by name and place, none that overlaps one before; sign by the words before."""
    import re

    words, starts = content.split(" "), [0]
    for w in words:
        starts.append(starts[-1] + len(w) + 1)
    places = {s: i for i, s in enumerate(starts)}
    hits = [(-len(c), c, s) for i, s in enumerate(starts[:-1]) for n in range(1, 6) if (c := " ".join(words[i : i + n])) in vocabulary and i + n <= len(words)]
    taken, out = [False] * len(words), set()
    for less, c, s in sorted(hits):
        spot = range(places[s], places[s] + c.count(" ") + 1)
        if not any(taken[k] for k in spot):
            for k in spot:
                taken[k] = True
            out.add((c, -1 if re.search(r"(without|excluding|alternatives? to|instead of|not using)\s*$", content[max(0, s - 20) : s]) else 1))
    return out


@pytest.mark.parametrize("n", [40, 100_000])
def test_mentions_in_long_searches(spark, n):
    import random

    rng = random.Random(n)
    vocabulary = {" ".join(rng.choices("abcdefgh", k=rng.randint(1, 4))) for _ in range(60)}
    concepts = spark.createDataFrame([(i, "task", c) for i, c in enumerate(sorted(vocabulary))], "paper_id int, facet string, concept string")
    contents = [" ".join(rng.choices([*"abcdefghxyz", "without", "alternatives", "to", "instead", "of"], k=rng.randint(1, n))) for _ in range(3 if n > 99 else 60)]
    contents = [c for c in contents if c not in vocabulary and not c.startswith("alternatives to ") and not c.startswith("more papers")]
    searches = spark.createDataFrame([(i, f"task: {c}") for i, c in enumerate(contents)], "query_id int, text string")
    got = {(r.query_id, r.concept, r.sign) for r in mentions(searches, concepts).collect()}
    assert got == {(i, *hit) for i, c in enumerate(contents) for hit in brute_hits(c, vocabulary)}
