import pytest
from pyspark.sql import functions as F

from facetlake.operators import review
from facetlake.operators.facets import FACETS, arrays, retrieval_grade
from facetlake.operators.gates import GateError
from facetlake.plans import experiment, validation
from tests.test_operators import catalog


def example(spark):
    concepts = catalog(spark, 40)
    ids = [f"P{i + 1:06}" for i in range(40)]
    cases = spark.createDataFrame([(q, q, p) for q in ids[:3] for p in ids[10:20]], "case_id string, query_paper_id string, paper_id string")
    maps = arrays(concepts)
    at = lambda c: maps.select(F.col("paper_id").alias(c), F.col("concepts").alias(f"c_{c}"))
    graded = cases.join(at("query_paper_id"), "query_paper_id").join(at("paper_id"), "paper_id").select("case_id", "paper_id", retrieval_grade(F.col("c_query_paper_id"), F.col("c_paper_id")).alias("grade"))
    papers = concepts.groupBy("paper_id").agg(F.concat_ws(" ", F.sort_array(F.collect_list("concept"))).alias("text"))
    return papers, concepts, cases, graded


def test_retrieval_run(spark, tmp_path):
    papers, concepts, cases, graded = example(spark)
    scores, details, summary = experiment.run_retrieval(papers, concepts, cases, graded)
    experiment.check_scores(scores, cases)
    assert details.count() == 12 and {r.group_name for r in summary.collect()} == {"overall"}
    experiment.write_run(scores, details, summary, f"{tmp_path}/run", {"seed": 1})
    got = experiment.verified(spark, f"{tmp_path}/run", ["rankings", "summary"])
    assert len(got["rankings"].first().ranking) == 10 and "weighted_facets" in (tmp_path / "run/report.md").read_text()
    with pytest.raises(GateError):
        experiment.write_run(scores, details, summary, f"{tmp_path}/run", {})
    with pytest.raises(GateError):
        experiment.check_scores(scores.filter("paper_id <> 'P000011'"), cases)


def test_behavior_run_ignores_the_future(spark):
    _, concepts, _, _ = example(spark)
    rows = [("U1", "P000001", "like", "2026-01-01"), ("U1", "P000005", "like", "2026-02-05"), ("U1", "P000006", "dislike", "2026-02-06")]
    history = spark.createDataFrame(rows, "user_id string, paper_id string, interaction_type string, ts string").withColumn("ts", F.to_timestamp("ts"))
    cases = spark.createDataFrame([("c", "U1", 2, p) for p in ("P000005", "P000006", "P000007")], "case_id string, user_id string, period int, paper_id string").withColumn("cutoff", F.to_timestamp(F.lit("2026-02-01"))).withColumn("until", F.to_timestamp(F.lit("2026-03-01")))
    groups = experiment.period_groups(cases, spark.createDataFrame([("U1", "drift")], "user_id string, kind string"))
    scores, _, summary = experiment.run_behavior("temporal", history, cases.drop("period"), concepts, groups=groups, recent_start=F.to_timestamp(F.lit("2025-12-01")))
    assert {r.group_name for r in summary.collect()} == {"overall", "drift", "period_2", "drift_period_2"}
    alone, _, _ = experiment.run_behavior("temporal", history.filter("ts < '2026-02-01'"), cases.drop("period"), concepts, recent_start=F.to_timestamp(F.lit("2025-12-01")))
    assert sorted(map(tuple, scores.collect())) == sorted(map(tuple, alone.collect()))


def test_retrieval_gate_notices_changes(spark):
    _, concepts, cases, graded = example(spark)
    splits = cases.select("case_id", "query_paper_id").distinct().withColumn("split", F.lit("train"))
    validation.check_retrieval(cases, graded, concepts, splits, 10)
    for bad in (graded.withColumn("grade", F.col("grade") + F.when(F.col("paper_id") == "P000011", 0.1).otherwise(0.0)), graded.filter("paper_id <> 'P000011'")):
        with pytest.raises(GateError):
            validation.check_retrieval(cases, bad, concepts, splits, 10)
    with pytest.raises(GateError):
        validation.check_retrieval(cases, graded, concepts, splits.unionByName(splits.withColumn("split", F.lit("dev"))), 10)
    with pytest.raises(GateError):
        validation.check_pools(cases, 9)


def logs(spark):
    ts = lambda df: df.withColumn("ts", F.to_timestamp("ts"))
    s = ts(spark.createDataFrame([("q1", "U1", "S", None, "2026-01-01 00:00:00"), ("q2", "U1", "S", "q1", "2026-01-01 00:01:00")], "query_id string, user_id string, session_id string, parent_query_id string, ts string"))
    x = ts(spark.createDataFrame([("x1", "U1", "S", "q2", ["a", "b"], "2026-01-01 00:02:00")], "exposure_id string, user_id string, session_id string, query_id string, paper_ids array<string>, ts string"))
    i = ts(spark.createDataFrame([("U1", "a", "like", "S", "x1", "2026-01-01 00:03:00"), ("U1", "b", "view", "S", "x1", "2026-01-01 00:04:00")], "user_id string, paper_id string, interaction_type string, session_id string, exposure_id string, ts string"))
    return s, x, i


def test_log_gates(spark):
    s, x, i = logs(spark)
    validation.check_logs(s, x, i, 2)
    late = F.to_timestamp(F.lit("2026-02-01"))
    for bad in ((s.withColumn("ts", late), x, i), (s, x.withColumn("ts", late), i), (s, x, i.withColumn("paper_id", F.lit("zzz"))), (s, x, i.withColumn("ts", late)), (s, x, i.withColumn("interaction_type", F.lit("buy"))), (s.withColumn("parent_query_id", F.lit("none")), x, i)):
        with pytest.raises(GateError):
            validation.check_logs(*bad, 2)


def test_catalog_gates(spark):
    papers = spark.createDataFrame([("P000001", "T", "A", 2020), ("P000002", "T", "A", None)], "paper_id string, title string, abstract string, year int")
    facets = spark.createDataFrame([("P000001", ["x"], [], [], [], [])], "paper_id string, " + ", ".join(f"{f} array<string>" for f in FACETS))
    validation.check_papers(papers)
    validation.check_facets(facets, papers)
    for bad in (papers.withColumn("paper_id", F.lit("X1")), papers.withColumn("title", F.lit(" ")), papers.withColumn("year", F.lit(9))):
        with pytest.raises(GateError):
            validation.check_papers(bad)
    for bad in (facets.withColumn("task", F.array(F.lit("A"), F.lit("a"))), facets.withColumn("paper_id", F.lit("P000009")), facets.withColumn("task", F.lit(None).cast("array<string>"))):
        with pytest.raises(GateError):
            validation.check_facets(bad, papers)
    meta = papers.select("paper_id").limit(1)
    assert experiment.load_annotated(papers, facets, facets.select("paper_id")).count() == 1 and meta.count() == 1


def test_reviewed_labels(spark):
    labels = spark.createDataFrame([("P1", "task", 0, "b", "A1"), ("P1", "task", 1, "a", "A0")], "paper_id string, facet string, index int, concept string, evidence_id string")
    answer = review.targets(labels).first().answer
    assert answer.startswith('{"paper_id":"P1","problem":[],"task":[{"concept":"b","evidence_id":"A1"}')
    evidence = spark.createDataFrame([("P1", f"A{i}", f"s{i}") for i in range(3)], "paper_id string, evidence_id string, evidence string")
    items = spark.createDataFrame([("P1", "task", 0, "x", ["A0", "A2"]), ("P1", "task", 1, "y", ["A2", "A0"]), ("P1", "task", 2, "z", ["A9"])], "paper_id string, facet string, index int, concept string, evidence_ids array<string>")
    got = {r["index"]: (r.evidence, r.n_missing) for r in review.joined_evidence(items, evidence).collect()}
    assert got[0] == ("s0 s2", 0) and got[1][1] == 1 and got[2][1] == 1
    words = spark.createDataFrame([("stopped cats", "we stop the cat"), ("cat stop", "stop cat")], "c string, e string").select(review.ordered_words(F.col("c"), F.col("e")).alias("ok"))
    assert [r.ok for r in words.collect()] == [True, False]
    decisions = spark.createDataFrame([("P1", "task", "a", "keep", "me", "you", None), ("P1", "task", "b", "remove", "me", "you", "why")], "paper_id string, facet string, concept string, decision string, author string, reviewer string, reason string")
    review.check_reviews(decisions, labels)
    for bad in (decisions.withColumn("reviewer", F.lit("me")), decisions.withColumn("reason", F.lit(None).cast("string")), decisions.filter("concept = 'a'")):
        with pytest.raises(GateError):
            review.check_reviews(bad, labels)
    report = review.split_report(labels, spark.createDataFrame([("P1", "train")], "paper_id string, split string")).first()
    assert (report.n_present, report.n_multiple, report.n_concepts) == (1, 1, 2)
    found = review.features(labels, spark.createDataFrame([("P1", 50, "web")], "paper_id string, n_chars int, origin string"), [10, 100]).first().features
    assert found == ["has_task", "length_1", "many_task", "origin_web"]


def test_eligibility_and_merging(spark):
    rows = spark.createDataFrame([("P000001", "t", "a"), ("P2", "t", "b"), ("P3", "T", "B"), ("P4", "x", "y"), ("P5", "z", "z")], "paper_id string, title string, abstract string")
    held = spark.createDataFrame([("P9", "X", "Y"), ("P5", "other", "other")], "paper_id string, title string, abstract string")
    assert [r.paper_id for r in review.eligible(rows, held).collect()] == ["P2"]
    with pytest.raises(GateError):
        review.check_no_leak(spark.createDataFrame([("P2", "train"), ("P3", "dev")], "paper_id string, split string"), rows)
    one = lambda *x: spark.createDataFrame([(i,) for i in x], "paper_id string")
    assert review.merged_groups([one("a"), one("b")], one("a", "b")).count() == 2
    for groups, want in (([one("a"), one("a")], one("a")), ([one("a")], one("a", "b"))):
        with pytest.raises(GateError):
            review.merged_groups(groups, want)
    attempts = spark.createDataFrame([("P", 1, "extract", True, 3, 50.0), ("P", 2, "review", True, 1, 10.0), ("Q", 1, "extract", False, 1, 90.0), ("Q", 2, "extract", False, 2, 20.0)], "paper_id string, attempt int, stage string, valid boolean, n_items int, score double").withColumn("parseable", F.lit(True)).withColumn("schema_valid", F.lit(True)).withColumn("errors", F.array().cast("array<string>"))
    assert {r.paper_id: r.attempt for r in review.newest_valid(attempts).collect()} == {"P": 2, "Q": 2}
    assert review.freeze(rows, 3, 2, "s").groupBy("batch").count().count() == 2


def test_experiment_violations_name_every_fault(spark):
    """A valid experiment has none; one fault of each rule gives that rule and its key."""
    import datetime as dt

    from facetlake.plans import experiment_gate as E

    t = lambda s: dt.datetime(2024, 1, 1, 0, 0, s)
    good = {
        "searches": [(1, 7, "s", None, t(0)), (2, 7, "s", 1, t(10))],
        "exposures": [(11, 7, "s", 1, [1, 2], t(1)), (12, 7, "s", None, [3, 4], t(11))],
        "interactions": [(7, 1, "click", "s", 11, t(2)), (7, 4, "like", "s", 12, t(12))],
        "cases": [("a", 9, 1), ("a", 9, 2), ("b", 8, 1), ("b", 8, 3)],
        "splits": [("a", 9, "train"), ("b", 8, "test")],
    }
    schemas = {
        "searches": "query_id int, user_id int, session_id string, parent_query_id int, ts timestamp",
        "exposures": "exposure_id int, user_id int, session_id string, query_id int, paper_ids array<int>, ts timestamp",
        "interactions": "user_id int, paper_id int, interaction_type string, session_id string, exposure_id int, ts timestamp",
        "cases": "case_id string, query_paper_id int, paper_id int",
        "splits": "case_id string, query_paper_id int, split string",
    }
    found = lambda rows: E.experiment_violations(*[spark.createDataFrame(rows[n], schemas[n]) for n in schemas], shown=2, pool=2)
    assert found(good).count() == 0
    E.require_valid(found(good))
    faults = [
        ("searches", (2, 7, "s", 2, t(10)), {("searches", "repeated_id", "2"), ("searches", "bad_parent", "2")}),
        ("exposures", (13, 6, "s", 1, [1, 1, 1], t(20)), {("exposures", "wrong_search", "13"), ("exposures", "repeated_paper", "13"), ("exposures", "size", "13")}),
        ("interactions", (7, 9, "bought", "s", 12, t(12)), {("interactions", r, "12:9") for r in ("not_shown", "kind", "not_rising")}),
        ("interactions", (7, 1, "view", "s", 99, t(40)), {("interactions", "wrong_exposure", "99:1")}),
        ("cases", ("b", 8, 3), {("cases", "repeated_paper", "b:3"), ("cases", "size", "b")}),
        ("cases", ("a", 9, 9), {("cases", "own_query", "a:9"), ("cases", "size", "a")}),
        ("cases", ("c", 5, 1), {("cases", "size", "c"), ("splits", "uncovered", "c")}),
        ("splits", ("b", 9, "later"), {("splits", "repeated_case", "b"), ("splits", "side", "b"), ("splits", "leaking_anchor", "9")}),
        ("splits", ("d", 4, "dev"), {("splits", "unknown_case", "d")}),
    ]
    for name, row, wanted in faults:
        bad = found(good | {name: [*good[name], row]})
        assert {tuple(r) for r in bad.select("name", "rule", "key").collect()} == wanted, (name, row)
    with pytest.raises(GateError, match="splits.unknown_case: 1, such as d"):
        E.require_valid(bad)


def test_lineage_by_pointer_doubling(spark):
    from facetlake.operators import lineage

    rows = [(i, i - 1 if i else None, f"d{i}", f"d{i - 1}", f"a{i % 2}") for i in range(100)]
    rows += [(200, 202, "d", "d", "x"), (201, 200, "d", "d", "y"), (202, 201, "d", "d", "z"), (203, 200, "d", "d", "z"), (204, 204, "d", "d", "x"), (300, -1, "d", "", "x"), (301, 300, "d", "old", "x"), (302, None, "d", None, "q"), (302, None, "d", None, "q")]
    records = spark.createDataFrame(rows, "id int, parent_id int, digest string, parent_digest string, actor string").repartition(5)
    got = {r.id: (r.root, r.depth) for r in lineage.chains(records).collect()}
    circles = {i: (None, None) for i in range(200, 205)}
    assert got == {i: (0, i) for i in range(100)} | circles | {300: (300, 0), 301: (300, 1), 302: (302, 0)}
    found = {(r.rule, r.key) for r in lineage.lineage_violations(records).collect()}
    assert found == {("circle", str(i)) for i in range(200, 205)} | {("missing_parent", "300"), ("changed_parent", "301"), ("own_review", "301"), ("own_review", "204"), ("repeated_id", "302")}
    assert lineage.chains(records.filter("false")).count() == 0 and lineage.lineage_violations(records.filter("false")).count() == 0
