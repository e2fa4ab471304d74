"""Interval totals against a plain scan, with a user who holds a third of all events."""

import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from facetlake.operators import profiles as P
from facetlake.operators.intervals import cover, interval_totals

EVENTS = "user_id long, paper_id string, interaction_type string, ts timestamp"
CASES = "case_id string, user_id long, since timestamp, until timestamp"
START = datetime(2023, 12, 30, 7, 30)


@pytest.mark.parametrize(("bits", "levels"), [(1, 6), (3, 2), (2, 3)])
def test_cover_holds_each_bucket_once(spark, bits, levels):
    ends = [(a, b) for a in range(-9, 30, 2) for b in range(-9, 90, 7)]
    rows = spark.createDataFrame(ends, "a long, b long").select("a", "b", cover(F.col("a"), F.col("b"), bits, levels).alias("spans")).collect()
    for r in rows:
        held = [x for s in r.spans for x in range(s.place << bits * s.level, (s.place + 1) << bits * s.level)]
        assert sorted(held) == list(range(r.a, r.b))


def drawn(seed):
    """A third of the events are user 1's; ties, repeated rows, times on bucket borders, nulls in every column."""
    draw = random.Random(seed)
    kinds = list(P.BEHAVIORS)
    events = []
    for _ in range(900):
        user = 1 if draw.random() < 1 / 3 else draw.randrange(2, 12)
        ts = START + timedelta(hours=draw.choice([0.5, 1]) * draw.randrange(0, 2000)) if draw.random() < 0.8 else datetime(2024, 1, draw.randrange(1, 30))
        events.append((user, f"p{draw.randrange(6)}", draw.choice(kinds), ts))
    events += events[:40] + [(None, "p1", "like", START), (1, None, "like", START), (1, "p1", None, START), (1, "p1", "like", None)]
    cases = []
    for i in range(60):
        since = START + timedelta(hours=draw.randrange(-50, 1500)) if draw.random() < 0.7 else None
        until = (since or START) + timedelta(hours=draw.choice([0, 1, 5, 24, 200, 1500]), microseconds=draw.choice([0, 1]))
        cases.append((f"c{i}", draw.choice([1, 1, 2, 5, 99]), since, until))
    cases += [("late", 1, datetime(2030, 1, 1), datetime(2030, 2, 1)), ("early", 1, None, datetime(1960, 1, 1)), ("midnight", 1, datetime(2024, 1, 3), datetime(2024, 1, 9)), ("none", None, None, START), ("open", 1, START, None)]
    return events, cases


def plain_totals(events, cases, half_life):
    weights, found = P.BEHAVIOR_WEIGHTS, {}
    for case, user, since, until in cases:
        for who, paper, kind, ts in events:
            if None in (user, until, who, ts) or who != user or ts >= until or (since and ts < since):
                continue
            w = weights.get(kind)
            n, total, best = found.get((case, paper), (0, None, None))
            if w is not None:
                total = (total or 0) + w * (math.pow(2, -((until - ts) / timedelta(days=1)) / half_life) if half_life else 1)
            grade = max(0, w) if w is not None else 0
            found[case, paper] = (n + 1, total, max(best or 0, grade))
    return found


@pytest.mark.parametrize(("half_life", "layout"), [(None, {}), (9.0, {}), (9.0, {"seconds": 3600, "bits": 2, "levels": 3, "sections": 2}), (None, {"levels": 1})])
def test_equals_a_plain_scan(spark, half_life, layout):
    events, cases = drawn(5)
    rows = P.interval_weights(spark.createDataFrame(cases, CASES), spark.createDataFrame(events, EVENTS), half_life_days=half_life, **layout).collect()
    want = plain_totals(events, cases, half_life)
    assert {(r.case_id, r.paper_id): (r.n, r.grade) for r in rows} == {k: (n, g) for k, (n, _, g) in want.items()}
    for r in rows:
        assert r.weight == pytest.approx(want[r.case_id, r.paper_id][1], abs=1e-9)


def test_profiles_of_the_visible_rows_are_unchanged(spark):
    events, _ = drawn(8)
    history = spark.createDataFrame([e for e in events if None not in e], EVENTS)
    cuts = spark.createDataFrame([("a", 1, datetime(2024, 1, 20, 5)), ("b", 1, datetime(2024, 2, 1)), ("c", 3, datetime(2024, 1, 11, 11))], "case_id string, user_id long, cutoff timestamp")
    weight = P.behavior_weight(F.col("interaction_type")) * P.time_weight(7.0)
    plain = P.visible(history, cuts).groupBy("case_id", "paper_id").agg(F.sum(weight).alias("weight"))
    spans = P.interval_weights(cuts.select("case_id", "user_id", F.lit(None).cast("timestamp").alias("since"), F.col("cutoff").alias("until")), history, half_life_days=7.0)
    as_map = lambda df: {(r.case_id, r.paper_id): round(r.weight, 9) for r in df.collect()}
    assert as_map(plain) == as_map(spans)


def test_empty_tables_extra_columns_and_no_keys(spark):
    events, cases = drawn(3)
    none_events, none_cases = spark.createDataFrame([], EVENTS), spark.createDataFrame([], CASES)
    some = spark.createDataFrame(cases, CASES).withColumn("ts", F.lit(1)).withColumn("n", F.lit(2)).withColumn("level", F.lit(0))
    all_events = spark.createDataFrame(events, EVENTS).withColumn("until", F.lit(1)).withColumn("case_id", F.lit(0)).withColumn("place", F.lit(0))
    assert P.interval_weights(some, none_events).count() == 0 == P.interval_weights(none_cases, all_events).count()
    got = {r.case_id: r.n for r in interval_totals(some, all_events, []).collect()}
    want = {}
    for (case, _), (n, _, _) in plain_totals(events, cases, None).items():
        want[case] = want.get(case, 0) + n
    assert got == want
