"""Totals of events between two times of their user, for any number of times a user.

A plain join on the user with a range condition makes a row for each event and time, and one
join group of a user's whole history. Here events are added up once in buckets of time and in
spans of ``2 ** bits`` of the next narrower ones; a case takes the few spans that cover its
whole buckets and meets single events in its two edge buckets only. Join keys are (user, span,
section of the keys), so no group holds a long history. The spans that a case reads grow with
the logarithm of the time up to ``2 ** (bits * (levels - 1))`` buckets, in proportion beyond.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetlake.functions import vectors as V

DAY = 86_400


def bucket_of(ts: Column, seconds: int, up: bool = False) -> Column:
    """The number of the bucket that holds a time; up: of the first bucket that begins at the time or later."""
    micros = F.unix_micros(ts)
    at = -micros if up else micros
    whole = ((at - F.pmod(at, F.lit(seconds * 1_000_000))) / (seconds * 1_000_000)).cast("bigint")
    return -whole if up else whole


def cover(first: Column, last: Column, bits: int, levels: int) -> Column:
    """Spans array<struct<level, place>> that hold the buckets [first, last) exactly once: place p of level k holds 2 ** (bits * k) buckets from p times that on."""
    none = F.array().cast("array<bigint>")
    between = lambda a, b: F.when(a < b, F.sequence(a, b - 1)).otherwise(none)
    out = []
    for level in range(levels):
        low, high = -F.shiftright(-first, bits * level), F.shiftright(last, bits * level)
        if level + 1 < levels:
            a, b = -F.shiftright(-first, bits * (level + 1)), F.shiftright(last, bits * (level + 1))
            inner = F.concat(between(low, F.shiftleft(a, bits)), between(F.shiftleft(b, bits), high))
            places = F.when(a < b, inner).otherwise(between(low, high))
        else:
            places = between(low, high)
        out.append(_placed(places, level))
    return F.concat(*out)


def _placed(places: Column, level: int) -> Column:
    return F.transform(places, lambda p: F.struct(F.lit(level).alias("level"), p.alias("place")))


def interval_totals(
    cases: DataFrame,
    events: DataFrame,
    keys: Sequence[str],
    sums: Mapping[str, Column] | None = None,
    tops: Mapping[str, Column] | None = None,
    *,
    half_life_days: float | None = None,
    seconds: int = DAY,
    bits: int = 3,
    levels: int = 4,
    sections: int = 8,
) -> DataFrame:
    """(case_id, *keys, n, *sums, *tops) of the events of a case's user with since <= ts < until.

    cases: case_id, user_id, since (null: from the beginning), until; events: user_id, ts, *keys and
    what the columns of ``sums`` (added up, halved every half_life_days before ``until``) and ``tops``
    (the greatest) read. Events without a user or time, and cases without a user or end, take no
    part; an empty interval has no row. A case_id that repeats is an interval of its own each time,
    added up under the id. A key may be null.
    """
    sums, tops = dict(sums or {}), dict(tops or {})
    mine = events.filter("user_id is not null and ts is not null")
    section = F.pmod(F.xxhash64(*keys), F.lit(sections)) if keys else F.lit(0)
    rows = mine.select("user_id", "ts", *keys, *[c.cast("double").alias(f"_s_{name}") for name, c in sums.items()], *[c.alias(f"_t_{name}") for name, c in tops.items()])
    rows = rows.withColumn("_bucket", bucket_of(F.col("ts"), seconds)).withColumn("_section", section)
    #: The beginning of all time: before it no bucket has a row, so spans start there.
    least = mine.agg(F.min(bucket_of(F.col("ts"), seconds)).alias("least")).scalar()
    asked = cases.filter("user_id is not null and until is not null").select("case_id", "user_id", "since", "until", F.coalesce(least, F.lit(0)).alias("_least"))
    asked = asked.withColumn("_a", F.greatest(bucket_of(F.col("since"), seconds, up=True), "_least")).withColumn("_b", bucket_of(F.col("until"), seconds))
    dealt = F.explode(F.sequence(F.lit(0), F.lit((sections if keys else 1) - 1)))

    age = lambda end, start: V.decay(end - start, half_life_days) if half_life_days else F.lit(1.0)
    at, until = F.unix_micros("ts") / 1e6, F.unix_micros("until") / 1e6
    spans = rows.withColumn("_span", F.explode(F.array(*[F.struct(F.lit(k).alias("level"), F.shiftright("_bucket", bits * k).alias("place"), F.lit(seconds << bits * k).alias("width")) for k in range(levels)])))
    spans = spans.select("*", "_span.level", "_span.place", ((F.col("_span.place") + 1) * F.col("_span.width")).alias("_end"))
    added = [F.sum(F.col(f"_s_{s}") * age(F.col("_end"), at)).alias(f"_s_{s}") for s in sums]
    partial = spans.groupBy("user_id", "level", "place", "_section", "_end", *keys).agg(F.count("*").alias("n"), *added, *[F.max(f"_t_{t}").alias(f"_t_{t}") for t in tops])
    wanted = asked.select("case_id", "user_id", "until", F.inline(cover(F.col("_a"), F.col("_b"), bits, levels))).withColumn("_section", dealt)
    #: A span's sums are decayed to its end; from there to the case's end all of it ages alike.
    late = age(until, F.col("_end"))
    whole = wanted.join(partial, ["user_id", "level", "place", "_section"]).select("case_id", *keys, "n", *[(F.col(f"_s_{s}") * late).alias(f"_s_{s}") for s in sums], *[f"_t_{t}" for t in tops])

    outer = lambda c, up: F.when(bucket_of(c, seconds) != bucket_of(c, seconds, up=True), bucket_of(c, seconds))
    edges = F.array_distinct(F.array_compact(F.array(outer(F.col("since"), True), outer(F.col("until"), True))))
    cut = asked.select("case_id", "user_id", "since", "until", F.explode(edges).alias("_bucket")).withColumn("_section", dealt)
    inside = (F.col("ts") < F.col("until")) & (F.col("since").isNull() | (F.col("ts") >= F.col("since")))
    single = cut.join(rows, ["user_id", "_bucket", "_section"]).filter(inside)
    loose = single.select("case_id", *keys, F.lit(1).cast("bigint").alias("n"), *[(F.col(f"_s_{s}") * age(until, at)).alias(f"_s_{s}") for s in sums], *[f"_t_{t}" for t in tops])
    both = whole.unionByName(loose)
    return both.groupBy("case_id", *keys).agg(F.sum("n").alias("n"), *[F.sum(f"_s_{s}").alias(s) for s in sums], *[F.max(f"_t_{t}").alias(t) for t in tops])
