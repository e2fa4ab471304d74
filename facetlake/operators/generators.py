"""Generators of mock experiments over facet concepts.

Draws are hashes of a seed and ids, so a run repeats whatever the partitions.
Distributions, quotas and rules are those of the experiments; the stream of
random numbers is this library's own.
"""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_right
from collections import deque
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetlake.functions import vectors as V
from facetlake.operators import sampling as K
from facetlake.operators.facets import FACETS, FIXED_WEIGHTS, arrays, retrieval_grade, session_grade, sharing
from facetlake.operators.profiles import BEHAVIORS


@dataclass(frozen=True)
class Config:
    """Settings of all four experiments; ``check`` is their gate."""

    seed: str = "42"
    num_queries: int = 300
    candidates: int = 100
    positive_fraction: float = 0.2
    hard_negative_fraction: float = 0.5
    positive_grade: float = 0.6
    num_users: int = 300
    events_per_user: int = 50
    history_events: int = 30
    step_seconds: int = 86_400
    start: str = "2026-01-01T00:00:00"
    concepts_per_facet: int = 2
    targeted_fraction: float = 0.8
    search_fraction: float = 0.6
    exposure_size: int = 4
    noise: float = 0.15
    positive_range: tuple[float, float] = (0.5, 1.0)
    negative_range: tuple[float, float] = (-1.0, -0.5)
    thresholds: tuple[float, ...] = (-0.25, 0.05, 0.2, 0.4)
    stable_fraction: float = 0.5
    drift: tuple[float, ...] = (0.0, 0.5, 1.0, 1.0)
    boundaries: tuple[str, ...] = ("2026-01-01T00:00:00", "2026-02-01T00:00:00", "2026-03-01T00:00:00", "2026-04-01T00:00:00", "2026-05-01T00:00:00")
    events_per_period: int = 15
    sessions_per_user: int = 5
    observation_pairs: int = 4
    weights: dict[str, float] = field(default_factory=lambda: dict(FIXED_WEIGHTS))

    def check(self) -> Config:
        fractions = (self.positive_fraction, self.hard_negative_fraction, self.targeted_fraction, self.search_fraction, self.noise, self.stable_fraction)
        low, high = self.positive_range, self.negative_range
        problems = [
            not all(math.isfinite(x) and 0 <= x <= 1 for x in fractions),
            not 0 < self.num_queries <= 9999 or self.candidates < 2 or self.exposure_size < 2 or self.concepts_per_facet < 2,
            list(self.thresholds) != sorted(set(self.thresholds)) or len(self.thresholds) != len(BEHAVIORS) - 1,
            not (0 <= low[0] <= low[1] <= 1 and -1 <= high[0] <= high[1] <= 0),
            set(self.weights) != set(FACETS) or min(self.weights.values()) < 0 or sum(self.weights.values()) <= 0,
        ]
        if any(problems):
            raise ValueError(f"invalid settings: {self}")
        return self


class Chance:
    """Numbers that depend on a seed and on what they are for, not on how many were drawn before."""

    def __init__(self, *seed: object):
        self.seed = ":".join(map(str, seed))

    def __call__(self, *what: object) -> float:
        """A number in [0, 1)."""
        digest = hashlib.md5(":".join([self.seed, *map(str, what)]).encode()).digest()
        return int.from_bytes(digest[:6], "big") / (1 << 48)

    def within(self, bounds: Sequence[float], *what: object) -> float:
        return bounds[0] + (bounds[1] - bounds[0]) * self(*what)

    def shuffled(self, values: Iterable, *what: object) -> list:
        return sorted(values, key=lambda v: (self(*what, v), v))

    def gauss(self, width: float, *what: object) -> float:
        return width * math.sqrt(-2 * math.log(1 - self(*what, "r"))) * math.cos(2 * math.pi * self(*what, "a"))


def interpolate(old: DataFrame, new: DataFrame, keys: Sequence[str], share: float, weight: str = "weight") -> DataFrame:
    """(1 - share) * old + share * new over the union of keys; what one side lacks is 0."""
    joined = old.withColumnRenamed(weight, "old_w").join(new.withColumnRenamed(weight, "new_w"), list(keys), "full_outer")
    return joined.select(*keys, ((1 - share) * F.coalesce("old_w", F.lit(0.0)) + share * F.coalesce("new_w", F.lit(0.0))).alias(weight))


def build_retrieval(concepts: DataFrame, config: Config) -> tuple[DataFrame, DataFrame]:
    """Queries with their candidate pools and graded labels, and the anchors' splits.

    Anchors have two facets or more. Papers that share a concept are graded by
    the weights; others grade 0 and make up the easy negatives: as many as a pool
    needs are drawn for each anchor, no pair of all papers is made.
    """
    config.check()
    filled = concepts.groupBy("paper_id").agg(F.count_distinct("facet").alias("n")).filter("n >= 2").select("paper_id")
    anchors = K.sample(filled, config.num_queries, config.seed, ["paper_id"]).select(F.col("paper_id").alias("anchor_id"))
    maps = arrays(concepts)
    near = sharing(anchors, concepts).join(maps.select(F.col("paper_id").alias("anchor_id"), F.col("concepts").alias("a")), "anchor_id").join(maps, "paper_id")
    graded = near.select(F.col("anchor_id").alias("case_id"), "paper_id", retrieval_grade(F.col("a"), F.col("concepts"), config.weights).alias("grade"))
    far = _far_papers(anchors, concepts, config.candidates, config.seed)
    far = far.join(graded.select("case_id", "paper_id"), ["case_id", "paper_id"], "left_anti").withColumn("grade", F.lit(0.0))
    pools = graded.unionByName(far).withColumn("kind", F.when(F.col("grade") >= config.positive_grade, "positive").when(F.col("grade") > 0, "hard").otherwise("easy"))
    chosen = K.candidate_sample(pools.select("case_id", "paper_id", "kind"), config.candidates, config.positive_fraction, config.hard_negative_fraction, config.seed)
    labels = chosen.join(pools.select("case_id", "paper_id", "grade"), ["case_id", "paper_id"])
    return labels, K.grouped_splits(labels.select("case_id").distinct(), "case_id", config.seed)


def _far_papers(anchors: DataFrame, concepts: DataFrame, n: int, seed: str) -> DataFrame:
    """For each anchor, up to 2n papers at drawn places of the numbered catalog."""
    from facetlake.storage import numbered

    catalog = numbered(concepts.select("paper_id").distinct(), ["paper_id"], "place")
    total = catalog.agg(F.count("*").alias("n")).scalar()
    draws = anchors.select("anchor_id", F.explode(F.sequence(F.lit(1), F.lit(2 * n))).alias("i"))
    at = draws.withColumn("place", (F.floor(V.hashed_unit(seed, F.col("anchor_id"), F.col("i")) * total) + 1).cast("bigint"))
    return at.join(catalog, "place").filter("paper_id <> anchor_id").select(F.col("anchor_id").alias("case_id"), "paper_id").distinct()


# --- behaviour ---------------------------------------------------------------

EVENTS = "user_id string, kind string, event_id string, session_id string, seconds double, paper_id string, papers array<string>, interaction_type string, text string, parent_id string"


def concept_rows(papers: dict[str, dict[str, set]]) -> pd.DataFrame:
    """(paper_id, facet, concept) of a catalog."""
    return pd.DataFrame([(p, f, c) for p, facets in papers.items() for f in FACETS for c in facets.get(f, ())], columns=["paper_id", "facet", "concept"])


def new_profile(concepts: pd.DataFrame, config: Config, chance: Chance) -> tuple[pd.DataFrame, pd.Series]:
    """(facet, concept, weight) rows and the importance of each facet.

    Two papers are drawn. Of each facet, concepts of the first are liked, one
    fewer than a facet has room for; concepts of the second alone are avoided and
    fill the room that is left. Importance is drawn for facets with a concept.
    """
    liked, avoided = chance.shuffled(concepts["paper_id"].unique(), "paper")[:2]
    of = concepts[concepts["paper_id"].isin([liked, avoided])].drop_duplicates(["facet", "concept", "paper_id"])
    good = of[of["paper_id"] == liked].assign(sign=1)
    bad = of[of["paper_id"] == avoided].merge(good[["facet", "concept"]], how="left", on=["facet", "concept"], indicator="known")
    bad = bad[bad["known"] == "left_only"].drop(columns="known").assign(sign=-1)

    def first(rows: pd.DataFrame, room: pd.Series) -> pd.DataFrame:
        """As many rows of each facet as it has room for, in drawn order."""
        rows = rows.assign(order=[chance("order", f, c) for f, c in zip(rows["facet"], rows["concept"], strict=True)]).sort_values(["order", "concept"])
        return rows[rows.groupby("facet").cumcount() < rows["facet"].map(room)]

    room = pd.Series(config.concepts_per_facet, index=list(FACETS))
    good = first(good, room - 1)
    bad = first(bad, room.sub(good["facet"].value_counts(), fill_value=0))
    profile = pd.concat([good, bad])[["facet", "concept", "sign"]].reset_index(drop=True)
    bounds = {1: config.positive_range, -1: config.negative_range}
    profile["weight"] = [round(chance.within(bounds[r.sign], "weight", r.facet, r.concept), 6) for r in profile.itertuples()]
    raw = pd.Series({f: chance.within((0.05, 1), "importance", f) if f in set(profile["facet"]) else 0.0 for f in FACETS})
    return profile[["facet", "concept", "weight"]], raw / (raw.sum() or 1.0)


def affinities(profile: pd.DataFrame, concepts: pd.DataFrame, importance: pd.Series) -> pd.Series:
    """Importance-weighted mean preference for each paper's concepts; a facet that the paper or the profile lacks adds nothing."""
    rated = concepts[concepts["facet"].isin(profile["facet"])].merge(profile, how="left", on=["facet", "concept"]).fillna({"weight": 0.0})
    means = rated.groupby(["paper_id", "facet"])["weight"].mean().reset_index()
    return (means["weight"] * means["facet"].map(importance)).groupby(means["paper_id"]).sum().reindex(concepts["paper_id"].unique(), fill_value=0.0)


def chosen_papers(profile: pd.DataFrame, concepts: pd.DataFrame, n: int, config: Config, chance: Chance) -> list[str]:
    """A paper for each step, none twice: a share of steps takes the next paper with a concept of the profile, the others the next of all."""
    every = chance.shuffled(concepts["paper_id"].unique(), "queue")
    aimed = set(concepts.merge(profile[["facet", "concept"]], on=["facet", "concept"])["paper_id"])
    queues = {True: deque(p for p in every if p in aimed), False: deque(every)}
    taken: dict[str, None] = {}
    for step in range(min(n, len(every))):
        for queue in queues.values():
            while queue and queue[0] in taken:
                queue.popleft()
        targeted = chance("aim", step) < config.targeted_fraction and len(queues[True]) > 0
        taken[queues[targeted].popleft()] = None
    return list(taken)


def user_events(user: str, session: str, concepts: pd.DataFrame, profile: pd.DataFrame, importance: pd.Series, seconds: Sequence[float], config: Config, chance: Chance) -> pd.DataFrame:
    """EVENTS of one user: a table of steps, and from it the searches (2 s before a step), exposures (1 s before) and reactions."""
    papers = chosen_papers(profile, concepts, len(seconds), config, chance)
    steps = pd.DataFrame({"step": range(len(papers)), "at": list(seconds)[: len(papers)], "paper": papers})
    liked = profile[profile["weight"] > 0].sort_values(["facet", "concept"]).reset_index(drop=True)
    shares = liked["facet"].map(importance).cumsum()
    scores, everyone = affinities(profile, concepts, importance), list(concepts["paper_id"].unique())
    base = steps.assign(user_id=user, session_id=session)

    asks = base[[len(liked) > 0 and chance("asks", i) < config.search_fraction for i in base["step"]]]
    wish = [liked.loc[min(shares.searchsorted(chance("wish", i) * shares.iloc[-1]), len(liked) - 1)] for i in asks["step"]]
    searches = asks.assign(kind="search", seconds=asks["at"] - 2, event_id=[f"{session}Q{i:04}" for i in asks["step"]], text=[f"{w.facet}: {w.concept} papers" for w in wish])
    searches["parent_id"] = searches["event_id"].shift()

    names = [f"{session}X{i:04}" for i in base["step"]]
    shown = [chance.shuffled([r.paper, *[p for p in chance.shuffled(everyone, "beside", r.step)[: config.exposure_size] if p != r.paper][: config.exposure_size - 1]], "place", r.step) for r in base.itertuples()]
    exposures = base.assign(kind="exposure", seconds=base["at"] - 1, event_id=names, papers=shown, parent_id=base["step"].map(searches.set_index("step")["event_id"]))
    kinds = [react(scores[r.paper] + chance.gauss(config.noise, "noise", r.step), config.thresholds) for r in base.itertuples()]
    reactions = base.assign(kind="reaction", seconds=base["at"], event_id=names, paper_id=base["paper"], interaction_type=kinds)
    columns = [c.split()[0] for c in EVENTS.split(", ")]
    out = pd.concat([searches, exposures, reactions]).sort_values("seconds", kind="stable").reindex(columns=columns)
    return out.astype(object).where(out.notna(), None)


def react(score: float, thresholds: Sequence[float]) -> str:
    return BEHAVIORS[bisect_right(thresholds, score)]


def bounded_catalog(catalog: DataFrame) -> pd.DataFrame:
    """The concepts of a mock's catalog (paper_id, concepts map), which has a checked bound and is sent along."""
    rows = catalog.limit(100_001).collect()
    if len(rows) > 100_000:
        raise ValueError("the simulator takes catalogs of up to 100,000 papers")
    return concept_rows({r["paper_id"]: {f: set(c) for f, c in r["concepts"].items()} for r in rows})


def simulate(users: DataFrame, catalog: DataFrame, config: Config) -> DataFrame:
    """EVENTS of users (user_id) over a catalog (paper_id, concepts map).

    A user is one task's group, as a paper is reacted to once.
    """
    config.check()
    concepts = bounded_catalog(catalog)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        user = group["user_id"].iloc[0]
        chance = Chance(config.seed, user)
        profile, importance = new_profile(concepts, config, chance)
        times = [i * config.step_seconds for i in range(config.events_per_user)]
        return user_events(user, f"{user}S", concepts, profile, importance, times, config, chance)

    return users.select("user_id").groupBy("user_id").applyInPandas(run, EVENTS)


def blended(old: pd.DataFrame, new: pd.DataFrame, share: float) -> pd.DataFrame:
    """(1 - share) of one profile and share of another over the union of their concepts."""
    both = pd.concat([old.assign(weight=old["weight"] * (1 - share)), new.assign(weight=new["weight"] * share)])
    return both.groupby(["facet", "concept"], as_index=False)["weight"].sum()


def simulate_drift(users: DataFrame, catalog: DataFrame, config: Config) -> DataFrame:
    """As ``simulate`` over periods: drifting users move from one profile to another by the drift shares, stable ones stay. Adds nothing but periods in session ids."""
    config.check()
    concepts = bounded_catalog(catalog)
    starts = pd.to_datetime(list(config.boundaries))
    edges = [(s - starts[0]).total_seconds() for s in starts]

    def run(group: pd.DataFrame) -> pd.DataFrame:
        user = group["user_id"].iloc[0]
        (first, importance), (second, _) = (new_profile(concepts, config, Chance(config.seed, "drift", user, k)) for k in (1, 2))
        drifting = Chance(config.seed, "drift", user)("drifts") >= config.stable_fraction
        periods = []
        for p, (share, a, b) in enumerate(zip(config.drift, edges, edges[1:], strict=False), 1):
            times = [a + (b - a) * k / (config.events_per_period + 1) for k in range(1, config.events_per_period + 1)]
            periods.append(user_events(user, f"{user}P{p}S", concepts, blended(first, second, share * drifting), importance, times, config, Chance(config.seed, "drift", user, "period", p)))
        return pd.concat(periods)

    return users.select("user_id").groupBy("user_id").applyInPandas(run, EVENTS)


def split_history(events: DataFrame, config: Config) -> DataFrame:
    """Adds side: a user's first reactions are history, the rest holdout; searches and exposures from 3 s before the first held-out reaction on are holdout too."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("user_id").orderBy("seconds"))
    first = events.filter("kind = 'reaction'").withColumn("n", n).filter(F.col("n") == config.history_events + 1).select("user_id", (F.col("seconds") - 3).alias("cutoff"))
    return events.join(first, "user_id", "left").withColumn("side", F.when(F.col("cutoff").isNull() | (F.col("seconds") < F.col("cutoff")), "history").otherwise("holdout"))


def build_sessions(users: DataFrame, concepts: DataFrame, config: Config) -> DataFrame:
    """Session cases: user, anchor, a focus facet and direction drawn, candidates graded by them."""
    config.check()
    filled = concepts.groupBy("paper_id").agg(F.collect_set("facet").alias("facets")).filter((F.size("facets") >= 2) & F.array_contains("facets", "problem"))
    from facetlake.storage import numbered

    catalog = numbered(filled, ["paper_id"], "place")
    total = catalog.agg(F.count("*").alias("n")).scalar()
    cases = users.select("user_id", F.explode(F.sequence(F.lit(1), F.lit(config.sessions_per_user))).alias("i"))
    cases = cases.withColumn("case_id", F.format_string("%sD%02d", F.col("user_id").cast("string"), "i")).withColumn("place", (F.floor(V.hashed_unit(config.seed, F.col("case_id")) * total) + 1).cast("bigint"))
    cases = cases.join(catalog.withColumnRenamed("paper_id", "query_paper_id"), "place")
    others = F.array_sort(F.array_remove("facets", F.lit("problem")))
    focus = F.get(others, F.floor(V.hashed_unit(config.seed, F.lit("focus"), F.col("case_id")) * F.size(others)).cast("int"))
    way = F.when(V.hashed_unit(config.seed, F.lit("way"), F.col("case_id")) < 0.5, "similar").otherwise("different")
    cases = cases.select("case_id", "user_id", "query_paper_id", focus.alias("focus"), way.alias("direction"))
    near = sharing(cases.select(F.col("query_paper_id").alias("anchor_id")).distinct(), concepts)
    far = _far_papers(cases.select(F.col("query_paper_id").alias("anchor_id")).distinct(), concepts, config.candidates, config.seed).select(F.col("case_id").alias("anchor_id"), "paper_id")
    pool = near.union(far).distinct()
    maps = arrays(concepts)
    rows = cases.join(pool, cases.query_paper_id == pool.anchor_id).join(maps.select(F.col("paper_id").alias("query_paper_id"), F.col("concepts").alias("a")), "query_paper_id").join(maps, "paper_id")
    grade = F.lit(0)
    for f in FACETS:
        grade = F.when(F.col("focus") == f, session_grade(F.col("a"), F.col("concepts"), f, F.col("direction"))).otherwise(grade)
    graded = rows.select("case_id", "user_id", "query_paper_id", "focus", "direction", "paper_id", grade.alias("grade"))
    kind = F.when(F.col("grade") == 2, "positive").when(F.col("grade") == 1, "hard").otherwise("easy")
    chosen = K.candidate_sample(graded.select("case_id", "paper_id", kind.alias("kind")), min(config.candidates, 20), 0.5, config.hard_negative_fraction, config.seed)
    return graded.join(chosen.select("case_id", "paper_id", "place"), ["case_id", "paper_id"])
