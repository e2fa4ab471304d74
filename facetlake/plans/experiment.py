"""Whole experiments: gates, visible prefixes, scores, metrics, reports, in one lazy plan until the sinks.

A scorer only ever gets rows before its case's cutoff; hidden truth is read by
the evaluator alone.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetlake.functions import metrics as M
from facetlake.operators import gates as G
from facetlake.operators import profiles as P
from facetlake.operators.scorers import score_retrieval
from facetlake.sources.tables import check_manifest, markdown, table_digest, write_csv, write_json, exists, write_text


def evaluate(scores: DataFrame, labels: DataFrame, ks: Sequence[int], groups: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Details by (case_id, model) and the summary by (model, group).

    scores: case_id, model, paper_id, score; labels: case_id, paper_id, grade;
    groups: case_id, groups (array), for instance a user's kind and the period.
    """
    rows = M.ranked(scores, ["case_id", "model"]).join(labels, ["case_id", "paper_id"])
    details = M.graded_metrics(rows, ["case_id", "model"], ks)
    names = [c for c in details.columns if c not in ("case_id", "model")]
    grouped = details.join(groups, "case_id", "left") if groups is not None else details.withColumn("groups", F.array().cast("array<string>"))
    return details, M.grouped_summary(grouped, ["model"], F.coalesce("groups", F.array().cast("array<string>")), names)


def check_scores(scores: DataFrame, cases: DataFrame) -> None:
    """Every model ranks every case's pool exactly, with finite scores. Models are few; their names come to the driver."""
    models = [r["model"] for r in scores.select("model").distinct().limit(1001).collect()]
    if len(models) > 1000:
        raise G.GateError("more than 1,000 models")
    G.require_none(G.incomplete(scores, cases, models), "a ranking lacks or repeats candidates")
    G.require_none(G.bad_rankings(M.ranked(scores, ["case_id", "model"])), "a score isn't finite")


def run_retrieval(papers: DataFrame, concepts: DataFrame, cases: DataFrame, labels: DataFrame, ks: Sequence[int] = (5, 10), **options) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(scores, details, summary) of all retrieval models."""
    scores = score_retrieval(papers, concepts, cases, **options)
    return scores, *evaluate(scores, labels, ks)


def run_behavior(experiment: str, history: DataFrame, cases: DataFrame, concepts: DataFrame, ks: Sequence[int] = (5, 10), searches: DataFrame | None = None, groups: DataFrame | None = None, **inputs) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(scores, details, summary) of the preference or temporal models.

    history: user_id, paper_id, interaction_type, ts; cases: case_id, user_id,
    cutoff, until, paper_id; searches: user_id, facet, concept, sign, ts. What
    lies at or after a cutoff only makes labels.
    """
    cutoffs = cases.select("case_id", "user_id", "cutoff").distinct()
    rows = P.visible(history, cutoffs)
    found = None if searches is None else P.visible(searches, cutoffs)
    scores = P.score_all(experiment, cases.select("case_id", "paper_id"), rows=rows, all_rows=rows, concepts=concepts, searches=found, **inputs)
    return scores, *evaluate(scores, P.labels(cases, history), ks, groups)


def period_groups(cases: DataFrame, kinds: DataFrame) -> DataFrame:
    """(case_id, groups): the user's kind, the period, and both together; cases: case_id, user_id, period; kinds: user_id, kind."""
    period = F.concat(F.lit("period_"), F.col("period").cast("string"))
    return cases.select("case_id", "user_id", "period").distinct().join(kinds, "user_id").select("case_id", F.array(F.col("kind"), period, F.concat_ws("_", "kind", period)).alias("groups"))


def write_run(scores: DataFrame, details: DataFrame, summary: DataFrame, out: str, settings: dict) -> dict:
    """Rankings, details and summary, a report for people, the manifest last. An output that exists is refused."""
    if exists(summary.sparkSession, f"{out}/manifest.json"):
        raise G.GateError(f"{out} holds a finished run")
    ranked = M.ranked(scores, ["case_id", "model"])
    nested = ranked.groupBy("case_id", "model").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "paper_id", "score"))), lambda r: F.struct(r["paper_id"].alias("paper_id"), r["score"].alias("score"))).alias("ranking"))
    tables = {"rankings": nested, "details": details, "summary": summary}
    digests = {}
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{out}/{name}.parquet")
        digests[name] = table_digest(df.sparkSession.read.parquet(f"{out}/{name}.parquet"))
    kept = summary.sparkSession.read.parquet(f"{out}/summary.parquet").orderBy("model", "group_name")
    write_csv(kept, f"{out}/summary.csv", kept.columns)
    write_text(f"{out}/report.md", markdown(kept, kept.columns))
    manifest = {"settings": settings, "tables": digests, "hidden": {}}
    write_json(f"{out}/manifest.json", manifest)
    return manifest


def verified(spark, out: str, names: Sequence[str]) -> dict[str, DataFrame]:
    """The tables of a finished run or dataset, after its manifest was checked."""
    check_manifest(spark, out)
    return {n: spark.read.parquet(f"{out}/{n}.parquet") for n in names}


def load_annotated(papers: DataFrame, facets: DataFrame, metadata: DataFrame) -> DataFrame:
    """Papers with facets and metadata, after the gates that ids are unique and refer to papers; a paper without annotation is absent, not empty."""
    for df, name in ((papers, "papers"), (facets, "facets"), (metadata, "metadata")):
        G.require_none(G.repeated(df, ["paper_id"]), f"{name} repeat an id")
    G.require_none(G.orphans(facets, papers, ["paper_id"]), "facets of an unknown paper")
    G.require_none(G.differences(facets.select("paper_id"), metadata.select("paper_id")), "facets and metadata differ in papers")
    return papers.join(facets, "paper_id").join(metadata, "paper_id")


def scored_by(name: str, scorer: Callable[..., DataFrame], *args, **kwargs) -> DataFrame:
    """A user's own scorer in the shape of the registered ones."""
    from facetlake.operators.scorers import as_model

    return as_model(scorer(*args, **kwargs), name)


def oracle_summary(scores: DataFrame, privileged: Column) -> DataFrame:
    """Scores with the flag that marks rows which saw the truth."""
    return scores.withColumn("privileged", privileged)
