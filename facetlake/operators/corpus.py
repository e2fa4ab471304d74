"""The corpus: adapt sources, classify scope, resolve entities into stable ids, audit."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetlake.functions import text as T
from facetlake.operators.gates import require_none
from facetlake.storage import numbered, written

#: Identifier kinds taken from a source's metadata, and the domain of included papers.
IDENTIFIERS = ("doi", "arxiv_id", "acl_id", "pubmed_id", "pmc_id")
DOMAIN = "information_technology"


def adapt(rows: DataFrame, source: str, *, source_id: str, title: str = "title", abstract: str = "abstract", metadata: str | None = None) -> DataFrame:
    """One shape for all sources: source, source_id, title, abstract, year, identifiers.

    abstract may be an array of sentences; metadata a map of strings.
    """
    body = F.array_join(F.col(abstract), " ") if rows.schema[abstract].dataType.typeName() == "array" else F.col(abstract)
    kinds = [F.struct(F.lit("s2orc").alias("key"), F.col(source_id).cast("string").alias("value"))]
    year = F.lit(None).cast("int")
    if metadata:
        raw = lambda k: F.try_element_at(F.col(metadata), F.lit(k)).cast("string")
        year = T.numeric_id(raw("year"))
        kinds += [F.struct(F.lit(k).alias("key"), (T.doi(raw(k)) if k == "doi" else F.lower(F.trim(raw(k)))).alias("value")) for k in IDENTIFIERS]
    present = F.filter(F.array(*kinds), lambda x: F.coalesce(x["value"], F.lit("")) != "")
    return rows.select(F.lit(source).alias("source"), F.col(source_id).cast("string").alias("source_id"), T.collapsed(F.col(title)).alias("title"), T.collapsed(body).alias("abstract"), year.alias("year"), F.map_from_entries(present).alias("identifiers"))


def classify(papers: DataFrame, *, terms: Sequence[str], markers: Sequence[str], trusted: Sequence[str] = (), trusted_evidence: str = "source scope", fold: Callable[[Column], Column] = F.lower) -> DataFrame:
    """Adds included, reason, evidence.

    A trusted source; else a term in the title; else a sentence with a term and a
    method marker; else pending if any term was seen. A missing title or abstract
    wins over all of it.
    """
    hits = lambda text, what: F.filter(F.array(*[F.when(T.has_term(text, t), F.lit(t)) for t in what]), lambda x: x.isNotNull())
    in_title = hits(T.normalized(fold(F.coalesce(F.col("title"), F.lit("")))), terms)
    by_sentence = F.transform(T.sentences(F.coalesce(F.col("abstract"), F.lit(""))), lambda s: F.transform(F.array(T.normalized(fold(s))), lambda n: F.struct(hits(n, terms).alias("terms"), hits(n, markers).alias("markers")))[0])
    found = papers.withColumn("in_title", in_title).withColumn("by_sentence", by_sentence)
    both = F.filter("by_sentence", lambda s: (F.size(s["terms"]) > 0) & (F.size(s["markers"]) > 0))
    seen = F.array_sort(F.array_distinct(F.flatten(F.transform("by_sentence", lambda s: s["terms"]))))
    missing = (F.coalesce(F.trim("title"), F.lit("")) == "") | (F.coalesce(F.trim("abstract"), F.lit("")) == "")
    reason = (
        F.when(missing, "missing_title_or_abstract")
        .when(F.col("source").isin(*trusted) if trusted else F.lit(False), "source_cs_scope")
        .when(F.size("in_title") > 0, "it_term_in_title")
        .when(F.size(both) > 0, "it_method_in_abstract")
        .when(F.size(seen) > 0, "review_pending")
        .otherwise("no_explicit_it_evidence")
    )
    evidence = (
        F.when(F.col("reason") == "source_cs_scope", F.array(F.lit(trusted_evidence)))
        .when(F.col("reason") == "it_term_in_title", F.col("in_title"))
        .when(F.col("reason") == "it_method_in_abstract", F.array_sort(F.array_distinct(both[0]["terms"])))
        .otherwise(seen)
    )
    return found.withColumn("reason", reason).withColumn("included", F.col("reason").isin("source_cs_scope", "it_term_in_title", "it_method_in_abstract")).withColumn("evidence", evidence).drop("in_title", "by_sentence")


def override(classified: DataFrame, overrides: DataFrame) -> DataFrame:
    """Apply reviewed decisions (source, source_id, include, reviewer, review_reason); an incomplete one is an error. Missing text stays excluded."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    require_none(overrides.filter(F.col("include").isNull() | blank("reviewer") | blank("review_reason")), "an override needs include, reviewer and reason")
    joined = classified.join(overrides, ["source", "source_id"], "left")
    applies = F.col("include").isNotNull() & (F.col("reason") != "missing_title_or_abstract")
    return joined.withColumn("included", F.when(applies, F.col("include")).otherwise(F.col("included"))).withColumn("reason", F.when(applies, "manual_override").otherwise(F.col("reason"))).drop("include")


def digest(columns: Sequence[str]) -> Column:
    """SHA-256 of the columns as JSON with sorted keys (nulls left out)."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(columns)])), 256)


def resolve(rows: DataFrame, previous: DataFrame, fold: Callable[[Column], Column] = F.lower) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Papers, id map and title conflicts of records (adapted, with scope_evidence) against the id map so far.

    Records are taken in the order: known primary ones, other known ones, then by
    source and source id. A record belongs to the earliest one it shares an
    identifier with, or else the earliest with its normalized title and abstract;
    following those links to their end gives groups. It is an error if a record's
    identifiers lead to two groups, if a group has two issued ids, or if a known
    record's content changed. Groups without an issued id get the next numbers.
    """
    key = ["source", "source_id"]
    require_none(rows.groupBy(*key).count().filter("count > 1"), "duplicate source record")
    require_none(previous.groupBy(*key).count().filter("count > 1"), "duplicate source key in the id map")
    known = previous.select(*key, F.col("paper_id").alias("issued"), F.col("primary").alias("was_primary"), F.col("content_sha256").alias("old_sha256"))
    content = digest(["source", "source_id", "title", "abstract", "year", "identifiers"])
    flat = rows.withColumn("content_sha256", content).join(known, key, "left")
    require_none(flat.filter("old_sha256 <> content_sha256").select(*key), "source content changed")
    place = F.concat_ws("\u0001", F.when(F.col("issued").isNull(), "1").otherwise("0"), F.when(F.coalesce("was_primary", F.lit(False)), "0").otherwise("1"), "source", "source_id")
    norm = lambda c: T.normalized(fold(F.coalesce(F.col(c), F.lit(""))))
    flat = written(flat.withColumn("place", place).withColumn("title_key", norm("title")).withColumn("text_key", F.sha2(F.concat_ws("\u0001", norm("title"), norm("abstract")), 256)), "records")
    ids = flat.select("place", F.explode("identifiers").alias("kind", "value"))
    owners = ids.groupBy("kind", "value").agg(F.min("place").alias("owner"))
    by_id = ids.join(owners, ["kind", "value"]).filter("owner < place").groupBy("place").agg(F.min("owner").alias("id_link"))
    heads = flat.groupBy("text_key").agg(F.min("place").alias("text_link"))
    links = flat.select("place", "text_key").join(by_id, "place", "left").join(heads, "text_key").select("place", F.coalesce("id_link", "text_link").alias("up"))
    roots = _roots(links)
    split = ids.join(owners, ["kind", "value"]).join(roots, "place").join(roots.select(F.col("place").alias("owner"), F.col("root").alias("owner_root")), "owner").filter("root <> owner_root")
    require_none(split.select("place", "kind", "value"), "identifiers lead to two papers")
    grouped = flat.join(roots, "place")
    issued = grouped.groupBy("root").agg(F.min("issued").alias("low"), F.max("issued").alias("high"))
    require_none(issued.filter("low <> high"), "a paper would have two issued ids")
    last = previous.agg(F.coalesce(F.max(F.substring("paper_id", 2, 6).cast("int")), F.lit(0)).alias("n")).scalar()
    fresh = numbered(issued.filter("low is null").select("root"), ["root"]).select("root", F.format_string("P%06d", (F.col("number") + last).cast("int")).alias("paper_id"))
    named = written(issued.filter("low is not null").select("root", F.col("low").alias("paper_id")).unionByName(fresh), "paper-ids")
    full = grouped.join(named, "root")
    papers = full.filter("place = root").select("paper_id", "source", "source_id", "title", "abstract", "year", F.lit(DOMAIN).alias("domain"), "scope_evidence")
    active = full.select(*key, "paper_id", "identifiers", "content_sha256", F.lit(True).alias("active"), (F.col("place") == F.col("root")).alias("primary"))
    gone = previous.join(rows.select(*key), key, "left_anti").select(*key, "paper_id", "identifiers", "content_sha256", F.lit(False).alias("active"), F.lit(False).alias("primary"))
    tops = full.filter("place = root").select("title_key", "paper_id", *key, "place")
    first = tops.groupBy("title_key").agg(F.min("place").alias("first_place"), F.array_sort(F.collect_set("paper_id")).alias("same_title"))
    conflicts = tops.join(first, "title_key").filter("place <> first_place").select(*key, "paper_id", F.array_remove("same_title", F.col("paper_id")).alias("conflicting_paper_ids"))
    return papers, active.unionByName(gone), conflicts


def _roots(links: DataFrame) -> DataFrame:
    """(place, root): links (place, up) followed to their end, twice as far each round."""
    now = written(links.select("place", F.col("up").alias("root")), "links")
    while True:
        nxt = now.join(now.select(F.col("place").alias("root"), F.col("root").alias("far")), "root").select("place", F.col("far").alias("root"))
        nxt = written(nxt, "links")
        if nxt.join(now, ["place", "root"], "left_anti").isEmpty():
            return nxt
        now = nxt


def corpus_report(audit: DataFrame) -> DataFrame:
    """Counts by source and reason: total, included, distinct titles."""
    return audit.groupBy("source", "reason").agg(F.count("*").alias("total"), F.count_if("included").alias("included"), F.count_distinct("title").alias("titles"))
