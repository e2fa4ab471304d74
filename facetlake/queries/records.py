"""Queries on single records: files and envelopes, word forms, evidence, times, weights, splits, review rules."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from facetlake.functions import rules as R
from facetlake.functions import text as T
from facetlake.functions import vectors as V
from facetlake.operators import corpus as C
from facetlake.operators import extraction as X
from facetlake.operators import facets as A
from facetlake.operators import gates as G
from facetlake.operators import intent as D
from facetlake.operators import lineage as L
from facetlake.operators import matching as J
from facetlake.operators import profiles as P
from facetlake.operators import review as W
from facetlake.plans import experiment_gate as E
from facetlake.queries.base import BASE_SQL, part_concepts, reactions, table
from facetlake.queries.extraction import attempts, gold_and_predicted
from facetlake.sources import exports as O
from facetlake.sources import tables as S
from facetlake.storage import new_dir, written

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


# --- files and envelopes -----------------------------------------------------


@query("jsonl_round_trip", "SELECT p_partkey, p_name, CASE WHEN p_size > 25 THEN p_size END AS p_size FROM part")
def jsonl_round_trip(spark, sf):
    """Parts as JSON lines in a total order, read back; some values are null."""
    rows = table(spark, sf, "part").select("p_partkey", "p_name", F.when(F.col("p_size") > 25, F.col("p_size")).alias("p_size"))
    S.write_jsonl(rows, path := new_dir(spark, "jsonl"), ["p_partkey"])
    return S.read_jsonl(spark, path, "p_partkey bigint, p_name string, p_size int")


@query("csv_summary", "SELECT p_brand, count(*) AS n, min(p_name) AS least FROM part GROUP BY p_brand")
def csv_summary(spark, sf):
    rows = table(spark, sf, "part").groupBy("p_brand").agg(F.count("*").alias("n"), F.min("p_name").alias("least"), F.max("p_size").alias("left_out"))
    S.write_csv(rows, path := new_dir(spark, "csv"), ["p_brand", "n", "least"])
    return spark.read.option("header", True).schema("p_brand string, n bigint, least string").csv(path)


@query("dataset_manifest", "SELECT 'customers' AS name, 'tables' AS kind, count(*) AS n FROM customer UNION ALL SELECT 'truth', 'hidden', count(*) FROM nation")
def dataset_manifest(spark, sf):
    """A dataset with a hidden table, written, checked against its manifest, and counted from it."""
    out, truth = new_dir(spark, "dataset"), new_dir(spark, "truth")
    S.write_dataset({"customers": table(spark, sf, "customer")}, {"truth": table(spark, sf, "nation")}, out, truth, {"seed": 1})
    said = S.check_manifest(spark, out, truth)
    rows = [(name, kind, digest["rows"]) for kind in ("tables", "hidden") for name, digest in said[kind].items()]
    return spark.createDataFrame(rows, "name string, kind string, n bigint")


@query("judged_pools", "SELECT 'method' AS facet, 'Q' || s_nationkey AS query_id, 'P' || s_suppkey AS paper_id, (s_suppkey % 4)::DOUBLE AS relevance FROM supplier")
def judged_pools(spark, sf):
    """Suppliers as a judged pool of their nation: one JSON document, read back as rows."""
    pool = table(spark, sf, "supplier").groupBy(F.concat(F.lit("Q"), "s_nationkey").alias("q")).agg(F.collect_list(F.struct(F.concat(F.lit("P"), "s_suppkey").alias("c"), (F.col("s_suppkey") % 4).cast("double").alias("r"))).alias("x"))
    value = F.struct(F.transform("x", lambda x: x["c"]).alias("cands"), F.transform("x", lambda x: x["r"]).alias("relevance_adju"))
    document = pool.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("q", value)))).alias("value"))
    document.write.text(path := new_dir(spark, "pool"))
    return S.judged_pools(spark, {"method": path})


@query("signed_records", "SELECT n_nationkey, n_name, sha256('{\"n_name\":\"' || n_name || '\",\"n_nationkey\":' || n_nationkey || '}') AS record_sha256 FROM nation")
def signed_records(spark, sf):
    rows = table(spark, sf, "nation").select("n_nationkey", "n_name")
    envelopes = written(S.signed(rows, "run-1"), "signed")
    return S.opened(envelopes, "run-1", rows.schema).join(envelopes.select(F.get_json_object("record", "$.n_nationkey").cast("int").alias("n_nationkey"), "record_sha256"), "n_nationkey")


_NAME = "CASE p_size % 5 WHEN 0 THEN '/abs/' || p_name WHEN 1 THEN 'top/../' || p_name WHEN 2 THEN 'C:/top/' || p_name WHEN 3 THEN 'top\\sub\\./' || p_name ELSE 'top/' || p_brand || '/' || p_name END"


@query("safe_paths", "SELECT p_partkey, CASE p_size % 5 WHEN 3 THEN 'sub/' || p_name WHEN 4 THEN p_brand || '/' || p_name END AS path FROM part")
def safe_paths(spark, sf):
    return table(spark, sf, "part").select("p_partkey", T.safe_path(F.expr(_NAME.replace("\\", "\\\\"))).alias("path"))


@query("remaining_work", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def remaining_work(spark, sf):
    """What a resumed run has left: customers without an order in progress."""
    done = table(spark, sf, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return S.remaining(table(spark, sf, "customer").select("c_custkey"), done, ["c_custkey"])


# --- texts and labels --------------------------------------------------------


@query("collapsed_text", r"SELECT p_partkey, trim(regexp_replace('  ' || p_name || chr(9) || chr(10) || ' ' || p_type || ' ', '\s+', ' ', 'g')) AS title FROM part")
def collapsed_text(spark, sf):
    return table(spark, sf, "part").select("p_partkey", T.collapsed(F.concat(F.lit("  "), "p_name", F.lit("\t\n "), "p_type", F.lit(" "))).alias("title"))


def inflected_sql(base: str, ending: str) -> str:
    """The regular form of a base as SQL: the spelling rules in order."""
    y = f"len({base}) > 1 AND regexp_matches({base}, '[^aeiou]y$')"
    double = f"regexp_matches({base}, '^[^aeiou]*[aeiou][bdglmnprt]$')"
    drop = f"ends_with({base}, 'e') AND NOT regexp_matches({base}, '[ey]e$')"
    if ending == "ing":
        return f"CASE WHEN ends_with({base}, 'ie') THEN {base}[:-3] || 'ying' WHEN {base} = 'singe' THEN 'singeing' WHEN {drop} THEN {base}[:-2] || 'ing' WHEN {double} THEN {base} || {base}[-1] || 'ing' ELSE {base} || 'ing' END"
    return f"CASE WHEN {drop} THEN {base} || 'd' WHEN {y} THEN {base}[:-2] || 'ied' WHEN {double} THEN {base} || {base}[-1] || 'ed' ELSE {base} || 'ed' END"


_VOCABULARY = "WITH words AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents)"


def vocabulary(spark, sf):
    return table(spark, sf, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word")).distinct()


@query("verb_forms", f"{_VOCABULARY} SELECT word, {inflected_sql('word', 'ing')} AS ing, {inflected_sql('word', 'ed')} AS ed FROM words")
def verb_forms(spark, sf):
    form = lambda ending: R.column(lambda w: R.inflected(w, ending), "string")(F.col("word")).alias(ending)
    return vocabulary(spark, sf).select("word", form("ing"), form("ed"))


def _forms_sql() -> str:
    """All words, their stems that lead back to them, their singulars."""
    parts = ["SELECT word, word AS form FROM words", "SELECT word, CASE word WHEN 'using' THEN 'use' WHEN 'used' THEN 'use' WHEN 'uses' THEN 'use' WHEN 'dying' THEN 'die' WHEN 'lying' THEN 'lie' WHEN 'tying' THEN 'tie' END FROM words"]
    for ending in ("ing", "ed"):
        stem = f"word[:-{len(ending) + 1}]"
        source = f"(SELECT word, {stem} AS stem FROM words WHERE ends_with(word, '{ending}') AND len(word) >= {len(ending) + 3})"
        for base, when in (("stem", "true"), ("stem || 'e'", "true"), ("stem[:-2] || 'y'", "ends_with(stem, 'i')"), ("stem[:-2]", "stem[-1] = stem[-2] AND regexp_matches(stem, '[b-df-hj-np-tv-z]$')")):
            parts.append(f"SELECT word, base FROM (SELECT word, {base} AS base FROM {source} WHERE {when}) WHERE {inflected_sql('base', ending)} = word")
    parts.append("SELECT word, word[:-4] || 'y' FROM words WHERE len(word) > 4 AND ends_with(word, 'ies')")
    plural = "len(word) > 3 AND ends_with(word, 's') AND NOT (len(word) > 4 AND ends_with(word, 'ies')) AND NOT regexp_matches(word, '[sui]s$')"
    parts += [f"SELECT word, word[:-2] FROM words WHERE {plural}", f"SELECT word, word[:-3] FROM words WHERE {plural} AND regexp_matches(word, '(ch|sh|ss|x|z|o)es$')"]
    return " UNION ALL ".join(parts)


@query("word_forms", f"{_VOCABULARY}, f AS ({_forms_sql()}) SELECT word, string_agg(DISTINCT form, ' ' ORDER BY form) AS forms FROM f WHERE form IS NOT NULL GROUP BY word")
def word_forms(spark, sf):
    forms = R.column(R.word_forms, "array<string>")
    return vocabulary(spark, sf).select("word", F.array_join(forms(F.col("word")), " ").alias("forms"))


_RESOURCE = "CASE p_size % 4 WHEN 0 THEN 'dataset of ' || lower(p_name) WHEN 1 THEN 'Corpus of ' || p_type WHEN 2 THEN 'the collection with ' || lower(p_type) ELSE p_name END"


@query("generic_resources", f"SELECT p_partkey, regexp_matches(c, '(?i)^(?:(?:a|an|the)\\s+)?(?:dataset|corpus|collection|set)\\s+(?:of|on|with|containing)\\b') AND c[strpos(c, ' '):] = lower(c[strpos(c, ' '):]) AS generic FROM (SELECT p_partkey, {_RESOURCE} AS c FROM part)")
def generic_resources(spark, sf):
    return table(spark, sf, "part").select("p_partkey", R.column(R.generic_resource, "boolean")(F.expr(_RESOURCE)).alias("generic"))


@query("label_numbers", "SELECT p_partkey, CASE WHEN p_size = p_partkey THEN 2 ELSE 3 END AS n, round(p_size + 1234 + CASE WHEN p_size = p_partkey THEN 0 ELSE p_partkey END + 0.5, 6) AS total FROM part WHERE p_partkey NOT IN (1234) AND p_size + 0.5 <> p_partkey")
def label_numbers(spark, sf):
    """Quantities of a label by value: thousands separators, decimals and repeats aside."""
    part = table(spark, sf, "part").filter("p_partkey <> 1234")
    label = F.concat(F.lit("gain of "), F.col("p_size").cast("string"), F.lit(".50 over 1,234 and v"), F.col("p_partkey").cast("string"), F.lit(" in "), F.when(F.col("p_size") == F.col("p_partkey"), F.lit("1234")).otherwise(F.col("p_partkey").cast("string")))
    found = part.select("p_partkey", F.transform(R.column(R.numbers, "array<string>")(label), lambda x: x.cast("double")).alias("x"))
    return found.select("p_partkey", F.size("x").alias("n"), F.round(F.aggregate("x", F.lit(0.0), lambda a, b: a + b), 6).alias("total"))


_COVER = "1.0 / (CASE p_size % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END)"


@query("phrase_coverage", "SELECT p_partkey, round(CASE p_size % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 2.0 / 3 WHEN 2 THEN 0.0 ELSE 1.0 END, 6) AS share FROM part")
def phrase_coverage(spark, sf):
    """The kept share of a source phrase: whole, with a word left out, in the wrong order, or with an example in between."""
    k = F.col("p_partkey").cast("string")
    source = F.concat(F.lit("the x"), k, F.lit(" model (e.g. small) y"), k, F.lit(" of z"), k)
    pick = lambda *words: F.concat_ws(" ", *[F.concat(F.lit(w), k) for w in words])
    concept = F.when(F.col("p_size") % 4 == 0, F.concat(F.lit("model y"), k)).when(F.col("p_size") % 4 == 1, pick("y", "z")).when(F.col("p_size") % 4 == 2, pick("z", "x")).otherwise(F.concat(F.lit("x"), k, F.lit(" models y"), k))
    return table(spark, sf, "part").select("p_partkey", F.round(R.column(R.phrase_coverage, "double")(concept, source), 6).alias("share"))


_SENTENCES = r"string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))"


@query("uncited_candidates", rf"""SELECT doc_id, count(*) FILTER (regexp_matches(s, '{X.METHOD_CUE.pattern}'))::INT AS n_method,
  count(*) FILTER (regexp_matches(s, '{X.ARTIFACT_CUE.pattern}') OR regexp_matches(s, '{X.NEGATIVE_CUE.pattern}'))::INT AS n_contribution
  FROM (SELECT doc_id, unnest({_SENTENCES}) AS s FROM (SELECT doc_id, lower(text) AS text FROM documents WHERE text IS NOT NULL)) GROUP BY doc_id""")
def uncited_candidates(spark, sf):
    """Sentences with a cue of a facet that has no item yet."""
    count = lambda facet: R.column(lambda text: str(len(X.uncited_candidates({"title": "", "abstract": text}, None)[facet])), "string")(F.lower("text")).cast("int")
    return table(spark, sf, "documents").filter("text is not null").select("doc_id", count("method").alias("n_method"), count("contribution").alias("n_contribution"))


@query("json_prefixes", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE props END AS json FROM events")
def json_prefixes(spark, sf):
    """The first JSON object of a reply that goes on, or null if there is none."""
    reply = F.when(F.col("event_id") % 3 == 0, F.lit("none")).when(F.col("event_id") % 3 == 1, F.concat("props", F.lit(" and more }"))).otherwise(F.col("props"))
    return table(spark, sf, "events").select("event_id", R.column(X.json_prefix, "string")(reply).alias("json"))


@query("repeated_concepts", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN array_to_string(regexp_extract_all(lower(p_name), '\\w+'), ' ') END AS concept FROM part")
def repeated_concepts(spark, sf):
    """The concept that a cut reply says twice in a facet."""
    second = F.when(F.col("p_size") % 2 == 0, F.upper("p_name")).otherwise(F.concat("p_name", F.lit(" two")))
    reply = F.concat(F.lit('{"task": [{"concept": "'), "p_name", F.lit('"}, {"concept": "'), second, F.lit('"}, {"conc'))
    return table(spark, sf, "part").select("p_partkey", R.column(X.repeated_concept, "string")(reply).alias("concept"))


@query("joined_evidence", f"SELECT doc_id AS paper_id, s[1] || CASE WHEN len(s) > 2 THEN ' ' || s[3] ELSE '' END AS evidence, (len(s) <= 2)::INT AS n_missing FROM (SELECT doc_id, {_SENTENCES} AS s FROM documents WHERE text IS NOT NULL)")
def joined_evidence(spark, sf):
    """Items on the first and third sentence, with both as one text; a missing one is counted."""
    docs = table(spark, sf, "documents").filter("text is not null").select(F.col("doc_id").alias("paper_id"), F.lit("t").alias("title"), F.col("text").alias("abstract"))
    items = docs.select("paper_id", F.lit("task").alias("facet"), F.lit(0).alias("index"), F.lit("c").alias("concept"), F.array(F.lit("A0"), F.lit("A2")).alias("evidence_ids"))
    return W.joined_evidence(items, X.evidence_rows(docs)).select("paper_id", "evidence", F.col("n_missing").cast("int").alias("n_missing"))


@query("training_targets", """WITH g AS (SELECT p_partkey AS paper_id, p_name, p_type, p_size FROM part)
SELECT paper_id, '{"paper_id":' || paper_id || ',"problem":[],"task":[{"concept":"' || p_name || '","evidence_id":"T0"}],"method":[' || CASE WHEN p_size > 25 THEN '{"concept":"' || p_type || '","evidence_id":"A0"},{"concept":"second","evidence_id":"A1"}' ELSE '' END || '],"dataset":[],"contribution":[]}' AS answer FROM g""")
def training_targets(spark, sf):
    part = table(spark, sf, "part")
    row = lambda facet, index, concept, cited: F.struct(F.lit(facet).alias("facet"), F.lit(index).alias("index"), concept.alias("concept"), F.lit(cited).alias("evidence_id"))
    some = F.array(row("task", 0, F.col("p_name"), "T0"), row("method", 1, F.lit("second"), "A1"), row("method", 0, F.col("p_type"), "A0"))
    gold = part.select(F.col("p_partkey").alias("paper_id"), "p_size", F.inline(some)).filter("facet = 'task' or p_size > 25").drop("p_size")
    return W.targets(gold)


# --- times, weights, facets --------------------------------------------------


@query("zoned_times", """SELECT event_id, CASE event_id % 3 WHEN 0 THEN strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%SZ') WHEN 1 THEN strftime(date_trunc('second', ts) - INTERVAL 2 HOUR, '%Y-%m-%dT%H:%M:%SZ') END AS utc FROM events""")
def zoned_times(spark, sf):
    """Times with Z, with an offset, and without a zone (null)."""
    raw = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss")
    zone = F.when(F.col("event_id") % 3 == 0, F.concat(raw, F.lit("Z"))).when(F.col("event_id") % 3 == 1, F.concat(raw, F.lit("+02:00"))).otherwise(raw)
    return table(spark, sf, "events").select("event_id", T.iso_utc(T.zoned_time(zone)).alias("utc"))


@query("normalized_weights", "SELECT s_nationkey, s_suppkey, round(w / sum(w) OVER (PARTITION BY s_nationkey), 9) AS weight FROM (SELECT s_nationkey, s_suppkey, greatest(s_acctbal, 0) AS w FROM supplier) QUALIFY sum(w) OVER (PARTITION BY s_nationkey) > 0")
def normalized_weights(spark, sf):
    rows = table(spark, sf, "supplier").select("s_nationkey", "s_suppkey", F.greatest("s_acctbal", F.lit(0.0)).alias("weight"))
    found, bad = V.normalized(rows, ["s_nationkey"])
    return found.join(bad, "s_nationkey", "left_anti").select("s_nationkey", "s_suppkey", F.round("weight", 9).alias("weight"))


@query("concept_sets", """
WITH c AS (
  SELECT p_partkey AS paper_id, f.facet, trim(regexp_replace(lower(f.concept), '[^\\p{L}\\p{M}\\p{N}_]+', ' ', 'g')) AS concept
  FROM part, unnest([{'facet': 'problem', 'concept': string_split(p_name, ' ')[1]}, {'facet': 'problem', 'concept': upper(string_split(p_name, ' ')[1])}, {'facet': 'task', 'concept': p_type || ' - ' || p_brand}, {'facet': 'dataset', 'concept': ' ! '}]) u(f)
  WHERE p_size % 11 <> 0 AND p_size % 13 <> 0)
SELECT DISTINCT paper_id, facet, concept FROM c WHERE concept <> ''""")
def concept_sets(spark, sf):
    """Parts as papers with facet lists; those whose metadata name a fallback or errors are left out as a whole."""
    part, none = table(spark, sf, "part"), F.array().cast("array<string>")
    name = F.get(F.split("p_name", " "), F.lit(0))
    facets = part.select(F.col("p_partkey").alias("paper_id"), F.array(name, F.upper(name)).alias("problem"), F.array(F.concat("p_type", F.lit(" - "), "p_brand")).alias("task"), none.alias("method"), F.array(F.lit(" ! ")).alias("dataset"), F.lit(None).cast("array<string>").alias("contribution"))
    metadata = part.select(F.col("p_partkey").alias("paper_id"), (F.col("p_size") % 11 == 0).alias("fallback_used"), F.when(F.col("p_size") % 13 == 0, F.array(F.lit("no source"))).otherwise(none).alias("validation_errors"))
    return A.concept_sets(facets, metadata, faithful=False)


@query("facet_postings", "WITH " + BASE_SQL + "SELECT DISTINCT facet, concept, paper_id FROM concepts")
def facet_postings(spark, sf):
    """The inverted index itself: every paper under each of its concepts."""
    return A.index(part_concepts(spark, sf))


@query("profile_affinity", "WITH " + BASE_SQL + """,
prof AS (SELECT DISTINCT paper_id % 7 AS user_id, facet, concept, 0.5 AS weight FROM concepts WHERE paper_id % 20 = 0),
cnt AS (SELECT paper_id, facet, count(DISTINCT concept) AS n FROM concepts GROUP BY ALL),
hit AS (SELECT user_id, c.paper_id, c.facet, sum(weight) AS w FROM (SELECT DISTINCT * FROM concepts) c JOIN prof USING (facet, concept) GROUP BY ALL)
SELECT user_id, paper_id, round(sum(0.2 * w / n), 9) AS affinity FROM hit JOIN cnt USING (paper_id, facet) GROUP BY ALL""")
def profile_affinity(spark, sf):
    concepts = part_concepts(spark, sf)
    profile = concepts.filter("paper_id % 20 = 0").select((F.col("paper_id") % 7).alias("user_id"), "facet", "concept", F.lit(0.5).alias("weight")).distinct()
    importance = profile.select("user_id").distinct().select("user_id", F.explode(F.array(*map(F.lit, A.FACETS))).alias("facet"), F.lit(0.2).alias("importance"))
    return P.affinity(profile, importance, concepts).select("user_id", "paper_id", F.round("affinity", 9).alias("affinity"))


# --- gates, splits, reviews --------------------------------------------------


@query("facet_gate", "SELECT 'trimmed' AS rule, count(*) FILTER (p_size % 5 = 0) AS n_violations FROM part UNION ALL SELECT 'present', count(*) FILTER (p_size % 3 = 0) FROM part UNION ALL SELECT 'once', count(*) FILTER (p_size % 7 = 0) FROM part")
def facet_gate(spark, sf):
    """Lists of concepts with planted faults: white space at the ends, nulls, repeats in other case."""
    part = table(spark, sf, "part")
    spaced = F.array(F.when(F.col("p_size") % 5 == 0, F.concat(F.lit(" "), "p_name")).otherwise(F.col("p_name")))
    absent = F.when(F.col("p_size") % 3 != 0, F.array("p_type"))
    twice = F.when(F.col("p_size") % 7 == 0, F.array("p_name", F.upper("p_name"))).otherwise(F.array("p_name"))
    return G.violations(part.select(spaced.alias("a"), absent.alias("b"), twice.alias("c")), trimmed=G.concept_list("a"), present=G.concept_list("b"), once=G.concept_list("c"))


@query("pool_gate", "SELECT count(DISTINCT l_orderkey) FILTER (n <> 4) AS n_other_size, count(DISTINCT l_orderkey) FILTER (n <> d) AS n_repeating FROM (SELECT l_orderkey, count(*) AS n, count(DISTINCT l_suppkey) AS d FROM lineitem GROUP BY l_orderkey)")
def pool_gate(spark, sf):
    """Orders as pools of suppliers: how many have another size than four or hold one twice."""
    pools = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("case_id"), F.col("l_suppkey").alias("paper_id"))
    size, twice = G.bad_pools(pools, 4)
    return size.agg(F.count("*").alias("n_other_size")).crossJoin(twice.agg(F.count_distinct("case_id").alias("n_repeating")))


@query("log_gate", "WITH " + BASE_SQL + """
SELECT 'parent' AS rule, count(*) AS n_violations FROM reactions r LEFT JOIN reactions p ON p.event_id = r.event_id - 1 WHERE r.event_id % 2 = 0 AND (p.event_id IS NULL OR p.user_id <> r.user_id OR p.ts >= r.ts)
UNION ALL SELECT 'kind', count(*) FILTER (interaction_type NOT IN ('dislike', 'view', 'click', 'save', 'like')) FROM reactions""")
def log_gate(spark, sf):
    """Events as a log in which every second event names the one before it as its parent."""
    rows = reactions(spark, sf).withColumn("parent_id", F.when(F.col("event_id") % 2 == 0, F.col("event_id") - 1))
    parents = G.bad_parents(rows, "event_id", "parent_id", ["user_id"]).agg(F.lit("parent").alias("rule"), F.count("*").alias("n_violations"))
    return parents.unionByName(G.violations(rows, kind=F.col("interaction_type").isin(*P.BEHAVIORS)))


@query("shown_candidates", "WITH " + BASE_SQL + "SELECT user_id AS case_id, paper_id FROM pool WHERE (user_id, paper_id) NOT IN (SELECT (user_id, paper_id) FROM seen)")
def shown_candidates(spark, sf):
    """Candidates that were not shown before: an anti join with the history."""
    from facetlake.queries.base import CUTOFF, timed_cases

    _, cases = timed_cases(spark, sf)
    seen = reactions(spark, sf).filter(F.col("ts") < F.to_timestamp(F.lit(CUTOFF))).select(F.col("user_id").alias("case_id"), "paper_id")
    return S.remaining(cases.select("case_id", "paper_id"), seen, ["case_id", "paper_id"])


@query("merged_groups", "SELECT s_suppkey AS paper_id, s_nationkey % 3 AS grp FROM supplier")
def merged_groups(spark, sf):
    """Three reviewed groups, apart from each other and together all suppliers."""
    rows = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("paper_id"), (F.col("s_nationkey") % 3).alias("grp"))
    return W.merged_groups([rows.filter(F.col("grp") == g) for g in range(3)], rows)


@query("split_report", "WITH " + BASE_SQL + """, c AS (SELECT paper_id % 3 AS split, facet, paper_id, count(*) AS n FROM concepts GROUP BY ALL)
SELECT split, facet, count(*) AS n_present, count(*) FILTER (n > 1) AS n_multiple, sum(n)::BIGINT AS n_concepts FROM c GROUP BY ALL""")
def split_report(spark, sf):
    concepts = part_concepts(spark, sf)
    return W.split_report(concepts, concepts.select("paper_id", (F.col("paper_id") % 3).alias("split")).distinct())


@query("stratum_features", "WITH " + BASE_SQL + """, m AS (SELECT paper_id, facet, count(*) AS n FROM concepts GROUP BY ALL), x AS (SELECT paper_id, 'has_' || facet AS f FROM m UNION ALL SELECT paper_id, 'many_' || facet FROM m WHERE n > 1
UNION ALL SELECT p_partkey, 'length_' || ((length(p_name) > 12)::INT + (length(p_name) > 16)::INT) FROM part UNION ALL SELECT p_partkey, 'origin_' || p_brand FROM part)
SELECT paper_id, string_agg(f, ' ' ORDER BY f) AS features FROM x GROUP BY paper_id""")
def stratum_features(spark, sf):
    lengths = table(spark, sf, "part").select(F.col("p_partkey").alias("paper_id"), F.length("p_name").alias("n_chars"), F.col("p_brand").alias("origin"))
    return W.features(part_concepts(spark, sf), lengths, (12, 16)).select("paper_id", F.array_join("features", " ").alias("features"))


@query("eligible_examples", """SELECT min(p_partkey) AS paper_id, lower(p_name) AS name, lower(p_type) AS type FROM part WHERE p_partkey <> 1 AND p_partkey % 10 <> 0
  AND (lower(p_name), lower(p_type)) NOT IN (SELECT (lower(p_name), lower(p_type)) FROM part WHERE p_partkey % 10 = 0) GROUP BY ALL""")
def eligible_examples(spark, sf):
    """Training examples that are not held out by id or text, one a text."""
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("paper_id"), F.col("p_name").alias("title"), F.col("p_type").alias("abstract"))
    found = W.eligible(rows, rows.filter("paper_id % 10 = 0"), development="1")
    return found.select("paper_id", F.lower("title").alias("name"), F.lower("abstract").alias("type"))


@query("newest_valid_review", "WITH t AS (SELECT l_orderkey AS paper_id, l_linenumber AS attempt, l_linestatus = 'O' AND l_quantity > 25 AS good FROM lineitem QUALIFY count(*) OVER (PARTITION BY l_orderkey, l_linenumber) = 1) SELECT paper_id, max(attempt) AS attempt FROM t WHERE good GROUP BY paper_id")
def newest_valid_review(spark, sf):
    """The last valid review of each paper that has one."""
    once = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").count().filter("count = 1").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"))
    lines = table(spark, sf, "lineitem")
    rows = lines.join(once, (F.col("l_orderkey") == F.col("k")) & (F.col("l_linenumber") == F.col("n")), "left_semi")
    tries = rows.select(F.col("l_orderkey").alias("paper_id"), F.col("l_linenumber").alias("attempt"), F.when(F.col("l_linestatus") == "O", "review").otherwise("extract").alias("stage"), (F.col("l_quantity") > 25).alias("valid"), F.col("l_quantity").alias("score"), F.lit(True).alias("parseable"), F.array().cast("array<string>").alias("errors"), F.lit(1).alias("n_items"))
    return W.newest_valid(tries).filter("stage = 'review' and valid").select("paper_id", "attempt")


@query("compliance_at_k", "SELECT c_nationkey AS case_id, avg((c_custkey % 3 = 2)::INT) AS compliance_5 FROM (SELECT c_nationkey, c_custkey FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) <= 5) GROUP BY c_nationkey")
def compliance_at_k(spark, sf):
    from facetlake.functions import metrics as M

    rows = table(spark, sf, "customer").select(F.col("c_nationkey").alias("case_id"), F.lit("m").alias("model"), F.col("c_custkey").alias("paper_id"), (-F.col("c_custkey")).cast("double").alias("score"), (F.col("c_custkey") % 3).alias("grade"))
    return D.compliance(M.ranked(rows, ["case_id", "model"]), 5).select("case_id", "compliance_5")


@query("adapted_records", r"""SELECT 'parts' AS source, p_partkey::VARCHAR AS source_id, p_name AS title, p_type || ' ' || p_brand AS abstract, CASE WHEN p_size > 25 THEN 1980 + p_size END AS year, '10.1/' || lower(p_brand) AS doi FROM part""")
def adapted_records(spark, sf):
    """Parts as source records: sentences joined, years in range, DOIs without their resolver."""
    rows = table(spark, sf, "part").select("p_partkey", F.concat(F.lit(" "), "p_name").alias("name"), F.array("p_type", "p_brand").alias("body"), F.create_map(F.lit("year"), F.when(F.col("p_size") > 25, (F.col("p_size") + 1980).cast("string")).otherwise("n.d."), F.lit("doi"), F.concat(F.lit("https://doi.org/10.1/"), "p_brand")).alias("meta"))
    found = C.adapt(rows, "parts", source_id="p_partkey", title="name", abstract="body", metadata="meta")
    return found.select("source", "source_id", "title", "abstract", "year", F.try_element_at("identifiers", F.lit("doi")).alias("doi"))


@query("scope_overrides", "SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN p_partkey % 8 = 0 ELSE p_size > 25 END AS included, CASE WHEN p_partkey % 4 = 0 THEN 'manual_override' ELSE 'rule' END AS reason FROM part")
def scope_overrides(spark, sf):
    part = table(spark, sf, "part")
    classified = part.select("p_partkey", F.lit("parts").alias("source"), F.col("p_partkey").cast("string").alias("source_id"), (F.col("p_size") > 25).alias("included"), F.lit("rule").alias("reason"))
    decided = part.filter("p_partkey % 4 = 0").select(F.lit("parts").alias("source"), F.col("p_partkey").cast("string").alias("source_id"), (F.col("p_partkey") % 8 == 0).alias("include"), F.lit("r").alias("reviewer"), F.lit("why").alias("review_reason"))
    return C.override(classified, decided).select("p_partkey", "included", "reason")


@query("repair_packets", """WITH t AS (SELECT l_orderkey AS paper_id, max(round(l_tax * 100))::INT AS n FROM lineitem GROUP BY ALL)
SELECT paper_id, n AS n_items, 1 AS n_global, coalesce(n * (n - 1) // 2, 0)::INT AS total_index, 2 * n AS n_errors FROM t""")
def repair_packets(spark, sf):
    """A packet a paper: its flagged items with two errors each, and one global error."""
    papers = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("paper_id")).agg(F.max(F.round(F.col("l_tax") * 100)).cast("int").alias("n"))
    places = F.filter(F.sequence(F.lit(0), F.col("n")), lambda i: i < F.col("n"))
    errors = papers.select("paper_id", F.concat(F.array(F.lit("coverage: x")), F.flatten(F.transform(places, lambda i: F.array(F.concat(F.lit("task["), i.cast("string"), F.lit("]: bad")), F.concat(F.lit("task["), i.cast("string"), F.lit("]: worse")))))).alias("errors"))
    items = papers.select("paper_id", F.lit("task").alias("facet"), F.explode(F.sequence(F.lit(0), F.col("n"))).alias("index"), F.lit("c").alias("concept"), F.lit("T0").alias("evidence_id"))
    evidence = papers.select("paper_id", F.lit("T0").alias("evidence_id"), F.lit("title").alias("source"), F.lit("c").alias("evidence"))
    found = X.repair_packet(errors, items, evidence)
    add = lambda f: F.aggregate("items", F.lit(0), lambda a, x: a + f(x))
    return found.select("paper_id", F.size("items").alias("n_items"), F.size("global_errors").alias("n_global"), add(lambda x: x["index"]).alias("total_index"), add(lambda x: F.size(x["errors"])).alias("n_errors"))


@query("saved_selection_gate", """WITH t AS (SELECT l_orderkey AS paper_id, l_linenumber * 1000000 + l_partkey AS attempt, l_quantity AS score, l_returnflag <> 'R' AS parseable, round(l_tax * 100)::INT AS n_errors FROM lineitem),
b AS (SELECT paper_id, min(score) AS score FROM (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY paper_id ORDER BY score DESC, parseable DESC, n_errors, attempt) = 1) GROUP BY paper_id)
SELECT 'no saved result' AS rule, count(*) AS n FROM b WHERE paper_id % 5 = 0 UNION ALL SELECT 'another score', count(*) FROM b WHERE paper_id % 5 <> 0 AND paper_id % 2 = 0""")
def saved_selection_gate(spark, sf):
    """Saved selections held against the attempts: some are missing, some have another score."""
    tries = attempts(spark, sf)
    best = X.best_attempt(tries).select("paper_id", "attempt", "score")
    saved = best.filter("paper_id % 5 <> 0").withColumn("score", F.when(F.col("paper_id") % 2 == 0, F.col("score") + 1).otherwise(F.col("score")))
    return X.saved_violations(saved, tries).groupBy("rule").agg(F.count("*").alias("n"))


@query("evaluation_report", "WITH " + BASE_SQL + """,
g AS (SELECT DISTINCT paper_id, facet, concept FROM concepts), p AS (SELECT paper_id, facet, CASE WHEN facet = 'method' AND paper_id % 3 = 0 THEN 'other' ELSE concept END AS concept FROM g WHERE NOT (facet = 'task' AND paper_id % 4 = 0)),
b AS (SELECT coalesce(g.facet, p.facet) AS facet, g.paper_id IS NOT NULL AS in_g, p.paper_id IS NOT NULL AS in_p FROM g FULL JOIN p ON g.paper_id = p.paper_id AND g.facet = p.facet AND g.concept = p.concept),
f AS (SELECT facet, count(*) FILTER (in_g AND in_p) AS tp, count(*) FILTER (NOT in_g) AS fp, count(*) FILTER (NOT in_p) AS fn FROM b GROUP BY ALL),
m AS (SELECT * FROM f UNION ALL SELECT 'micro', sum(tp)::BIGINT, sum(fp)::BIGINT, sum(fn)::BIGINT FROM f),
s AS (SELECT *, tp / nullif(tp + fp, 0) AS "precision", tp / nullif(tp + fn, 0) AS recall, 2 * tp / nullif(2 * tp + fp + fn, 0) AS f1 FROM m)
SELECT facet, tp, fp, fn, round("precision", 6) AS "precision", round(recall, 6) AS recall, round(f1, 6) AS f1 FROM s UNION ALL SELECT 'macro', NULL, NULL, NULL, NULL, NULL, round(avg(f1), 6) FROM s WHERE facet <> 'micro'""")
def evaluation_report(spark, sf):
    """The evaluation of one set of predictions: per facet, micro and macro."""
    gold, _ = gold_and_predicted(spark, sf)
    gold = gold.distinct()
    changed = F.when((F.col("facet") == "method") & (F.col("paper_id") % 3 == 0), "other").otherwise(F.col("key"))
    predicted = gold.filter("not (facet = 'task' and paper_id % 4 = 0)").withColumn("key", changed)
    report = J.evaluate(gold, predicted)
    return report.select("facet", "tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query("compact_history", "WITH " + BASE_SQL + "SELECT user_id, count(*) AS n_events, count(*) FILTER (w > 0) AS n_positive, min(ts) AS first_ts, max(ts) AS last_ts FROM reactions GROUP BY user_id")
def compact_history(spark, sf):
    """Users with their event counts and time range, as a loader checks them."""
    return P.user_table(reactions(spark, sf))


_EXPERIMENT_SQL = """
base AS (SELECT event_id, user_id, date_trunc('day', ts) AS day, (props->>'k')::BIGINT AS k, ts FROM events WHERE event_type <> 'error'),
searches AS (
  SELECT event_id AS query_id, user_id, day AS session_id, ts, CASE WHEN event_id % 50 = 0 THEN event_id + 1 ELSE lag(event_id) OVER (PARTITION BY user_id, day ORDER BY ts, event_id) END AS parent FROM base
  UNION ALL SELECT event_id, user_id, day, ts, NULL FROM base WHERE event_id % 90 = 6),
exposures AS (
  SELECT event_id AS exposure_id, user_id + (event_id % 45 = 3)::INT AS user_id, day AS session_id, event_id AS query_id, CASE WHEN event_id % 40 = 1 THEN [k, k] WHEN event_id % 55 = 8 THEN [k] ELSE [k, k + 1] END AS paper_ids,
    CASE WHEN event_id % 60 = 7 THEN ts - INTERVAL 1 SECOND ELSE ts + INTERVAL 1 SECOND END AS ts FROM base),
interactions AS (
  SELECT user_id, CASE WHEN event_id % 30 = 4 THEN k + 9 ELSE k END AS paper_id, CASE WHEN event_id % 70 = 5 THEN 'bought' ELSE 'click' END AS kind, day AS session_id,
    CASE WHEN event_id % 35 = 2 THEN -event_id ELSE event_id END AS exposure_id, ts + INTERVAL 2 SECOND AS ts FROM base),
cases AS (SELECT o_custkey AS case_id, o_custkey % 100 AS query_paper_id, o_orderkey % 100 AS paper_id FROM orders),
splits AS (
  SELECT c_custkey AS case_id, c_custkey % 100 AS query_paper_id, CASE WHEN c_custkey % 77 = 0 THEN 'spare' WHEN c_custkey < 100 AND c_custkey % 4 = 0 THEN 'test' ELSE 'train' END AS split FROM customer WHERE c_custkey % 31 <> 0
  UNION ALL SELECT c_custkey, c_custkey % 100, 'train' FROM customer WHERE c_custkey % 83 = 0)
"""


def experiment_tables(spark, sf):
    """Events as an experiment's logs, orders as its pools, customers as its splits, with faults of each rule planted."""
    n, k, ts = F.col("event_id"), F.col("k"), F.col("ts")
    base = table(spark, sf, "events").filter("event_type <> 'error'").select("event_id", "user_id", F.date_trunc("day", "ts").alias("session_id"), F.get_json_object("props", "$.k").cast("bigint").alias("k"), F.col("ts").cast("timestamp").alias("ts"))
    second = lambda i: ts + F.make_dt_interval(secs=F.lit(i))
    parent = F.when(n % 50 == 0, n + 1).otherwise(F.lag("event_id").over(Window.partitionBy("user_id", "session_id").orderBy("ts", "event_id")))
    searches = base.select(n.alias("query_id"), "user_id", "session_id", "ts", parent.alias("parent_query_id"))
    searches = searches.unionByName(base.filter(n % 90 == 6).select(n.alias("query_id"), "user_id", "session_id", "ts", F.lit(None).cast("bigint").alias("parent_query_id")))
    papers = F.when(n % 40 == 1, F.array("k", "k")).when(n % 55 == 8, F.array("k")).otherwise(F.array(k, k + 1))
    exposures = base.select(n.alias("exposure_id"), (F.col("user_id") + (n % 45 == 3).cast("int")).alias("user_id"), "session_id", n.alias("query_id"), papers.alias("paper_ids"), F.when(n % 60 == 7, second(-1)).otherwise(second(1)).alias("ts"))
    interactions = base.select("user_id", F.when(n % 30 == 4, k + 9).otherwise(k).alias("paper_id"), F.when(n % 70 == 5, "bought").otherwise("click").alias("interaction_type"), "session_id", F.when(n % 35 == 2, -n).otherwise(n).alias("exposure_id"), second(2).alias("ts"))
    cases = table(spark, sf, "orders").select(F.col("o_custkey").alias("case_id"), (F.col("o_custkey") % 100).alias("query_paper_id"), (F.col("o_orderkey") % 100).alias("paper_id"))
    c = F.col("c_custkey")
    customers = table(spark, sf, "customer")
    side = F.when(c % 77 == 0, "spare").when((c < 100) & (c % 4 == 0), "test").otherwise("train")
    splits = customers.filter(c % 31 != 0).select(c.alias("case_id"), (c % 100).alias("query_paper_id"), side.alias("split")).unionByName(customers.filter(c % 83 == 0).select(c.alias("case_id"), (c % 100).alias("query_paper_id"), F.lit("train").alias("split")))
    return searches, exposures, interactions, cases, splits


@query("experiment_violations", "WITH " + _EXPERIMENT_SQL + """,
q AS (SELECT query_id, count(*) AS n, min(user_id) AS u, min(session_id) AS s, min(ts) AS t FROM searches GROUP BY query_id),
x AS (SELECT * FROM exposures),
i AS (SELECT *, lag(ts) OVER (PARTITION BY user_id, session_id ORDER BY ts, exposure_id, paper_id) AS before FROM interactions),
ix AS (SELECT i.*, x.exposure_id IS NULL AS lost, x.user_id = i.user_id AND x.session_id = i.session_id AND x.ts < i.ts AS after, list_contains(x.paper_ids, i.paper_id) AS shown FROM i LEFT JOIN x ON x.exposure_id = i.exposure_id),
pool AS (SELECT case_id, paper_id, count(*) AS n, max((paper_id = query_paper_id)::INT) AS own FROM cases GROUP BY ALL),
sp AS (SELECT case_id, count(*) AS n, bool_and(split IN ('train', 'dev', 'test')) AS known FROM splits GROUP BY case_id),
sc AS (SELECT sp.*, coalesce(sp.case_id, c.case_id) AS id, c.case_id IS NOT NULL AS pooled FROM sp FULL JOIN (SELECT DISTINCT case_id FROM cases) c ON sp.case_id = c.case_id)
SELECT 'searches' AS name, 'repeated_id' AS rule, query_id::VARCHAR AS key FROM q WHERE n > 1
UNION ALL SELECT 'searches', 'bad_parent', s.query_id::VARCHAR FROM searches s LEFT JOIN q ON q.query_id = s.parent WHERE s.parent IS NOT NULL AND NOT coalesce(q.u = s.user_id AND q.s = s.session_id AND q.t < s.ts, false)
UNION ALL SELECT 'exposures', 'wrong_search', exposure_id::VARCHAR FROM x LEFT JOIN q USING (query_id) WHERE NOT coalesce(q.u = x.user_id AND q.s = x.session_id AND q.t < x.ts, false)
UNION ALL SELECT 'exposures', 'repeated_paper', exposure_id::VARCHAR FROM x WHERE len(list_distinct(paper_ids)) <> len(paper_ids)
UNION ALL SELECT 'exposures', 'size', exposure_id::VARCHAR FROM x WHERE len(paper_ids) <> 2
UNION ALL SELECT 'interactions', 'wrong_exposure', exposure_id || ':' || paper_id FROM ix WHERE NOT coalesce(after, false)
UNION ALL SELECT 'interactions', 'not_shown', exposure_id || ':' || paper_id FROM ix WHERE NOT lost AND NOT shown
UNION ALL SELECT 'interactions', 'kind', exposure_id || ':' || paper_id FROM ix WHERE kind = 'bought'
UNION ALL SELECT 'interactions', 'not_rising', exposure_id || ':' || paper_id FROM ix WHERE before >= ts
UNION ALL SELECT 'cases', 'repeated_paper', case_id || ':' || paper_id FROM pool WHERE n > 1
UNION ALL SELECT 'cases', 'own_query', case_id || ':' || paper_id FROM pool WHERE own = 1
UNION ALL SELECT 'cases', 'size', case_id::VARCHAR FROM pool GROUP BY case_id HAVING sum(n) <> 10
UNION ALL SELECT 'splits', 'uncovered', id::VARCHAR FROM sc WHERE n IS NULL
UNION ALL SELECT 'splits', 'unknown_case', id::VARCHAR FROM sc WHERE NOT pooled
UNION ALL SELECT 'splits', 'repeated_case', id::VARCHAR FROM sc WHERE n > 1
UNION ALL SELECT 'splits', 'side', id::VARCHAR FROM sc WHERE NOT known
UNION ALL SELECT 'splits', 'leaking_anchor', query_paper_id::VARCHAR FROM splits GROUP BY query_paper_id HAVING min(split) <> max(split)""")
def experiment_violations(spark, sf):
    """Every broken rule of a whole experiment, from its tables with planted faults."""
    return E.experiment_violations(*experiment_tables(spark, sf), shown=2, pool=10)


_LINEAGE_SQL = """
orders_in_turn AS (SELECT *, lag(o_orderkey) OVER w AS before, lag(o_totalprice) OVER w AS price_before, first_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS newest FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
records AS (
  SELECT o_orderkey AS id, CASE WHEN o_orderkey % 97 = 0 THEN -o_orderkey WHEN before IS NULL AND o_custkey % 53 = 0 THEN newest ELSE before END AS parent_id,
    md5(o_orderkey || ':' || round(o_totalprice)::BIGINT) AS digest, md5(before || ':' || (round(price_before)::BIGINT + (o_orderkey % 61 = 0)::INT)) AS parent_digest, o_orderpriority AS actor FROM orders_in_turn),
tied AS (SELECT r.*, p.id AS p_id, p.digest AS p_digest, p.actor AS p_actor FROM records r LEFT JOIN records p ON r.parent_id = p.id),
down AS (SELECT id, id AS root, 0::BIGINT AS depth FROM tied WHERE p_id IS NULL UNION ALL SELECT t.id, d.root, d.depth + 1 FROM down d JOIN tied t ON t.p_id = d.id)
"""


def order_records(spark, sf):
    """Orders as records made from the customer's order before, with broken links planted."""
    turn = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    key, before = F.col("o_orderkey"), F.lag("o_orderkey").over(turn)
    newest = F.first("o_orderkey").over(Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")))
    sign = lambda k, price, more: F.md5(F.concat_ws(":", k, F.round(price).cast("bigint") + more))
    seen = F.when(before.isNotNull(), sign(before, F.lag("o_totalprice").over(turn), (key % 61 == 0).cast("int")))
    parent = F.when(key % 97 == 0, -key).when(before.isNull() & (F.col("o_custkey") % 53 == 0), newest).otherwise(before)
    return table(spark, sf, "orders").select(key.alias("id"), parent.alias("parent_id"), sign(key, F.col("o_totalprice"), F.lit(0)).alias("digest"), seen.alias("parent_digest"), F.col("o_orderpriority").alias("actor"))


@query("lineage_chains", "WITH RECURSIVE " + _LINEAGE_SQL + "SELECT r.id, d.root, d.depth FROM records r LEFT JOIN down d USING (id)")
def lineage_chains(spark, sf):
    return L.chains(order_records(spark, sf))


@query("lineage_violations", "WITH RECURSIVE " + _LINEAGE_SQL + """
SELECT 'lineage' AS name, 'missing_parent' AS rule, id::VARCHAR AS key FROM tied WHERE parent_id IS NOT NULL AND p_id IS NULL
UNION ALL SELECT 'lineage', 'changed_parent', id::VARCHAR FROM tied WHERE p_id IS NOT NULL AND parent_digest IS DISTINCT FROM p_digest
UNION ALL SELECT 'lineage', 'own_review', id::VARCHAR FROM tied WHERE p_id IS NOT NULL AND actor = p_actor
UNION ALL SELECT 'lineage', 'circle', id::VARCHAR FROM records WHERE id NOT IN (SELECT id FROM down)""")
def lineage_violations(spark, sf):
    return L.lineage_violations(order_records(spark, sf))


# --- exports -----------------------------------------------------------------


@query("export_coverage", "WITH " + BASE_SQL + """, f AS (SELECT facet, count(DISTINCT paper_id) AS n FROM concepts WHERE concept <> '' GROUP BY facet), t AS (SELECT count(DISTINCT paper_id) AS n FROM concepts)
SELECT f.facet, f.n AS n_covered, f.n AS n_read, t.n AS n_records FROM f, t""")
def export_coverage(spark, sf):
    """Papers with their facets, exported in two runs; coverage as the manifest says and as the files hold it."""
    concepts = part_concepts(spark, sf).filter("concept <> ''")
    wide = concepts.groupBy("paper_id").pivot("facet", list(A.FACETS)).agg(F.sort_array(F.collect_set("concept")))
    out, how = new_dir(spark, "export"), {"batches": 12, "signature": "facets"}
    cover = {f: F.size(f) > 0 for f in A.FACETS}
    O.export(wide, out, "paper_id", **how, coverage=cover, wave=4, waves=1)
    said = O.export(wide, out, "paper_id", **how, coverage=cover, wave=4)
    told = F.explode(F.array(*[F.struct(F.lit(f).alias("facet"), F.lit(n).cast("bigint").alias("n_covered"), F.col(f).alias("concepts")) for f, n in said["coverage"].items()]))
    rows = O.exported(spark, wide, out).select("paper_id", told.alias("x")).select("paper_id", "x.*")
    return rows.groupBy("facet", "n_covered").agg(F.count_if(F.size("concepts") > 0).alias("n_read"), F.count("*").alias("n_records"))
