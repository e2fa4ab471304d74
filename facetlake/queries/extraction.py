"""Extraction-quality queries: label matches, attempts, repairs, review queues."""

from __future__ import annotations

from pyspark.sql import functions as F

from facetlake.functions import metrics as M
from facetlake.functions import rules as R
from facetlake.operators import extraction as X
from facetlake.operators import matching as J
from facetlake.queries.base import BASE_SQL, part_concepts, table
from facetlake.storage import numbered

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def gold_and_predicted(spark, sf):
    """A part's concepts as the reference, and those of the next part as the prediction."""
    gold = part_concepts(spark, sf).select("paper_id", "facet", F.col("concept").alias("key"))
    return gold, gold.withColumn("paper_id", F.col("paper_id") - 1)


_COUNTS = "WITH " + BASE_SQL + """,
g AS (SELECT DISTINCT paper_id, facet, concept FROM concepts), p AS (SELECT paper_id - 1 AS paper_id, facet, concept FROM g),
b AS (SELECT coalesce(g.paper_id, p.paper_id) AS paper_id, coalesce(g.facet, p.facet) AS facet, g.paper_id IS NOT NULL AS in_g, p.paper_id IS NOT NULL AS in_p FROM g FULL JOIN p ON g.paper_id = p.paper_id AND g.facet = p.facet AND g.concept = p.concept),
c AS (SELECT paper_id, facet, count(*) FILTER (in_g AND in_p) AS tp, count(*) FILTER (NOT in_g) AS fp, count(*) FILTER (NOT in_p) AS fn FROM b GROUP BY ALL)
"""


@query("exact_label_counts", _COUNTS + "SELECT * FROM c")
def exact_label_counts(spark, sf):
    return J.exact_counts(*gold_and_predicted(spark, sf))


@query("exact_label_prf", _COUNTS + """,
f AS (SELECT facet, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM c GROUP BY facet), m AS (SELECT * FROM f UNION ALL SELECT 'micro', sum(tp)::BIGINT, sum(fp)::BIGINT, sum(fn)::BIGINT FROM f),
s AS (SELECT *, tp / nullif(tp + fp, 0) AS "precision", tp / nullif(tp + fn, 0) AS recall, 2 * tp / nullif(2 * tp + fp + fn, 0) AS f1 FROM m)
SELECT facet, tp, fp, fn, round("precision", 6) AS "precision", round(recall, 6) AS recall, round(f1, 6) AS f1 FROM s UNION ALL SELECT 'macro', NULL, NULL, NULL, NULL, NULL, round(avg(f1), 6) FROM s WHERE facet <> 'micro'""")
def exact_label_prf(spark, sf):
    found = M.prf_by_facet(exact_label_counts(spark, sf))
    return found.select("facet", "tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query("label_differences", _COUNTS + "SELECT g.facet, g.concept, count(*) AS n_missed FROM g ANTI JOIN p ON g.paper_id = p.paper_id AND g.facet = p.facet AND g.concept = p.concept GROUP BY ALL")
def label_differences(spark, sf):
    gold, predicted = gold_and_predicted(spark, sf)
    return gold.distinct().join(predicted, ["paper_id", "facet", "key"], "left_anti").groupBy("facet", F.col("key").alias("concept")).agg(F.count("*").alias("n_missed"))


@query("compare_arms", _COUNTS + """,
a AS (SELECT 'next' AS arm, paper_id, facet, concept FROM p UNION SELECT 'after', paper_id - 2, facet, concept FROM g),
h AS (SELECT arm, count(*) FILTER (g.paper_id IS NOT NULL) AS tp, count(*) FILTER (g.paper_id IS NULL) AS fp FROM a LEFT JOIN g USING (paper_id, facet, concept) GROUP BY arm)
SELECT arm, tp, fp, (SELECT count(*) FROM g) - tp AS fn, round(tp / (tp + fp), 6) AS "precision", round(tp / (SELECT count(*) FROM g), 6) AS recall, round(2 * tp / (tp + fp + (SELECT count(*) FROM g)), 6) AS f1 FROM h""")
def compare_arms(spark, sf):
    gold, predicted = gold_and_predicted(spark, sf)
    both = predicted.withColumn("arm", F.lit("next")).unionByName(predicted.withColumn("paper_id", F.col("paper_id") - 1).withColumn("arm", F.lit("after")))
    found = J.compare_arms(both, gold)
    return found.select("arm", "tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


def attempts(spark, sf):
    """Order lines as attempts: quantity scores, returned ones can't be read, tax counts errors, open ones are reviews."""
    errors = F.transform(F.array_repeat(F.lit("task"), F.round(F.col("l_tax") * 100).cast("int")), lambda f, i: F.concat(f, F.lit("["), i.cast("string"), F.lit("]: bad")))
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("paper_id"), (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("attempt"), F.when(F.col("l_linestatus") == "O", "review").otherwise("extract").alias("stage"), F.col("l_quantity").alias("score"), (F.col("l_returnflag") != "R").alias("parseable"), (F.col("l_returnflag") == "A").alias("schema_valid"), errors.alias("errors"), F.col("l_extendedprice").alias("seconds"))


_ATTEMPTS = "WITH t AS (SELECT l_orderkey AS paper_id, l_linenumber * 1000000 + l_partkey AS attempt, l_linestatus = 'O' AS review, l_quantity AS score, l_returnflag <> 'R' AS parseable, l_returnflag = 'A' AS schema_valid, round(l_tax * 100)::INT AS n_errors, l_extendedprice AS seconds, l_quantity > 25 AS valid FROM lineitem) "


@query("attempt_select_best", _ATTEMPTS + "SELECT paper_id, min(score) AS score, min(n_errors) AS n_errors FROM (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY paper_id ORDER BY score DESC, parseable DESC, n_errors, attempt) = 1) GROUP BY paper_id")
def attempt_select_best(spark, sf):
    return X.best_attempt(attempts(spark, sf)).select("paper_id", "score", F.size("errors").alias("n_errors"))


@query("attempt_select_review", _ATTEMPTS + "SELECT paper_id, score, n_errors, review FROM t QUALIFY row_number() OVER (PARTITION BY paper_id ORDER BY score DESC, parseable DESC, n_errors, review DESC, attempt DESC) = 1")
def attempt_select_review(spark, sf):
    return X.best_attempt(attempts(spark, sf), prompt="3.7").select("paper_id", "score", F.size("errors").alias("n_errors"), (F.col("stage") == "review").alias("review"))


@query("attempt_select_schema", _ATTEMPTS + "SELECT paper_id, schema_valid, score, review FROM t QUALIFY row_number() OVER (PARTITION BY paper_id ORDER BY schema_valid DESC, parseable DESC, score DESC, review DESC, attempt DESC) = 1")
def attempt_select_schema(spark, sf):
    return X.best_attempt(attempts(spark, sf), policy="3.2").select("paper_id", "schema_valid", "score", (F.col("stage") == "review").alias("review"))


@query("patch_select_best", _ATTEMPTS + "SELECT paper_id, valid, score, n_errors FROM t QUALIFY row_number() OVER (PARTITION BY paper_id ORDER BY valid DESC, schema_valid DESC, score DESC, n_errors, attempt) = 1")
def patch_select_best(spark, sf):
    return X.best_patch(attempts(spark, sf).withColumn("valid", F.col("score") > 25)).select("paper_id", "valid", "score", F.size("errors").alias("n_errors"))


@query("flagged_items", _ATTEMPTS + 'SELECT DISTINCT paper_id, \'task\' AS facet, i::INT AS "index" FROM (SELECT paper_id, unnest(range(0, n_errors)) AS i FROM t)')
def flagged_items(spark, sf):
    return X.flagged_items(attempts(spark, sf))


@query("attempt_usage", _ATTEMPTS + "SELECT review, count(*) AS n, round(sum(seconds), 2) AS seconds, round(avg(seconds), 4) AS mean_seconds, round(median(seconds), 4) AS median_seconds FROM t GROUP BY review")
def attempt_usage(spark, sf):
    rows = attempts(spark, sf).groupBy((F.col("stage") == "review").alias("review"))
    return rows.agg(F.count("*").alias("n"), F.round(F.sum("seconds"), 2).alias("seconds"), F.round(F.avg("seconds"), 4).alias("mean_seconds"), F.round(F.median("seconds"), 4).alias("median_seconds"))


@query("repair_transitions", _ATTEMPTS + """, d AS (SELECT paper_id, bool_or(valid) AS draft_valid FROM t WHERE NOT review GROUP BY ALL), f AS (SELECT paper_id, bool_or(valid) AS final_valid FROM t WHERE review GROUP BY ALL)
SELECT draft_valid, final_valid, count(*) AS n FROM d JOIN f USING (paper_id) GROUP BY ALL""")
def repair_transitions(spark, sf):
    rows = attempts(spark, sf)
    side = lambda s: rows.filter(F.col("stage") == s).groupBy("paper_id").agg(F.bool_or(F.col("score") > 25).alias("valid"))
    return X.repair_transitions(side("extract"), side("review"))


@query("choose_checkpoint", "SELECT s_nationkey, s_suppkey FROM supplier QUALIFY row_number() OVER (PARTITION BY s_nationkey ORDER BY round(s_acctbal / 1000) DESC, round(s_acctbal / 10) DESC, s_suppkey) = 1")
def choose_checkpoint(spark, sf):
    rows = table(spark, sf, "supplier").select("s_nationkey", "s_suppkey", F.round(F.col("s_acctbal") / 1000).alias("f1"), F.round(F.col("s_acctbal") / 10).alias("recall"), F.col("s_suppkey").alias("epoch"))
    return X.best_checkpoint(rows, ["s_nationkey"]).select("s_nationkey", "s_suppkey")


@query("review_queue", "WITH " + BASE_SQL + "SELECT paper_id, n_facets, n_concepts, rank FROM (SELECT paper_id, count(DISTINCT facet) AS n_facets, count(*) AS n_concepts, row_number() OVER (ORDER BY count(DISTINCT facet) DESC, count(*) DESC, paper_id) AS rank FROM concepts GROUP BY paper_id) WHERE rank <= 100")
def review_queue(spark, sf):
    rows = part_concepts(spark, sf).groupBy("paper_id").agg(F.count_distinct("facet").alias("n_facets"), F.count("*").alias("n_concepts"))
    ranked = numbered(rows.select("*", (-F.col("n_facets")).alias("a"), (-F.col("n_concepts")).alias("b")), ["a", "b", "paper_id"], "rank")
    return ranked.filter("rank <= 100").select("paper_id", "n_facets", "n_concepts", "rank")


_SPLIT = r"string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))"


@query("evidence_grounding", f"SELECT doc_id AS paper_id, count(*) AS n_items, count(*) FILTER (i <= n) AS n_grounded, sum(CASE WHEN i <= n THEN length(s[i]) END)::BIGINT AS n_chars FROM (SELECT doc_id, {_SPLIT} AS s, len({_SPLIT}) AS n, unnest([1, 3, 9]) AS i FROM documents) GROUP BY doc_id")
def evidence_grounding(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("paper_id"), F.split("text", "\n")[0].alias("title"), F.col("text").alias("abstract"))
    items = docs.select("paper_id", F.explode(F.array(F.lit("A0"), F.lit("A2"), F.lit("A8"))).alias("evidence_id"))
    found = X.grounded(items, X.evidence_rows(docs))
    return found.groupBy("paper_id").agg(F.count("*").alias("n_items"), F.count_if(F.col("source") == "abstract").alias("n_grounded"), F.sum(F.length("evidence")).alias("n_chars"))


@query("guard_reasons")
def guard_reasons(spark, sf):
    """Why neighbouring sentences can't be the same finding; the guards are Python rules with tests of their own."""
    docs = table(spark, sf, "documents").select(F.split("text", "\n").alias("lines")).select(F.explode(F.arrays_zip(F.col("lines").alias("a"), F.slice("lines", F.lit(2), F.size("lines")).alias("b"))).alias("x"))
    reason = R.column(R.guard, "string")(F.coalesce("x.a", F.lit("")), F.coalesce("x.b", F.lit("")), F.lit("contribution"))
    return docs.groupBy(F.coalesce(reason, F.lit("none")).alias("reason")).agg(F.count("*").alias("n"))


@query("label_assignment")
def label_assignment(spark, sf):
    """Suppliers to brands, one to one in each nation, by mean discount; a test holds the choice against all choices."""
    lines = table(spark, sf, "lineitem").select("l_suppkey", "l_partkey", "l_discount")
    joined = lines.join(table(spark, sf, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey")).join(table(spark, sf, "part").select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    pairs = joined.groupBy("s_nationkey", F.col("l_suppkey").cast("string").alias("left"), F.col("p_type").alias("right")).agg(F.round(F.avg("l_discount"), 6).alias("score"))
    return J.assign_groups(pairs, ["s_nationkey"])


_PAIRS_SQL = """
offered AS (
  SELECT s_nationkey AS nation, l_suppkey, l_partkey % 7 AS class, round(1000000 * avg(l_discount))::BIGINT AS score
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL HAVING avg(l_discount) >= 0.05),
turns AS (SELECT *, dense_rank() OVER (PARTITION BY nation ORDER BY l_suppkey) AS turn FROM offered)
"""


@query("assignment_totals", "WITH RECURSIVE " + _PAIRS_SQL + """,
options AS (SELECT nation, turn, 1 << class AS bit, score, 1 AS one FROM turns UNION ALL SELECT DISTINCT nation, turn, 0, 0, 0 FROM turns),
dp AS (
  SELECT DISTINCT nation, 0::BIGINT AS turn, 0 AS mask, {'n': 0, 'total': 0::BIGINT} AS best FROM turns
  UNION ALL
  SELECT nation, turn, mask, max(best) AS best FROM (
    SELECT d.nation, o.turn, (d.mask | o.bit)::INT AS mask, {'n': d.best.n + o.one, 'total': d.best.total + o.score} AS best
    FROM dp d JOIN options o ON o.nation = d.nation AND o.turn = d.turn + 1 WHERE d.mask & o.bit = 0) GROUP BY nation, turn, mask)
SELECT nation AS s_nationkey, max(best).n::BIGINT AS n_pairs, max(best).total::BIGINT AS total FROM dp GROUP BY nation""")
def assignment_totals(spark, sf):
    """Suppliers to part classes, one to one in each nation: how many pairs, and their sum; SQL tries every set of classes."""
    lines = table(spark, sf, "lineitem").join(table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    means = lines.groupBy("s_nationkey", F.col("l_suppkey").cast("string").alias("left"), (F.col("l_partkey") % 7).cast("string").alias("right")).agg(F.avg("l_discount").alias("mean"))
    pairs = means.filter("mean >= 0.05").select("s_nationkey", "left", "right", F.round(1_000_000 * F.col("mean")).alias("score"))
    return J.assign_groups(pairs, ["s_nationkey"]).groupBy("s_nationkey").agg(F.count("*").alias("n_pairs"), F.sum("score").cast("bigint").alias("total"))


@query("attempt_assessment")
def attempt_assessment(spark, sf):
    """Replies made of each document's own words, judged: the first three words of a sentence are valid, reversed ones are not."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("paper_id"), F.split("text", "\n")[0].alias("title"), F.col("text").alias("abstract"))
    lead = F.array_join(F.slice(F.split(F.split("abstract", r"(?<=[.!?])\s+")[0], " "), 1, 3), " ")
    item = lambda c: F.array(F.struct(c.alias("concept"), F.lit("A0").alias("evidence_id")))
    none = F.slice(item(lead), 1, 0)
    reply = F.to_json(F.struct("paper_id", none.alias("problem"), item(F.trim(lead)).alias("task"), item(F.trim(F.reverse(lead))).alias("method"), none.alias("dataset"), none.alias("contribution")))
    rows = docs.withColumn("reply", reply).withColumn("attempt", F.lit(1)).withColumn("stage", F.lit("extract"))
    return X.assess_attempts(rows).select("paper_id", "score", "schema_valid", "parseable", F.size("errors").alias("n_errors"), F.size("items").alias("n_items"))


#: Turns of a conversation as attempts: long words are items (facet by length, valid if of odd length), the longest are flagged.
_TURNS_SQL = r"""
replies AS (
  SELECT conv_id AS paper_id, turn + 1 AS attempt, turn > 0 AS review, conv_id % 3 = 0 AS excused, length(text) % 5 <> 0 AS formed, (length(text) % 100)::DOUBLE AS score,
    regexp_extract_all(lower(text), '[a-z]+') AS words FROM conversations),
listed AS (
  SELECT * EXCLUDE words, list_sort([{'f': length(w) % 5, 'i': i - 1, 'concept': w, 'valid': length(w) % 2 = 1} FOR w, i IN words IF length(w) >= 8]) AS items FROM replies),
told AS (
  SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY attempt) AS try,
    CASE WHEN formed THEN [{'f': -1, 't': 'coverage: all facets are empty'} FOR x IN [1] IF len(items) = 0 AND NOT excused] ELSE [{'f': -1, 't': 'wrong facet keys'}] END
    || [{'f': x.f, 't': x.concept} FOR x IN items IF length(x.concept) >= 13] AS errors FROM listed),
runs AS (
  SELECT paper_id, try, attempt, review, formed, score, items, errors, [0, 1, 2, 3, 4]::BIGINT[] AS scope, false AS stagnant FROM told WHERE try = 1
  UNION ALL
  SELECT paper_id, try, attempt, review, formed,
    CASE WHEN merges THEN round(12 * len(list_distinct([x.f FOR x IN items IF x.valid])) + CASE WHEN len(items) > 0 THEN (25 * len([1 FOR x IN items IF x.valid]) + 2.5 * len(items)) / len(items) ELSE 0 END + 10, 4) ELSE score END,
    items, errors, scope, items = p_items AND errors = p_errors
  FROM (
    SELECT *, CASE WHEN merges THEN kept || [{'f': -1, 't': 'coverage: all facets are empty'} FOR x IN [1] IF len(items) = 0 AND NOT excused] ELSE own_errors END AS errors FROM (
      SELECT paper_id, try, attempt, review, formed, score, scope, merges, excused, own_errors, p_items, p_errors,
        CASE WHEN merges THEN list_sort([x FOR x IN own_items IF list_contains(scope, x.f)] || [x FOR x IN p_items IF NOT list_contains(scope, x.f)]) ELSE own_items END AS items,
        [e FOR e IN own_errors IF e.f = 0 AND list_contains(scope, 0)] || [e FOR e IN p_errors IF e.f = 0 AND NOT list_contains(scope, 0)] || [e FOR e IN own_errors IF e.f = 1 AND list_contains(scope, 1)] || [e FOR e IN p_errors IF e.f = 1 AND NOT list_contains(scope, 1)]
        || [e FOR e IN own_errors IF e.f = 2 AND list_contains(scope, 2)] || [e FOR e IN p_errors IF e.f = 2 AND NOT list_contains(scope, 2)] || [e FOR e IN own_errors IF e.f = 3 AND list_contains(scope, 3)] || [e FOR e IN p_errors IF e.f = 3 AND NOT list_contains(scope, 3)]
        || [e FOR e IN own_errors IF e.f = 4 AND list_contains(scope, 4)] || [e FOR e IN p_errors IF e.f = 4 AND NOT list_contains(scope, 4)] AS kept
      FROM (
        SELECT t.paper_id, t.try, t.attempt, t.review, t.formed, t.score, t.excused, t.items AS own_items, t.errors AS own_errors, p.items AS p_items, p.errors AS p_errors, t.formed AND p.formed AS merges,
          [f FOR f IN [0, 1, 2, 3, 4]::BIGINT[] IF NOT p.formed OR f IN (0, 3) OR list_contains([e.f FOR e IN p.errors], f) OR list_contains([e.f FOR e IN p.errors], -1)] AS scope
        FROM runs p JOIN told t ON t.paper_id = p.paper_id AND t.try = p.try + 1 AND t.try <= 4 WHERE NOT (p.review AND len(p.errors) = 0)))))
"""


def conversation_attempts(spark, sf):
    said = table(spark, sf, "conversations").withColumn("words", F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)")))
    facets = F.array(*map(F.lit, X.FACETS))
    numbered_words = F.transform("words", lambda w, i: F.struct((F.length(w) % 5).alias("f"), i.alias("index"), w.alias("concept"), F.lit(0.5).alias("retained"), (F.length(w) % 2 == 1).alias("valid")))
    found = F.array_sort(F.filter(numbered_words, lambda x: F.length(x["concept"]) >= 8))
    items = F.transform(found, lambda x: F.struct(F.get(facets, x["f"]).alias("facet"), x["index"].alias("index"), x["concept"].alias("concept"), x["retained"].alias("retained"), x["valid"].alias("valid")))
    rows = said.select(F.col("conv_id").alias("paper_id"), (F.col("turn") + 1).alias("attempt"), F.when(F.col("turn") > 0, "review").otherwise("extract").alias("stage"), (F.length("text") % 5 != 0).alias("schema_valid"), F.lit(True).alias("parseable"), (F.length("text") % 100).cast("double").alias("score"), (F.col("conv_id") % 3 == 0).alias("excused"), items.alias("items"))
    whole = F.when(~F.col("schema_valid"), F.array(F.lit("wrong facet keys"))).when((F.size("items") == 0) & ~F.col("excused"), F.array(F.lit(X.ALL_EMPTY))).otherwise(F.array().cast("array<string>"))
    flagged = F.transform(F.filter("items", lambda x: F.length(x["concept"]) >= 13), lambda x: F.concat(x["facet"], F.lit("[0]: "), x["concept"]))
    return rows.withColumn("errors", F.concat(whole, flagged))


_STATUS_SQL = "CASE WHEN review AND len(errors) = 0 THEN 'accepted' WHEN try >= 4 THEN 'exhausted' ELSE 'retried' END"


@query("review_merges", "WITH RECURSIVE " + _TURNS_SQL + f"""
SELECT paper_id, attempt, {_STATUS_SQL} AS status, list_aggregate(scope, 'string_agg', ',') AS scope, coalesce(list_aggregate([x.f || ':' || x.concept FOR x IN items], 'string_agg', ' '), '') AS items,
  coalesce(list_aggregate([e.t FOR e IN errors], 'string_agg', '; '), '') AS errors, score, stagnant FROM runs""")
def review_merges(spark, sf):
    """Each conversation as a run of attempts: drafts after each merge, with the facets that each review might change."""
    rows = X.merge_reviews(conversation_attempts(spark, sf), most=4)
    number = lambda f: (F.array_position(F.array(*map(F.lit, X.FACETS)), f) - 1).cast("string")
    items = F.array_join(F.transform("items", lambda x: F.concat(number(x["facet"]), F.lit(":"), x["concept"])), " ")
    errors = F.array_join(F.transform("errors", lambda e: F.regexp_replace(e, r"^[a-z]+\[0\]: ", "")), "; ")
    return rows.select("paper_id", "attempt", "status", F.array_join(F.transform("scope", number), ",").alias("scope"), items.alias("items"), errors.alias("errors"), "score", "stagnant")


@query("review_results", "WITH RECURSIVE " + _TURNS_SQL + f""",
ended AS (SELECT *, {_STATUS_SQL} AS status FROM runs),
best AS (
  SELECT * FROM ended WHERE status = 'accepted' UNION ALL
  (SELECT * FROM ended WHERE paper_id IN (SELECT paper_id FROM ended WHERE status = 'exhausted') QUALIFY row_number() OVER (PARTITION BY paper_id ORDER BY score DESC, len(errors), review DESC, attempt DESC) = 1))
SELECT paper_id, attempt, paper_id IN (SELECT paper_id FROM ended WHERE status = 'exhausted') AS fallback, score, len(items)::INT AS n_items, (len(errors) + CASE WHEN paper_id IN (SELECT paper_id FROM ended WHERE status = 'exhausted') THEN 1 ELSE 0 END)::INT AS n_errors FROM best""")
def review_results(spark, sf):
    found = X.run_results(X.merge_reviews(conversation_attempts(spark, sf), most=4))
    return found.select("paper_id", "attempt", "fallback", "score", F.size("items").alias("n_items"), F.size("errors").alias("n_errors"))
