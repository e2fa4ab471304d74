"""Gates, joins and set operations over the relational tables; windows over event time."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from facetlake.functions import metrics as M
from facetlake.functions import text as T
from facetlake.operators import corpus, intent
from facetlake.operators import gates as G
from facetlake.queries.base import reactions, table
from facetlake.storage import numbered
from facetlake.streaming import periods

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


@query("catalog_gate", """SELECT unnest(['name', 'size', 'price']) AS rule, unnest([count(*) FILTER (NOT coalesce(regexp_matches(p_name, '^[a-z]+ [a-z]+$'), false)), count(*) FILTER (NOT coalesce(p_size BETWEEN 1 AND 40, false)), count(*) FILTER (NOT coalesce(p_retailprice > 0, false))]) AS n_violations FROM part""")
def catalog_gate(spark, sf):
    return G.violations(table(spark, sf, "part"), name=F.regexp_like("p_name", F.lit("^[a-z]+ [a-z]+$")), size=F.col("p_size").between(1, 40), price=F.col("p_retailprice") > 0)


@query("referential_gate", """SELECT 'orders' AS child, count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) UNION ALL SELECT 'labels', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)""")
def referential_gate(spark, sf):
    t = lambda n, c: table(spark, sf, n).select(F.col(c).alias("k"))
    one = lambda name, child, parent: G.orphans(child, parent, ["k"]).agg(F.count("*").alias("n")).select(F.lit(name).alias("child"), "n")
    return one("orders", t("orders", "o_custkey"), t("customer", "c_custkey")).unionByName(one("lineitem", t("lineitem", "l_orderkey"), t("orders", "o_orderkey"))).unionByName(one("labels", t("labels", "doc_id"), t("documents", "doc_id")))


@query("duplicate_identical_gate", "SELECT l_orderkey, l_partkey FROM lineitem GROUP BY ALL HAVING count(DISTINCT (l_quantity, l_discount, l_tax)) > 1")
def duplicate_identical_gate(spark, sf):
    return G.conflicting(table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_discount", "l_tax"), ["l_orderkey", "l_partkey"])


@query("repeated_keys", "SELECT l_orderkey, l_linenumber, count(*) AS count FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def repeated_keys(spark, sf):
    return G.repeated(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("reformulation_order_gate", """
WITH t AS (SELECT *, conv_id * 1000 + turn AS id, conv_id * 1000 + turn - 1 AS parent FROM conversations)
SELECT count(*) AS n FROM t WHERE turn > 0 AND NOT EXISTS (SELECT 1 FROM t p WHERE p.id = t.parent AND p.conv_id = t.conv_id AND p.turn < t.turn)""")
def reformulation_order_gate(spark, sf):
    turn = F.col("turn")
    rows = table(spark, sf, "conversations").select("conv_id", "turn", (F.col("conv_id") * 1000 + turn).alias("id"), F.when(turn > 0, F.col("conv_id") * 1000 + turn - 1).alias("parent"))
    return G.bad_parents(rows, "id", "parent", ["conv_id"], "turn").agg(F.count("*").alias("n"))


@query("missing_annotations", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def missing_annotations(spark, sf):
    return table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left_anti")


@query("annotated_documents", "SELECT d.doc_id, lang, source, quality, toxic FROM documents d JOIN labels USING (doc_id)")
def annotated_documents(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "lang", "source").join(table(spark, sf, "labels"), "doc_id")


@query("set_differences", "SELECT 'left' AS side, k FROM (SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier) UNION ALL SELECT 'right', k FROM (SELECT s_nationkey AS k FROM supplier EXCEPT ALL SELECT c_nationkey FROM customer)")
def set_differences(spark, sf):
    return G.differences(table(spark, sf, "customer").select(F.col("c_nationkey").alias("k")), table(spark, sf, "supplier").select(F.col("s_nationkey").alias("k"))).select("side", "k")


@query("merged_streams", "SELECT user_id, 'event' AS stream, count(*) AS n FROM events GROUP BY user_id UNION ALL SELECT c_custkey, 'order', count(*) FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY c_custkey")
def merged_streams(spark, sf):
    a = table(spark, sf, "events").select("user_id", F.lit("event").alias("stream"))
    b = table(spark, sf, "orders").join(table(spark, sf, "customer").select("c_custkey"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_custkey").alias("user_id"), F.lit("order").alias("stream"))
    return a.unionByName(b).groupBy("user_id", "stream").agg(F.count("*").alias("n"))


@query("next_free_id", "SELECT p_name, (SELECT max(c_custkey) FROM customer) + row_number() OVER (ORDER BY p_name) AS new_id FROM (SELECT DISTINCT p_name FROM part)")
def next_free_id(spark, sf):
    last = table(spark, sf, "customer").agg(F.max("c_custkey").alias("m")).scalar()
    return numbered(table(spark, sf, "part").select("p_name").distinct(), ["p_name"]).select("p_name", (F.col("number") + last).alias("new_id"))


_W = r"[\p{L}\p{M}\p{N}_]"


@query("entity_resolution", rf"""
WITH r AS (SELECT source, doc_id::VARCHAR AS source_id, '1' || chr(1) || '1' || chr(1) || source || chr(1) || doc_id AS place,
  array_to_string(regexp_extract_all(lower(trim(regexp_replace(string_split(text, chr(10))[1], '\s+', ' ', 'g'))), '{_W}+'), ' ') AS tk, array_to_string(regexp_extract_all(lower(text), '{_W}+'), ' ') AS ak FROM documents),
g AS (SELECT *, min(place) OVER (PARTITION BY tk, ak) AS root FROM r),
n AS (SELECT root, row_number() OVER (ORDER BY root) AS i FROM (SELECT DISTINCT root FROM g))
SELECT source, source_id, 'P' || lpad(i::VARCHAR, 6, '0') AS paper_id, place = root AS "primary" FROM g JOIN n USING (root)""")
def entity_resolution(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source", F.split("text", "\n")[0].alias("title"), F.col("text").alias("abstract"))
    rows = docs.select("source", F.col("doc_id").cast("string").alias("source_id"), T.collapsed(F.col("title")).alias("title"), T.collapsed(F.col("abstract")).alias("abstract"), F.lit(None).cast("int").alias("year"), F.create_map(F.lit("s2orc"), F.col("doc_id").cast("string")).alias("identifiers"), F.array(F.lit("scope")).alias("scope_evidence"))
    before = spark.createDataFrame([], "source string, source_id string, paper_id string, identifiers map<string,string>, content_sha256 string, active boolean, `primary` boolean")
    _, id_map, _ = corpus.resolve(rows, before)
    return id_map.select("source", "source_id", "paper_id", "primary")


@query("signature_zip", """
WITH s AS (SELECT p_brand AS g, CASE WHEN p_size <= 25 THEN 'left' ELSE 'right' END AS side, p_partkey, row_number() OVER (PARTITION BY p_brand, p_size <= 25 ORDER BY p_retailprice, p_partkey) AS n FROM part)
SELECT a.g, a.n, a.p_partkey AS left_id, b.p_partkey AS right_id FROM s a JOIN s b ON a.g = b.g AND a.n = b.n AND a.side = 'left' AND b.side = 'right'""")
def signature_zip(spark, sf):
    rows = table(spark, sf, "part").select(F.col("p_brand").alias("g"), F.when(F.col("p_size") <= 25, "left").otherwise("right").alias("side"), F.col("p_partkey").alias("paper_id"), "p_retailprice")
    return intent.signature_pairs(rows, ["g"], "side", F.col("p_retailprice")).select("g", F.col("n").cast("bigint").alias("n"), "left_id", "right_id")


@query("history_concepts", """SELECT o_custkey, p_type AS concept, round(sum(1.0 / 2), 6) AS weight FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey GROUP BY ALL""")
def history_concepts(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey")
    joined = table(spark, sf, "orders").select("o_orderkey", "o_custkey").join(lines, F.col("o_orderkey") == F.col("l_orderkey")).join(table(spark, sf, "part").select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    return joined.groupBy("o_custkey", F.col("p_type").alias("concept")).agg(F.round(F.sum(F.lit(0.5)), 6).alias("weight"))


@query("asof_order_prefix", """SELECT o_custkey, o_orderkey, (SELECT count(*) FROM orders p WHERE p.o_custkey = o.o_custkey AND p.o_orderdate < o.o_orderdate) AS n_before FROM orders o""")
def asof_order_prefix(spark, sf):
    """Orders strictly before each order of the same customer: a range frame instead of a self-join."""
    before = Window.partitionBy("o_custkey").orderBy(F.unix_micros(F.col("o_orderdate").cast("timestamp"))).rangeBetween(Window.unboundedPreceding, -1)
    return table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.count("*").over(before).alias("n_before"))


@query("tumbling_periods", """
WITH r AS (SELECT user_id, ts, CASE event_type WHEN 'error' THEN 'dislike' WHEN 'view' THEN 'view' WHEN 'click' THEN 'click' WHEN 'signup' THEN 'save' ELSE 'like' END AS interaction_type FROM events)
SELECT time_bucket(INTERVAL 10 DAY, ts, TIMESTAMP '1970-01-01') AS start, time_bucket(INTERVAL 10 DAY, ts, TIMESTAMP '1970-01-01') + INTERVAL 10 DAY AS "end", user_id, interaction_type, count(*) AS n FROM r GROUP BY ALL""")
def tumbling_periods(spark, sf):
    return _plain(periods.period_counts(reactions(spark, sf)))


def _plain(df):
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


@query("session_windows", """
WITH f AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 6 HOUR, true)::INT AS fresh FROM events),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM f)
SELECT min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", user_id, count(*) AS n FROM s GROUP BY user_id, k""")
def session_windows(spark, sf):
    return _plain(periods.sessions(reactions(spark, sf), "6 hours"))


@query("label_prf", """
WITH p AS (SELECT lang AS facet, quality = 0 AS truth, contains(text, ' | ') AS guess FROM documents JOIN labels USING (doc_id)),
c AS (SELECT facet, count(*) FILTER (truth AND guess) AS tp, count(*) FILTER (NOT truth AND guess) AS fp, count(*) FILTER (truth AND NOT guess) AS fn FROM p GROUP BY facet)
SELECT facet, tp, fp, fn, round(tp / nullif(tp + fp, 0), 6) AS "precision", round(tp / nullif(tp + fn, 0), 6) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1, round(coalesce(5 * tp / nullif(5 * tp + 4 * fn + fp, 0), 0), 6) AS f2 FROM c""")
def label_prf(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.col("lang").alias("facet"), F.col("text").contains(" | ").alias("guess")).join(table(spark, sf, "labels").select("doc_id", (F.col("quality") == 0).alias("truth")), "doc_id")
    t, g = F.col("truth"), F.col("guess")
    counts = rows.groupBy("facet").agg(F.count_if(t & g).alias("tp"), F.count_if(~t & g).alias("fp"), F.count_if(t & ~g).alias("fn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    scored = counts.select("facet", "tp", "fp", "fn", *M.prf(tp, fp, fn), M.f2(tp, fp, fn).alias("f2"))
    return scored.select("facet", "tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "f2")])
