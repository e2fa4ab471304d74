"""Behaviour queries over events: profiles, decay, recency, directions, temporal gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from facetlake.functions import metrics as M
from facetlake.functions import text as T
from facetlake.functions import vectors as V
from facetlake.operators import facets as A
from facetlake.operators import gates as G
from facetlake.operators import intent as D
from facetlake.operators import profiles as P
from facetlake.operators.search import mentions
from facetlake.queries.base import BASE_SQL, CUTOFF, RECENT, UNTIL, part_concepts, part_papers, reactions, table, timed_cases, tokens_sql
from facetlake.storage import written

QUERIES, ORACLE = {}, {}
HALF_LIFE = 7.0


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def rounded(df, *names, digits=6):
    return df.select(*[F.round(c, digits).alias(c) if c in names else c for c in df.columns])


@query("behavior_counts", "WITH " + BASE_SQL + "SELECT interaction_type, count(*) AS n, sum(w)::BIGINT AS weight FROM reactions GROUP BY ALL")
def behavior_counts(spark, sf):
    return reactions(spark, sf).groupBy("interaction_type").agg(F.count("*").alias("n"), F.sum(P.behavior_weight(F.col("interaction_type"))).alias("weight"))


@query("behavior_thresholds", "SELECT b AS behavior, count(*) AS n FROM (SELECT CASE WHEN s < -0.25 THEN 'dislike' WHEN s < 0.05 THEN 'view' WHEN s < 0.2 THEN 'click' WHEN s < 0.4 THEN 'save' ELSE 'like' END AS b FROM (SELECT value / 100 - 0.3 AS s FROM events)) GROUP BY b")
def behavior_thresholds(spark, sf):
    return table(spark, sf, "events").groupBy(P.behavior(F.col("value") / 100 - 0.3).alias("behavior")).agg(F.count("*").alias("n"))


@query("popularity", "WITH " + BASE_SQL + "SELECT paper_id, sum(greatest(0, w))::BIGINT AS popularity FROM seen GROUP BY paper_id")
def popularity(spark, sf):
    return P.popularity(seen(spark, sf))


def seen(spark, sf):
    users, _ = timed_cases(spark, sf)
    return P.visible(reactions(spark, sf), users)


@query("temporal_prefix_join", "WITH " + BASE_SQL + "SELECT user_id, count(*) AS n, sum(w)::BIGINT AS weight, max(ts) AS last_ts FROM seen GROUP BY user_id")
def temporal_prefix_join(spark, sf):
    return seen(spark, sf).groupBy("user_id").agg(F.count("*").alias("n"), F.sum(P.behavior_weight(F.col("interaction_type"))).alias("weight"), F.max("ts").cast("timestamp_ntz").alias("last_ts"))


@query("rolling_period_labels", "WITH " + BASE_SQL + f"SELECT user_id AS case_id, paper_id, max(greatest(0, w)) AS grade FROM reactions WHERE ts >= TIMESTAMP '{CUTOFF}' AND ts < TIMESTAMP '{UNTIL}' GROUP BY ALL")
def rolling_period_labels(spark, sf):
    _, cases = timed_cases(spark, sf)
    return P.labels(cases, reactions(spark, sf))


_DECAY = f"power(2, -(epoch_us(TIMESTAMP '{CUTOFF}') - epoch_us(ts)) / 1e6 / (86400 * {HALF_LIFE}))"


@query("user_profile_decay", "WITH " + BASE_SQL + f"SELECT user_id, paper_id, round(sum(w * {_DECAY}), 5) + 0.0::DOUBLE AS weight FROM seen GROUP BY ALL")
def user_profile_decay(spark, sf):
    w = P.behavior_weight(F.col("interaction_type")) * P.time_weight(HALF_LIFE)
    return seen(spark, sf).groupBy("user_id", "paper_id").agg(F.round(F.sum(w), 5).alias("weight"))


@query("user_profile_recent", "WITH " + BASE_SQL + f"SELECT user_id, paper_id, sum(w)::BIGINT AS weight FROM seen WHERE ts >= TIMESTAMP '{RECENT}' GROUP BY ALL")
def user_profile_recent(spark, sf):
    rows = seen(spark, sf).filter(F.col("ts") >= F.to_timestamp(F.lit(RECENT)))
    return rows.groupBy("user_id", "paper_id").agg(F.sum(P.behavior_weight(F.col("interaction_type"))).alias("weight"))


#: Every user's cutoffs: each fifth day at six, from the second to the thirtieth; a period is the three and a half days after it.
_PERIODS_SQL = "cuts AS (SELECT user_id, unnest(range(0, 6)) AS period, TIMESTAMP '2024-01-02 06:00:00' + period * INTERVAL 5 DAY AS cutoff FROM (SELECT DISTINCT user_id FROM reactions))"


def user_periods(spark, sf):
    at = F.to_timestamp(F.lit("2024-01-02 06:00:00"))
    users = reactions(spark, sf).select("user_id").distinct().withColumn("period", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(5).cast("bigint"))))
    rows = users.withColumn("cutoff", at + F.make_dt_interval(days=(5 * F.col("period")).cast("int")))
    return rows.withColumn("case_id", F.struct("user_id", "period"))


@query("period_profile_weights", "WITH " + BASE_SQL + ", " + _PERIODS_SQL + f"""
SELECT user_id, period, paper_id, count(*) AS n, round(sum(w * power(2, -(epoch_us(cutoff) - epoch_us(ts)) / 1e6 / (86400 * {HALF_LIFE}))), 5) + 0.0::DOUBLE AS weight
FROM cuts JOIN reactions USING (user_id) WHERE ts < cutoff GROUP BY ALL""")
def period_profile_weights(spark, sf):
    """All cutoffs of all users: what each had reacted to before, decayed to the cutoff."""
    cases = user_periods(spark, sf).select("case_id", "user_id", F.lit(None).cast("timestamp").alias("since"), F.col("cutoff").alias("until"))
    found = P.interval_weights(cases, reactions(spark, sf), half_life_days=HALF_LIFE)
    return found.select("case_id.user_id", "case_id.period", "paper_id", "n", (F.round("weight", 5) + 0.0).alias("weight"))


@query("period_grades", "WITH " + BASE_SQL + ", " + _PERIODS_SQL + """
SELECT user_id, period, paper_id, count(*) AS n, sum(w)::BIGINT AS weight, max(greatest(0, w)) AS grade
FROM cuts JOIN reactions USING (user_id) WHERE ts >= cutoff AND ts < cutoff + INTERVAL 84 HOUR GROUP BY ALL""")
def period_grades(spark, sf):
    """All periods of all users: what each reacts to in the three and a half days from its beginning."""
    cases = user_periods(spark, sf).select("case_id", "user_id", F.col("cutoff").alias("since"), (F.col("cutoff") + F.expr("INTERVAL 84 HOURS")).alias("until"))
    found = P.interval_weights(cases, reactions(spark, sf))
    return found.select("case_id.user_id", "case_id.period", "paper_id", "n", F.col("weight").cast("bigint").alias("weight"), "grade")


def text_vectors(spark, sf):
    return V.tfidf(part_papers(spark, sf).select("paper_id", T.tokens(F.lower("text")).alias("tokens")), ["paper_id"])


_TEXT_SQL = BASE_SQL + f""",
tf AS (SELECT p_partkey AS paper_id, term, count(*) AS n FROM (SELECT p_partkey, unnest({tokens_sql("(p_name || ' ' || p_type || ' ' || p_brand)")}) AS term FROM part) GROUP BY ALL),
tw AS (SELECT tf.*, n * (ln((1 + (SELECT count(*) FROM part)) / (1 + df)) + 1) AS x FROM tf JOIN (SELECT term, count(*) AS df FROM tf GROUP BY term) USING (term)),
tv AS (SELECT paper_id, term, x / sqrt(sum(x * x) OVER (PARTITION BY paper_id)) AS weight FROM tw)
"""


@query("text_profiles", "WITH " + _TEXT_SQL + f""",
raw AS (SELECT user_id, term, sum(w * {_DECAY} * weight) AS x FROM seen JOIN tv USING (paper_id) WHERE w <> 0 AND ts >= TIMESTAMP '{RECENT}' GROUP BY ALL)
SELECT user_id AS case_id, term, round(x / sqrt(sum(x * x) OVER (PARTITION BY user_id)), 5) + 0.0::DOUBLE AS weight FROM raw WHERE x <> 0""")
def text_profiles(spark, sf):
    found = P.text_profiles(seen(spark, sf), text_vectors(spark, sf), half_life_days=HALF_LIFE, recent_start=F.to_timestamp(F.lit(RECENT)))
    return rounded(found, "weight", digits=5).select("case_id", "term", "weight")


def searches(spark, sf):
    """Views as searches: for the viewed part's type, or for alternatives to it after a dear view."""
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("paper_id"), "p_type")
    views = reactions(spark, sf).filter("interaction_type = 'view'").join(table(spark, sf, "events").select("event_id", "value").hint("merge"), "event_id").join(part.hint("merge"), "paper_id")
    text = F.concat(F.lit("method: "), F.when(F.col("value") > 10, "alternatives to ").otherwise(""), F.lower("p_type"), F.lit(" papers"))
    return views.select(F.col("event_id").alias("query_id"), "user_id", F.col("ts"), text.alias("text"))


_SEARCH_SQL = "searches AS (SELECT r.event_id AS query_id, r.user_id, r.ts, 'method' AS facet, lower(p_type) AS concept, CASE WHEN e.value > 10 THEN -1 ELSE 1 END AS sign FROM reactions r JOIN events e USING (event_id) JOIN part ON p_partkey = r.paper_id WHERE interaction_type = 'view')"


@query("search_mentions", "WITH " + BASE_SQL + ", " + _SEARCH_SQL + "SELECT query_id, user_id, facet, concept, sign FROM searches")
def search_mentions(spark, sf):
    return mentions(searches(spark, sf), part_concepts(spark, sf)).select("query_id", "user_id", "facet", "concept", "sign")


def search_rows(spark, sf):
    users, _ = timed_cases(spark, sf)
    return written(P.visible(mentions(searches(spark, sf), part_concepts(spark, sf)), users), "searches")


def _facet_sql(weight: str, search_weight: str) -> str:
    return BASE_SQL + ", " + _SEARCH_SQL + f""",
sizes AS (SELECT paper_id, facet, count(*) AS n FROM concepts GROUP BY ALL),
ev AS (
  SELECT user_id, facet, concept, {weight} / n AS x FROM seen JOIN concepts USING (paper_id) JOIN sizes USING (paper_id, facet)
  UNION ALL SELECT user_id, facet, concept, sign * {search_weight} FROM searches WHERE ts < TIMESTAMP '{CUTOFF}'),
raw AS (SELECT user_id, facet, concept, sum(x) AS x FROM ev GROUP BY ALL),
pv AS (SELECT user_id AS case_id, facet, concept, x / sqrt(sum(x * x) OVER (PARTITION BY user_id, facet)) AS weight FROM raw WHERE abs(x) > 1e-12),
users AS (SELECT DISTINCT user_id FROM seen),
mass AS (SELECT user_id, facet, sum(abs(x)) AS m FROM raw GROUP BY ALL),
imp AS (SELECT user_id AS case_id, facet, CASE WHEN sum(coalesce(m, 0)) OVER (PARTITION BY user_id) > 0 THEN coalesce(m, 0) / sum(coalesce(m, 0)) OVER (PARTITION BY user_id) ELSE 0.2 END AS importance FROM users CROSS JOIN facet_names LEFT JOIN mass USING (user_id, facet)),
hot AS (SELECT paper_id, facet, concept, 1 / sqrt(count(*) OVER (PARTITION BY paper_id, facet)) AS h FROM (SELECT DISTINCT * FROM concepts)),
fs AS (SELECT p.user_id AS case_id, p.paper_id, sum(pv.weight * imp.importance * hot.h) AS score FROM pool p JOIN hot USING (paper_id) JOIN pv ON pv.case_id = p.user_id AND pv.facet = hot.facet AND pv.concept = hot.concept
  JOIN imp ON imp.case_id = p.user_id AND imp.facet = hot.facet GROUP BY ALL),
ts_scores AS (SELECT user_id AS case_id, pool.paper_id, round(coalesce(score, 0), 5) + 0.0::DOUBLE AS score FROM pool LEFT JOIN fs ON case_id = user_id AND fs.paper_id = pool.paper_id)
"""


FACET_SQL = _facet_sql("w", "1")


@query("facet_profiles", "WITH " + FACET_SQL + "SELECT case_id, facet, concept, round(weight, 5) + 0.0::DOUBLE AS weight FROM pv")
def facet_profiles(spark, sf):
    found, _ = P.facet_profiles(seen(spark, sf), part_concepts(spark, sf), search_rows(spark, sf))
    return rounded(found.filter(F.abs("weight") > 1e-12), "weight", digits=5).select("case_id", "facet", "concept", "weight")


@query("facet_importance", "WITH " + FACET_SQL + "SELECT case_id, facet, round(importance, 5) AS importance FROM imp")
def facet_importance(spark, sf):
    _, found = P.facet_profiles(seen(spark, sf), part_concepts(spark, sf), search_rows(spark, sf))
    return rounded(found, "importance", digits=5)


@query("static_profile_scores", "WITH " + FACET_SQL + "SELECT * FROM ts_scores")
def static_profile_scores(spark, sf):
    return temporal(spark, sf).filter("model = 'static'").drop("model")


@query("decay_profile_scores", "WITH " + _facet_sql(f"w * {_DECAY}", _DECAY) + "SELECT * FROM ts_scores")
def decay_profile_scores(spark, sf):
    return temporal(spark, sf).filter("model = 'decay'").drop("model")


_RECENT01 = f"(ts >= TIMESTAMP '{RECENT}')::INT"


@query("recent_profile_scores", "WITH " + _facet_sql(f"w * {_RECENT01}", _RECENT01) + "SELECT * FROM ts_scores")
def recent_profile_scores(spark, sf):
    return temporal(spark, sf).filter("model = 'recent'").drop("model")


def temporal(spark, sf):
    _, cases = timed_cases(spark, sf)
    rows = seen(spark, sf)
    found = P.score_all("temporal", cases, rows=rows, all_rows=rows, concepts=part_concepts(spark, sf), searches=search_rows(spark, sf), recent_start=F.to_timestamp(F.lit(RECENT)), half_life_days=HALF_LIFE)
    return rounded(found, "score", digits=5)


@query("preference_metrics")
def preference_metrics(spark, sf):
    """All preference and temporal models in one metrics job; its parts have SQL of their own."""
    _, cases = timed_cases(spark, sf)
    rows = seen(spark, sf)
    common = {"rows": rows, "all_rows": rows, "concepts": part_concepts(spark, sf), "searches": search_rows(spark, sf)}
    found = P.score_all("preference", cases, text_vectors=text_vectors(spark, sf), **common).unionByName(temporal(spark, sf).withColumn("model", F.concat(F.lit("temporal_"), "model")))
    ranked = M.ranked(found, ["case_id", "model"]).join(P.labels(cases, reactions(spark, sf)).hint("merge"), ["case_id", "paper_id"])
    details = M.graded_metrics(ranked, ["case_id", "model"], [10])
    return M.grouped_summary(details, ["model"], F.array(F.lit("period_1")), ["ndcg_10", "recall_10", "precision_10", "mrr_10"])


@query("popularity_ranking", "WITH " + BASE_SQL + """,
p AS (SELECT paper_id, sum(greatest(0, w)) AS s FROM seen GROUP BY paper_id)
SELECT user_id AS case_id, pool.paper_id, coalesce(s, 0)::DOUBLE AS score, row_number() OVER (PARTITION BY user_id ORDER BY coalesce(s, 0) DESC, pool.paper_id) AS rank FROM pool LEFT JOIN p ON p.paper_id = pool.paper_id""")
def popularity_ranking(spark, sf):
    _, cases = timed_cases(spark, sf)
    found = P.score_all("preference", cases, rows=seen(spark, sf), all_rows=seen(spark, sf), concepts=part_concepts(spark, sf), text_vectors=text_vectors(spark, sf)).filter("model = 'popularity'")
    return M.ranked(found, ["case_id"]).select("case_id", "paper_id", "score", F.col("rank").cast("bigint").alias("rank"))


@query("temporal_leak_gate", "WITH " + BASE_SQL + f""",
h AS (SELECT user_id, max(ts) AS a FROM seen GROUP BY user_id), o AS (SELECT user_id, min(ts) AS b FROM reactions WHERE ts >= TIMESTAMP '{CUTOFF}' GROUP BY user_id)
SELECT count(*) AS n_leaks FROM h FULL JOIN o USING (user_id) WHERE a IS NULL OR b IS NULL OR a >= b""")
def temporal_leak_gate(spark, sf):
    rows, cut = reactions(spark, sf), F.to_timestamp(F.lit(CUTOFF))
    return G.temporal_leaks(rows.filter(F.col("ts") < cut), rows.filter(F.col("ts") >= cut)).agg(F.count("*").alias("n_leaks"))


@query("increasing_time_gate", "WITH " + BASE_SQL + "SELECT count(*) AS n FROM (SELECT ts, lag(ts) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM reactions) WHERE ts <= b")
def increasing_time_gate(spark, sf):
    return G.not_increasing(reactions(spark, sf), ["user_id"], ["event_id"]).agg(F.count("*").alias("n"))


@query("profile_interpolation", "WITH " + BASE_SQL + f""",
a AS (SELECT user_id, paper_id, avg(w) AS x FROM seen WHERE ts < TIMESTAMP '{RECENT}' GROUP BY ALL), b AS (SELECT user_id, paper_id, avg(w) AS y FROM seen WHERE ts >= TIMESTAMP '{RECENT}' GROUP BY ALL)
SELECT user_id, paper_id, round(0.5 * coalesce(x, 0) + 0.5 * coalesce(y, 0), 6) + 0.0::DOUBLE AS weight FROM a FULL JOIN b USING (user_id, paper_id)""")
def profile_interpolation(spark, sf):
    from facetlake.operators.generators import interpolate

    rows, start = seen(spark, sf), F.to_timestamp(F.lit(RECENT))
    mean = lambda df: df.groupBy("user_id", "paper_id").agg(F.avg(P.behavior_weight(F.col("interaction_type"))).alias("weight"))
    return rounded(interpolate(mean(rows.filter(F.col("ts") < start)), mean(rows.filter(F.col("ts") >= start)), ["user_id", "paper_id"], 0.5), "weight")


@query("search_text_profiles", "WITH " + BASE_SQL + ", " + _SEARCH_SQL + f""",
docs AS (SELECT 'p' || p_partkey AS id, p_name || ' ' || p_type || ' ' || p_brand AS text FROM part UNION ALL SELECT 'q' || query_id, 'method: ' || CASE WHEN sign < 0 THEN 'alternatives to ' ELSE '' END || concept || ' papers' FROM searches),
tf AS (SELECT id, term, count(*) AS n FROM (SELECT id, unnest({tokens_sql("text")}) AS term FROM docs) GROUP BY ALL),
tw AS (SELECT tf.*, n * (ln((1 + (SELECT count(*) FROM docs)) / (1 + df)) + 1) AS x FROM tf JOIN (SELECT term, count(*) AS df FROM tf GROUP BY term) USING (term)),
tv AS (SELECT id, term, x / sqrt(sum(x * x) OVER (PARTITION BY id)) AS weight FROM tw),
acts AS (SELECT user_id, 'p' || paper_id AS id, w FROM seen UNION ALL SELECT user_id, 'q' || query_id, 1 FROM searches WHERE ts < TIMESTAMP '{CUTOFF}'),
raw AS (SELECT user_id, term, sum(w * weight) AS x FROM acts JOIN tv USING (id) WHERE w <> 0 GROUP BY ALL)
SELECT user_id AS case_id, term, round(x / sqrt(sum(x * x) OVER (PARTITION BY user_id)), 5) + 0.0::DOUBLE AS weight FROM raw WHERE abs(x) > 1e-12""")
def search_text_profiles(spark, sf):
    """Text profiles where every search counts as a click on itself."""
    named = lambda df, c, mark: df.withColumn(c, F.concat(F.lit(mark), F.col(c).cast("string")))
    papers, asked = named(part_papers(spark, sf), "paper_id", "p"), written(named(searches(spark, sf), "query_id", "q"), "asked")
    users, _ = timed_cases(spark, sf)
    acts = P.with_queries(named(reactions(spark, sf), "paper_id", "p").select("user_id", "paper_id", "interaction_type", "ts"), asked)
    found = P.text_profiles(P.visible(acts, users), P.search_text_vectors(papers, asked))
    return rounded(found.filter(F.abs("weight") > 1e-12), "weight", digits=5).select("case_id", "term", "weight")


@query("latest_query_wins", "WITH " + BASE_SQL + ", " + _SEARCH_SQL + "SELECT user_id, facet, arg_max(concept, (ts, query_id)) AS concept, arg_max(sign, (ts, query_id)) AS sign FROM searches GROUP BY ALL")
def latest_query_wins(spark, sf):
    rows = mentions(searches(spark, sf), part_concepts(spark, sf))
    by = F.struct("ts", "query_id")
    return rows.groupBy("user_id", "facet").agg(F.max_by("concept", by).alias("concept"), F.max_by("sign", by).alias("sign"))


# --- directions --------------------------------------------------------------


def session_inputs(spark, sf):
    """A session a user: the first part reacted to is the anchor; each day's other parts, two by two in time order, are exposures."""
    rows = reactions(spark, sf).withColumn("day", F.to_date("ts"))
    first = rows.groupBy("user_id").agg(F.min_by("paper_id", F.struct("ts", "event_id")).alias("query_paper_id"))
    anchors = first.select(F.col("user_id").alias("case_id"), "query_paper_id")
    from pyspark.sql import Window

    best = rows.groupBy("user_id", "day", "paper_id").agg(F.min("ts").alias("ts"), F.max_by("interaction_type", F.struct("ts", "event_id")).alias("interaction_type"))
    others = best.join(first.hint("merge"), "user_id").filter("paper_id <> query_paper_id").withColumn("n", F.row_number().over(Window.partitionBy("user_id", "day").orderBy("ts", "paper_id")))
    keyed = others.select(F.col("user_id").alias("case_id"), F.concat_ws("-", "user_id", "day", F.floor((F.col("n") - 1) / 2)).alias("exposure_id"), "n", "paper_id", "interaction_type")
    exposures = keyed.groupBy("case_id", "exposure_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "paper_id"))), lambda x: x["paper_id"]).alias("paper_ids"))
    return anchors, exposures, keyed.drop("n")


_SESSION_SQL = BASE_SQL + """,
anchors AS (SELECT user_id AS case_id, arg_min(paper_id, (ts, event_id)) AS query_paper_id FROM reactions GROUP BY ALL),
best AS (SELECT user_id AS case_id, ts::DATE AS day, paper_id, min(ts) AS ts, arg_max(w, (ts, event_id)) AS w FROM reactions GROUP BY ALL),
two AS (SELECT b.*, row_number() OVER (PARTITION BY case_id, day ORDER BY ts, b.paper_id) AS n FROM best b JOIN anchors USING (case_id) WHERE b.paper_id <> query_paper_id),
pairs AS (SELECT a.case_id, a.case_id || '-' || a.day || '-' || (a.n // 2) AS exposure_id, a.paper_id AS a, b.paper_id AS b, a.w AS w_a, b.w AS w_b FROM two a JOIN two b ON a.case_id = b.case_id AND a.day = b.day AND a.n % 2 = 1 AND b.n = a.n + 1),
sets AS (SELECT paper_id, facet, list(DISTINCT concept) AS s FROM concepts GROUP BY ALL),
st AS (SELECT p.*, f.facet, list_has_any(q.s, x.s) AS sa, list_has_any(q.s, y.s) AS sb FROM pairs p JOIN anchors USING (case_id) CROSS JOIN facet_names f
  LEFT JOIN sets q ON q.paper_id = query_paper_id AND q.facet = f.facet LEFT JOIN sets x ON x.paper_id = p.a AND x.facet = f.facet LEFT JOIN sets y ON y.paper_id = p.b AND y.facet = f.facet
  WHERE query_paper_id IN (SELECT paper_id FROM concepts) AND p.a IN (SELECT paper_id FROM concepts) AND p.b IN (SELECT paper_id FROM concepts)),
cmp AS (SELECT *, sum((sa IS DISTINCT FROM sb)::INT) OVER (PARTITION BY case_id, exposure_id) - (sa IS DISTINCT FROM sb)::INT AS other FROM st),
contrasts AS (SELECT case_id, facet, CASE WHEN sa THEN w_b - w_a ELSE w_a - w_b END AS contrast FROM cmp WHERE other = 0 AND sa IS NOT NULL AND sb IS NOT NULL AND sa <> sb),
beh AS (SELECT case_id, facet, sum(contrast) / (count(*) + 2) AS delta FROM contrasts GROUP BY ALL HAVING count(*) >= 2 AND abs(sum(contrast) / (count(*) + 2)) >= 0.25)
"""


@query("matched_pair_contrast", "WITH " + _SESSION_SQL + "SELECT case_id, facet, contrast FROM contrasts")
def matched_pair_contrast(spark, sf):
    anchors, exposures, reacted = session_inputs(spark, sf)
    return D.contrasts(D.feedback_pairs(exposures, reacted), anchors, A.arrays(part_concepts(spark, sf)))


@query("direction_estimates", "WITH " + _SESSION_SQL + ", " + _SEARCH_SQL + """,
q AS (SELECT s.user_id AS case_id, s.facet, arg_max(sign, (ts, query_id)) AS sign FROM searches s JOIN anchors a ON a.case_id = s.user_id JOIN (SELECT DISTINCT * FROM concepts) c ON c.paper_id = a.query_paper_id AND c.facet = s.facet AND c.concept = s.concept GROUP BY ALL)
SELECT a.case_id, f.facet, CASE WHEN q.sign < 0 THEN 'different' WHEN q.sign > 0 THEN 'similar' WHEN b.delta > 0 THEN 'different' WHEN b.delta < 0 THEN 'similar' WHEN f.facet = 'problem' THEN 'similar' ELSE 'unknown' END AS direction,
  round(CASE WHEN q.sign < 0 THEN 1 WHEN q.sign > 0 THEN 0.8 WHEN b.delta IS NOT NULL THEN least(1, abs(b.delta) / 3) WHEN f.facet = 'problem' THEN 1 ELSE 0 END, 6) AS confidence
FROM anchors a CROSS JOIN facet_names f LEFT JOIN q ON q.case_id = a.case_id AND q.facet = f.facet LEFT JOIN beh b ON b.case_id = a.case_id AND b.facet = f.facet""")
def direction_estimates(spark, sf):
    return rounded(found_directions(spark, sf)[0], "confidence")


def found_directions(spark, sf):
    anchors, exposures, reacted = session_inputs(spark, sf)
    anchors, concepts = written(anchors, "anchors"), part_concepts(spark, sf)
    by = D.behavior_directions(D.contrasts(D.feedback_pairs(exposures, reacted), anchors, A.arrays(concepts)))
    said = mentions(searches(spark, sf), concepts).withColumnRenamed("user_id", "case_id")
    q = D.query_directions(said, anchors, concepts)
    return D.directions(anchors, by, q), by, q, anchors


@query("intent_scores")
def intent_scores(spark, sf):
    """Direction models and the privileged row over each user's reacted parts; the estimates have SQL of their own."""
    from facetlake.operators.scorers import joint_vectors, part_cosines

    found, by, q, anchors = found_directions(spark, sf)
    concepts = part_concepts(spark, sf)
    pool = reactions(spark, sf).select(F.col("user_id").alias("case_id"), "paper_id").distinct()
    cases = anchors.join(pool.hint("merge"), "case_id").filter("paper_id <> query_paper_id")
    cosines = written(part_cosines(cases, joint_vectors(part_papers(spark, sf), concepts)).filter("part <> 'text'"), "cosines")
    filled = concepts.select("paper_id", "facet").distinct()
    users, _ = timed_cases(spark, sf)
    _, importance = P.facet_profiles(seen(spark, sf), concepts, search_rows(spark, sf))
    scores = D.score_directions(cases=cases, cosines=cosines, filled=filled, anchors=anchors, importance=importance, behavior=by, queries=q)
    oracle = D.oracle_scores(cases, cosines, filled, D.equal_weights(anchors), found)
    return rounded(scores.withColumn("privileged", F.lit(False)).unionByName(oracle), "score", digits=5)


@query("direction_quality", "WITH " + _SESSION_SQL + """,
t AS (SELECT a.case_id, f.facet, CASE WHEN f.facet IN ('problem', 'task') THEN 'similar' WHEN f.facet = 'dataset' THEN 'ignore' ELSE 'different' END AS truth,
  CASE WHEN b.delta > 0 THEN 'different' WHEN b.delta < 0 THEN 'similar' WHEN f.facet = 'problem' THEN 'similar' ELSE 'unknown' END AS direction
  FROM anchors a CROSS JOIN facet_names f LEFT JOIN beh b ON b.case_id = a.case_id AND b.facet = f.facet)
SELECT case_id, round(avg((truth = direction)::INT), 6) AS direction_accuracy, round(avg((direction <> 'unknown')::INT), 6) AS direction_coverage FROM t WHERE truth <> 'ignore' GROUP BY case_id""")
def direction_quality(spark, sf):
    _, by, _, anchors = found_directions(spark, sf)
    truth = D.directions(anchors, by).select("case_id", "facet", F.when(F.col("facet").isin("problem", "task"), "similar").when(F.col("facet") == "dataset", "ignore").otherwise("different").alias("direction"))
    return rounded(D.direction_metrics(truth, D.directions(anchors, by)), "direction_accuracy", "direction_coverage")


@query("direction_macro_f1", "WITH " + _SESSION_SQL + """,
t AS (SELECT CASE WHEN f.facet IN ('problem', 'task') THEN 'similar' ELSE 'different' END AS t,
  CASE WHEN b.delta > 0 THEN 'different' WHEN b.delta < 0 THEN 'similar' WHEN f.facet = 'problem' THEN 'similar' ELSE 'unknown' END AS p
  FROM anchors a CROSS JOIN facet_names f LEFT JOIN beh b ON b.case_id = a.case_id AND b.facet = f.facet)
SELECT 'behavior' AS model, round((coalesce(2 * count(*) FILTER (p = 'similar' AND t = 'similar') / nullif(count(*) FILTER (p = 'similar') + count(*) FILTER (t = 'similar'), 0), 0)
  + coalesce(2 * count(*) FILTER (p = 'different' AND t = 'different') / nullif(count(*) FILTER (p = 'different') + count(*) FILTER (t = 'different'), 0), 0)) / 2, 6) AS macro_f1 FROM t""")
def direction_macro_f1(spark, sf):
    _, by, _, anchors = found_directions(spark, sf)
    rows = D.directions(anchors, by).withColumn("truth", F.when(F.col("facet").isin("problem", "task"), "similar").otherwise("different")).withColumn("model", F.lit("behavior"))
    return rounded(M.two_label_f1(rows, ["model"], "direction", "truth"), "macro_f1")


@query("importance_mae", "WITH " + FACET_SQL + "SELECT case_id, round(avg(abs(importance - 0.2)), 5) AS importance_mae FROM imp GROUP BY case_id")
def importance_mae(spark, sf):
    _, importance = P.facet_profiles(seen(spark, sf), part_concepts(spark, sf), search_rows(spark, sf))
    flat = importance.select("case_id", "facet", F.lit(0.2).alias("importance"))
    return rounded(D.importance_error(flat, importance), "importance_mae", digits=5)


@query("period_counts", f"SELECT CASE WHEN ts < TIMESTAMP '{RECENT}' THEN 1 WHEN ts < TIMESTAMP '{CUTOFF}' THEN 2 WHEN ts < TIMESTAMP '{UNTIL}' THEN 3 END AS period, user_id, count(*) AS n FROM events WHERE ts < TIMESTAMP '{UNTIL}' GROUP BY ALL")
def period_counts(spark, sf):
    from facetlake.streaming.periods import period_of

    rows = reactions(spark, sf).withColumn("period", period_of(F.col("ts"), [RECENT, CUTOFF, UNTIL]))
    return rows.filter("period is not null").groupBy("period", "user_id").agg(F.count("*").alias("n"))
