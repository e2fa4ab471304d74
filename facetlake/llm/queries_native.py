"""Queries of the operators that use DataFrame functions only, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetlake.llm.common import table
from facetlake.llm.licenses import PHRASES, SHARE, TEMPLATES, prepared, scan_licenses
from facetlake.llm.mixing import mix_plan
from facetlake.llm.quality import DELTA, RISK, RULES, judge_quality
from facetlake.llm.secrets import KINDS, find_secrets, listed
from facetlake.llm.url_filter import judge_urls

RULE_ROWS = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed_rule")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = ", ".join(f"('{h}', '{p}', '{a}')" for h, p, a in RULE_ROWS)
    rules = spark.sql(f"SELECT * FROM VALUES {values} AS t(host, path, action)")
    return judge_urls(table(spark, sf_dir, "pages"), rules)


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.concat("base", "added")).alias("spans"))


def op10_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_plan(table(spark, sf_dir, "documents")).drop("source")


def op11_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


QUERIES = {"op1_quality": op1_quality, "op3_url_filter": op3_url_filter, "op6_secrets": op6_secrets, "op10_mix": op10_mix, "op11_licenses": op11_licenses}

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_STEPS_SQL = ", ".join(f"({i}, {', '.join(f'{c!r}::DOUBLE' for c in cs)})" for i, cs in enumerate(zip(*RULES.values(), strict=True), 1))
_OVER_SQL = " OR ".join(f"{s} > c_{s}" for s in RULES)

OP1_SQL = rf"""
WITH t AS (
  SELECT doc_id, coalesce(lang, 'und') AS stratum,
    coalesce(text, '') AS x, {WORDS} AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
w AS (
  SELECT *, row_number() OVER () AS rid,
    CASE WHEN len(words) >= 5 THEN list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i+4], chr(32))) ELSE [] END AS wins
  FROM t),
ex AS (SELECT rid, unnest(wins) AS win, generate_subscripts(wins, 1) AS i FROM w),
dup AS (SELECT rid, i, i - lag(i, 1, -5) OVER (PARTITION BY rid ORDER BY i) AS gap FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS n FROM ex) WHERE n > 1),
rep AS (SELECT rid, sum(least(5, gap))::BIGINT AS n FROM dup GROUP BY rid),
f AS (
  SELECT doc_id, stratum, x, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
    (length(x) - length(regexp_replace(x, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
    len(lines) AS n_lines, length(x) - length(replace(x, '!', '')) AS n_bangs, length(x) - length(regexp_replace(x, '\p{{Lu}}', '', 'g')) AS n_upper
  FROM w LEFT JOIN rep USING (rid)),
g AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
    coalesce(n_symbols / nullif(word_chars, 0), 0) AS symbol_ratio, coalesce(n_bangs / nullif(word_chars, 0), 0) AS bang_ratio,
    coalesce(n_upper / nullif(word_chars, 0), 0) AS upper_ratio, coalesce(n_dup_lines / nullif(n_lines, 0), 0) AS dup_line_ratio,
    coalesce(n_repeat_words / nullif(n_words, 0), 0) AS repeat_ratio, coalesce(word_chars / nullif(n_words, 0), 0) AS word_length
  FROM f),
steps(step, {", ".join(f"c_{s}" for s in RULES)}) AS (VALUES {_STEPS_SQL}),
lab AS (SELECT doc_id, max(quality) AS good FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
trials AS (SELECT stratum, x, max(good) AS good, {", ".join(f"any_value({s}) AS {s}" for s in RULES)} FROM g JOIN lab USING (doc_id) WHERE NOT base_failed GROUP BY stratum, x),
sizes AS (SELECT *, row_number() OVER (ORDER BY n_good DESC, stratum) AS rank FROM (SELECT stratum, count(*) FILTER (good = 1) AS n_good FROM trials GROUP BY stratum)),
able AS (SELECT coalesce(max(rank) FILTER (n_good * ln(1 - {RISK!r}::DOUBLE) <= ln({DELTA!r}::DOUBLE / rank)), 0) AS tested FROM sizes),
counts AS (
  SELECT stratum, step, n_good, tested, count(*) FILTER (good = 1 AND ({_OVER_SQL})) AS k, count(*) FILTER (good <> 1 AND ({_OVER_SQL})) AS bad
  FROM trials JOIN sizes USING (stratum) JOIN able ON rank <= tested CROSS JOIN steps GROUP BY stratum, step, n_good, tested),
probed AS (
  SELECT *, CASE WHEN k > n_good * {RISK!r} THEN 1.0 ELSE
    list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n_good + 1) - lgamma(i + 1) - lgamma(n_good - i + 1)
      + i * ln({RISK!r}::DOUBLE) + (n_good - i) * ln(1 - {RISK!r}::DOUBLE)))) END AS p
  FROM counts),
passed AS (SELECT *, max(p) OVER (PARTITION BY stratum ORDER BY step) AS worst FROM probed),
best AS (
  SELECT stratum, step FROM passed WHERE worst <= {DELTA!r}::DOUBLE / tested AND bad - k > 0
  QUALIFY row_number() OVER (PARTITION BY stratum ORDER BY bad - k DESC, step) = 1),
judged AS (
  SELECT g.*, CASE {" ".join(f"WHEN {s} > c_{s} THEN '{s}'" for s in RULES)} END AS failed_rule FROM g LEFT JOIN best USING (stratum) LEFT JOIN steps USING (step))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND failed_rule IS NULL AS kept, failed_rule FROM judged
"""

OP3_SQL = rf"""
WITH u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, regexp_extract(coalesce(rest, ''), '^[^/?#]*') AS raw, coalesce(rest, '') AS rest FROM u),
p AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
rules(r_host, r_path, action) AS (VALUES {", ".join(f"('{h}', '{q}', '{a}')" for h, q, a in RULE_ROWS)}),
fit AS (
  SELECT page_id, max({{'n': length(r_host) + length(r_path), 'h': length(r_host), 'rule': r_host || r_path, 'action': action}}) AS best
  FROM p JOIN rules ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path) GROUP BY page_id)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.action, 'allow') AS verdict FROM p LEFT JOIN fit USING (page_id)
"""


def _spans_sql(name: str, pattern: str, kind: int, keep: str) -> str:
    quoted = pattern.replace("'", "''")
    return f"""
{name}_m AS (SELECT rid, regexp_extract_all(x, '{quoted}') AS m, regexp_split_to_array(x, '{quoted}') AS p FROM d WHERE regexp_matches(x, '{quoted}')),
{name}_u AS (SELECT rid, unnest(m) AS s, unnest(p[1:len(m)]) AS gap, generate_subscripts(m, 1) AS i FROM {name}_m),
{name}_e AS (SELECT rid, s, (sum(length(s) + length(gap)) OVER (PARTITION BY rid ORDER BY i))::BIGINT AS e FROM {name}_u),
{name} AS (SELECT rid, {kind} AS kind, e - length(s) AS a, e AS b FROM {name}_e WHERE {keep})"""


_ASSIGN_SQL = r'''(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?(?:[A-Za-z0-9+/_.=-]+)'''
_ASSIGN_KEEP = r'''length(regexp_extract(s, '((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2)) >= 12'''
_CLIENT_SQL = r'''(?:(?i:client_?id|user_?name|login))["']?\x20*[:=]\x20*["']?(?:[A-Za-z0-9@._-]+)'''
_CLIENT_KEEP = r'''length(regexp_extract(s, '((?i:client_?id|user_?name|login))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9@._-]+)', 2)) >= 4'''


def _beside_sql(table: str, *parts: str) -> str:
    '''Condition: a row of each of the parts is at most 300 code points from the row of ``table``.'''
    return " AND ".join(f"EXISTS (SELECT 1 FROM {p} z WHERE z.rid = {table}.rid AND z.a - {table}.b <= 300 AND {table}.a - z.b <= 300)" for p in parts)


OP6_SQL = rf'''
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS x FROM documents),
{_spans_sql("assign", _ASSIGN_SQL, 0, _ASSIGN_KEEP)},
{_spans_sql("access", "AKIA[A-Z0-9]+", 1, "length(s) >= 18")},
{_spans_sql("hexa", "[0-9a-f]+", 2, "length(s) >= 16")},
{_spans_sql("runs", "[A-Za-z0-9+/=]+", 3, "length(s) = 40 OR length(s) >= 100")},
{_spans_sql("temp", "ASIA[A-Z0-9]+", 4, "length(s) = 20")},
{_spans_sql("clients", _CLIENT_SQL, 5, _CLIENT_KEEP)},
{_spans_sql("accounts", "[0-9]+", 7, "length(s) = 12")},
{_spans_sql("ends", "https?://[A-Za-z0-9.-]+", 8, "true")},
weak AS (SELECT * FROM runs WHERE b - a = 40),
sessions AS (SELECT rid, 6 AS kind, a, b FROM runs WHERE b - a >= 100),
ids AS (SELECT * FROM access UNION ALL SELECT * FROM temp),
sec AS (SELECT * FROM weak WHERE {_beside_sql("weak", "ids")}),
tmp AS (SELECT * FROM temp WHERE {_beside_sql("temp", "weak")}),
cli AS (SELECT * FROM clients WHERE {_beside_sql("clients", "assign")}),
who AS (SELECT * FROM access UNION ALL SELECT * FROM tmp UNION ALL SELECT * FROM cli),
parts AS (SELECT * FROM sec UNION ALL SELECT * FROM assign),
ses AS (SELECT * FROM sessions WHERE {_beside_sql("sessions", "tmp", "sec")}),
acc AS (SELECT * FROM accounts WHERE {_beside_sql("accounts", "access", "sec")}),
eps AS (SELECT * FROM ends WHERE {_beside_sql("ends", "who", "parts")}),
base AS (SELECT * FROM assign UNION ALL SELECT * FROM access UNION ALL SELECT * FROM hexa),
added AS (SELECT * FROM sec UNION ALL SELECT * FROM tmp UNION ALL SELECT * FROM cli UNION ALL SELECT * FROM ses UNION ALL SELECT * FROM acc UNION ALL SELECT * FROM eps),
every AS (SELECT * FROM base UNION ALL SELECT * FROM added WHERE NOT EXISTS (SELECT 1 FROM base z WHERE z.rid = added.rid AND z.a < added.b AND added.a < z.b)),
named AS (SELECT rid, kind, a, b, {list(KINDS)!r}[kind + 1] || ':' || a || ':' || b AS s FROM every),
rolled AS (SELECT rid, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
  coalesce(string_agg(s, ',' ORDER BY a, kind) FILTER (kind < 3), '') AS base, string_agg(s, ',' ORDER BY a, kind) AS spans FROM named GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN rolled USING (rid)
'''

OP10_SQL = rf"""
WITH b AS (
  SELECT doc_id, source, len({WORDS})::BIGINT AS size, md5('mix:' || coalesce(doc_id::VARCHAR, 'null') || ':' || coalesce(md5(text), 'null')) AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM b GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM s),
w AS (SELECT *, (rank - 1) % 3 + 1 AS weight, source_size * 3 AS cap FROM r),
l AS (
  SELECT *, sum(source_size) OVER () AS total, sum(weight) OVER () AS all_w,
    coalesce(sum(cap) OVER f, 0) AS cap_before, coalesce(sum(weight) OVER f, 0) AS w_before
  FROM w WINDOW f AS (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, cap * 1.0::DOUBLE <= weight * ((total - cap_before)::DOUBLE / (all_w - w_before)::DOUBLE) AS capped FROM l),
e AS (SELECT *, coalesce(sum(cap) FILTER (capped) OVER (), 0) AS cap_sum, coalesce(sum(weight) FILTER (capped) OVER (), 0) AS w_sum FROM c),
t AS (SELECT source, source_size, CASE WHEN capped THEN cap::DOUBLE ELSE weight * ((total - cap_sum)::DOUBLE / nullif(all_w - w_sum, 0)::DOUBLE) END AS target FROM e),
p AS (
  SELECT b.*, t.source_size, t.target, round(t.target)::BIGINT AS budget,
    (sum(size) OVER (PARTITION BY b.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS start
  FROM b JOIN t ON b.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  (CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END * size
   + greatest(0, least(size, budget - CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END * source_size - start)))::BIGINT AS taken
FROM p
"""

_POSTINGS = ", ".join(f"({n}, '{label}', {round(1000 * share)}, {base}, {i}, '{w}', {i in keys})" for n, (label, words, keys, share, base) in enumerate(prepared(TEMPLATES, PHRASES, SHARE)) for i, w in enumerate(words))

OP11_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents),
t(number, label, share, base, position, word, key) AS (VALUES {_POSTINGS}),
w AS (SELECT rid, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS pos FROM d),
df AS (SELECT word, count(DISTINCT rid) AS n FROM w GROUP BY word),
weighed AS (SELECT t.*, greatest(1, round(1000 * ln(((SELECT count(*) FROM d) + 1) / coalesce(n, 1))))::BIGINT AS weight FROM t LEFT JOIN df USING (word)),
whole AS (SELECT number, sum(weight)::BIGINT AS total, count(*) FILTER (key) AS n_keys FROM weighed GROUP BY number),
met AS (
  SELECT rid, number, pos - position AS start, any_value(label) AS label, any_value(base) AS base, any_value(share) AS share,
    sum(weight)::BIGINT AS agreed, count(*) FILTER (key) AS keys
  FROM w JOIN weighed USING (word) WHERE pos >= position GROUP BY rid, number, start),
found AS (SELECT met.*, agreed / total AS part FROM met JOIN whole USING (number) WHERE keys = n_keys AND agreed >= (share * total + 999) // 1000),
rolled AS (
  SELECT rid, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(part) AS score
  FROM found GROUP BY rid)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM d LEFT JOIN rolled USING (rid)
"""

ORACLE = {"op1_quality": OP1_SQL, "op3_url_filter": OP3_SQL, "op6_secrets": OP6_SQL, "op10_mix": OP10_SQL, "op11_licenses": OP11_SQL}
