"""Secret scans with multipart credential linking (DataFrame functions only).

Strong patterns are reported by themselves. Weak candidates are reported only
where the parts that complete them lie in one scope with them:

| kind | candidate | needs |
|---|---|---|
| weak_secret | a run of exactly 40 base64 characters | an access identifier, lasting or temporary |
| temp_access | a temporary access identifier | a weak secret |
| client | a client or user name with its value | an assigned secret |
| session | a run of 100 or more base64 characters | a reported temporary identifier and a reported weak secret |
| account | a run of exactly 12 digits | a lasting access identifier and a reported weak secret |
| endpoint | a URL's scheme and host | a reported identifier or client, and a reported or assigned secret |

Two spans share a scope if at most ``scope`` code points lie between the end of
one and the start of the other. The interval join deals spans by (row, cell), a
cell being ``scope`` code points, to all cells that they cover; a part also goes to
the cells beside, and as the join is a semi join no pair is ever made. A weak span that overlaps a
strong one is not reported again, but counts as a part.

Positions come from the same matcher as the matches: the pieces between matches
and the matches themselves, laid end to end, give every offset by a running sum
over a row's matches. So the work grows with the text and its matches only.

Defined results: a null or empty text has no spans and the digest of the empty
string; documents with repeated or null ids are kept apart by row; equal starts
are listed in the order of ``KINDS``; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facetlake.llm.common import let, written

#: In the order in which equal starts are listed.
KINDS = ("assign", "access", "hex", "weak_secret", "temp_access", "client", "session", "account", "endpoint")
ASSIGN = "((?i:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
CLIENT = "((?i:client_?id|user_?name|login))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9@._-]+)"
ACCESS = "AKIA[A-Z0-9]{14,}"
HEX = "[0-9a-f]{16,}"
TEMP = "ASIA[A-Z0-9]{16,}"
RUN = "[A-Za-z0-9+/=]{40,}"
DIGITS = "[0-9]{12,}"
ENDPOINT = "https?://[A-Za-z0-9.-]+"
SPANS = "array<struct<start:bigint,kind:int,end:bigint>>"
MATCH = "array<struct<pattern:int,i:int,gap:int,n:int,kind:int>>"


def matches(text: Column, number: int, pattern: str, kind, group: int = 0) -> Column:
    """(pattern, i, gap before it, length, kind or null) of the leftmost non-overlapping matches; ``kind`` gets the length of ``group``."""
    made = let(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda m: let(
            F.split(text, pattern, -1),
            lambda p: F.transform(
                m,
                lambda x, i: F.struct(
                    F.lit(number).alias("pattern"), i.alias("i"), F.length(F.get(p, i)).alias("gap"), F.length(x).alias("n"), kind(F.length(F.regexp_extract(x, pattern, group) if group else x)).cast("int").alias("kind")
                ),
            ),
        ),
    )
    return F.when(F.regexp_like(text, F.lit(pattern)), made).otherwise(F.array().cast(MATCH))


def one_kind(name: str, test=None):
    """The kind's number if the length passes the test."""
    number = F.lit(KINDS.index(name))
    return lambda n: F.when(test(n), number) if test else number


def run_kind(n: Column) -> Column:
    return F.when(n == 40, F.lit(KINDS.index("weak_secret"))).when(n >= 100, F.lit(KINDS.index("session")))


def listed(spans: Column) -> Column:
    """kind:start:end of sorted spans, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.sort_array(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def all_spans(docs: DataFrame) -> DataFrame:
    """(row, start, kind, end) of all strong and weak candidates; docs: row, text."""
    t, none = F.col("text"), F.array().cast(MATCH)
    strong = docs.select(
        "row",
        "text",
        matches(t, 0, ASSIGN, one_kind("assign", lambda n: n >= 12), 2).alias("assign"),
        matches(t, 1, ACCESS, one_kind("access")).alias("access"),
        matches(t, 2, HEX, one_kind("hex")).alias("hex"),
        F.when(F.contains(t, F.lit("ASIA")), matches(t, 3, TEMP, one_kind("temp_access", lambda n: n == 20))).otherwise(none).alias("temp"),
    )
    keyed = (F.size("access") > 0) | (F.size("temp") > 0)
    linked = keyed | (F.size("assign") > 0)
    weak = [
        F.when(keyed, matches(t, 4, RUN, run_kind)).otherwise(none),
        F.when(F.size("assign") > 0, matches(t, 5, CLIENT, one_kind("client", lambda n: n >= 4), 2)).otherwise(none),
        F.when(keyed, matches(t, 6, DIGITS, one_kind("account", lambda n: n == 12))).otherwise(none),
        F.when(linked, matches(t, 7, ENDPOINT, one_kind("endpoint"))).otherwise(none),
    ]
    found = strong.select("row", F.inline(F.concat("assign", "access", "hex", "temp", *weak)))
    at = Window.partitionBy("row", "pattern").orderBy("i")
    end = F.sum((F.col("gap") + F.col("n")).cast("bigint")).over(at)
    return found.withColumn("end", end).filter("kind is not null").select("row", (F.col("end") - F.col("n")).alias("start"), "kind", "end")


def find_secrets(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", scope: int = 300) -> DataFrame:
    """doc_id, base (strong spans) and added (linked weak spans), each an array of (start, kind, end)."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    #: ids and spans of one scan, so that row numbers agree
    kept = written(rows.select("row", "doc_id", matched(F.col("text")).alias("text")), "secret-rows")
    spans = written(all_spans(kept.filter("text is not null").select("row", "text")), "secret-spans")
    strong = spans.filter(F.col("kind") < 3)
    added = outside(link_parts(spans, scope), strong, scope)
    both = strong.unionByName(added).groupBy("row").agg(F.collect_list(F.when(F.col("kind") < 3, F.struct("start", "kind", "end"))).alias("base"), F.collect_list(F.when(F.col("kind") >= 3, F.struct("start", "kind", "end"))).alias("added"))
    none = F.array().cast(SPANS)
    return kept.select("row", "doc_id").join(both, "row", "left").select("doc_id", F.coalesce("base", none).cast(SPANS).alias("base"), F.coalesce("added", none).cast(SPANS).alias("added"))


def matched(text: Column) -> Column:
    """The text if it has any strong match or temporary identifier, else null."""
    strong = F.regexp_like(text, F.lit(ASSIGN)) | F.regexp_like(text, F.lit(ACCESS)) | F.regexp_like(text, F.lit(HEX)) | F.contains(text, F.lit("ASIA"))
    return F.when(strong, text)


SPAN = ["row", "start", "kind", "end"]


def cells(first: Column, last: Column, scope: int, margin: int = 0) -> Column:
    """The cells from one place to another, and ``margin`` more on both sides."""
    return F.explode(F.sequence(F.floor(first / scope) - margin, F.floor(last / scope) + margin))


def dealt(spans: DataFrame, prefix: str, scope: int, margin: int = 0) -> DataFrame:
    return spans.withColumn("cell", cells(F.col("start"), F.col("end"), scope, margin)).select("row", "cell", *[F.col(c).alias(f"{prefix}{c}") for c in ("start", "kind", "end")])


def beside(spans: DataFrame, parts: DataFrame, scope: int) -> DataFrame:
    """The spans with a part at most ``scope`` away; both: row, start, kind, end.

    Spans go to the cells that they cover, parts to theirs and one more on each side; the
    lengths of a kind's spans add up to no more than the text, so the rows do too.
    """
    near = (F.col("p_start") - F.col("end") <= scope) & (F.col("start") - F.col("p_end") <= scope)
    s, p = dealt(spans, "", scope).alias("s"), dealt(parts, "p_", scope, 1).alias("p")
    return s.join(p, (F.col("s.row") == F.col("p.row")) & (F.col("s.cell") == F.col("p.cell")) & near, "left_semi").select(*SPAN).distinct()


def outside(spans: DataFrame, base: DataFrame, scope: int) -> DataFrame:
    """The spans that overlap no base span."""
    over = (F.col("p_start") < F.col("end")) & (F.col("start") < F.col("p_end"))
    s, p = dealt(spans, "", scope).alias("s"), dealt(base, "p_", scope).alias("p")
    covered = s.join(p, (F.col("s.row") == F.col("p.row")) & (F.col("s.cell") == F.col("p.cell")) & over, "left_semi").select(*SPAN).distinct()
    return spans.join(covered, SPAN, "left_anti")


def link_parts(spans: DataFrame, scope: int) -> DataFrame:
    """Weak spans (row, start, kind, end) with their complements in scope."""
    part = lambda *names: spans.filter(F.col("kind").isin(*[KINDS.index(n) for n in names]))
    secrets = beside(part("weak_secret"), part("access", "temp_access"), scope)
    temporary = beside(part("temp_access"), part("weak_secret"), scope)
    clients = beside(part("client"), part("assign"), scope)
    first = written(secrets.unionByName(temporary).unionByName(clients), "secret-links")
    linked = lambda *names: first.filter(F.col("kind").isin(*[KINDS.index(n) for n in names]))
    sessions = beside(beside(part("session"), linked("temp_access"), scope), linked("weak_secret"), scope)
    accounts = beside(beside(part("account"), part("access"), scope), linked("weak_secret"), scope)
    who = part("access").unionByName(linked("temp_access", "client"))
    endpoints = beside(beside(part("endpoint"), who, scope), part("assign").unionByName(linked("weak_secret")), scope)
    return first.unionByName(sessions).unionByName(accounts).unionByName(endpoints)
