"""URL filter rules by a sort-merge range join (DataFrame functions only).

A host's labels in reverse order ("com.example.www.") make a key under which a
rule's host and all its subdomains are one interval. Rule hosts nest or are
apart, so a sweep in key order needs a stack of the rules now open. Each rule
host gives two rows to the sweep: at the interval's start the stack with it, at
the end the stack without it. A window carries the latest stack forward to the
urls, whose path then picks the longest fitting rule.

The sweep is dealt by top-level label and a salt of the page, so that a host or
a top-level domain with a third of all urls is many groups; the rules' rows are
repeated for each salt (2 x rule hosts x salts rows, no page is repeated).

Defined results: a null url or one without "://" has an empty host and path and
no rule; hosts are compared as they stand (a port or user name is part of
them); of rules of equal length the one with the longer host wins, then the
greater text; repeated pages are judged each; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facetlake.llm.common import ascii_lower

STACK = "array<struct<host:string,path:string,action:string>>"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    raw = F.regexp_extract(rest, "^[^/?#]*", 0)
    return ascii_lower(raw), F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.length(rest)), "^[^?#]*", 0)


def host_key(host: Column) -> Column:
    """"www.example.com" becomes "com.example.www."; every subdomain's key begins with the domain's."""
    return F.concat(F.array_join(F.reverse(F.split(host, "\\.")), "."), F.lit("."))


def sweep_rows(rules: DataFrame) -> DataFrame:
    """(key, stack): from ``key`` on, until the next row, the rules in ``stack`` are open.

    Ancestors meet by equality on their keys: a host of n labels has n of them.
    """
    by_host = rules.select(ascii_lower(F.col("host")).alias("host"), "path", "action").dropDuplicates().withColumn("key", host_key(F.col("host")))
    own = by_host.groupBy("key").agg(F.collect_list(F.struct("host", "path", "action")).cast(STACK).alias("own"))
    labels = F.split(F.rtrim(F.col("key"), F.lit(".")), "\\.")
    above = own.select("key", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.concat(F.array_join(F.slice(labels, 1, n), "."), F.lit(".")))).alias("up"))
    stacks = above.join(own.select(F.col("key").alias("up"), "own"), "up").groupBy("key").agg(
        F.flatten(F.collect_list("own")).cast(STACK).alias("with"),
        F.flatten(F.collect_list(F.when(F.col("up") != F.col("key"), F.col("own")))).cast(STACK).alias("without"),
    )
    ends = F.concat(F.substring(F.col("key"), F.lit(1), F.length("key") - 1), F.lit("/"))
    return stacks.select(F.inline(F.array(F.struct(F.col("key").alias("key"), F.col("with").alias("stack")), F.struct(ends.alias("key"), F.col("without").alias("stack")))), F.substring_index("key", ".", 1).alias("top"))


def judge_urls(pages: DataFrame, rules: DataFrame, *, url: str = "url", page_id: str = "page_id", salts: int = 256, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule (host and path, or null), verdict for every row of ``pages``.

    rules: host, path, action ("allow" or "block").
    """
    host, path = host_and_path(F.col("url"))
    urls = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url")).select("page_id", host.alias("host"), path.alias("path"), F.pmod(F.xxhash64("page_id", "url"), F.lit(salts)).cast("int").alias("salt"))
    urls = urls.withColumn("key", host_key(F.col("host"))).withColumn("top", F.substring_index("key", ".", 1))
    events = sweep_rows(rules).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    rows = urls.select("top", "salt", "key", F.lit(1).alias("is_url"), F.lit(None).cast(STACK).alias("stack"), "page_id", "host", "path").unionByName(
        events.select("top", "salt", "key", F.lit(0).alias("is_url"), "stack"), allowMissingColumns=True
    )
    order = Window.partitionBy("top", "salt").orderBy("key", "is_url").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    opened = rows.withColumn("open", F.last("stack", ignorenulls=True).over(order)).filter("is_url = 1")
    fitting = F.filter(F.col("open"), lambda r: F.startswith(F.col("path"), r["path"]))
    best = F.array_max(F.transform(fitting, lambda r: F.struct((F.length(r["host"]) + F.length(r["path"])).alias("n"), F.length(r["host"]).alias("h"), F.concat(r["host"], r["path"]).alias("rule"), r["action"].alias("action"))))
    return opened.withColumn("best", best).select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce(F.col("best.action"), F.lit(default)).alias("verdict"))
