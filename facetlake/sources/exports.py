"""An export that resumes: records go out in batches, each finished by a small manifest of its own.

A record's batch is a hash of its key, so each run deals alike. A batch is a folder; it
counts once its manifest stands beside it, written after its files. A run that ends early
leaves folders without a manifest, which the next run replaces; finished batches are
neither read nor written again, unless their signature (what they were made from) differs.
Counts are taken from the written files: counts observed while writing may tell of a task's
rows twice where a lost executor's stage runs again.
"""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from facetlake.operators.gates import GateError, require_none
from facetlake.sources.tables import exists, hadoop_path, read_json, write_json

#: The column that names the folders of batches.
BATCH = "export_batch"


def batch_of(key: Column, batches: int) -> Column:
    return F.pmod(F.xxhash64(key.cast("string")), F.lit(batches)).cast("int")


def _manifest(out: str, batch: int) -> str:
    return f"{out}/manifests/batch-{batch:06}.json"


def finished(spark: SparkSession, out: str, signature: str) -> dict[int, dict]:
    """Manifests of the batches that were finished under this signature: a small file a batch, read at once."""
    fs, pattern = hadoop_path(spark, f"{out}/manifests/batch-*.json")
    if not fs.globStatus(pattern):
        return {}
    said = [json.loads(r["value"]) for r in spark.read.text(f"{out}/manifests/batch-*.json", wholetext=True).collect()]
    return {m["batch"]: m for m in said if m["signature"] == signature}


def export(records: DataFrame, out: str, key: str, *, batches: int, signature: str, coverage: Mapping[str, Column] | None = None, wave: int = 16, waves: int | None = None) -> dict | None:
    """Write what is missing of ``records`` (a row a key) below ``out``; the manifest of the whole, or None while batches are missing.

    A wave writes ``wave`` batches in one job with dynamic partition overwrite, then counts
    their rows and coverage (records for which a column holds; null: it doesn't) in one read.
    ``waves`` bounds the work of this run. A batch without records has a manifest of zero
    rows. The manifest of the whole comes last: an export without one is unfinished. A null
    key, one key in two rows or a column named like the batch is an error. Choose
    ``batches`` so that a batch is one file, and keep it: it is part of the signature.
    """
    spark, signature = records.sparkSession, f"{signature}/{batches}/{key}"
    if BATCH in records.columns:
        raise GateError(f"records hold a column {BATCH}")
    done = finished(spark, out, signature)
    todo = [b for b in range(batches) if b not in done]
    if todo:
        _drop(spark, f"{out}/manifest.json")
    dealt = records.withColumn(BATCH, batch_of(F.col(key), batches))
    for start in range(0, len(todo), wave)[:waves]:
        some = todo[start : start + wave]
        for b in some:
            _drop(spark, _manifest(out, b))
            _drop(spark, f"{out}/records/{BATCH}={b}")
        mine = dealt.filter(F.col(BATCH).isin(some)).repartition(len(some), BATCH).sortWithinPartitions(BATCH, key)
        mine.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BATCH).parquet(f"{out}/records")
        counts = _counts(_read(spark, records, out).filter(F.col(BATCH).isin(some)), key, coverage or {})
        for b in some:
            done[b] = {"batch": b, "signature": signature, **counts.get(b, _none(coverage))}
            write_json(_manifest(out, b), done[b], spark)
    if len(done) < batches:
        return None
    whole = {"signature": signature, "batches": batches, **_total(done, coverage)}
    write_json(f"{out}/manifest.json", whole, spark)
    return whole


def _none(coverage: Mapping[str, Column] | None) -> dict:
    return {"rows": 0, "coverage": dict.fromkeys(coverage or {}, 0)}


def _total(done: Mapping[int, dict], coverage: Mapping[str, Column] | None) -> dict:
    return {"rows": sum(m["rows"] for m in done.values()), "coverage": {name: sum(m["coverage"][name] for m in done.values()) for name in coverage or {}}}


def _counts(rows: DataFrame, key: str, coverage: Mapping[str, Column]) -> dict[int, dict]:
    """batch -> rows and coverage of written batches, a row a batch; bad keys are an error."""
    held = [F.count_if(F.coalesce(holds, F.lit(False))).alias(f"c{i}") for i, holds in enumerate(coverage.values())]
    each = rows.groupBy(BATCH, key).agg(F.count("*").alias("n"), *held)
    bad = F.col(key).isNull() | (F.col("n") > 1)
    found = each.groupBy(BATCH).agg(F.sum("n").alias("n"), F.count_if(bad).alias("bad"), F.min(F.when(bad, F.coalesce(F.col(key).cast("string"), F.lit("null")))).alias("example"), *[F.sum(f"c{i}").alias(f"c{i}") for i in range(len(held))]).collect()
    for r in found:
        if r["bad"]:
            raise GateError(f"{r['bad']} keys are null or repeat in batch {r[BATCH]}, such as {r['example']}")
    return {r[BATCH]: {"rows": r["n"], "coverage": {name: r[f"c{i}"] for i, name in enumerate(coverage)}} for r in found}


def _drop(spark: SparkSession, path: str) -> None:
    fs, at = hadoop_path(spark, path)
    fs.delete(at, True)


def _read(spark: SparkSession, records: DataFrame, out: str) -> DataFrame:
    schema = records.withColumn(BATCH, F.lit(0)).schema
    return spark.read.schema(schema).parquet(f"{out}/records") if exists(spark, f"{out}/records") else spark.createDataFrame([], schema)


def exported(spark: SparkSession, records: DataFrame, out: str) -> DataFrame:
    """The records (of the schema of ``records``) of a finished export, after the count of its files was held against the manifest."""
    if not exists(spark, f"{out}/manifest.json"):
        raise GateError(f"{out} is unfinished")
    said, rows = read_json(f"{out}/manifest.json", spark), _read(spark, records, out).drop(BATCH)
    if (n := rows.count()) != said["rows"]:
        raise GateError(f"{out} holds {n} records, its manifest says {said['rows']}")
    return rows


def pending(todo: DataFrame, out: str, key: str, *, batches: int, signature: str) -> DataFrame:
    """Rows of ``todo`` whose batch isn't finished: a test of the key's own hash, without a join or a read of the records."""
    done = finished(todo.sparkSession, out, f"{signature}/{batches}/{key}")
    left = [b for b in range(batches) if b not in done]
    return todo.filter(batch_of(F.col(key), batches).isin(left) if left else F.lit(False))


def restore(records: DataFrame, out: str, key: str, *, batches: int, signature: str, coverage: Mapping[str, Column] | None = None) -> dict:
    """Rebuild lost batch manifests from the files of a finished export; the manifest of the whole.

    Each record must lie in its key's batch, and rows and coverage must add up to the
    manifest of the whole; nothing is written otherwise.
    """
    spark = records.sparkSession
    whole = read_json(f"{out}/manifest.json", spark)
    if whole["signature"] != f"{signature}/{batches}/{key}":
        raise GateError("the export was made from something else")
    rows = _read(spark, records, out)
    require_none(rows.filter(F.col(BATCH) != batch_of(F.col(key), batches)).select(key), "a record lies in another batch than its own")
    counts = _counts(rows, key, coverage or {})
    done = {b: {"batch": b, "signature": whole["signature"], **counts.get(b, _none(coverage))} for b in range(batches)}
    got = _total(done, coverage)
    if got != {"rows": whole["rows"], "coverage": {name: whole["coverage"].get(name) for name in coverage or {}}}:
        raise GateError(f"the files hold {got}, the manifest says otherwise")
    for b, manifest in done.items():
        write_json(_manifest(out, b), manifest, spark)
    return whole
