"""Readers and writers: strict JSON lines, manifests, completed-record checkpoints, signed records, judged pools."""

from __future__ import annotations

import hashlib
import json
import re
import tarfile
import zipfile
from collections.abc import Iterable, Sequence
from pathlib import Path, PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from facetlake.operators.gates import GateError, require_none


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """One JSON object a line, of exactly this shape; anything else fails the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_jsonl(df: DataFrame, path: str, order: Sequence[str] = (), mode: str = "errorifexists") -> None:
    """Keys sorted, rows in a total order over the part files; the commit is atomic a job."""
    rows = df.select(*sorted(df.columns))
    (rows.orderBy(*order) if order else rows).write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_csv(df: DataFrame, path: str, columns: Sequence[str], mode: str = "errorifexists") -> None:
    """A summary of few rows as one file with a header; other columns are left out."""
    df.select(*columns).coalesce(1).write.mode(mode).option("header", True).csv(path)


def markdown(df: DataFrame, columns: Sequence[str], limit: int = 1000) -> str:
    """A small result as a table; null is N/A. More rows than ``limit`` are an error."""
    rows = df.select(*columns).limit(limit + 1).collect()
    if len(rows) > limit:
        raise GateError(f"a report holds up to {limit} rows")
    show = lambda v: "N/A" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)
    return "\n".join(["| " + " | ".join(r) + " |" for r in [list(columns), ["---"] * len(columns), *[[show(r[c]) for c in columns] for r in rows]]]) + "\n"


def hadoop_path(spark: SparkSession, path: str | Path):
    """(file system, path) of any store that Spark reads."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(str(path))
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def write_text(path: str | Path, text: str, spark: SparkSession | None = None) -> None:
    """A small document for people, replaced as a whole, in the store that the path names."""
    spark = spark or SparkSession.active()
    fs, target = hadoop_path(spark, path)
    _, part = hadoop_path(spark, f"{path}.part")
    out = fs.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    fs.delete(target, False)
    if not fs.rename(part, target):
        raise OSError(f"{path} was not written")


def write_json(path: str | Path, value: object, spark: SparkSession | None = None) -> None:
    write_text(path, json.dumps(value, ensure_ascii=False, indent=2, sort_keys=True) + "\n", spark)


def exists(spark: SparkSession, path: str | Path) -> bool:
    fs, at = hadoop_path(spark, path)
    return fs.exists(at)


def read_json(path: str | Path, spark: SparkSession | None = None) -> object:
    spark = spark or SparkSession.active()
    return json.loads(spark.read.text(str(path), wholetext=True).first()["value"])


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of files, read by Spark and so from any store."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def table_digest(df: DataFrame) -> dict[str, object]:
    """Rows and an order-free digest of a table: what a manifest says of it."""
    row = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
    part = lambda a: F.sum(F.conv(F.substring("_h", a, 8), 16, 10).cast("decimal(38,0)"))
    got = df.select(row.alias("_h")).agg(F.count("*").alias("n"), *[part(1 + 8 * i).alias(f"p{i}") for i in range(4)]).first()
    text = ":".join(str(got[f"p{i}"] or 0) for i in range(4))
    return {"rows": got["n"], "sha256": hashlib.sha256(f"{got['n']}:{text}".encode()).hexdigest()}


def write_dataset(tables: dict[str, DataFrame], hidden: dict[str, DataFrame], out: str, truth: str, settings: dict, code: Iterable[Path] = ()) -> dict:
    """Observable and hidden tables under folders that don't nest, the manifest last: a dataset without one is unfinished."""
    a, b = PurePosixPath(out), PurePosixPath(truth)
    if a == b or a in b.parents or b in a.parents:
        raise GateError("observable and hidden folders must be apart")
    manifest = {"settings": settings, "tables": {}, "hidden": {}, "code": {p.name: hashlib.sha256(p.read_bytes()).hexdigest() for p in code}}
    for kind, folder, group in (("tables", out, tables), ("hidden", truth, hidden)):
        for name, df in group.items():
            df.write.mode("errorifexists").parquet(f"{folder}/{name}.parquet")
            manifest[kind][name] = table_digest(df.sparkSession.read.parquet(f"{folder}/{name}.parquet"))
    write_json(f"{out}/manifest.json", manifest)
    return manifest


def check_manifest(spark: SparkSession, out: str, truth: str | None = None) -> dict:
    """The manifest, after its tables were read again and found the same."""
    manifest = read_json(f"{out}/manifest.json", spark)
    for kind, folder in (("tables", out), ("hidden", truth)):
        for name, said in manifest[kind].items() if folder else ():
            if table_digest(spark.read.parquet(f"{folder}/{name}.parquet")) != said:
                raise GateError(f"{name} differs from its manifest")
    return manifest


def remaining(todo: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What a resumed run has left: rows without a completed record."""
    return todo.join(done.select(*keys), list(keys), "left_anti")


def signed(df: DataFrame, signature: str) -> DataFrame:
    """Records in an envelope: signature, record_sha256, record (JSON with sorted keys)."""
    record = F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})
    return df.select(F.lit(signature).alias("signature"), F.sha2(record, 256).alias("record_sha256"), record.alias("record"))


def opened(envelopes: DataFrame, signature: str, schema: StructType) -> DataFrame:
    """The records of envelopes, after the gate that each has this signature and its own digest."""
    require_none(envelopes.filter((F.col("signature") != signature) | (F.sha2("record", 256) != F.col("record_sha256"))).select("record_sha256"), "a record doesn't match its envelope")
    return envelopes.select(F.from_json("record", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def judged_pool(spark: SparkSession, path: str, facet: str) -> DataFrame:
    """(facet, query_id, paper_id, relevance) of a JSON object: query -> {"cands": [...], "relevance_adju": [...]}."""
    pool = "struct<cands:array<string>,relevance_adju:array<double>>"
    read = spark.read.text(path, wholetext=True).select(F.from_json("value", f"map<string,{pool}>", {"mode": "FAILFAST"}).alias("m"))
    each = read.select(F.explode("m").alias("query_id", "pool"))
    return each.select(F.lit(facet).alias("facet"), "query_id", F.inline(F.arrays_zip(F.col("pool.cands").alias("paper_id"), F.col("pool.relevance_adju").alias("relevance"))))


def judged_pools(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """The pools of all facets; paths: facet -> path."""
    out = None
    for facet, path in sorted(paths.items()):
        part = judged_pool(spark, path, facet)
        out = part if out is None else out.unionByName(part)
    return out


def inside(root: str | Path, name: str) -> Path:
    """A path under ``root``; one that leads out is an error."""
    base = Path(root).resolve()
    path = (base / name).resolve()
    if path != base and base not in path.parents:
        raise GateError(f"{name} leaves {root}")
    return path


def unpack(archive: str | Path, target: str | Path) -> list[Path]:
    """The files of a zip or tar.gz archive without their first folder. Links, climbing names and changed overwrites are errors."""
    out = []

    def place(name: str, data: bytes) -> None:
        parts = PurePosixPath(name.replace("\\", "/"))
        if parts.is_absolute() or ".." in parts.parts or re.match(r"^[A-Za-z]:", name):
            raise GateError(f"unsafe name in the archive: {name}")
        if len(parts.parts) < 2:
            return
        path = inside(target, str(PurePosixPath(*parts.parts[1:])))
        if path.exists() and path.read_bytes() != data:
            raise GateError(f"{path} exists with other content")
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
        out.append(path)

    if zipfile.is_zipfile(archive):
        with zipfile.ZipFile(archive) as z:
            for info in z.infolist():
                if (info.external_attr >> 16) & 0o170000 == 0o120000:
                    raise GateError(f"a link in the archive: {info.filename}")
                if not info.is_dir():
                    place(info.filename, z.read(info))
    else:
        with tarfile.open(archive) as t:
            for info in t:
                if not (info.isfile() or info.isdir()):
                    raise GateError(f"neither file nor folder in the archive: {info.name}")
                if info.isfile():
                    place(info.name, t.extractfile(info).read())
    return out
