import json
import tarfile
import time
import zipfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from facetlake.operators.gates import GateError
from facetlake.sources import tables as S
from facetlake.streaming import periods


def test_json_lines(spark, tmp_path):
    df = spark.createDataFrame([(2, None), (1, "é")], "b int, a string")
    S.write_jsonl(df, f"{tmp_path}/x", ["b"])
    lines = [line for p in sorted(tmp_path.glob("x/part-*")) for line in p.read_text().splitlines()]
    assert lines == ['{"a":"é","b":1}', '{"a":null,"b":2}']
    assert S.read_jsonl(spark, f"{tmp_path}/x", df.schema).count() == 2
    (tmp_path / "bad.json").write_text('{"b": "no int"}\n')
    with pytest.raises(Exception, match="(?i)malformed|failfast|parse"):
        S.read_jsonl(spark, f"{tmp_path}/bad.json", df.schema).collect()


def test_reports_and_digests(spark, tmp_path):
    df = spark.createDataFrame([("m", 0.5, 1), ("n", None, 2)], "model string, ndcg double, extra int")
    S.write_csv(df, f"{tmp_path}/c", ["model", "ndcg"])
    assert next(tmp_path.glob("c/part-*")).read_text().splitlines()[0] == "model,ndcg"
    assert "| n | N/A |" in S.markdown(df, ["model", "ndcg"])
    assert S.table_digest(df) == S.table_digest(df.repartition(3)) != S.table_digest(df.withColumn("extra", F.lit(1)))
    assert S.file_digests(spark, f"file://{tmp_path}/c").count() >= 1


def test_dataset_and_manifest(spark, tmp_path):
    df = spark.range(5)
    S.write_dataset({"t": df}, {"h": df}, f"{tmp_path}/out", f"{tmp_path}/truth", {"seed": 1})
    assert S.check_manifest(spark, f"{tmp_path}/out", f"{tmp_path}/truth")["settings"] == {"seed": 1}
    spark.range(6).write.mode("overwrite").parquet(f"{tmp_path}/out/t.parquet")
    with pytest.raises(GateError):
        S.check_manifest(spark, f"{tmp_path}/out")
    with pytest.raises(GateError):
        S.write_dataset({}, {}, f"{tmp_path}/a", f"{tmp_path}/a/b", {})


def test_signed_records(spark):
    df = spark.createDataFrame([(1, "x")], "a int, b string")
    sealed = S.signed(df, "run-1")
    assert [tuple(r) for r in S.opened(sealed, "run-1", StructType(df.schema.fields)).collect()] == [(1, "x")]
    with pytest.raises(GateError):
        S.opened(sealed, "run-2", df.schema)
    with pytest.raises(GateError):
        S.opened(sealed.withColumn("record", F.lit("{}")), "run-1", df.schema)
    assert S.remaining(spark.range(5), spark.range(3), ["id"]).count() == 2


def test_judged_pools(spark, tmp_path):
    for facet in ("task", "method"):
        (tmp_path / f"{facet}.json").write_text(json.dumps({"q": {"cands": ["a", "b"], "relevance_adju": [2, 0]}}))
    got = S.judged_pools(spark, {f: f"{tmp_path}/{f}.json" for f in ("task", "method")})
    assert sorted(map(tuple, got.collect())) == [(f, "q", p, r) for f in ("method", "task") for p, r in (("a", 2.0), ("b", 0.0))]


def test_archives(tmp_path):
    (tmp_path / "f.txt").write_text("x")
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("top/in/f.txt", "x")
    with tarfile.open(tmp_path / "a.tar.gz", "w:gz") as t:
        t.add(tmp_path / "f.txt", "top/f.txt")
    assert [p.name for p in S.unpack(tmp_path / "a.zip", tmp_path / "o")] == ["f.txt"] and S.unpack(tmp_path / "a.tar.gz", tmp_path / "o")
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("top/in/f.txt", "changed")
    with zipfile.ZipFile(tmp_path / "c.zip", "w") as z:
        z.writestr("top/../../f.txt", "x")
    for name in ("b.zip", "c.zip"):
        with pytest.raises(GateError):
            S.unpack(tmp_path / name, tmp_path / "o")
    with pytest.raises(GateError):
        S.inside(tmp_path, "../x")


def test_stream_equals_batch(spark, sf, tmp_path):
    from facetlake.queries.base import reactions

    rows = reactions(spark, sf)
    rows.coalesce(2).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    counts = periods.period_counts(periods.once(stream, ["event_id"], "60 days"), late=None)
    query = counts.writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{tmp_path}/state").option("path", f"{tmp_path}/out").trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    time.sleep(0.1)
    done = spark.read.schema(counts.schema).parquet(f"{tmp_path}/out")
    batch = {tuple(r) for r in periods.period_counts(rows).collect()}
    assert {tuple(r) for r in done.collect()} <= batch
    memory = periods.period_counts(stream).writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    assert memory.awaitTermination(120)
    assert {tuple(r) for r in spark.table("counts").collect()} == batch
