"""Exports that are broken off and resumed."""

import pytest
from pyspark.sql import functions as F

from facetlake.operators.gates import GateError
from facetlake.sources import exports as O
from facetlake.sources import tables as S

HOW = {"batches": 10, "signature": "v1"}


@pytest.fixture(scope="module")
def cover(spark):
    return {"task": F.size("task") > 0, "long": F.length("note") > 3}


@pytest.fixture
def papers(spark):
    task, note = F.when(F.col("id") % 3 > 0, F.array(F.lit("t"))).otherwise(F.array().cast("array<string>")), F.when(F.col("id") % 4 > 0, F.repeat(F.lit("x"), (F.col("id") % 7).cast("int")))
    return spark.range(200).select(F.concat(F.lit("P"), F.col("id")).alias("paper_id"), task.alias("task"), note.alias("note"))


def files(folder):
    return {p: p.stat().st_mtime_ns for p in folder.rglob("*.parquet")}


def counted(papers):
    rows = papers.collect()
    return {"task": sum(len(r.task) > 0 for r in rows), "long": sum(len(r.note or "") > 3 for r in rows)}


def test_broken_off_in_a_write_and_resumed(spark, papers, cover, tmp_path):
    out = str(tmp_path / "out")
    last = papers.filter(O.batch_of(F.col("paper_id"), 10) == 7).first().paper_id
    broken = papers.withColumn("note", F.when(F.col("paper_id") == last, F.raise_error(F.lit("lost"))).otherwise(F.col("note")))
    with pytest.raises(Exception, match="lost"):
        O.export(broken, out, "paper_id", **HOW, coverage=cover, wave=2)
    assert sorted(O.finished(spark, out, "v1/10/paper_id")) == [0, 1, 2, 3, 4, 5]
    with pytest.raises(GateError, match="unfinished"):
        O.exported(spark, papers, out)
    before = files(tmp_path / "out")
    left = O.pending(papers, out, "paper_id", **HOW)
    assert {r.b for r in left.select(O.batch_of(F.col("paper_id"), 10).alias("b")).distinct().collect()} == {6, 7, 8, 9}
    said = O.export(papers, out, "paper_id", **HOW, coverage=cover, wave=3)
    assert said["rows"] == 200 and said["coverage"] == counted(papers)
    assert before.items() <= files(tmp_path / "out").items()
    assert sorted(map(str, O.exported(spark, papers, out).collect())) == sorted(map(str, papers.collect()))
    assert O.pending(papers, out, "paper_id", **HOW).isEmpty()


def test_broken_off_between_files_and_manifest(spark, papers, cover, tmp_path, monkeypatch):
    out, write = str(tmp_path / "out"), O.write_json

    def stops(path, value, session):
        if "batch-000004" in path:
            raise OSError("stopped")
        write(path, value, session)

    monkeypatch.setattr(O, "write_json", stops)
    with pytest.raises(OSError, match="stopped"):
        O.export(papers, out, "paper_id", **HOW, wave=6)
    monkeypatch.setattr(O, "write_json", write)
    assert sorted(O.finished(spark, out, "v1/10/paper_id")) == [0, 1, 2, 3]
    #: Files without a manifest are replaced, also by fewer records.
    fewer = papers.filter(~O.batch_of(F.col("paper_id"), 10).isin(4))
    assert O.export(fewer, out, "paper_id", **HOW)["rows"] == fewer.count() == O.exported(spark, papers, out).count()


def test_another_signature_and_a_lost_file(spark, papers, cover, tmp_path):
    out = str(tmp_path / "out")
    assert O.export(papers, out, "paper_id", **HOW, waves=0) is None
    O.export(papers, out, "paper_id", **HOW)
    again = papers.withColumn("note", F.lit("new"))
    O.export(again, out, "paper_id", **HOW)
    assert O.exported(spark, papers, out).filter("note = 'new'").isEmpty()
    O.export(again, out, "paper_id", batches=10, signature="v2")
    assert O.exported(spark, papers, out).filter("note = 'new'").count() == 200
    next((tmp_path / "out").rglob("*.parquet")).unlink()
    with pytest.raises(GateError, match="its manifest says 200"):
        O.exported(spark, papers, out)


def test_restore(spark, papers, cover, tmp_path):
    out = str(tmp_path / "out")
    said = O.export(papers, out, "paper_id", **HOW, coverage=cover)
    kept = O.finished(spark, out, said["signature"])
    for p in (tmp_path / "out" / "manifests").glob("*.json"):
        p.unlink()
    assert O.restore(papers, out, "paper_id", **HOW, coverage=cover) == said and O.finished(spark, out, said["signature"]) == kept
    with pytest.raises(GateError, match="something else"):
        O.restore(papers, out, "paper_id", batches=10, signature="v9")
    S.write_json(f"{out}/manifest.json", said | {"rows": 199}, spark)
    with pytest.raises(GateError, match="otherwise"):
        O.restore(papers, out, "paper_id", **HOW)


def test_bad_keys_empty_tables_and_clashing_columns(spark, papers, cover, tmp_path):
    for i, bad in enumerate((papers.unionByName(papers.limit(1)), papers.withColumn("paper_id", F.expr("nullif(paper_id, 'P5')")))):
        with pytest.raises(GateError, match="null or repeat"):
            O.export(bad, f"{tmp_path}/bad{i}", "paper_id", **HOW)
    with pytest.raises(GateError, match="column"):
        O.export(papers.withColumn(O.BATCH, F.lit(1)), f"{tmp_path}/clash", "paper_id", **HOW)
    none = papers.filter("false")
    assert O.export(none, f"{tmp_path}/none", "paper_id", **HOW, coverage=cover)["rows"] == 0
    assert O.exported(spark, none, f"{tmp_path}/none").count() == 0
