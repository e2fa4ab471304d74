import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

from facetlake import registry

REPO = Path(__file__).resolve().parent.parent


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query_matches_sql(spark, sf, duck, same, name):
    same(registry.QUERIES[name](spark, sf), duck, registry.ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE)))
def test_query_without_sql_gives_rows(spark, sf, name):
    assert registry.QUERIES[name](spark, sf).count() > 0


def test_partitions_do_not_matter(spark, sf):
    rows = lambda: sorted(map(tuple, registry.QUERIES["candidate_quota_sample"](spark, sf).collect()))
    before = rows()
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        assert rows() == before
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_entry_imports_without_session_and_without_training_data_operators(tmp_path):
    shutil.copytree(REPO / "facetlake", tmp_path / "facetlake", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(REPO / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert 'pipeline' not in q and not any(n.startswith('op') for n in q) and set(o) <= set(q); print(len(q))"
    done = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, check=False)
    assert done.returncode == 0 and int(done.stdout) > 80, done.stderr
