"""What the operators of this subpackage share: words, shared folders, written tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from facetlake.storage import new_dir, shared_dir, written

__all__ = ["ascii_lower", "let", "new_dir", "open_fs", "shared_dir", "table", "words_of", "written"]

#: White space that separates words: space and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = "[ \\t\\n\\x0B\\f\\r]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """Array of the maximal runs without white space; empty for null or blank texts."""
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(F.coalesce(trimmed, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_RUN))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, also inside higher-order functions."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ascii_lower(value: Column) -> Column:
    return F.translate(value, UPPER, LOWER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def open_fs(path: str):
    """(file system, path in it) for Python code on the driver or an executor; the scheme decides."""
    from pyarrow import fs

    if "://" not in path and path.startswith("file:"):
        path = "file://" + path[len("file:") :]
    scheme, _, rest = path.partition("://")
    return fs.FileSystem.from_uri({"s3a": "s3", "s3n": "s3"}.get(scheme, scheme) + "://" + rest if rest else path)
