"""The training-data pipeline: stages that each take and give documents, written between them.

Language identification drops what it rejects; of near-duplicate groups one
document stays; documents that hold a benchmark item go; sources are mixed to
their target weights, documents repeated by whole passes; the mixed corpus is
written as token shards and read back. A mixed corpus repeats ids, and the
shards hold every repeat.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from facetlake.llm import decontaminate, langid, mixing, simhash, tokens
from facetlake.llm.common import table, written
from facetlake.llm.queries_free import tokenizer_file


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_identified(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def write_token_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return tokens.read_tokens(tokens.write_tokens(docs, tokenizer=tokenizer_file()))


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("mixing", mix_sources),
    ("token_shards", write_token_shards),
]

#: The stages learn, hash by XXH64 and tokenize; a test holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
