"""The training-data pipeline: quality rules, near duplicates, decontamination, mixing, output.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and its
result is written as Parquet and read again as the next one's ``docs``.  All stages but
the last return the columns of ``documents``.

A stage's tables in the shared folder are deleted when the next one begins, as its rows have
been written in full by then; what a stage's input itself still reads stays.

Null ids, sources and texts, empty and very long texts, repeated rows, empty tables and columns
whose names clash with an operator's own are handled by every stage as its operator's docstring states.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from galleon.llm import _cuts, decontaminate, jaccard_join, mixing, quality_rules, sstable
from galleon.llm.queries import END, tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules do not reject."""
    with _cuts.stage(sf_dir, docs, first=True):
        return quality_rules.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at 0.8 or more."""
    with _cuts.stage(sf_dir, docs):
        return jaccard_join.keep_one(docs, k=5, num=80, den=100)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    with _cuts.stage(sf_dir, docs):
        return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at tempered weights: each whole at least once, none more than 1.5 times the least repeated.

    The shards are ordered by identifier, so the copies are not laid over blocks.
    """
    with _cuts.stage(sf_dir, docs):
        return mixing.mix(docs, entropy=0.98, repeats=1.5, budget="cover", laid=False).select(*docs.columns)


def output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in sorted-string-table shards, and the places of every document in them."""
    with _cuts.stage(sf_dir, docs):
        return sstable.read_back(sstable.write(docs, tokenizer_path(), END))


STAGES = [
    ("quality_rules", quality),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("source_mixing", mixture),
    ("sstable_output", output),
]

#: The stages estimate by expectation maximisation, sample, hash and tokenise: SQL does not express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over ``documents``; every other stage is written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = _cuts.written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
