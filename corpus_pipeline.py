"""The corpus pipeline: stages over documents, each written and read again by the next.

Every stage returns the columns of documents, the last one the pieces of the packed sequences. Documents go where a rule
rejects them, where line deduplication leaves nothing of them, where a near copy with a smaller id stays, and where they
hold a benchmark item.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from custlens.functions.stages import written
from custlens.llm import decontaminate, line_dedup, ngram_join, packing, quality_rules


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality_rules.kept(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the later occurrences of three-line windows; their length in characters follows."""
    left = line_dedup.deduplicated(docs)
    return left.withColumn("n_chars", F.length("text").cast("bigint"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, a similarity of 0.8 or more."""
    return ngram_join.one_of_each(docs, n=5, percent=80)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in sequences of 4096 tokens."""
    return packing.packed(docs)


STAGES = [
    ("quality_rules", quality), ("line_dedup", lines), ("ngram_join", near_copies), ("decontamination", benchmark),
    ("best_fit_packing", pack),
]

#: SQL can't state the token ids and the packing; tests compare every stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
