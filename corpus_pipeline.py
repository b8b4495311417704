"""A training corpus from raw documents: quality, near-dedup, decontamination, mixing, sharding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lotwise.llm.common import delete, materialize, scratch
from lotwise.llm.decontaminate import drop_contaminated
from lotwise.llm.mixing import mixed_documents
from lotwise.llm.quality import keep_good
from lotwise.llm.shard import shard_documents
from lotwise.llm.shingles import drop_near_copies


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go.

    Null and short texts are rejected; equal rows share a fate. Extra columns are kept; an empty table stays empty."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays that is linked by a Jaccard similarity of 0.8 or more over five-word shingles:
    SimHash links through BK-trees, verified, and what they miss.

    Null and empty texts are copies of each other; rows without an id stay; of tied rows the smallest id stays. Extra
    columns are kept; an empty table stays empty."""
    return drop_near_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go.

    Null and empty texts hold none and stay. Extra columns are kept; an empty table stays empty."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as many times as the mix takes it: 0 to 3.

    A text without words is taken once; a null source is one of its own; rows with equal id and text share a fate.
    Extra columns are kept; an empty table stays empty."""
    return mixed_documents(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and slot of every row of the mix.

    Null texts count as empty and null ids as values; repeated rows each get a slot. Extra columns are left out; an
    empty table gives an empty result."""
    return shard_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: Shingle sets, hashed n-grams and Newton steps are beyond SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written to the shared folder and read by the next. What a stage
    wrote for its own use, and its input, is deleted when its rows are written."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        with scratch(spark) as made:
            docs = materialize(stage(spark, docs, sf_dir))
            written = made.pop()
        if last:
            delete(spark, last)
        last = written
    return STAGES[-1][1](spark, docs, sf_dir)
