"""The training-data pipeline: documents in, packed training sequences out.

Every stage takes (spark, docs, sf_dir) and works on all rows the stage before it kept. All
but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from colloquia.llm import mixing, packing, quality, simhash, suffixes
from colloquia.llm.common import reachable, read


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the n-gram ratio."""
    return quality.kept_documents(docs, read(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    reachable(spark)
    return simhash.keep_one(docs, simhash.similar(docs, width=5, similarity=0.8))


def shared_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the 50-byte spans that a document with a smaller id has."""
    reachable(spark)
    return suffixes.deduplicated(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the capped water-filling mix takes it."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per token piece with its place in a sequence."""
    reachable(spark)
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("shared spans", shared_spans),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

# Tokenisation and suffix arrays are beyond SQL; tests compare the run with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
