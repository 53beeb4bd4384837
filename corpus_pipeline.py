"""The training-data pipeline: quality rules, line deduplication, near-duplicates, decontamination, packing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns the columns of
``documents`` (the last one the packed pieces). ``run`` writes each stage as Parquet in the shared folder and reads it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm import common, decontaminate, line_dedup, packing, quality, simhash


NEAR_WORDS = 5
#: a worker that packs has served the other stages before, and keeps fewer words
PACK_WORDS = 250_000


def _columns(docs: DataFrame, like: DataFrame) -> DataFrame:
    """``docs`` with the columns of ``like``; n_chars follows the text."""
    if "n_chars" in like.columns:
        docs = docs.withColumn("n_chars", F.length("text").cast(like.schema["n_chars"].dataType))
    return docs.select(*(F.col(f"`{c}`") for c in like.columns))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go, with null, empty and short texts; repeated rows share their fate. An empty table stays empty."""
    return quality.keep(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat a block of an earlier document go; no document goes, though one may be left empty (a copy is). Null texts
    stay null, an empty table empty."""
    return _columns(line_dedup.deduplicate(docs), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that with the smallest doc_id; of null and blank texts, and of repeated rows, one. Shingles
    have NEAR_WORDS words. An empty table stays empty."""
    return simhash.one_of_each(docs, shingle=NEAR_WORDS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go; null and blank texts contain none. An empty table, or benchmark, takes none away."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents at their places in sequences; null and empty texts are one token, repeated rows are packed each, an
    empty table gives no pieces."""
    return packing.pack(docs, cache=PACK_WORDS)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", lines),
    ("near duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", pack),
]

#: the expectation-maximisation, the alignment and the fingerprints have no SQL form
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = common.stored(spark, stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
