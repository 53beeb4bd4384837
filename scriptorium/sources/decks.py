"""A library of decks: Parquet tables of headers and cards, and JSON files of whole decks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptorium.sources.scratch import stored

LISTED = "deck_id source_document_title created_at total_flashcards categories_distribution difficulty_distribution estimated_study_time_min mastery_percentage study_progress source_document_id".split()


def save(decks: DataFrame, path: str) -> None:
    """Adds decks (deck_id, ..., cards: array of structs) to the library; a deck's rows stay together."""
    decks.withColumn("part", F.pmod(F.xxhash64("deck_id"), F.lit(64))).write.mode("append").partitionBy("part").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("part")


RAW = "raw_record"


def read_json(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """Decks from JSON files, one to a file. No file is lost: of one that can't be parsed, or doesn't fit the schema, all fields that can't be
    read are null, and raw_record has its text (null for good ones)."""
    reader = spark.read.option("multiLine", "true").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", RAW)
    if schema is None:
        found = reader.json(path)
        return found if RAW in found.columns else found.withColumn(RAW, F.lit(None).cast("string"))
    own = spark.createDataFrame([], schema).schema if isinstance(schema, str) else schema
    if RAW not in own.names:
        own = T.StructType([*own.fields, T.StructField(RAW, T.StringType())])
    return reader.schema(own).json(path)


def verdicts(spark: SparkSession, path: str, schema) -> DataFrame:
    """path, status (accepted or failed) and raw_record of each JSON file of decks."""
    own = stored(read_json(spark, path, schema).withColumn("path", F.col("_metadata.file_path")), "decks")  # raw_record can't be read on its own
    return own.select("path", F.when(F.col(RAW).isNull(), "accepted").otherwise("failed").alias("status"), RAW)


def write_json(decks: DataFrame, path: str) -> None:
    decks.write.mode("overwrite").json(path)


def listed(decks: DataFrame) -> DataFrame:
    """The list view, newest first; decks without a mastery have 0."""
    columns = [c for c in LISTED if c in decks.columns]
    out = decks.select(*columns)
    if "mastery_percentage" in columns:
        out = out.withColumn("mastery_percentage", F.coalesce("mastery_percentage", F.lit(0.0)))
    return out.orderBy(F.desc("created_at"), "deck_id")


def get(decks: DataFrame, deck_id: str) -> DataFrame:
    return decks.where(F.col("deck_id") == deck_id)


def delete(spark: SparkSession, path: str, deck_id: str) -> bool:
    """Rewrites the one partition that holds the deck; whether there was one.

    The rows that stay are written beside the partition, which is then swapped by renaming. A driver lost on the way leaves them in
    one of two hidden folders, from which the next call takes up again.
    """
    part = spark.range(1).select(F.pmod(F.xxhash64(F.lit(deck_id)), F.lit(64))).first()[0]
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    old, new, here = folder(f"{path}/_old-{part}"), folder(f"{path}/_new-{part}"), folder(f"{path}/part={part}")
    fs = here.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(old) and not fs.exists(here):  # a swap was cut off between its two renames
        fs.rename(old, here)
    if not fs.exists(here):
        return False
    own = spark.read.parquet(here.toString())
    if own.where(F.col("deck_id") == deck_id).isEmpty():
        return False
    rest = own.where(~F.col("deck_id").eqNullSafe(deck_id))
    fs.delete(old, True)
    rest.write.mode("overwrite").parquet(new.toString())
    keep = not spark.read.schema(own.schema).parquet(new.toString()).isEmpty()
    fs.rename(here, old)
    if keep:
        fs.rename(new, here)
    else:
        fs.delete(new, True)
    fs.delete(old, True)
    return True


def search(decks: DataFrame, title: str) -> DataFrame:
    return decks.where(F.contains(F.lower("source_document_title"), F.lit(title.lower())))
