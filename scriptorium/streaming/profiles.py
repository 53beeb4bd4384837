"""Profiles kept up to date by a stream of feedback."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from scriptorium.operators import profiles


def word_counts(stream: DataFrame) -> DataFrame:
    """user_id, word, n over a stream of feedback (user_id, original, accepted): a plain count, so update and complete mode both work."""
    return profiles.feedback(stream).where("counts").groupBy("user_id", F.col("accepted").alias("word")).agg(F.count(F.lit(1)).alias("n"))


def windowed(stream: DataFrame, late: str = "1 hour", window: str = "1 day") -> DataFrame:
    """Feedback per user and event-time window; events later than ``late`` are dropped, so state stays bounded."""
    own = stream.withWatermark("ts", late)
    return profiles.feedback(own).groupBy(F.window("ts", window).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("documents_processed"), F.count_if("counts").alias("corrections_accepted"))


def to_memory(counts: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
    """All that is there, into a table in memory."""
    return counts.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def to_table(counts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Each batch's totals replace the table; a batch that is repeated writes the same again."""

    def write(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    return counts.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
