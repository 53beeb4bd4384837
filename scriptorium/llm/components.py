"""Connected components of a graph in DataFrames: alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm import common


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of ``edges`` (a, b: long, no nulls): root is the smallest node of its component.

    In a step each node finds its smallest neighbour by a partial aggregate, so a hub costs one row per task, and
    its neighbours are then hung on that. Steps end when the edges no longer change; they are stored between steps.
    """
    spark = edges.sparkSession
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    before = None
    while True:
        both = e.union(e.select(F.col("v"), F.col("u")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        # large star: neighbours above the node hang on its smallest neighbour
        e = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        e = common.stored(spark, e, "large")
        # small star: the node and its neighbours below hang on the smallest of them
        least = e.groupBy("u").agg(F.min("v").alias("m"))
        down = e.join(least, "u")
        e = down.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        e = common.stored(spark, e, "small")
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
