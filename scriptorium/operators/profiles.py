"""Profiles of users' handwriting: counts of feedback events, and what they add to a candidate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions import lexicons as lx
from scriptorium.functions import text as tx


def safe_id(c: Column) -> Column:
    return F.regexp_replace(c, r"[^a-zA-Z0-9_\-]", "_")


def feedback(events: DataFrame) -> DataFrame:
    """user_id, original, accepted (trimmed, lower-case) and counts: whether the event teaches something."""
    o, a = F.lower(tx.strip(F.coalesce("original", F.lit("")))), F.lower(tx.strip(F.coalesce("accepted", F.lit(""))))
    out = events.withColumns({"user_id": safe_id(F.coalesce(F.col("user_id").cast("string"), F.lit("default_student"))), "original": o, "accepted": a})
    return out.withColumn("counts", (F.col("original") != F.col("accepted")) & (F.col("original") != "") & (F.col("accepted") != ""))


def since_reset(events: DataFrame) -> DataFrame:
    """Feedback after each user's last reset; rows (user_id, ts, kind: feedback or reset, ...)."""
    last = events.where("kind = 'reset'").groupBy("user_id").agg(F.max("ts").alias("__reset"))
    return events.where("kind = 'feedback'").join(last, "user_id", "left").where("__reset IS NULL OR ts > __reset").drop("__reset", "kind")


def summary(events: DataFrame) -> DataFrame:
    """user_id, documents_processed, corrections_accepted."""
    return feedback(events).groupBy("user_id").agg(F.count(F.lit(1)).alias("documents_processed"), F.count_if("counts").alias("corrections_accepted"))


def errors(events: DataFrame) -> DataFrame:
    return feedback(events).where("counts").groupBy("user_id", F.col("original").alias("text")).agg(F.count(F.lit(1)).alias("n"))


def words(events: DataFrame) -> DataFrame:
    return feedback(events).where("counts").groupBy("user_id", F.col("accepted").alias("word")).agg(F.count(F.lit(1)).alias("n"))


def confusions(events: DataFrame, weights: bool = True) -> DataFrame:
    """user_id, from, to, weight: 0.05 more for each time that one character stood for another in texts of equal length; without
    ``weights`` n, the number of times."""
    own = feedback(events).where("counts AND length(original) = length(accepted)")
    pairs = F.filter(F.arrays_zip(F.split("original", "").alias("a"), F.split("accepted", "").alias("b")), lambda p: p["a"] != p["b"])
    n = own.select("user_id", F.explode(pairs).alias("p")).groupBy("user_id", F.col("p.a").alias("from"), F.col("p.b").alias("to")).agg(F.count(F.lit(1)).alias("n"))
    if not weights:
        return n
    base = F.create_map(*(F.lit(x) for a, m in lx.CHAR_CONFUSIONS.items() for b, w in m.items() for x in (a + b, w)))
    weight = F.coalesce(F.try_element_at(base, F.concat("from", "to")), F.lit(0.20)) + F.col("n") * 0.05
    return n.select("user_id", "from", "to", F.round(weight, 3).alias("weight"))


def boosts(candidates: DataFrame, errors: DataFrame, words: DataFrame) -> DataFrame:
    """Adds boost to candidates (user_id, text): what the profile knows about the text and each of its words, up to 0.25. Candidates
    are met by their values: numbers given to rows would differ wherever a shuffle delivers the rows in another order."""
    asked = candidates.select("user_id", F.col("text").alias("__asked")).distinct()
    t = F.lower(tx.strip(F.col("__asked")))
    whole = asked.withColumn("text", t).join(errors, ["user_id", "text"]).select("user_id", "__asked", F.least(F.lit(0.20), F.col("n") * 0.05).alias("b"))
    each = asked.select("user_id", "__asked", F.explode(F.transform(tx.tokens(t), lambda w: F.regexp_replace(w, "[^a-z0-9]", ""))).alias("word"))
    each = each.join(words, ["user_id", "word"]).select("user_id", "__asked", F.least(F.lit(0.12), F.col("n") * 0.03).alias("b"))
    total = whole.union(each).groupBy("user_id", F.col("__asked").alias("text")).agg(F.round(F.least(F.lit(0.25), F.sum("b")), 6).alias("boost"))
    out = candidates.join(total, ["user_id", "text"], "left")
    return out.select(*candidates.columns, F.coalesce("boost", F.lit(0.0)).alias("boost"))


def export(events: DataFrame) -> DataFrame:
    """Nested profiles, one row per user."""
    err = errors(events).groupBy("user_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("text", "n")))).alias("systematic_errors"))
    voc = words(events).groupBy("user_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("word", "n")))).alias("custom_vocabulary"))
    con = confusions(events).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("from", "to", "weight"))).alias("character_confusions"))
    return summary(events).join(err, "user_id", "left").join(voc, "user_id", "left").join(con, "user_id", "left")
