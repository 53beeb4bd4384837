"""Recognition candidates, region quality and recovery. Recognisers themselves are plugged in as functions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptorium.functions import lexicons as lx
from scriptorium.functions import scores as sc
from scriptorium.functions import text as tx


def _nothing() -> tuple[Column, Column]:
    return F.array().cast("array<string>"), F.create_map().cast("map<string,double>")


def fuse_scales(candidates: DataFrame, keys: list[str], keywords: Column | None = None, boosts: Column | None = None, digits: int = 4) -> DataFrame:
    """Best candidate per key of rows (keys, place, scale, text, confidence): keys, selected_text, selected_scale, fused_confidence."""
    return _fuse(candidates, keys, "scale", sc.scale_score, keywords, boosts, digits, ("selected_text", "selected_scale", "fused_confidence"))


def aggregate_models(candidates: DataFrame, keys: list[str], keywords: Column | None = None, boosts: Column | None = None, digits: int = 4) -> DataFrame:
    """Best candidate per key of rows (keys, place, model, text, confidence): keys, selected_text, selected_model, aggregated_confidence."""
    return _fuse(candidates, keys, "model", sc.model_score, keywords, boosts, digits, ("selected_text", "selected_model", "aggregated_confidence"))


def _fuse(candidates, keys, source, score, keywords, boosts, digits, names) -> DataFrame:
    none, empty = _nothing()
    own = candidates.withColumn("__text", tx.strip(F.coalesce("text", F.lit("")))).where("__text <> ''")
    own = own.withColumn("__words", sc.candidate_words(F.col("__text")))
    s = score(F.col("__text"), F.col("__words"), F.col("confidence"), F.col(source), none if keywords is None else F.transform(keywords, F.lower), empty if boosts is None else boosts)
    s = F.round(s, digits)
    best = F.struct((-F.col("__score")).alias("less"), F.col("place"))
    out = own.withColumn("__score", s).groupBy(*keys).agg(F.min_by(F.struct(F.col("__text").alias(names[0]), F.col(source).alias(names[1]), F.col("__score").alias(names[2])), best).alias("b"))
    return out.select(*keys, "b.*")


def dedupe_third(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """Candidates from three recognisers in ``place`` order, less a third one that repeats an earlier text."""
    w = Window.partitionBy(*keys, F.lower(tx.strip(F.col("text"))))
    return candidates.withColumn("__first", F.min("place").over(w)).where("place < 2 OR place = __first").drop("__first")


def region_quality(regions: DataFrame, digits: int = 4) -> DataFrame:
    """Adds quality, language_consistency and gibberish to regions (text, confidence, ink_density, width, height)."""
    q = sc.quality(F.col("text"), F.col("confidence"), F.col("ink_density"), F.col("width"), F.col("height"))
    return regions.withColumns({k: F.round(v, digits) if k != "gibberish" else v for k, v in q.items()})


def recovery_plan(regions: DataFrame, page: list[str], order: str, min_confidence: float = 0.60, min_quality: float = 0.50, budget: int = 3, digits: int = 4) -> DataFrame:
    """Adds needs_recovery and recover: the first ``budget`` doubtful regions of a page are tried again."""
    out = region_quality(regions, digits)
    doubt = (F.col("confidence") < min_confidence) | (F.col("quality") < min_quality) | F.col("gibberish")
    out = out.withColumn("needs_recovery", doubt)
    n = F.sum(F.col("needs_recovery").cast("int")).over(Window.partitionBy(*page).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return out.withColumn("recover", F.col("needs_recovery") & (n <= budget))


def recover(planned: DataFrame, retried: DataFrame, keys: list[str], digits: int = 4) -> DataFrame:
    """Takes over, for regions marked ``recover``, the best of ``retried`` (keys, tier, text, confidence) that improves quality."""
    again = planned.where("recover").select(*keys, "ink_density", "width", "height", F.col("quality").alias("__old"))
    tried = region_quality(retried.join(again, keys), digits).where((F.col("quality") > F.col("__old")) & ~tx.blank(F.col("text")))
    best = tried.groupBy(*keys).agg(F.min_by(F.struct(F.col("text").alias("t"), F.col("confidence").alias("c"), F.col("quality").alias("q")), F.struct((-F.col("quality")).alias("less"), "tier")).alias("__new"))
    out = planned.join(best, keys, "left")
    new = F.col("__new")
    return out.withColumns(
        {
            "text": F.coalesce(new["t"], F.col("text")),
            "confidence": F.coalesce(new["c"], F.col("confidence")),
            "quality": F.coalesce(new["q"], F.col("quality")),
            "improved": new.isNotNull(),
        }
    ).drop("__new")


def page_stats(planned: DataFrame, page: list[str], digits: int = 4) -> DataFrame:
    return planned.groupBy(*page).agg(
        F.count(F.lit(1)).alias("total_regions"),
        F.count_if(~F.col("needs_recovery")).alias("high_confidence_count"),
        F.count_if(F.col("recover")).alias("fallback_invocations"),
        F.round(F.avg("confidence"), digits).alias("mean_confidence"),
        F.round(F.avg("quality"), digits).alias("mean_quality_score"),
    )


def is_confident(confidence: Column, least: float = 0.60) -> Column:
    return confidence >= least


def verified(text: Column) -> tuple[Column, Column, Column]:
    """(text, confidence, changes as array<struct<from, to>>) of the rule-based visual check."""
    out, changes = text, []
    for pattern, to in lx.VISUAL:
        m = F.regexp_extract(out, "(?iU)" + pattern, 0)
        changes.append(F.when(m != "", F.struct(m.alias("from"), F.lit(to).alias("to"))))
        out = F.regexp_replace(out, "(?iU)" + pattern, to)
    return out, F.when(tx.blank(text), 0.50).otherwise(0.88), F.filter(F.array(*changes), lambda c: c.isNotNull())


def word_changes(before: Column, after: Column) -> Column:
    """Differing words at equal places, or one whole change where the word counts differ."""
    a, b = tx.tokens(before), tx.tokens(after)
    pairs = F.filter(F.zip_with(a, b, lambda x, y: F.struct(x.alias("from"), y.alias("to"))), lambda p: p["from"] != p["to"])
    whole = F.when(before != after, F.array(F.struct(before.alias("from"), after.alias("to")))).otherwise(F.filter(pairs, lambda p: F.lit(False)))
    return F.when(F.size(a) == F.size(b), pairs).otherwise(whole)


def final_confidence(confidence: Column, adaptation: Column, boost: Column) -> Column:
    return F.least(F.lit(0.99), confidence + adaptation + F.when(boost > 0, 0.05).otherwise(0.0))


def merged(text: Column, confidence: Column, other: Column, other_confidence: Column) -> tuple[Column, Column]:
    """Another recogniser's reading in place of a region's, if it is not blank; the higher confidence."""
    return F.when(tx.blank(other), text).otherwise(other), F.greatest(confidence, other_confidence)


def cascade(easy_text: Column, easy_confidence: Column, n_words: Column, handwritten: Column, side: Column) -> tuple[Column, Column]:
    """Crop recognition from two recognisers' outputs: nothing below 5 pixels, the first if it is sure or has two words, else the second."""
    sure = ((easy_confidence > 0.40) | (n_words >= 2)) & ~tx.blank(easy_text)
    text = F.when(side < 5, "").when(sure, easy_text).when(~tx.blank(handwritten), handwritten).otherwise(F.coalesce(easy_text, F.lit("")))
    conf = F.when(side < 5, 0.0).when(sure, sc.clamp(easy_confidence, 0.70, 0.98)).when(~tx.blank(handwritten), 0.94).otherwise(F.coalesce(easy_confidence, F.lit(0.0)))
    return text, conf


def recognize(crops: DataFrame, recognizer: Callable[[bytes], tuple[str, float]], image: str = "image") -> DataFrame:
    """Adds text, confidence and error from a recogniser of image bytes; a failing crop gets an error and no text.

    ``recognizer`` is a factory's product per worker: pass a callable without state on the driver.
    """
    added = (("text", T.StringType()), ("confidence", T.DoubleType()), ("error", T.StringType()))
    schema = T.StructType([*crops.schema.fields, *(T.StructField(n, t) for n, t in added)])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            got = []
            for data in f[image]:
                try:
                    got.append((*recognizer(data), None))
                except Exception as e:  # one crop's failure is data, not a failed task
                    got.append((None, None, f"{type(e).__name__}: {e}"))
            f["text"], f["confidence"], f["error"] = (pd.Series([g[k] for g in got], index=f.index, dtype=t) for k, t in enumerate(("object", "float64", "object")))
            yield f

    return crops.mapInPandas(run, schema)


def read_scales(base: DataFrame, readings: DataFrame, keys: list[str], keywords: Column | None = None, boosts: Column | None = None, least: float = 0.65, digits: int = 4) -> DataFrame:
    """Best reading of each crop of ``base`` (keys, text, confidence): keys, selected_text, confidence, selected_scale, multiscale_executed.

    A text of ``least`` confidence or more is taken as it is. For the others the ``readings`` of other scales (keys, place, scale, text,
    confidence; not ``original``) are fused with it; without any text the base stays.
    """
    sure = (F.col("confidence") >= least) & ~tx.blank(F.col("text"))
    own = base.withColumn("__sure", F.coalesce(sure, F.lit(False)))
    doubt = own.where("NOT __sure")
    first = doubt.select(*keys, F.lit(-1).alias("place"), F.lit("original").alias("scale"), "text", "confidence")
    more = readings.where("scale <> 'original'").join(doubt.select(*keys), keys, "left_semi").select(*first.columns)
    fused = fuse_scales(first.union(more), keys, keywords, boosts, digits)
    out = own.join(fused, keys, "left")
    return out.select(
        *keys, F.when(F.col("__sure"), F.col("text")).otherwise(F.coalesce("selected_text", "text")).alias("selected_text"),
        F.when(F.col("__sure"), F.col("confidence")).otherwise(F.coalesce("fused_confidence", "confidence")).alias("confidence"),
        F.coalesce("selected_scale", F.lit("original")).alias("selected_scale"), (~F.col("__sure")).alias("multiscale_executed"),
    )


def crop_markdown(pages: DataFrame, read: DataFrame, page: list[str]) -> tuple[DataFrame, DataFrame]:
    """(regions, pages with markdown) from regions that were read one by one (page, region_id, region_type, text, confidence).

    An empty text counts with a confidence of 0.50. A page without regions has one of its full size, a Text of 0.88 without text.
    """
    text = tx.strip(F.coalesce("text", F.lit("")))
    own = read.withColumn("text", text).withColumn("confidence", F.when(F.col("text") == "", 0.50).otherwise(F.col("confidence")))
    own = own.select(*page, "region_id", "region_type", "text", "confidence")
    whole = pages.join(own.select(*page).distinct(), page, "left_anti").select(*page, F.lit(1).alias("region_id"), F.lit("Text").alias("region_type"), F.lit("").alias("text"), F.lit(0.88).alias("confidence"))
    regions = own.union(whole)
    mark = F.when(F.col("region_type") == "Title", "# ").when(F.col("region_type") == "Section-header", "## ").otherwise("")
    body = F.array_sort(F.collect_list(F.when(F.col("text") != "", F.struct("region_id", F.concat(mark, F.col("text")).alias("line")))))
    return regions, regions.groupBy(*page).agg(F.array_join(F.transform(body, lambda x: x["line"]), "\n\n").alias("markdown"))


def average_confidence(regions: DataFrame, page: list[str], digits: int = 1) -> DataFrame:
    """Mean confidence of each page in per cent; nulls count as zero."""
    return regions.groupBy(*page).agg(F.round(F.avg(F.coalesce("confidence", F.lit(0.0))) * 100, digits).alias("average_confidence"))
