"""Queries on page regions: recognition quality, candidates and layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions import lexicons as lx
from scriptorium.functions import scores as sc
from scriptorium.functions import text as tx
from scriptorium.operators import layout as ly
from scriptorium.operators import recognition as rg
from scriptorium.plans.registry import CORPUS, REGIONS, corpus, query, quoted, regions, replaced, sql_list, stripped, unequal, words_of

_W = "list_filter(string_split_regex(lower(t), '[^\\p{L}\\p{N}_]+'), lambda w: regexp_full_match(w, '[a-z]{2,}'))"
_LANG = f"""CASE WHEN length(t) = 0 THEN 0.0 WHEN len(w) = 0 THEN CASE WHEN length(t) <= 5 THEN 0.70 ELSE 0.30 END
  ELSE least(1.0, greatest(0.10, len(list_filter(w, lambda x: list_contains({sql_list(lx.LANGUAGE_WORDS)}, x) OR regexp_matches(x, '[aeiouy]')))::DOUBLE / len(w)
    * CASE WHEN len(list_filter(w, lambda x: regexp_matches(x, '[aeiouy]'))) > 0 THEN 1.0 ELSE 0.3 END)) END::DOUBLE"""
QUALITY = (
    REGIONS
    + f""", q0 AS (SELECT *, {stripped('text')} AS t FROM regions), q1 AS (SELECT *, {_W} AS w FROM q0), q2 AS (SELECT *, {_LANG} AS lang FROM q1),
quality AS (SELECT *, least(1.0, greatest(0.0, confidence * 0.40::DOUBLE + lang * 0.35::DOUBLE + greatest(0.20, least(1.0, CASE WHEN ink_density > 0 THEN ink_density ELSE 0.05 END / 0.15::DOUBLE))::DOUBLE * 0.15::DOUBLE
    + CASE WHEN xmax - xmin >= 10 AND ymax - ymin >= 8 THEN 0.90 ELSE 0.40 END::DOUBLE * 0.10::DOUBLE)) AS quality,
  confidence >= 0.70 AND lang <= 0.20 AND len({words_of('t')}) > 0 AS gibberish FROM q2)"""
)
PAGE = 1200
_PLAIN = "CASE WHEN scale IN ('original', 'clahe_contrast') THEN 0.05 ELSE 0.0 END"
_ANY_CASE = "(?i)"


def sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions(spark, sf_dir).withColumns({"width": F.col("xmax") - F.col("xmin"), "height": F.col("ymax") - F.col("ymin")})


@query(f"WITH {QUALITY} SELECT doc_id, region_id, round(lang, 6) AS language_consistency FROM quality")
def oc_language_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions(spark, sf_dir).select("doc_id", "region_id", F.round(sc.language_consistency(tx.strip(F.col("text"))), 6).alias("language_consistency"))


@query(f"WITH {QUALITY} SELECT doc_id, region_id, round(quality, 9) AS quality, gibberish FROM quality")
def oc_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rg.region_quality(sized(spark, sf_dir), digits=9).select("doc_id", "region_id", "quality", "gibberish")


@query(
    f"""WITH {REGIONS}, w AS (SELECT doc_id, region_id, confidence, unnest({words_of('text')}) AS word FROM regions),
c AS (SELECT *, greatest(0.40, confidence - CASE WHEN regexp_matches(word, '[@~{{}}\\[\\]\\\\|_]') THEN 0.20 ELSE 0.0 END)::DOUBLE AS c FROM w)
SELECT doc_id, region_id, count(*) AS n_words, count(*) FILTER (c < 0.70) AS n_low, round(min(c), 4) AS least FROM c GROUP BY doc_id, region_id"""
)
def oc_word_conf(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = regions(spark, sf_dir).select("doc_id", "region_id", F.explode(sc.word_confidences(F.col("text"), F.col("confidence"))).alias("w"))
    return words.groupBy("doc_id", "region_id").agg(F.count(F.lit(1)).alias("n_words"), F.count_if("w.is_low").alias("n_low"), F.min("w.confidence").alias("least"))


_PLAN = f"""WITH {QUALITY}, d AS (SELECT *, quality AS q, confidence < 0.60 OR round(quality, 9) < 0.50 OR gibberish AS needs_recovery FROM quality),
p AS (SELECT *, needs_recovery AND sum(CASE WHEN needs_recovery THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY region_id ROWS UNBOUNDED PRECEDING) <= 3 AS recover FROM d)"""


@query(f"{_PLAN} SELECT doc_id, region_id, needs_recovery, recover FROM p")
def oc_fallback_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rg.recovery_plan(sized(spark, sf_dir), ["doc_id"], "region_id", digits=9).select("doc_id", "region_id", "needs_recovery", "recover")


@query(
    f"""{_PLAN} SELECT doc_id, count(*) AS total_regions, count(*) FILTER (NOT needs_recovery) AS high_confidence_count, count(*) FILTER (recover) AS fallback_invocations,
  round(avg(confidence), 7) AS mean_confidence, round(avg(q), 7) AS mean_quality_score FROM p GROUP BY doc_id"""
)
def oc_page_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rg.page_stats(rg.recovery_plan(sized(spark, sf_dir), ["doc_id"], "region_id", digits=9), ["doc_id"], digits=7)


_AGAIN = QUALITY[len(REGIONS) :].replace("FROM regions", "FROM again").replace("q0", "a0").replace("q1", "a1").replace("q2", "a2").replace("quality AS (SELECT", "judged AS (SELECT")


@query(
    f"""{_PLAN}, tries(tier) AS (VALUES (1), (2)),
again AS (SELECT doc_id, region_id, tier, CASE tier WHEN 1 THEN replace(text, 'e', '~') ELSE lower(text) END AS text, least(1.0::DOUBLE, round(confidence + tier * 0.1::DOUBLE, 4)) AS confidence, ink_density, xmin, xmax, ymin, ymax, q AS old FROM p, tries WHERE recover){_AGAIN},
better AS (SELECT * FROM judged WHERE round(quality, 9) > round(old, 9) AND NOT ({unequal('text')}) QUALIFY row_number() OVER (PARTITION BY doc_id, region_id ORDER BY round(quality, 9) DESC, tier) = 1)
SELECT p.doc_id, p.region_id, coalesce(b.text, p.text) AS text, coalesce(b.confidence, p.confidence) AS confidence, round(coalesce(b.quality, p.q), 9) AS quality, b.text IS NOT NULL AS improved
FROM p LEFT JOIN better b ON b.doc_id = p.doc_id AND b.region_id = p.region_id"""
)
def oc_recover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Doubtful regions read again by two more tiers, the better reading taken over."""
    planned = rg.recovery_plan(sized(spark, sf_dir), ["doc_id"], "region_id", digits=9)
    tier = F.explode(F.array(F.lit(1), F.lit(2))).alias("tier")
    retried = regions(spark, sf_dir).select("doc_id", "region_id", tier, "text", "confidence")
    retried = retried.withColumns({"text": F.when(F.col("tier") == 1, F.replace("text", F.lit("e"), F.lit("~"))).otherwise(F.lower("text")), "confidence": F.least(F.lit(1.0), F.round(F.col("confidence") + F.col("tier") * 0.1, 4))})
    return rg.recover(planned, retried, ["doc_id", "region_id"], digits=9).select("doc_id", "region_id", "text", "confidence", "quality", "improved")


_CANDIDATES = (
    REGIONS
    + """, cands AS (SELECT doc_id, region_id, 0 AS place, 'easyocr' AS model, 'original' AS scale, text, confidence FROM regions
UNION ALL SELECT doc_id, region_id, 1, 'trocr_handwritten', 'clahe_contrast', replace(text, 'e', '~'), round(confidence + 0.1::DOUBLE, 4) FROM regions
UNION ALL SELECT doc_id, region_id, 2, 'got_ocr', 'lanczos', lower(text), round(confidence + 0.05::DOUBLE, 4) FROM regions)"""
)
_KEYWORDS = ("heat", "work", "the", "volume")


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = regions(spark, sf_dir)
    text, conf = F.col("text"), F.col("confidence")
    rows = F.array(
        F.struct(F.lit(0).alias("place"), F.lit("easyocr").alias("model"), F.lit("original").alias("scale"), text.alias("text"), conf.alias("confidence")),
        F.struct(F.lit(1).alias("place"), F.lit("trocr_handwritten").alias("model"), F.lit("clahe_contrast").alias("scale"), F.replace(text, F.lit("e"), F.lit("~")).alias("text"), F.round(conf + 0.1, 4).alias("confidence")),
        F.struct(F.lit(2).alias("place"), F.lit("got_ocr").alias("model"), F.lit("lanczos").alias("scale"), F.lower(text).alias("text"), F.round(conf + 0.05, 4).alias("confidence")),
    )
    return own.select("doc_id", "region_id", F.inline(rows))


def _scored(words: list[str], extra: str) -> str:
    return f"""{_CANDIDATES}, c0 AS (SELECT *, {stripped('text')} AS t FROM cands WHERE NOT ({unequal('text')})),
c1 AS (SELECT *, list_transform({words_of('t')}, lambda w: regexp_replace(lower(w), '^[.,!?;:"''()]+|[.,!?;:"''()]+$', '', 'g')) AS w FROM c0),
c2 AS (SELECT *, len(list_filter(w, lambda x: list_contains({sql_list(_KEYWORDS)}, x))) AS hits, len(list_filter(w, lambda x: list_contains({sql_list(_KEYWORDS)}, x) OR list_contains({sql_list(words)}, x))) AS known,
  length(regexp_replace(t, '[\\p{{L}}\\p{{N}} .,!?;:\\-''"]', '', 'g')) AS noise FROM c1),
c3 AS (SELECT *, round(least(0.99, greatest(0.05, confidence * 0.40::DOUBLE + known::DOUBLE / len(w) * 0.25::DOUBLE - least(0.20::DOUBLE, noise * 0.03::DOUBLE) + least(0.20::DOUBLE, hits * 0.10::DOUBLE) + ({extra})::DOUBLE)), 9) AS score FROM c2),
best AS (SELECT * FROM c3 QUALIFY row_number() OVER (PARTITION BY doc_id, region_id ORDER BY score DESC, place) = 1)"""


@query(f"WITH {_scored(lx.SCALE_WORDS, _PLAIN)} SELECT doc_id, region_id, t AS selected_text, scale AS selected_scale, score AS fused_confidence FROM best")
def oc_fuse_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rg.fuse_scales(candidates(spark, sf_dir), ["doc_id", "region_id"], F.array(*(F.lit(k) for k in _KEYWORDS)), digits=9)


@query(f"WITH {_scored(lx.MODEL_WORDS, 'CASE WHEN contains(model, ' + quoted('trocr') + ') THEN 0.08 WHEN contains(model, ' + quoted('got') + ') THEN 0.06 ELSE 0.0 END')} SELECT doc_id, region_id, t AS selected_text, model AS selected_model, score AS aggregated_confidence FROM best")
def oc_aggregate_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rg.aggregate_models(candidates(spark, sf_dir), ["doc_id", "region_id"], F.array(*(F.lit(k) for k in _KEYWORDS)), digits=9)




@query(
    f"""WITH {CORPUS}, e AS (SELECT doc_id, text, regexp_replace(text, '([. ])th', '\\1tb', 'g') AS t2 FROM corpus), w AS (SELECT doc_id, {words_of('text')} AS a, {words_of('t2')} AS b, text <> t2 AS differs FROM e)
SELECT doc_id, CASE WHEN len(a) = len(b) THEN len(list_filter(range(1, len(a) + 1), lambda i: a[i] <> b[i])) ELSE CASE WHEN differs THEN 1 ELSE 0 END END AS n_changes FROM w"""
)
def oc_word_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = corpus(spark, sf_dir).withColumn("t2", F.regexp_replace("text", "([. ])th", "$1tb"))
    return own.select("doc_id", F.size(rg.word_changes(F.col("text"), F.col("t2"))).cast("long").alias("n_changes"))


@query(f"WITH {CORPUS} SELECT doc_id, {replaced('text', lx.VISUAL)} AS verified, CASE WHEN {unequal('text')} THEN 0.50 ELSE 0.88 END::DOUBLE AS confidence, {' + '.join(f'CASE WHEN regexp_matches(text, {quoted(_ANY_CASE + p)}) THEN 1 ELSE 0 END' for p, _ in lx.VISUAL)} AS n_changes FROM corpus")
def oc_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    text, conf, changes = rg.verified(F.col("text"))
    return corpus(spark, sf_dir).select("doc_id", text.alias("verified"), conf.alias("confidence"), F.size(changes).alias("n_changes"))


# -- layout ----------------------------------------------------------------

_ORDER = "CAST(row_number() OVER (PARTITION BY doc_id ORDER BY ymin, xmin, region_id) AS INT)"


@query(f"WITH {REGIONS} SELECT doc_id, region_id, {_ORDER} AS reading_order FROM regions WHERE ink_density >= 0.015")
def ly_reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ly.reading_order(ly.without_empty(regions(spark, sf_dir)), ["doc_id"]).select("doc_id", "region_id", "reading_order")


@query(
    f"""WITH {REGIONS}, l AS (SELECT *, lag(ymax) OVER w AS y, lag(ymax - ymin) OVER w AS h, lag(region_type) OVER w AS k FROM regions WINDOW w AS (PARTITION BY doc_id ORDER BY ymin, region_id))
SELECT doc_id, region_id, sum(CASE WHEN ymin - y <= greatest(1, h) * 1.6 AND region_type = k AND region_type NOT IN ('Title', 'Section-header') THEN 0 ELSE 1 END)
  OVER (PARTITION BY doc_id ORDER BY ymin, region_id ROWS UNBOUNDED PRECEDING)::BIGINT AS paragraph_id FROM l"""
)
def ly_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ly.paragraphs(regions(spark, sf_dir), ["doc_id"]).select("doc_id", "region_id", "paragraph_id")


_MD = """CASE WHEN region_type = 'Title' THEN '# ' || t WHEN region_type = 'Section-header' THEN '## ' || t WHEN region_type = 'Caption' THEN '*' || t || '*'
  WHEN region_type = 'List-item' AND NOT regexp_matches(t, '^(- |\\* |\\d)') THEN '- ' || t WHEN region_type = 'Table' AND NOT contains(t, '|') THEN '```table' || chr(10) || t || chr(10) || '```' ELSE t END"""
_ASSEMBLED = f"""{REGIONS}, o AS (SELECT doc_id, {_ORDER} AS reading_order, region_type, {stripped('text')} AS t FROM regions),
pages_ AS (SELECT doc_id, string_agg(t, chr(10) || chr(10) ORDER BY reading_order) AS plain_text, string_agg({_MD}, chr(10) || chr(10) ORDER BY reading_order) AS markdown FROM o WHERE t <> '' GROUP BY doc_id)"""


@query(f"WITH {_ASSEMBLED} SELECT * FROM pages_")
def ly_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ly.assemble(ly.reading_order(regions(spark, sf_dir), ["doc_id"]), ["doc_id"])


@query(
    f"""WITH {_ASSEMBLED} SELECT doc_id // 8 AS volume, string_agg(plain_text, chr(10) || chr(10) || '=== PAGE BREAK ===' || chr(10) || chr(10) ORDER BY doc_id % 8) AS plain_text,
  string_agg('# Page ' || (doc_id % 8) || ' [General]' || chr(10) || chr(10) || markdown, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY doc_id % 8) AS markdown FROM pages_ GROUP BY doc_id // 8"""
)
def ly_pages_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = ly.assemble(ly.reading_order(regions(spark, sf_dir), ["doc_id"]), ["doc_id"])
    own = own.withColumns({"volume": F.expr("doc_id div 8"), "page_number": F.col("doc_id") % 8, "subject": F.lit("General")})
    return ly.concat_pages(own, ["volume"])


@query(
    f"""WITH {REGIONS}, a AS (SELECT *, greatest(6, floor(greatest(1, ymax - ymin) * 0.18::DOUBLE)) AS v, greatest(6, floor(greatest(1, xmax - xmin) * 0.08::DOUBLE)) AS h FROM regions),
n AS (SELECT a.doc_id, a.region_id, max(b.ymax) FILTER (b.ymax <= a.ymin AND least(a.xmax, b.xmax) > greatest(a.xmin, b.xmin)) AS above,
    min(b.ymin) FILTER (b.ymin >= a.ymax AND b.ymax > a.ymin AND least(a.xmax, b.xmax) > greatest(a.xmin, b.xmin)) AS below,
    max(b.xmax) FILTER (b.xmax <= a.xmin AND least(a.ymax, b.ymax) > greatest(a.ymin, b.ymin)) AS lft, min(b.xmin) FILTER (b.xmin >= a.xmax AND b.xmax > a.xmin AND least(a.ymax, b.ymax) > greatest(a.ymin, b.ymin)) AS rgt
  FROM a LEFT JOIN a b ON a.doc_id = b.doc_id AND (a.xmin, a.ymin, a.xmax, a.ymax) <> (b.xmin, b.ymin, b.xmax, b.ymax) GROUP BY a.doc_id, a.region_id),
p AS (SELECT doc_id, region_id, greatest(0, xmin - h, coalesce(lft, 0)) AS x0, greatest(0, ymin - v, coalesce(above, 0)) AS y0, least({PAGE}, xmax + h, coalesce(rgt, {PAGE})) AS x1, least(1000000, ymax + v, coalesce(below, 1000000)) AS y1
  FROM a JOIN n USING (doc_id, region_id)),
c AS (SELECT doc_id, region_id, CAST(greatest(0, least({PAGE} - 1, x0)) AS INT) AS pxmin, CAST(greatest(0, least(999999, y0)) AS INT) AS pymin, x1, y1 FROM p)
SELECT doc_id, region_id, pxmin, pymin, CAST(greatest(pxmin + 1, least({PAGE}, x1)) AS INT) AS pxmax, CAST(greatest(pymin + 1, least(1000000, y1)) AS INT) AS pymax FROM c"""
)
def ly_padding(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = regions(spark, sf_dir).withColumns({"page_width": F.lit(PAGE), "page_height": F.lit(1_000_000)})
    return ly.padded(own, ["doc_id"]).select("doc_id", "region_id", "pxmin", "pymin", "pxmax", "pymax")


@query()
def ly_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A greedy fold; tested against a brute-force version."""
    return ly.merge_lines(regions(spark, sf_dir), ["doc_id"])


@query(f"WITH {REGIONS} SELECT doc_id, region_id, '#' || region_id || ' [' || region_type || '] ' || CAST(floor(confidence * 100) AS INT) || '%' AS label FROM regions")
def io_overlay_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions(spark, sf_dir).select("doc_id", "region_id", ly.overlay_label().alias("label"))
