"""Queries on study modes, histories, readings at several scales and the suites of accuracy reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions import lexicons as lx
from scriptorium.functions import text as tx
from scriptorium.operators import cards as dk
from scriptorium.operators import evaluation as ev
from scriptorium.operators import proofreading as pr
from scriptorium.operators import recognition as rg
from scriptorium.operators import structure as st
from scriptorium.operators import vocabulary as vo
from scriptorium.plans import learning, pages, texts
from scriptorium.plans.registry import CORPUS, REGIONS, corpus, query, regions, replaced, stripped, table, unequal, words_of

# -- recognition -----------------------------------------------------------


@query(
    f"""WITH {pages._scored(lx.SCALE_WORDS, pages._PLAIN)}, base AS (SELECT *, confidence >= 0.65 AND NOT ({unequal('text')}) AS sure FROM cands WHERE place = 0)
SELECT b.doc_id, b.region_id, CASE WHEN sure THEN b.text ELSE coalesce(best.t, b.text) END AS selected_text, CASE WHEN sure THEN b.confidence ELSE coalesce(best.score, b.confidence) END AS confidence,
  CASE WHEN sure THEN 'original' ELSE coalesce(best.scale, 'original') END AS selected_scale, NOT sure AS multiscale_executed FROM base b LEFT JOIN best ON b.doc_id = best.doc_id AND b.region_id = best.region_id"""
)
def oc_read_scales(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = pages.candidates(spark, sf_dir)
    keys = ["doc_id", "region_id"]
    return rg.read_scales(every.where("place = 0").select(*keys, "text", "confidence"), every, keys, F.array(*(F.lit(k) for k in pages._KEYWORDS)), digits=9)


@query(
    f"""WITH {REGIONS}, r AS (SELECT doc_id, region_id, region_type, {stripped('text')} AS t FROM regions),
m AS (SELECT doc_id, string_agg(CASE region_type WHEN 'Title' THEN '# ' WHEN 'Section-header' THEN '## ' ELSE '' END || t, chr(10) || chr(10) ORDER BY region_id) FILTER (t <> '') AS markdown FROM r GROUP BY doc_id)
SELECT doc_id, coalesce(markdown, '') AS markdown FROM corpus LEFT JOIN m USING (doc_id)"""
)
def oc_crop_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rg.crop_markdown(corpus(spark, sf_dir).select("doc_id"), regions(spark, sf_dir), ["doc_id"])[1]


@query(f"WITH {REGIONS} SELECT doc_id, round(avg(confidence) * 100, 7) AS average_confidence FROM regions GROUP BY doc_id")
def oc_average_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rg.average_confidence(regions(spark, sf_dir), ["doc_id"], digits=7)


# -- subjects, routes ------------------------------------------------------


@query(f"WITH {CORPUS} SELECT doc_id, 'Physics' AS subject, 1.0::DOUBLE AS subject_confidence FROM corpus")
def rc_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.subject(corpus(spark, sf_dir), override="Physics").select("doc_id", "subject", "subject_confidence")


@query(f"WITH {learning.TOKENS} SELECT word, turn % 3 = 0 AS comma, ({learning._ROUTE} AND turn % 3 <> 0) AS is_vocabulary, count(*) AS n FROM clean GROUP BY ALL")
def vo_route_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The route without parts of speech; every third turn's words are explained by a comma."""
    comma = F.col("turn") % 3 == 0
    keep = vo.is_vocabulary(F.col("word"), F.lit("Punctuation"), F.when(comma, "Add a comma."))
    return learning.tokens(spark, sf_dir).groupBy("word", comma.alias("comma"), keep.alias("is_vocabulary")).agg(F.count(F.lit(1)).alias("n"))


# -- proofreading ----------------------------------------------------------


@query(f"WITH {CORPUS}, e AS (SELECT doc_id, text, regexp_replace(text, '([. ])th', '\\1tb', 'g') AS t2 FROM corpus) SELECT doc_id, text IS DISTINCT FROM t2 AS is_dirty FROM e")
def pr_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = corpus(spark, sf_dir)
    return own.select("doc_id", pr.dirty(F.regexp_replace("text", "([. ])th", "$1tb"), F.col("text")).alias("is_dirty"))


_ACTION = "CASE event_id % 4 WHEN 2 THEN 'undo' WHEN 3 THEN 'redo' ELSE 'push' END"


@query(
    f"""WITH RECURSIVE e AS (SELECT user_id, event_id, {_ACTION} AS a, event_type || '-' || event_id AS t, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
h AS (SELECT user_id, 0::BIGINT AS n, CAST(NULL AS BIGINT) AS event_id, CAST([] AS VARCHAR[]) AS texts, -1 AS place FROM (SELECT DISTINCT user_id FROM e)
UNION ALL SELECT e.user_id, e.n, e.event_id, CASE WHEN a = 'push' THEN list_append(texts[1:place + 1], t) ELSE texts END,
  CASE WHEN a = 'push' THEN place + 1 WHEN a = 'undo' AND place > 0 THEN place - 1 WHEN a = 'redo' AND place < len(texts) - 1 THEN place + 1 ELSE place END FROM h JOIN e ON e.user_id = h.user_id AND e.n = h.n + 1)
SELECT user_id, event_id, CAST(place AS INT) AS place, texts[place + 1] AS current FROM h WHERE n > 0"""
)
def pr_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as pushes, undos and redos of their users."""
    k = F.col("event_id") % 4
    action = F.when(k == 2, "undo").when(k == 3, "redo").otherwise("push")
    own = table(spark, sf_dir, "events").select("user_id", "event_id", action.alias("action"), F.concat_ws("-", "event_type", F.col("event_id").cast("string")).alias("text"))
    return pr.history(own, ["user_id"], "event_id")


# -- study modes -----------------------------------------------------------

_CARDS = f"""w AS (SELECT conv_id, turn, {words_of('text')} AS ws FROM conversations WHERE text IS NOT NULL),
cards AS (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'fill_in_blank' WHEN 1 THEN 'multiple_choice' WHEN 2 THEN 'type_answer' ELSE 'sentence_rewrite' END AS mode,
  CASE WHEN conv_id % 3 = 0 THEN '' ELSE ws[1] END AS correct, ws[-1] AS proposed, array_to_string(ws, ' ') AS sentence FROM w WHERE len(ws) > 0)"""


@query(
    f"""WITH {_CARDS}, x AS (SELECT *, CASE WHEN mode IN ('fill_in_blank', 'multiple_choice') THEN CASE WHEN correct <> '' THEN correct ELSE proposed END WHEN mode = 'type_answer' THEN proposed ELSE sentence END AS expected,
  CASE WHEN conv_id % 2 = 0 THEN ' ' || translate(proposed, 'aeiou', 'AEIOU') || ' ' ELSE lower(sentence) END AS answer FROM cards)
SELECT conv_id, turn, mode, lower(trim(answer)) = lower(expected) AS is_right,
  list_count(list_distinct([CASE WHEN correct <> '' THEN correct ELSE proposed END, proposed, 'however', 'which'])) AS n_options FROM x"""
)
def dk_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as cards of the four study modes, answered with the last word or the whole sentence."""
    ws = F.col("ws")
    own = table(spark, sf_dir, "conversations").select("conv_id", "turn", tx.tokens(F.col("text")).alias("ws")).where("size(ws) > 0")
    own = own.select(
        "conv_id", "turn", F.element_at(F.array(*(F.lit(m) for m in dk.MODES)), (F.col("turn") % 4 + 1).cast("int")).alias("mode"), F.when(F.col("conv_id") % 3 == 0, "").otherwise(ws[0]).alias("correct"),
        F.element_at(ws, -1).alias("proposed"), F.array_join(ws, " ").alias("sentence"),
    )
    answer = F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit(" "), F.translate("proposed", "aeiou", "AEIOU"), F.lit(" "))).otherwise(F.lower("sentence"))
    expected = dk.expected_answer(F.col("mode"), F.col("correct"), F.col("proposed"), F.col("sentence"))
    plain = F.when(F.col("correct") != "", F.col("correct")).otherwise(F.col("proposed"))
    options = dk.answer_options(F.array().cast("array<string>"), plain, F.col("proposed"))
    return own.select("conv_id", "turn", "mode", dk.is_right(answer, expected).alias("is_right"), F.size(options).cast("long").alias("n_options"))


@query(
    f"""WITH {learning.STYLED}, l(name) AS (VALUES ('Easy'), ('Medium'), ('Hard')), d AS (SELECT DISTINCT doc_id FROM carded), n AS (SELECT doc_id, difficulty AS name, count(*) AS n FROM carded GROUP BY ALL)
SELECT doc_id, name, coalesce(n, 0) AS n FROM d CROSS JOIN l LEFT JOIN n USING (doc_id, name)"""
)
def dk_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dk.distribution(dk.decks(learning.styled(spark, sf_dir).withColumn("category", F.col("card_category")), ["doc_id"]), ["doc_id"], "difficulties")


@query("SELECT DISTINCT conv_id, 'Talk ' || conv_id AS title FROM conversations WHERE contains(lower('Talk ' || conv_id), '1') AND conv_id % 2 = 0")
def dk_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "conversations").select("conv_id").distinct()
    own = own.select("conv_id", F.concat(F.lit("Talk "), "conv_id").alias("title"), F.lit("Notes").alias("category"), (F.col("conv_id") % 2 == 0).alias("has_deck"))
    return dk.history_matching(own, search="1", kind="flashcards").select("conv_id", "title")


# -- suites ----------------------------------------------------------------


def _histogram(column: str) -> str:
    return f"(SELECT '{{' || string_agg('\"' || {column} || '\":' || n, ',' ORDER BY {column}) || '}}' FROM (SELECT {column}, count(*) AS n FROM carded GROUP BY {column}))"


@query(
    f"""WITH {learning.STYLED}, t AS (SELECT (SELECT count(DISTINCT conv_id) FROM conversations) AS cases, (SELECT count(*) FROM corr) AS accepted, (SELECT count(*) FROM carded) AS made)
SELECT cases AS total_test_cases, accepted AS total_accepted_corrections, made AS total_flashcards_created, round(made / CAST(greatest(1, accepted) AS DOUBLE), 4) AS conversion_rate,
  {_histogram("card_category")} AS category_distribution, {_histogram("card_style")} AS card_style_distribution FROM t"""
)
def ev_flashcard_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards of the conversations' corrections."""
    cases = table(spark, sf_dir, "conversations").select("conv_id").distinct()
    made = learning.styled(spark, sf_dir).select(F.col("card_category").alias("category"), "card_style")
    return ev.flashcard_report(cases, learning.corrections(spark, sf_dir), made).withColumns({c: F.to_json(c) for c in ("category_distribution", "card_style_distribution")})


@query(
    f"""WITH {CORPUS}, {texts.RECOVERED}, decks AS (SELECT DISTINCT doc_id FROM (WITH {learning.FALLBACK} SELECT doc_id FROM fallback)),
cases AS (SELECT r.doc_id, substr({stripped("r.text")}, 1, 25) AS expected, r.recovered_text, d.doc_id IS NOT NULL AS has_deck FROM rec r LEFT JOIN decks d ON d.doc_id = r.doc_id),
t AS (SELECT count(*) AS n, count(*) FILTER (contains(lower(recovered_text), lower(expected))) AS found, count(*) FILTER (has_deck) AS decks FROM cases)
SELECT n AS total_test_cases, found AS successful_text_recoveries, round(found / CAST(n AS DOUBLE), 4) AS recovery_success_rate, decks AS successful_deck_generations, round(decks / CAST(n AS DOUBLE), 4) AS deck_generation_rate FROM t"""
)
def ev_resilience_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether recovery leaves the beginning of each text as it was, and whether its words make a deck."""
    docs = corpus(spark, sf_dir)
    decks = dk.fallback_words(docs, ["doc_id"], list(learning._DICTIONARY)).select("doc_id").distinct().withColumn("has_deck", F.lit(True))
    cases = docs.select("doc_id", F.substring(tx.strip(F.col("text")), 1, 25).alias("expected"), tx.recovered(F.col("text")).alias("corrected_text")).join(decks, "doc_id", "left")
    return ev.resilience_report(cases.withColumn("has_deck", F.coalesce("has_deck", F.lit(False))))


def resilience_cases(spark: SparkSession) -> DataFrame:
    """The noisy handwriting cases with what analysis makes of them."""
    own = spark.createDataFrame(list(ev.NOISY_CASES), "test_id string, raw string, expected string")
    return pr.analyze(own, "raw", ("test_id",))[0]


_FIXED = replaced(replaced("replace(truth, 'th', 'tb')", lx.HEADINGS), lx.VISUAL)


@query(
    f"""WITH {learning.PAIRS}, c AS (SELECT truth, {_FIXED} AS predicted FROM pairs), w AS (SELECT *, list_distinct(list_concat({words_of('predicted')}, {words_of('truth')})) AS u FROM c),
s AS (SELECT {learning._rate('predicted', True)} AS cer, {learning._rate('predicted', False)} AS wer, trim(predicted) = trim(truth) AS exact FROM w)
SELECT count(*) AS total_benchmark_samples, round(avg(cer), 4) AS pipeline_mean_cer, round(avg(wer), 4) AS pipeline_mean_wer, round(count(*) FILTER (exact) / CAST(greatest(1, count(*)) AS DOUBLE), 4) AS pipeline_sentence_accuracy FROM s"""
)
def ev_pipeline_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = learning.pairs(spark, sf_dir)
    samples = own.select("truth", F.create_map(F.lit("easyocr"), "guess", F.lit("trocr"), F.replace("truth", F.lit("th"), F.lit("tb"))).alias("hypotheses"))
    return ev.pipeline_rates(samples, lambda c: st.heading_fixes(c)[0], lambda c: rg.verified(c)[0])
