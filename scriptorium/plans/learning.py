"""Queries on vocabulary, study cards, profiles and accuracy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions import lexicons as lx
from scriptorium.functions import scores as sc
from scriptorium.functions import text as tx
from scriptorium.operators import cards as dk
from scriptorium.operators import evaluation as ev
from scriptorium.operators import profiles as ad
from scriptorium.operators import proofreading as pr
from scriptorium.operators import structure as st
from scriptorium.operators import tagging as tg
from scriptorium.operators import vocabulary as vo
from scriptorium.plans.registry import CORPUS, corpus, query, quoted, sql_list, sql_text, table, words_of
from scriptorium.sources import decks as library

# -- vocabulary ------------------------------------------------------------

_LETTERS = "lower(regexp_replace(word, '[^a-zA-Z]', '', 'g'))"
TOKENS = f"tokens AS (SELECT conv_id, turn, text, unnest({words_of('text')}) AS word FROM conversations), clean AS (SELECT *, {_LETTERS} AS w FROM tokens)"
POS = f"""{TOKENS}, tagged AS (SELECT *, CASE WHEN w = '' THEN 'grammar' WHEN w LIKE '%ly' THEN 'adverb' WHEN w LIKE '%ed' OR w LIKE '%ing' THEN 'verb' WHEN regexp_matches(w, '(tion|ment|ness|ity)$') THEN 'noun'
  WHEN w IN ('very', 'extremely', 'really', 'so', 'too') THEN 'adverb' WHEN w IN ('dirty', 'clean', 'happy', 'sad', 'big', 'small') THEN 'adjective' ELSE 'noun' END AS pos,
  CASE WHEN w = '' THEN 0.0 WHEN regexp_matches(w, '(ly|ed|ing|tion|ment|ness|ity)$') THEN 0.75 WHEN w IN ('very', 'extremely', 'really', 'so', 'too', 'dirty', 'clean', 'happy', 'sad', 'big', 'small') THEN 0.95 ELSE 0.60 END::DOUBLE AS pos_confidence FROM clean)"""


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", F.explode(tx.tokens(F.col("text"))).alias("word"))


def tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    pos, conf = vo.part_of_speech(F.col("word"))
    return tokens(spark, sf_dir).withColumns({"pos": pos, "pos_confidence": conf})


@query(f"WITH {POS} SELECT pos, pos_confidence, count(*) AS n, count(DISTINCT word) AS n_words FROM tagged GROUP BY pos, pos_confidence")
def vo_pos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tagged(spark, sf_dir).groupBy("pos", "pos_confidence").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("word").alias("n_words"))


_ROUTE = f"""length(w) >= 2 AND w NOT IN ({", ".join(quoted(x) for x in lx.FUNCTION_WORDS)}) AND NOT regexp_matches(word, '[\\d@#$%^&*()_+=\\[\\]{{}}<>\\\\/|]') AND NOT (length(word) > 1 AND upper(word) = word AND regexp_matches(word, '^\\p{{Lu}}'))"""


@query(f"WITH {POS} SELECT word, pos, ({_ROUTE}) AS is_vocabulary, count(*) AS n FROM tagged GROUP BY ALL")
def vo_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    keep = vo.is_vocabulary(F.col("word"), F.lit("Spelling Correction"), F.lit(""), F.col("pos"))
    return tagged(spark, sf_dir).groupBy("word", "pos", keep.alias("is_vocabulary")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH RECURSIVE {tg.sql()} SELECT conv_id, turn, sentence, place, token, tag FROM tags")
def vo_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best tags of every sentence of the conversations."""
    return tg.tokens(table(spark, sf_dir, "conversations"), ["conv_id", "turn"])


@query()
def vo_tags_learned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by a model that all documents have re-estimated."""
    return tg.tokens(table(spark, sf_dir, "conversations"), ["conv_id", "turn"], model=tg.learn(table(spark, sf_dir, "documents")))


#: a small lexicon over words of the test tables: word, pos, place, sense, definition, child definition, example, priority
SENSES = (
    ("the", "noun", 0, "the.noun.01", "A word that stands before a thing.", "Points at a thing.", "We read the book in the shade.", 1),
    ("the", "noun", 1, "the.noun.02", "Marks that and this in of to.", "Marks something.", "In that of this and to of.", 2),
    ("of", "noun", 0, "of.noun.01", "Belonging or part.", "Part of something.", "A piece of cake.", 1),
    ("and", "noun", 0, "and.noun.01", "Joins words the heed.", "Joins two words.", "", 3),
    ("the", "determiner", 0, "the.det.01", "Points at one thing that is known.", "Points at a thing.", "The in that of heed.", 1),
    ("the", "determiner", 1, "the.det.02", "Marks that and this in of to.", "Marks something.", "In that of this and to of.", 2),
    ("of", "preposition", 0, "of.prep.01", "Belonging to, or part.", "Part of something.", "A piece of cake.", 1),
    ("and", "conjunction", 0, "and.conj.01", "Joins words the heed.", "Joins two words.", "", 3),
    ("in", "preposition", 0, "in.prep.01", "Inside of and within.", "Inside.", "In the house.", 1),
    ("in", "adverb", 0, "in.adv.01", "To the inside.", "Into.", "Come in.", 1),
    ("bleed", "verb", 0, "bleed.verb.01", "To lose blood.", "To lose blood.", "A small cut may bleed.", 1),
)
_SENSE_ROWS = ", ".join("(" + ", ".join(quoted(x) if isinstance(x, str) else str(x) for x in r) + ")" for r in SENSES)


def senses(spark: SparkSession) -> DataFrame:
    own = spark.createDataFrame(list(SENSES), "word string, pos string, ord int, sense_id string, definition string, child_def string, example string, priority int")
    none = F.array().cast("array<string>")
    return own.withColumns({"synonyms": none, "antonyms": none, "source": F.lit("Learner lexicon")})


_STOP = sql_list("the and was were this that".split())


def _bag(expr: str) -> str:
    return f"list_distinct(list_filter(list_filter(string_split_regex(lower({expr}), '[^\\p{{L}}\\p{{N}}_]+'), lambda x: regexp_full_match(x, '[a-z]{{3,}}')), lambda x: x <> lower(word) AND NOT list_contains({_STOP}, x)))"


@query(
    f"""WITH RECURSIVE {POS}, {tg.sql()}, first AS (SELECT conv_id, turn, lower(regexp_replace(token, '[^a-zA-Z]', '', 'g')) AS w, arg_min(tag, {{'s': sentence, 'p': place}}) AS tag FROM tags GROUP BY ALL),
senses(sw, spos, ord, sense_id, definition, child_def, example, priority) AS (VALUES {_SENSE_ROWS}), d AS (SELECT DISTINCT g.conv_id, g.turn, g.text, g.word, g.w, CASE WHEN g.w = '' THEN 'grammar' ELSE coalesce(replace(f.tag, 'other', 'noun'), g.pos) END AS pos
  FROM tagged g LEFT JOIN first f ON f.conv_id = g.conv_id AND f.turn = g.turn AND f.w = g.w),
j AS (SELECT d.*, s.*, {_bag('text')} AS a, {_bag("definition || ' ' || example")} AS b FROM d JOIN senses s ON d.w = s.sw AND d.pos = s.spos),
k AS (SELECT *, len(list_intersect(a, b)) AS shared, len(list_distinct(list_concat(a, b))) AS total FROM j),
r AS (SELECT *, round(least(1.0::DOUBLE, greatest(0.20::DOUBLE, shared::DOUBLE / greatest(1, total) * 0.30::DOUBLE + CASE priority WHEN 1 THEN 0.25 WHEN 2 THEN 0.10 ELSE 0.0 END::DOUBLE + CASE WHEN shared > 0 THEN 0.15 ELSE 0.0 END::DOUBLE)), 4) AS similarity FROM k)
SELECT conv_id, turn, word, sense_id, round(similarity, 3) AS similarity FROM r QUALIFY row_number() OVER (PARTITION BY conv_id, turn, word ORDER BY similarity DESC, priority, ord) = 1"""
)
def vo_rank_senses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Senses of each word that have its part of speech in the turn."""
    # words without an entry have no sense; the words of a turn stay together, so that its sentences are tagged once
    known = sorted({r[0] for r in SENSES})
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("sentence"))
    turns = turns.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "conv_id", "turn")  # tagging is dear and texts are not
    own = F.filter(F.array_distinct(tx.tokens(F.col("sentence"))), lambda w: tx.letters(w).isin(known))
    words = turns.select("conv_id", "turn", F.explode(own).alias("word"), "sentence")
    words = tg.in_context(words, F.col("word"), F.col("sentence")).drop("pos_confidence")
    best = vo.rank_senses(words, senses(spark), ["conv_id", "turn", "word"])
    return best.select("conv_id", "turn", "word", "sense_id", F.round("similarity", 3).alias("similarity"))


@query(
    f"""WITH {POS}, s AS (SELECT DISTINCT word, pos_confidence, (length(word) % 10) / 10.0::DOUBLE AS sim FROM tagged), c AS (SELECT *, round(pos_confidence * 0.35::DOUBLE + least(1.0, greatest(0.30, sim))::DOUBLE * 0.45::DOUBLE + 0.18::DOUBLE, 6) AS confidence FROM s)
SELECT word, confidence, confidence < 0.70 AS verify FROM c"""
)
def vo_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = tagged(spark, sf_dir).select("word", "pos_confidence").distinct()
    conf, verify = vo.confidence(F.col("pos_confidence"), (F.length("word") % 10) / 10.0)
    return own.select("word", conf.alias("confidence"), verify.alias("verify"))


@query(
    """WITH p AS (SELECT a.vec_id, a.embedding AS x, b.embedding AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id - 1)
SELECT vec_id, round(list_cosine_similarity(list_transform(x, lambda v: v::DOUBLE), list_transform(y, lambda v: v::DOUBLE)), 6) AS similarity FROM p"""
)
def vo_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    before = e.select((F.col("vec_id") + 1).alias("vec_id"), F.col("embedding").alias("y"))
    return e.join(before, "vec_id").select("vec_id", F.round(sc.cosine(F.col("embedding"), F.col("y")), 6).alias("similarity"))


# -- cards -----------------------------------------------------------------

#: corrections from the conversations: of each two words of a turn the second replaces the first, with a category and an explanation by place
CORRECTIONS = f"""w AS (SELECT conv_id, turn, {words_of('text')} AS ws FROM conversations),
p AS (SELECT *, unnest(range(0, greatest(1, (len(ws) + 1) // 2))) AS k FROM w),
corr AS (SELECT conv_id AS doc_id, turn * 1000 + k AS ord, coalesce(ws[2 * k + 1], '') AS original, CASE WHEN (turn + k) % 5 = 3 THEN coalesce(ws[2 * k + 1], '') ELSE coalesce(ws[2 * k + 2], '') END AS proposed,
  CASE (turn + k) % 6 WHEN 0 THEN 'Spelling Correction' WHEN 1 THEN 'Missing Word' WHEN 2 THEN 'Punctuation Improvement' WHEN 3 THEN 'Capitalization' WHEN 4 THEN 'Vocabulary Improvement' ELSE 'Grammar Correction' END AS category,
  CASE (turn + k) % 4 WHEN 0 THEN 'Check the verb tense here.' WHEN 1 THEN 'Use an article.' WHEN 2 THEN '' ELSE 'Contextual homophone' END AS explanation, 0.80::DOUBLE + ((turn + k) % 3) / 20.0::DOUBLE AS confidence FROM p)"""


def corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = ("Spelling Correction", "Missing Word", "Punctuation Improvement", "Capitalization", "Vocabulary Improvement", "Grammar Correction")
    notes = ("Check the verb tense here.", "Use an article.", "", "Contextual homophone")
    own = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce(tx.tokens(F.col("text")), F.array().cast("array<string>")).alias("ws"))
    last = F.greatest(F.lit(0), F.floor((F.size("ws") + 1) / 2).cast("int") - 1)
    own = own.select("*", F.explode(F.sequence(F.lit(0), last)).alias("k"))
    first, second = (F.coalesce(F.get("ws", 2 * F.col("k") + i), F.lit("")) for i in (0, 1))
    place = F.col("turn") + F.col("k")
    return own.select(
        F.col("conv_id").alias("doc_id"), (F.col("turn") * 1000 + F.col("k")).cast("long").alias("ord"), first.alias("original"), F.when(place % 5 == 3, first).otherwise(second).alias("proposed"),
        F.element_at(F.array(*(F.lit(k) for k in kinds)), (place % 6 + 1).cast("int")).alias("category"), F.element_at(F.array(*(F.lit(k) for k in notes)), (place % 4 + 1).cast("int")).alias("explanation"),
        (0.80 + (place % 3) / 20.0).alias("confidence"),
    )


_N = lambda c: f"len({words_of(c)})"
_OPP = f"""CASE WHEN contains(lower(explanation), 'article') OR lower(original) IN ('a', 'an', 'the') OR lower(proposed) IN ('a', 'an', 'the') THEN 'Article Usage'
  WHEN regexp_matches(lower(explanation), 'subject-verb|agreement') THEN 'Subject-Verb Agreement' WHEN regexp_matches(lower(explanation), 'tense|past participle') THEN 'Verb Tense'
  WHEN contains(lower(explanation), 'preposition') OR lower(original) IN ('on', 'in', 'at', 'to', 'for', 'with', 'by', 'from', 'of') THEN 'Preposition Usage'
  WHEN regexp_matches(lower(explanation), 'apostrophe|comma|period|question mark') OR category IN ('Punctuation Correction', 'Punctuation Improvement') THEN 'Punctuation Correction'
  WHEN category IN ('Capitalization', 'Capitalization Correction') OR contains(lower(explanation), 'capitalize') THEN 'Capitalization Correction'
  WHEN category IN ('Contextual Substitution', 'Contextual Word Correction') OR regexp_matches(lower(explanation), 'homophone|contextual') THEN 'Contextual Word Correction'
  WHEN category IN ('Spelling Correction', 'Spelling Mistake', 'Character Confusion', 'OCR Confidence Recovery') OR regexp_matches(lower(explanation), 'spelling|typo') THEN 'Spelling Mistake'
  WHEN category = 'Missing Word' OR original = '' THEN 'Missing Word' WHEN {_N('original')} > 2 OR {_N('proposed')} > 2 THEN 'Sentence Restructuring' ELSE category END"""
_STYLES = "CASE learning_category " + " ".join(f"WHEN {quoted(k)} THEN {quoted(v)}" for k, v in lx.CARD_STYLES.items()) + " ELSE 'grammar_explanation' END"


@query(
    f"""WITH {CORRECTIONS}, o AS (SELECT *, 'opp_' || row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS opportunity_id, {_OPP} AS learning_category FROM corr)
SELECT doc_id, opportunity_id, learning_category, {_STYLES} AS card_style FROM o WHERE original <> '' OR proposed <> ''"""
)
def dk_opportunities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dk.opportunities(corrections(spark, sf_dir), ["doc_id"]).select("doc_id", "opportunity_id", "learning_category", "card_style")


_STYLE = f"""CASE WHEN regexp_matches(lower(category), 'spelling|typo') OR contains(lower(explanation), 'spell') THEN 'spelling' WHEN regexp_matches(lower(category), 'missing|omitted') OR contains(lower(explanation), 'missing') THEN 'fill_in_blank'
  WHEN regexp_matches(lower(category), 'punctuation|comma|period') THEN 'punctuation_practice' WHEN contains(lower(category), 'capital') OR lower(original) = lower(proposed) THEN 'capitalization_rule'
  WHEN regexp_matches(lower(category), 'vocab|style') OR contains(lower(explanation), 'word choice') THEN 'vocabulary' WHEN contains(lower(category), 'structur') OR {_N('original')} > 3 THEN 'sentence_reconstruction' ELSE 'grammar_explanation' END"""
_LEVEL = """CASE WHEN card_style IN ('spelling', 'capitalization_rule') THEN CASE WHEN length(original) <= 6 AND abs(length(original) - length(proposed)) <= 1 THEN 'Easy' ELSE 'Medium' END
  WHEN card_style IN ('fill_in_blank', 'punctuation_practice') THEN CASE WHEN ord % 20 + 4 <= 8 THEN 'Easy' ELSE 'Medium' END WHEN card_style = 'vocabulary' THEN CASE WHEN length(proposed) >= 9 THEN 'Hard' ELSE 'Medium' END
  WHEN card_style = 'sentence_reconstruction' THEN CASE WHEN ord % 20 + 4 > 12 THEN 'Hard' ELSE 'Medium' END WHEN regexp_matches(lower(explanation), 'subj|tense|clause') THEN 'Medium' WHEN ord % 20 + 4 > 15 THEN 'Hard' ELSE 'Easy' END"""
_TAGS = """list_sort(list_distinct(list_filter([card_category, CASE WHEN regexp_matches(lower(explanation), 'verb|tense') THEN 'Verb Tense' END, CASE WHEN regexp_matches(lower(explanation), 'subject|agreement') THEN 'Subject-Verb Agreement' END,
  CASE WHEN contains(lower(explanation), 'article') OR lower(original) IN ('a', 'an', 'the') THEN 'Articles' END, CASE WHEN contains(lower(explanation), 'prep') OR lower(original) IN ('in', 'on', 'at', 'to', 'for', 'with', 'by', 'from') THEN 'Prepositions' END,
  CASE WHEN card_style = 'vocabulary' OR length(proposed) >= 8 THEN 'Academic Vocabulary' END, CASE WHEN contains(lower(explanation), 'ocr') THEN 'OCR Recovery' END, CASE WHEN card_style = 'sentence_reconstruction' THEN 'Sentence Structure' END], lambda x: x IS NOT NULL)))"""
STYLED = f"""{CORRECTIONS}, styled0 AS (SELECT *, {_STYLE} AS card_style FROM corr WHERE original <> '' AND proposed <> '' AND original <> proposed),
styled AS (SELECT *, CASE card_style WHEN 'spelling' THEN 'Spelling Correction' WHEN 'fill_in_blank' THEN 'Missing Word' WHEN 'punctuation_practice' THEN 'Punctuation' WHEN 'capitalization_rule' THEN 'Capitalization'
  WHEN 'vocabulary' THEN 'Vocabulary Improvement' WHEN 'sentence_reconstruction' THEN 'Sentence Structure' ELSE 'Grammar Correction' END AS card_category FROM styled0),
carded AS (SELECT *, {_LEVEL} AS difficulty, array_to_string({_TAGS}, ', ') AS tags FROM styled)"""


def styled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Convertible corrections with style, difficulty and tags; a correction at place k has k mod 20 + 4 words of context."""
    own = dk.with_defaults(corrections(spark, sf_dir))
    own = own.where(dk.convertible(own))
    o, p, e = F.col("original"), F.col("proposed"), F.col("explanation")
    style, category = dk.resolved_style(F.col("category"), o, p, e)
    own = own.withColumns({"card_style": style, "card_category": category})
    sentence = F.repeat(F.lit("word "), (F.col("ord") % 20 + 4).cast("int"))
    s = F.col("card_style")
    return own.withColumns({"difficulty": dk.difficulty(s, o, p, sentence, e), "tags": dk.tags(F.col("card_category"), s, o, p, e)})


@query(f"WITH {STYLED} SELECT doc_id, ord, card_style, card_category, difficulty, tags FROM carded")
def dk_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    return styled(spark, sf_dir).select("doc_id", "ord", "card_style", "card_category", "difficulty", F.array_join("tags", ", ").alias("tags"))


_CONCEPT = "lower(category) || ':' || lower(original) || '->' || lower(proposed)"


@query(f"WITH {STYLED} SELECT {_CONCEPT} AS concept, arg_min(original, doc_id * 1000000 + ord) AS original, count(*) AS n_merged FROM carded GROUP BY {_CONCEPT}")
def dk_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concepts over all conversations as one document."""
    own = styled(spark, sf_dir).withColumns({"ord": F.col("doc_id") * 1000000 + F.col("ord"), "corrected_sentence": F.lit(""), "all_docs": F.lit(0)}).drop("doc_id")
    return dk.merged_concepts(own, ["all_docs"]).select("concept", "original", F.col("n_merged").cast("long"))


@query(
    f"""WITH {STYLED} SELECT doc_id, count(*) AS total_flashcards, count(*) FILTER (difficulty = 'Easy') AS easy, count(*) FILTER (difficulty = 'Medium') AS medium, count(*) FILTER (difficulty = 'Hard') AS hard,
  count(DISTINCT card_category) AS n_categories, CAST(greatest(1, round_even(count(*) * 1.5, 0)) AS INT) AS estimated_study_time_min, 'deck_' || substr(md5(doc_id::VARCHAR), 1, 10) AS deck_id FROM carded GROUP BY doc_id"""
)
def dk_deck(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = dk.decks(styled(spark, sf_dir).withColumn("category", F.col("card_category")), ["doc_id"])
    d = F.col("difficulties")
    return own.select("doc_id", "total_flashcards", d["Easy"].alias("easy"), d["Medium"].alias("medium"), d["Hard"].alias("hard"), F.size("categories").cast("long").alias("n_categories"), "estimated_study_time_min", "deck_id")


@query(
    f"""WITH {STYLED}, m AS (SELECT doc_id, {_CONCEPT} AS concept, count(*) AS n, arg_min(confidence, ord) AS confidence FROM carded GROUP BY ALL), a AS (SELECT doc_id, count(*) AS p, count(*) FILTER (original = '' OR proposed = '' OR original = proposed) AS u FROM corr GROUP BY doc_id)
SELECT a.doc_id, max(p) AS accepted_corrections_processed, max(u) AS unconvertible_corrections, coalesce(sum(n - 1), 0)::BIGINT AS duplicate_cards_removed, count(concept) AS flashcards_generated, round(coalesce(avg(confidence), 0), 7)::DOUBLE AS mean_confidence
FROM a LEFT JOIN m USING (doc_id) GROUP BY a.doc_id"""
)
def dk_telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = corrections(spark, sf_dir)
    made = dk.merged_concepts(own.withColumn("corrected_sentence", F.lit("")), ["doc_id"])
    return dk.telemetry(own, made, ["doc_id"], digits=7)


@query(
    """WITH c AS (SELECT DISTINCT user_id % 50 AS deck_id, user_id AS card FROM events), u AS (SELECT user_id AS card, arg_max(event_type, event_id) AS t FROM events WHERE event_type IN ('purchase', 'error', 'signup') GROUP BY user_id)
SELECT deck_id, count(*) AS cards_completed, count(*) FILTER (t = 'purchase') AS cards_mastered, count(*) FILTER (t = 'signup') AS cards_bookmarked, round(100.0 * count(*) FILTER (t = 'purchase') / count(*), 1)::DOUBLE AS mastery_percentage
FROM c LEFT JOIN u USING (card) GROUP BY deck_id"""
)
def dk_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as cards of 50 decks, their events as updates: a purchase masters, a signup bookmarks, an error resets."""
    e = table(spark, sf_dir, "events")
    false = F.lit(False)
    cards = e.select((F.col("user_id") % 50).alias("deck_id"), F.col("user_id").alias("card_id")).distinct().withColumns({f: false for f in dk.FLAGS})
    kind = F.col("event_type")
    updates = e.where(kind.isin("purchase", "error", "signup")).select(
        F.col("user_id").alias("card_id"), F.col("event_id").alias("ord"), (kind == "purchase").alias("is_mastered"), (kind == "signup").alias("is_bookmarked"), F.when(kind == "error", True).alias("needs_review")
    )
    return dk.progress(cards, updates, ["deck_id"])[1]


@query(f"WITH {STYLED} SELECT doc_id, ord, difficulty FROM carded WHERE difficulty = 'Medium' AND (ord % 3 <> 0 OR ord % 2 = 0) AND (contains(lower(original), 'th') OR contains(lower(tags), 'th'))")
def dk_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards in review: those at every third place are mastered, those at even ones bookmarked."""
    own = styled(spark, sf_dir).withColumns({"is_mastered": F.col("ord") % 3 == 0, "is_bookmarked": F.col("ord") % 2 == 0, "original_sentence": F.col("original"), "corrected_sentence": F.lit("")})
    own = own.withColumn("explanation", F.lit(""))
    return dk.matching(own, level="Medium", review=True, search="th").select("doc_id", "ord", "difficulty")


_DICTIONARY = ("there", "heat", "tion", "volume", "that", "with")
_FOUND = "list_transform(regexp_extract_all(regexp_replace(text, '[^\\x00-\\x7F]', '_', 'g'), '\\b[A-Za-z]{3,}\\b'), lambda w: lower(w))"


FALLBACK = (
    f"""{CORPUS}, f AS (SELECT doc_id, {_FOUND} AS ws FROM corpus), p AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS nth FROM f), d AS (SELECT doc_id, word, min(nth) AS nth FROM p GROUP BY doc_id, word),
k AS (SELECT *, word IN ({", ".join(quoted(w) for w in _DICTIONARY)}) AS known FROM d), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, known ORDER BY nth) AS n FROM k),
c AS (SELECT *, least(10, count(*) FILTER (known) OVER (PARTITION BY doc_id)) AS n_known FROM r),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN known THEN 0 ELSE 1 END, nth) AS place FROM c WHERE known AND n <= 10 OR NOT known AND n_known < 5 AND length(word) >= 4 AND word NOT IN ({", ".join(quoted(w) for w in lx.FUNCTION_WORDS)})),
fallback AS (SELECT doc_id, CAST(place AS INT) AS place, word, CASE WHEN length(word) <= 5 THEN 'Easy' WHEN length(word) <= 8 THEN 'Medium' ELSE 'Hard' END AS difficulty FROM o WHERE n_known >= 5 OR place <= 8)"""
)


@query(f"WITH {FALLBACK} SELECT doc_id, place, word, difficulty FROM fallback")
def dk_fallback_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dk.fallback_words(corpus(spark, sf_dir), ["doc_id"], list(_DICTIONARY)).select("doc_id", "place", "word", "difficulty")


_POS_OF = """CASE WHEN word LIKE '%ly' THEN 'adverb' WHEN word LIKE '%ed' OR word LIKE '%ing' THEN 'verb' WHEN regexp_matches(word, '(tion|ment|ness|ity)$') THEN 'noun'
  WHEN word IN ('very', 'extremely', 'really', 'so', 'too') THEN 'adverb' WHEN word IN ('dirty', 'clean', 'happy', 'sad', 'big', 'small') THEN 'adjective' ELSE 'noun' END"""


@query(
    f"""WITH {FALLBACK}, t AS (SELECT *, 'Document ' || doc_id AS title, {_POS_OF} AS pos, word NOT IN ({", ".join(quoted(x) for x in lx.FUNCTION_WORDS)}) AS vocab FROM fallback)
SELECT doc_id, 'card_text_' || doc_id || '_' || place AS card_id, word, difficulty, 0.92::DOUBLE AS confidence, 'Vocabulary_Explorer' AS card_style, 'We learned about ' || word || ' in class.' AS corrected_sentence,
  'Vocabulary Explorer: ' || upper(left(word, 1)) || substr(word, 2) AS front_title, 'Part of speech: ' || pos AS hint, 'Vocabulary, Spelling, ' || upper(left(pos, 1)) || substr(pos, 2) AS tags,
  CASE WHEN vocab THEN 'Describes or represents ' || chr(39) || word || chr(39) || ' as used in this sentence.' ELSE 'A key vocabulary term from ' || title || '.' END AS child_definition,
  CASE WHEN NOT vocab THEN 'We learned about ' || word || ' during our class study.' WHEN pos = 'noun' THEN 'The student noticed a very interesting ' || word || ' during the afternoon science lesson.'
    WHEN pos = 'verb' THEN 'We decided to ' || word || ' together after completing our morning school assignments.' WHEN pos = 'adjective' THEN 'The teacher shared a very ' || word || ' example with the whole classroom today.'
    ELSE 'The children worked ' || word || ' to finish their creative writing project on time.' END AS example,
  'Key vocabulary word extracted from ' || title || '.' AS explanation, 'Master key vocabulary term ' || chr(39) || word || chr(39) || '.' AS learning_objective FROM t"""
)
def dk_fallback_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vocabulary cards of all documents, as for documents without corrections."""
    docs = corpus(spark, sf_dir).withColumn("title", F.concat(F.lit("Document "), F.col("doc_id")))
    own = dk.fallback_cards(docs, ["doc_id"], list(_DICTIONARY))
    return own.select(
        "doc_id", "card_id", F.col("proposed").alias("word"), "difficulty", "confidence", "card_style", "corrected_sentence", F.col("front.title").alias("front_title"), F.col("front.hint").alias("hint"),
        F.array_join("tags", ", ").alias("tags"), "child_definition", "example", "explanation", "learning_objective",
    )


def conversation_corrections(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(turns as documents, their corrections): of each two words of a turn the second replaces the first, where that stands first."""
    docs = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"), F.concat(F.lit("Talk "), "conv_id").alias("title"))
    own = corrections(spark, sf_dir).select(F.col("doc_id").alias("conv_id"), F.floor(F.col("ord") / 1000).cast("long").alias("turn"), "ord", "original", "proposed", "category", "explanation", "confidence")
    own = own.join(docs.select("conv_id", "turn", "text"), ["conv_id", "turn"])
    begin = (F.position("original", "text") - 1).cast("int")
    return docs, own.withColumns({"begin": begin, "stop": (begin + F.length("original")).cast("int")}).drop("text")


@query()
def dk_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole cards of the conversations' corrections; tested against a loop, and on golden rows."""
    docs, own = conversation_corrections(spark, sf_dir)
    return dk.build_cards(docs, own, ["conv_id", "turn"], senses=senses(spark)).withColumns({"front": F.to_json("front"), "back": F.to_json("back")})


@query("SELECT 'deck_' || conv_id AS deck_id, 'Talk ' || conv_id AS source_document_title, max(turn) AS created_at, count(*) AS total_flashcards, 0.0::DOUBLE AS mastery_percentage FROM conversations GROUP BY conv_id")
def dk_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max("turn").alias("created_at"), F.count(F.lit(1)).alias("total_flashcards"))
    own = own.select(F.concat(F.lit("deck_"), "conv_id").alias("deck_id"), F.concat(F.lit("Talk "), "conv_id").alias("source_document_title"), "created_at", "total_flashcards", F.lit(None).cast("double").alias("mastery_percentage"))
    return library.listed(own)


# -- profiles --------------------------------------------------------------

#: events as feedback: what was read is the event's kind, what was meant the same or, above the middle, one letter changed or all turned round
FEEDBACK = """fb AS (SELECT CAST(user_id AS VARCHAR) AS user_id, ts, event_id, CASE WHEN event_type = 'error' THEN 'reset' ELSE 'feedback' END AS kind, event_type AS original,
  CASE WHEN event_id % 3 = 0 THEN event_type WHEN event_id % 3 = 1 THEN replace(event_type, 'i', 'l') ELSE reverse(event_type) END AS accepted FROM events),
live AS (SELECT fb.* FROM fb LEFT JOIN (SELECT user_id, max(ts) AS r FROM fb WHERE kind = 'reset' GROUP BY user_id) USING (user_id) WHERE kind = 'feedback' AND (r IS NULL OR ts > r))"""


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, k = F.col("event_type"), F.col("event_id") % 3
    accepted = F.when(k == 0, e).when(k == 1, F.replace(e, F.lit("i"), F.lit("l"))).otherwise(F.reverse(e))
    return table(spark, sf_dir, "events").select(F.col("user_id").cast("string"), "ts", "event_id", F.when(e == "error", "reset").otherwise("feedback").alias("kind"), e.alias("original"), accepted.alias("accepted"))


@query(f"WITH {FEEDBACK} SELECT user_id, count(*) AS documents_processed, count(*) FILTER (original <> accepted) AS corrections_accepted FROM fb GROUP BY user_id")
def ad_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ad.summary(feedback(spark, sf_dir))


@query(f"WITH {FEEDBACK} SELECT user_id, count(*) AS documents_processed, count(*) FILTER (original <> accepted) AS corrections_accepted FROM live GROUP BY user_id")
def ad_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ad.summary(ad.since_reset(feedback(spark, sf_dir)))


_BASE = ", ".join(f"({quoted(a)}, {quoted(b)}, {w}::DOUBLE)" for a, m in lx.CHAR_CONFUSIONS.items() for b, w in m.items())


@query(
    f"""WITH {FEEDBACK}, base(a, b, w) AS (VALUES {_BASE}), p AS (SELECT user_id, original, accepted, unnest(range(1, length(original) + 1)) AS i FROM fb WHERE original <> accepted AND length(original) = length(accepted)),
c AS (SELECT user_id, substr(original, i, 1) AS a, substr(accepted, i, 1) AS b FROM p), n AS (SELECT user_id, a, b, count(*) AS n FROM c WHERE a <> b GROUP BY ALL)
SELECT user_id, n.a AS "from", n.b AS "to", round(coalesce(w, 0.20)::DOUBLE + 0.05::DOUBLE * n, 3) AS weight FROM n LEFT JOIN base ON n.a = base.a AND n.b = base.b"""
)
def ad_confusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ad.confusions(feedback(spark, sf_dir))


@query(
    f"""WITH {FEEDBACK}, e AS (SELECT user_id, original AS t, count(*) AS n FROM fb WHERE original <> accepted GROUP BY ALL), w AS (SELECT user_id, accepted AS t, count(*) AS n FROM fb WHERE original <> accepted GROUP BY ALL),
q AS (SELECT DISTINCT user_id, original || ' ' || accepted AS text, original, accepted FROM fb UNION SELECT DISTINCT user_id, original, original, NULL FROM fb),
b AS (SELECT q.user_id, q.text, least(0.20::DOUBLE, 0.05::DOUBLE * coalesce(e.n, 0)) + least(0.12::DOUBLE, 0.03::DOUBLE * coalesce(w1.n, 0)) + least(0.12::DOUBLE, 0.03::DOUBLE * coalesce(w2.n, 0)) AS s
  FROM q LEFT JOIN e ON q.user_id = e.user_id AND q.text = e.t LEFT JOIN w w1 ON q.user_id = w1.user_id AND q.original = w1.t LEFT JOIN w w2 ON q.user_id = w2.user_id AND q.accepted = w2.t)
SELECT user_id, text, round(least(0.25::DOUBLE, s), 6) AS boost FROM b"""
)
def ad_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    fb = feedback(spark, sf_dir)
    asked = fb.select("user_id", F.concat("original", F.lit(" "), "accepted").alias("text")).union(fb.select("user_id", "original")).distinct()
    return ad.boosts(asked, ad.errors(fb), ad.words(fb))


@query(f"WITH {FEEDBACK} SELECT user_id, accepted AS word, count(*) AS n FROM fb WHERE original <> accepted GROUP BY ALL")
def ad_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream, to its end."""
    from scriptorium.sources.scratch import shared_dir
    from scriptorium.streaming import profiles as stream
    import uuid

    events = table(spark, sf_dir, "events")
    e, k = F.col("event_type"), F.col("event_id") % 3
    accepted = F.when(k == 0, e).when(k == 1, F.replace(e, F.lit("i"), F.lit("l"))).otherwise(F.reverse(e))
    live = spark.readStream.schema(events.schema).option("pathGlobFilter", "events*").parquet(sf_dir)
    counts = stream.word_counts(live.select(F.col("user_id").cast("string"), e.alias("original"), accepted.alias("accepted")))
    name = f"{shared_dir(spark)}/scriptorium/stream-{uuid.uuid4().hex}"
    stream.to_table(counts, f"{name}/table", f"{name}/state").awaitTermination()
    return spark.read.parquet(f"{name}/table")


# -- accuracy --------------------------------------------------------------

_ASCII = "regexp_replace(text, '[^\\x00-\\x7F]', '?', 'g')"
PAIRS = f"pairs AS (SELECT item_id, {_ASCII} AS truth, replace(replace({_ASCII}, 'th', 'tb'), 'of ', '') AS guess FROM benchmark)"


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "benchmark").select("item_id", F.regexp_replace("text", r"[^\x00-\x7F]", "?").alias("truth"))
    return own.withColumn("guess", F.replace(F.replace("truth", F.lit("th"), F.lit("tb")), F.lit("of "), F.lit("")))


@query(f"WITH {PAIRS} SELECT item_id, round(levenshtein(guess, truth)::DOUBLE / length(truth), 6) AS cer FROM pairs")
def ev_cer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir).select("item_id", F.round(sc.cer(F.col("guess"), F.col("truth")), 6).alias("cer"))


def _chars(ws: str) -> str:
    return f"array_to_string(list_transform({ws}, lambda w: chr(CAST(33 + list_position(u, w) AS INT))), '')"


@query(f"WITH {PAIRS}, w AS (SELECT item_id, {words_of('guess')} AS g, {words_of('truth')} AS t FROM pairs), d AS (SELECT *, list_distinct(list_concat(g, t)) AS u FROM w) SELECT item_id, round(levenshtein({_chars('g')}, {_chars('t')})::DOUBLE / len(t), 6) AS wer FROM d")
def ev_wer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir).select("item_id", F.round(sc.wer(F.col("guess"), F.col("truth")), 6).alias("wer"))


@query(
    f"""WITH {PAIRS}, h AS (SELECT truth, 'whole' AS model, guess AS t FROM pairs UNION ALL SELECT truth, 'lower', lower(truth) FROM pairs UNION ALL SELECT truth, 'exact', truth FROM pairs)
SELECT model, count(*) AS n, round(avg(levenshtein(t, truth)::DOUBLE / length(truth)), 4) AS mean_cer FROM h GROUP BY model"""
)
def ev_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = pairs(spark, sf_dir).withColumn("hypotheses", F.create_map(F.lit("whole"), "guess", F.lit("lower"), F.lower("truth"), F.lit("exact"), "truth"))
    return ev.by_model(own).select("model", "n", "mean_cer")


_SENT = "list_filter(list_transform(string_split({}, '.'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '')"


@query(
    f"""WITH {PAIRS}, s AS (SELECT item_id, {_SENT.format('guess')} AS p, {_SENT.format('truth')} AS g FROM pairs)
SELECT item_id, len(list_filter(range(1, least(len(p), len(g)) + 1), lambda i: levenshtein(p[i], g[i])::DOUBLE / length(g[i]) < 0.10)) AS matched, greatest(len(p), len(g)) AS compared FROM s"""
)
def ev_sentence_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = pairs(spark, sf_dir).withColumnRenamed("guess", "predicted")
    return ev.sentence_match(own).select("item_id", F.col("matched").cast("long"), F.col("compared").cast("long"))


@query(
    """WITH l AS (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id), d AS (SELECT doc_id, CASE WHEN length(text) - length(replace(text, ' ', '')) >= 49 THEN 1 ELSE 0 END AS guess FROM documents)
SELECT count(*) AS total, count(*) FILTER (quality = guess) AS correct, round(count(*) FILTER (quality = guess)::DOUBLE / count(*), 4) AS accuracy FROM l JOIN d USING (doc_id)"""
)
def ev_label_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A length rule held against the quality labels."""
    guess = F.when(F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit(""))) >= 49, 1).otherwise(0)
    own = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality")).join(table(spark, sf_dir, "documents").select("doc_id", guess.alias("guess")), "doc_id")
    return ev.accuracy(own, "quality", "guess")


# Subject cases (title, text, subject).
SUBJECT_CASES = (
    ("Properties of Matter", "Everything around us is made of matter. Matter exists in solid liquid and gases.", "Science"),
    ("Algebra Lesson 2", "Solve the linear equation for x. Calculate the perimeter and area of the triangle.", "Mathematics"),
    ("Laws of Motion", "Force equals mass times acceleration. Velocity is displacement divided by time.", "Physics"),
    ("Chemical Reactions", "Acids react with bases to form salt and water. An atom consists of protons and electrons.", "Chemistry"),
    ("Plant Biology", "Plants prepare food by photosynthesis. Leaves contain chlorophyll.", "Biology"),
    ("Geography of Continents", "Latitude lines run parallel to equator. Erosion wears away soil.", "Geography"),
    ("History Chapter 5", "The empire expanded across multiple continents during the 18th century treaty.", "History"),
    ("Python Programming", "An algorithm is a step by step set of instructions. Loops execute repeatedly.", "Computer Science"),
)
# Feedback steps (read, accepted).
FEEDBACK_STEPS = (
    ("Eil Jueket with water", "Fill bucket with water"),
    ("Us is made of matier", "Us is made of matter"),
    ("road a bike to school", "rode a bike to school"),
    ("the son is shining", "the sun is shining"),
    ("light passes through transparent glass", "light passes through transparent glass"),
)


_SCORES = {f"s{k}": (n, v) for k, (n, v) in enumerate(lx.SUBJECTS.items())}


def _subject_of(source: str, name: str) -> str:
    """CTEs that give the subject of ``source`` (doc_id, text) as ``name`` (doc_id, subject)."""
    from scriptorium.plans.texts import _subject_score

    scores = ", ".join(f"{_subject_score(v)} AS {k}" for k, (_, v) in _SCORES.items())
    best = f"greatest({', '.join(_SCORES)})"
    cases = " ".join(f"WHEN {k} = {best} THEN {quoted(n)}" for k, (n, _) in _SCORES.items())
    return f"{name}n AS (SELECT doc_id, {scores} FROM {source}), {name} AS (SELECT doc_id, CASE WHEN {best} < 15 THEN 'General' {cases} END AS subject FROM {name}n)"


@query(
    f"""WITH {CORPUS}, half AS (SELECT doc_id, substr(text, 1, length(text) // 2) AS text FROM corpus), {_subject_of("corpus", "a")}, {_subject_of("half", "b")}
SELECT count(*) AS total, count(*) FILTER (a.subject = b.subject) AS correct, round(count(*) FILTER (a.subject = b.subject) / CAST(count(*) AS DOUBLE), 4) AS accuracy FROM a JOIN b USING (doc_id)"""
)
def ev_subject_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The subject that the first half of each text shows, held against that of the whole."""
    whole = corpus(spark, sf_dir)
    a = st.subject(whole).select("doc_id", F.col("subject").alias("expected"))
    b = st.subject(whole.select("doc_id", F.substring("text", F.lit(1), F.floor(F.length("text") / 2).cast("int")).alias("text"))).select("doc_id", "subject")
    return ev.accuracy(a.join(b, "doc_id"), "expected", "subject")


def benchmark_cases(spark: SparkSession) -> DataFrame:
    """The proofreading cases with what analysis makes of them."""
    own = spark.createDataFrame(list(ev.CASES), "test_id string, category string, raw string, truth string")
    docs, found = pr.analyze(own, "raw", ("test_id",))
    n = found.groupBy("test_id").agg(F.count(F.lit(1)).alias("n_suggestions"))
    return docs.join(n, "test_id", "left").select("test_id", "category", "raw", F.col("corrected_text").alias("predicted"), "truth", F.coalesce("n_suggestions", F.lit(0)).alias("n_suggestions"))


def _rate(a: str, chars: bool) -> str:
    if chars:
        return f"levenshtein({a}, truth) / CAST(length(truth) AS DOUBLE)"
    return f"levenshtein({_chars(words_of(a))}, {_chars(words_of('truth'))}) / CAST(len({words_of('truth')}) AS DOUBLE)"


@query(
    f"""WITH {PAIRS}, c AS (SELECT item_id, truth, guess AS raw, replace(guess, 'tb', 'th') AS predicted, (length(guess) - length(replace(guess, 'tb', ''))) // 2 AS n FROM pairs),
w AS (SELECT *, list_distinct(list_concat({words_of('predicted')}, {words_of('truth')})) AS u FROM c),
s AS (SELECT *, {_rate('raw', True)} AS before, {_rate('predicted', True)} AS cer, {_rate('predicted', False)} AS wer, trim(predicted) = trim(truth) AS exact FROM w),
o AS (SELECT *, CASE WHEN cer < before OR exact THEN 'tp' WHEN n > 0 AND cer >= before THEN 'fp' WHEN before > 0 AND cer = before THEN 'fn' ELSE 'none' END AS outcome FROM s),
t AS (SELECT count(*) AS n, count(*) FILTER (exact) AS exact, avg(cer) AS cer, avg(wer) AS wer, count(*) FILTER (outcome = 'tp') AS tp, count(*) FILTER (outcome = 'fp') AS fp, count(*) FILTER (outcome = 'fn') AS fn FROM o),
r AS (SELECT *, tp / CAST(greatest(1, tp + fp) AS DOUBLE) AS p, tp / CAST(greatest(1, tp + fn) AS DOUBLE) AS r FROM t)
SELECT n AS total_test_cases, exact AS exact_sentence_matches, round(exact / CAST(greatest(1, n) AS DOUBLE), 4) AS sentence_accuracy, round(cer, 4) AS mean_character_error_rate, round(wer, 4) AS mean_word_error_rate,
  round(p, 4) AS proofreading_precision, round(r, 4) AS proofreading_recall, round(p * r * 2 / greatest(1e-6::DOUBLE, p + r), 4) AS proofreading_f1_score FROM r"""
)
def ev_benchmark_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items read with one confusion and a lost word, and corrected for the confusion."""
    own = pairs(spark, sf_dir).withColumn("raw", F.col("guess"))
    n = F.floor((F.length("raw") - F.length(F.replace("raw", F.lit("tb"), F.lit("")))) / 2)
    return ev.report(ev.case_scores(own.withColumns({"predicted": F.replace("raw", F.lit("tb"), F.lit("th")), "n_suggestions": n})))


@query(
    f"""WITH {FEEDBACK}, s AS (SELECT user_id, event_id AS step, lower(original) AS o, lower(accepted) AS a, lower(original) <> lower(accepted) AS c FROM fb WHERE kind = 'feedback'),
n AS (SELECT x.user_id, x.step, x.c, count(*) FILTER (y.c AND y.a = x.a AND y.step < x.step) AS nb, count(*) FILTER (y.c AND y.a = x.a) AS na, count(*) FILTER (y.c AND y.o = x.a AND y.step < x.step) AS eb, count(*) FILTER (y.c AND y.o = x.a) AS ea,
  count(*) FILTER (y.c) AS corrections_accepted FROM s x JOIN s y ON y.user_id = x.user_id AND y.step <= x.step GROUP BY x.user_id, x.step, x.c)
SELECT user_id, step, corrections_accepted, round(least(0.25::DOUBLE, least(0.12::DOUBLE, nb * 0.03::DOUBLE) + least(0.20::DOUBLE, eb * 0.05::DOUBLE)), 6) AS before,
  round(least(0.25::DOUBLE, least(0.12::DOUBLE, na * 0.03::DOUBLE) + least(0.20::DOUBLE, ea * 0.05::DOUBLE)), 6) AS after FROM n"""
)
def ev_learning_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each user's profile adds to each accepted word before and after it was accepted."""
    return ev.learning_curve(feedback(spark, sf_dir).where("kind = 'feedback'").select("user_id", F.col("event_id").alias("step"), "original", "accepted"), ["user_id"])
