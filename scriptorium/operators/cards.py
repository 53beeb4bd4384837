"""Study cards and decks from corrections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions import lexicons as lx
from scriptorium.functions import text as tx
from scriptorium.operators import vocabulary

DEFAULT_CATEGORY, DEFAULT_CONFIDENCE = "Grammar Correction", 0.90


def _has(c: Column, *parts: str) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | F.contains(c, F.lit(p))
    return out


def _low(c: Column) -> Column:
    return F.lower(F.coalesce(c, F.lit("")))


def opportunity(original: Column, proposed: Column, category: Column, explanation: Column) -> Column:
    """Learning category of a correction; the first that fits."""
    e, o, p = _low(explanation), _low(original), _low(proposed)
    articles = ("a", "an", "the")
    return (
        F.when(_has(e, "article") | o.isin(*articles) | p.isin(*articles), "Article Usage")
        .when(_has(e, "subject-verb", "agreement"), "Subject-Verb Agreement")
        .when(_has(e, "tense", "past participle"), "Verb Tense")
        .when(_has(e, "preposition") | o.isin("on", "in", "at", "to", "for", "with", "by", "from", "of"), "Preposition Usage")
        .when(_has(e, "apostrophe", "comma", "period", "question mark") | category.isin("Punctuation Correction", "Punctuation Improvement"), "Punctuation Correction")
        .when(category.isin("Capitalization", "Capitalization Correction") | _has(e, "capitalize"), "Capitalization Correction")
        .when(category.isin("Contextual Substitution", "Contextual Word Correction") | _has(e, "homophone", "contextual"), "Contextual Word Correction")
        .when(category.isin("Spelling Correction", "Spelling Mistake", "Character Confusion", "OCR Confidence Recovery") | _has(e, "spelling", "typo"), "Spelling Mistake")
        .when((category == "Missing Word") | (o == ""), "Missing Word")
        .when((F.size(tx.tokens(original)) > 2) | (F.size(tx.tokens(proposed)) > 2), "Sentence Restructuring")
        .when(category == "", DEFAULT_CATEGORY)
        .otherwise(category)
    )


def style_of(category: Column) -> Column:
    """Card style of a learning category."""
    table = F.create_map(*(F.lit(x) for kv in lx.CARD_STYLES.items() for x in kv))
    return F.coalesce(F.try_element_at(table, category), F.lit("grammar_explanation"))


def with_defaults(corrections: DataFrame) -> DataFrame:
    """Trimmed texts, and defaults for what is missing."""
    return corrections.withColumns(
        {
            "original": tx.strip(F.coalesce("original", F.lit(""))),
            "proposed": tx.strip(F.coalesce("proposed", F.lit(""))),
            "category": F.coalesce("category", F.lit(DEFAULT_CATEGORY)),
            "explanation": F.coalesce("explanation", F.lit("")),
            "confidence": F.coalesce("confidence", F.lit(DEFAULT_CONFIDENCE)),
        }
    )


def opportunities(corrections: DataFrame, doc: list[str], order: str = "ord") -> DataFrame:
    """Adds opportunity_id (by place among a document's corrections), learning_category, card_style; corrections without any text go."""
    own = with_defaults(corrections).withColumn("opportunity_id", F.concat(F.lit("opp_"), F.row_number().over(Window.partitionBy(*doc).orderBy(order))))
    own = own.where("original <> '' OR proposed <> ''")
    own = own.withColumn("learning_category", opportunity(F.col("original"), F.col("proposed"), F.col("category"), F.col("explanation")))
    return own.withColumn("card_style", style_of(F.col("learning_category")))


def with_rejected(accepted: DataFrame, every: DataFrame, doc: list[str]) -> DataFrame:
    """Accepted corrections, then those of ``every`` with other ids."""
    more = every.join(accepted.select(*doc, "suggestion_id"), [*doc, "suggestion_id"], "left_anti")
    return accepted.withColumn("__g", F.lit(0)).unionByName(more.withColumn("__g", F.lit(1))).withColumn("ord", F.col("__g") * (1 << 40) + F.col("ord")).drop("__g")


def convertible(c: DataFrame) -> Column:
    return (F.col("original") != "") & (F.col("proposed") != "") & (F.col("original") != F.col("proposed"))


def clean_sentence(c: Column) -> Column:
    """Spaces after punctuation, between glued words, and never two."""
    t = F.regexp_replace(c, "[\r\n\t]+", " ")
    t = F.regexp_replace(t, "([,.:;!?])([a-zA-Z0-9])", "$1 $2")
    t = F.regexp_replace(t, "([a-z])([A-Z])", "$1 $2")
    return tx.strip(F.regexp_replace(t, " +", " "))


def context_sentences(text: Column, begin: Column, stop: Column, original: Column, proposed: Column) -> Column:
    """Sentence as it ``was`` and as it is ``now``, corrected, around a correction; a template without a place in the text."""
    left, right = F.substring(text, F.lit(1), begin), F.substring(text, stop + 1, F.length(text))
    # tried at the beginnings of sentences alone: from each character it would be square in the text
    own_left = F.regexp_extract(left, r"(?:^|(?<=[.!?\n]))([^.!?\n]*)$", 1)
    own_right = F.regexp_extract(right, r"^([^.!?\n]*)", 1)
    found = F.struct(own_left.alias("left"), own_right.alias("right"), tx.strip(F.concat(own_left, F.substring(text, begin + 1, stop - begin), own_right)).alias("sentence"))

    def corrected(x: Column) -> Column:
        # the first whole word in the sentence, else the first occurrence, is replaced
        sentence, own_left, own_right = x["sentence"], x["left"], x["right"]
        quoted = F.concat(F.lit(r"(?U)\b\Q"), F.replace(original, F.lit(r"\E"), F.lit("")), F.lit(r"\E\b"))
        place = tx.let(F.regexp_instr(sentence, quoted), lambda n: F.when(n > 0, n).otherwise(F.position(original, sentence)))
        gap_left = F.when((own_left != "") & ~own_left.endswith(" "), " ").otherwise("")
        gap_right = F.when((own_right != "") & ~own_right.rlike(r"^[ ,.!?;:]"), " ").otherwise("")
        inserted = F.concat(own_left, gap_left, proposed, gap_right, own_right)

        def put(at: Column) -> Column:
            swapped = F.concat(F.substring(sentence, F.lit(1), at - 1), proposed, F.substring(sentence, at + F.length(original), F.length(sentence)))
            return F.when((original != "") & (at > 0), swapped).otherwise(inserted)

        return tx.let(place, put)

    both = tx.let(found, lambda x: tx.let(clean_sentence(x["sentence"]), lambda c: F.struct(c.alias("was"), F.when(c != "", clean_sentence(corrected(x))).alias("now"))))
    placed = (begin >= 0) & (stop <= F.length(text)) & (begin < stop)
    none = F.struct(clean_sentence(F.concat(F.lit("The sentence contained '"), original, F.lit("'."))).alias("was"), clean_sentence(F.concat(F.lit("The sentence was corrected to '"), proposed, F.lit("'."))).alias("now"))
    return F.when(placed, tx.let(both, lambda x: F.when(x["was"] != "", x).otherwise(none))).otherwise(none)


def resolved_style(category: Column, original: Column, proposed: Column, explanation: Column) -> tuple[Column, Column]:
    """(card style, card category) of a correction; the first test that holds."""
    c, e = _low(category), _low(explanation)
    rules = (
        (_has(c, "spelling", "typo") | _has(e, "spell"), "spelling", "Spelling Correction"),
        (_has(c, "missing", "omitted") | _has(e, "missing"), "fill_in_blank", "Missing Word"),
        (_has(c, "punctuation", "comma", "period"), "punctuation_practice", "Punctuation"),
        (_has(c, "capital") | (F.lower(original) == F.lower(proposed)), "capitalization_rule", "Capitalization"),
        (_has(c, "vocab", "style") | _has(e, "word choice"), "vocabulary", "Vocabulary Improvement"),
        (_has(c, "structur") | (F.size(tx.tokens(original)) > 3), "sentence_reconstruction", "Sentence Structure"),
    )
    style = name = F
    for test, s, n in rules:
        style, name = style.when(test, s), name.when(test, n)
    return style.otherwise("grammar_explanation"), name.otherwise("Grammar Correction")


def difficulty(style: Column, original: Column, proposed: Column, sentence: Column, explanation: Column) -> Column:
    e, n = _low(explanation), F.size(tx.tokens(sentence))
    short = (F.length(original) <= 6) & (F.abs(F.length(original) - F.length(proposed)) <= 1)
    return (
        F.when(style.isin("spelling", "capitalization_rule"), F.when(short, "Easy").otherwise("Medium"))
        .when(style.isin("fill_in_blank", "punctuation_practice"), F.when(n <= 8, "Easy").otherwise("Medium"))
        .when(style == "vocabulary", F.when((F.length(proposed) >= 9) | _has(e, "academic"), "Hard").otherwise("Medium"))
        .when(style == "sentence_reconstruction", F.when(n > 12, "Hard").otherwise("Medium"))
        .when(_has(e, "subj", "tense", "clause"), "Medium")
        .when(n > 15, "Hard")
        .otherwise("Easy")
    )


def tags(category: Column, style: Column, original: Column, proposed: Column, explanation: Column) -> Column:
    """Sorted tags."""
    e, o = _low(explanation), F.lower(original)
    found = F.array(
        category,
        F.when(_has(e, "verb", "tense"), "Verb Tense"),
        F.when(_has(e, "subject", "agreement"), "Subject-Verb Agreement"),
        F.when(_has(e, "article") | o.isin("a", "an", "the"), "Articles"),
        F.when(_has(e, "prep") | o.isin("in", "on", "at", "to", "for", "with", "by", "from"), "Prepositions"),
        F.when((style == "vocabulary") | (F.length(proposed) >= 8), "Academic Vocabulary"),
        F.when(_has(e, "ocr"), "OCR Recovery"),
        F.when(style == "sentence_reconstruction", "Sentence Structure"),
    )
    return F.array_sort(F.array_distinct(F.array_compact(found)))


def _by_style(style: Column, frames: dict[str, str], values: dict[str, Column]) -> Column:
    out = F
    for s, frame in frames.items():
        parts, rest = [], frame
        while "{" in rest:
            lead, _, rest = rest.partition("{")
            name, _, rest = rest.partition("}")
            parts += [F.lit(lead), values[name]]
        out = out.when(style == s, F.concat(*parts, F.lit(rest)))
    return out


# Rule, objective and tip of each card style.
RULES = {
    "spelling": "Spelling Rule: Ensure correct letter patterns and suffixes when writing '{p}'.",
    "fill_in_blank": "Contextual Completeness: Ensure all necessary syntax components such as '{p}' are included for grammatical precision.",
    "grammar_explanation": "Grammatical Rule: Maintain subject-verb agreement, consistent tense usage, and correct word forms.",
    "punctuation_practice": "Punctuation Rule: Use punctuation marks correctly to delineate clauses and improve readability.",
    "capitalization_rule": "Capitalization Rule: Always capitalize proper nouns, the pronoun 'I', and the first word of a sentence.",
    "vocabulary": "Vocabulary Elevation: Upgrade informal or plain words ('{o}') to precise academic vocabulary ('{p}').",
    "sentence_reconstruction": "Sentence Structure Rule: Organize clauses logically for clear syntactic flow.",
}
OBJECTIVES = {
    "spelling": "Master accurate spelling of '{p}' and avoid common typos.",
    "fill_in_blank": "Identify missing contextual words like '{p}' to complete sentence structures.",
    "grammar_explanation": "Recognize and correct grammatical errors involving '{o}' -> '{p}'.",
    "punctuation_practice": "Apply correct punctuation conventions within sentence context.",
    "capitalization_rule": "Master standard capitalization rules for '{p}'.",
    "vocabulary": "Expand academic vocabulary by learning the usage and synonyms of '{p}'.",
    "sentence_reconstruction": "Reconstruct flawed sentence patterns into clear, well-formed statements.",
}
TIPS = {
    "spelling": "Remember: '{p}' ({pos}) is spelled correctly here.",
    "fill_in_blank": "The word '{p}' ({pos}) completes the syntactic meaning.",
    "grammar_explanation": "Check for subject-verb agreement and tense consistency.",
    "punctuation_practice": "Punctuation separates distinct ideas and prevents run-on sentences.",
    "capitalization_rule": "Proper nouns and sentence origins must always be capitalized.",
    "vocabulary": "Using '{p}' ({pos}) demonstrates academic writing style.",
    "sentence_reconstruction": "Focus on clear subject-verb arrangement.",
}
# Title, prompt and study type of each card style's front.
FRONTS = {
    "spelling": ("Spelling Challenge", "Identify or type the correct spelling for the highlighted word in context:", "spelling_choice_or_input"),
    "fill_in_blank": ("Fill in the Blank", "Choose or type the missing word to complete the sentence correctly:", "fill_blank"),
    "grammar_explanation": ("Grammar Error Spotter", "Analyze the sentence below. Identify the grammatical error before revealing the rule:", "grammar_spotter"),
    "punctuation_practice": ("Punctuation Practice", "Examine this sentence. Where is punctuation missing or incorrect?", "punctuation"),
    "capitalization_rule": ("Capitalization Mastery", "Identify the word that requires proper capitalization in this sentence:", "capitalization"),
    "vocabulary": ("Vocabulary Elevation", "How can you improve the phrase '{o}' in context?", "vocabulary"),
    "sentence_reconstruction": ("Sentence Reconstruction", "Rebuild the corrected sentence from its original flawed version:", "reconstruction"),
}


def explained(original: Column, proposed: Column, explanation: Column, rule: Column) -> Column:
    own = F.concat(F.lit("Replacing '"), original, F.lit("' with '"), proposed, F.lit("' ensures grammatical accuracy and clarity."))
    return F.concat_ws(" ", F.when(F.length(explanation) > 10, explanation).otherwise(own), rule)


def distractor(original: Column, proposed: Column) -> Column:
    """A plausible wrong spelling."""
    cut = F.when(F.length(proposed) > 4, F.substring(proposed, F.lit(1), F.length(proposed) - 1)).otherwise(F.concat(proposed, F.lit("s")))
    return F.when(original != proposed, original).otherwise(cut)


def merged_concepts(corrections: DataFrame, doc: list[str]) -> DataFrame:
    """One row per concept (category, original, proposed, whatever the case) of a document: the first correction's fields,
    n_merged and extra_examples (the other corrected sentences in order). ``corrections`` has ord and corrected_sentence."""
    own = with_defaults(corrections).where(convertible(corrections))
    key = F.concat_ws("", F.lower("category"), F.lit(":"), F.lower("original"), F.lit("->"), F.lower("proposed"))
    fields = [c for c in own.columns if c not in doc]
    rows = F.array_sort(F.collect_list(F.struct("ord", "corrected_sentence")))
    out = own.groupBy(*doc, key.alias("concept")).agg(F.min_by(F.struct(*fields), "ord").alias("f"), rows.alias("rows"))
    extra = F.transform(F.slice("rows", 2, F.greatest(F.lit(1), F.size("rows"))), lambda r: r["corrected_sentence"])
    return out.select(*doc, "concept", "f.*", F.size("rows").alias("n_merged"), extra.alias("extra_examples"))


def build_cards(docs: DataFrame, corrections: DataFrame, doc: list[str], text: str = "text", title: str = "title", senses: DataFrame | None = None, created_at: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Cards of the documents' corrections (doc, ord, original, proposed, category, explanation, confidence, begin, stop).

    Ids derive from document and concept, tags are sorted and the time is a parameter, so a deck
    built twice is the same deck. ``front`` and ``back`` are structs with the fields of all styles.
    """
    own = with_defaults(corrections).join(docs.select(*doc, F.col(text).alias("__text"), F.col(title).alias("title")), doc)
    own = own.withColumn("__both", context_sentences(F.col("__text"), F.col("begin"), F.col("stop"), F.col("original"), F.col("proposed")))
    own = own.withColumns({"original_sentence": F.col("__both.was"), "corrected_sentence": F.col("__both.now")}).drop("__text", "__both")
    one = merged_concepts(own, doc)
    o, p, e = F.col("original"), F.col("proposed"), F.col("explanation")
    style, category = resolved_style(F.col("category"), o, p, e)
    one = one.withColumns({"card_style": style, "card_category": category})
    s = F.col("card_style")
    one = one.withColumns(
        {
            "difficulty": difficulty(s, o, p, F.col("original_sentence"), e),
            "tags": tags(F.col("card_category"), s, o, p, e),
            "rule": _by_style(s, RULES, {"o": o, "p": p}),
            "learning_objective": _by_style(s, OBJECTIVES, {"o": o, "p": p}),
            "card_id": F.concat(F.lit("fc_"), F.substring(F.md5(F.concat_ws("|", *(F.col(c).cast("string") for c in doc), "concept")), 1, 8)),
        }
    )
    words = vocabulary.describe(one.withColumnRenamed("category", "raw_category").withColumnRenamed("card_category", "category"), [*doc, "concept"], senses)
    words = words.withColumn("card_explanation", explained(o, p, e, F.col("rule")))
    pos = F.col("pos")
    wrong = distractor(o, p)
    change = F.concat(F.lit("Change '"), o, F.lit("' to '"), p, F.lit("'"))
    gap = F.lit("[ _____ ]")

    def gapped(sentence: Column, word: Column) -> Column:
        at = F.position(word, sentence)
        return F.when((at > 0) & (word != ""), F.concat(F.substring(sentence, F.lit(1), at - 1), gap, F.substring(sentence, at + F.length(word), F.length(sentence))))

    options = (
        F.when(s == "spelling", F.array(p, F.when(wrong != p, wrong).otherwise(F.concat(p, F.lit("e")))))
        .when(s == "fill_in_blank", F.array(p, F.lit("and"), F.lit("which"), F.lit("however")))
        .when(s == "grammar_explanation", F.array(change, F.concat(F.lit("Remove '"), o, F.lit("' entirely")), F.concat(F.lit("Move '"), o, F.lit("' to end of sentence"))))
    )
    front = F.struct(
        *(_by_style(s, {k: v[n] for k, v in FRONTS.items()}, {"o": o}).alias(name) for n, name in ((0, "title"), (1, "prompt"), (2, "study_type"))),
        F.when(s == "fill_in_blank", F.coalesce(gapped(F.col("corrected_sentence"), p), gapped(F.col("original_sentence"), o), F.col("original_sentence"))).otherwise(F.col("original_sentence")).alias("context_sentence"),
        F.when(s == "vocabulary", p).when(s.isin("spelling", "capitalization_rule", "grammar_explanation"), o).alias("target_word"),
        options.alias("options"),
        F.when(s == "fill_in_blank", F.concat(F.lit("Initial letter: "), F.upper(F.substring(p, 1, 1)))).alias("hint"),
        F.when(s == "sentence_reconstruction", tx.tokens(F.col("corrected_sentence"))).alias("scrambled_tokens"),
    )
    sentence_answer = s.isin("punctuation_practice", "sentence_reconstruction")
    plain = F.array(p, F.lit("enhanced"), F.lit("elevated"))
    back = F.struct(
        F.when(sentence_answer, F.col("corrected_sentence")).when(s == "grammar_explanation", change).otherwise(p).alias("correct_answer"),
        pos.alias("part_of_speech"), F.col("child_definition"), F.col("definition").alias("official_definition"), F.col("example").alias("usage_example"), F.col("pronunciation").alias("phonetic_hint"),
        F.when((s == "vocabulary") & (F.size("synonyms") == 0), plain).otherwise(F.col("synonyms")).alias("synonyms"),
        F.when((s == "vocabulary") & (F.size("antonyms") == 0), F.array(o)).otherwise(F.col("antonyms")).alias("antonyms"),
        F.col("card_explanation").alias("explanation"), F.col("rule"), F.col("original_sentence"), F.col("corrected_sentence"), F.col("extra_examples"),
        _by_style(s, TIPS, {"p": p, "pos": pos}).alias("tip"),
    )
    flags = {f: F.lit(False) for f in ("is_mastered", "is_bookmarked", "needs_review")}
    return words.withColumns({"front": front, "back": back, "created_at": F.lit(created_at)} | flags).select(
        *doc, "card_id", "title", F.col("category"), "card_style", "original", "proposed", "original_sentence", "corrected_sentence", "front", "back", F.col("card_explanation").alias("explanation"), "rule",
        "learning_objective", "difficulty", "confidence", "tags", "pos", "is_vocabulary", "sense", "definition", "child_definition", "example", "synonyms", "antonyms", "pronunciation", "source", "verify",
        "n_merged", "extra_examples", "created_at", *flags,
    )


def fallback_words(docs: DataFrame, doc: list[str], dictionary: list[str], text: str = "text") -> DataFrame:
    """Words for cards of documents without corrections: up to ten dictionary words in order; with fewer than five, content
    words of four letters or more up to eight in all. Rows (doc, place, word, difficulty)."""
    found = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"\b([A-Za-z]{3,})\b"), 1), F.lower))
    known = F.slice(F.filter(found, lambda w: F.array_contains(F.array(*(F.lit(x) for x in dictionary)) if dictionary else F.array().cast("array<string>"), w)), 1, 10)
    content = F.filter(F.array_except(found, known), lambda w: (F.length(w) >= 4) & ~w.isin(*lx.FUNCTION_WORDS))
    chosen = F.when(F.size(known) < 5, F.slice(F.concat(known, content), 1, 8)).otherwise(known)
    level = F.when(F.length("word") <= 5, "Easy").when(F.length("word") <= 8, "Medium").otherwise("Hard")
    return docs.select(*doc, F.posexplode(chosen).alias("place", "word")).withColumn("place", F.col("place") + 1).withColumn("difficulty", level)


def fallback_cards(
    docs: DataFrame, doc: list[str], dictionary: list[str], text: str = "text", title: str = "title", senses: DataFrame | None = None, created_at: str = "1970-01-01T00:00:00Z"
) -> DataFrame:
    """Vocabulary cards of documents without corrections: one for each of :func:`fallback_words`, with the columns of :func:`build_cards`."""
    words = fallback_words(docs, doc, dictionary, text).join(docs.select(*doc, F.col(title).alias("title")), doc)
    w = F.col("word")
    sentence = F.concat(F.lit("We learned about "), w, F.lit(" in class."))
    asked = words.withColumns(
        {"original": w, "proposed": w, "category": F.lit("Vocabulary & Spelling"), "explanation": F.concat(F.lit("Key vocabulary word in "), "title"), "original_sentence": sentence, "corrected_sentence": sentence}
    )
    own = vocabulary.describe(asked, [*doc, "place"], senses)
    pos = F.col("pos")
    own = own.withColumns(
        {
            "child_definition": F.when(F.col("child_definition") != "", F.col("child_definition")).otherwise(F.concat(F.lit("A key vocabulary term from "), "title", F.lit("."))),
            "example": F.when(F.col("example") != "", F.col("example")).otherwise(F.concat(F.lit("We learned about "), w, F.lit(" during our class study."))),
            "explanation": F.concat(F.lit("Key vocabulary word extracted from "), "title", F.lit(".")),
            "rule": F.concat(F.lit("Understand the usage and definition of key vocabulary word '"), w, F.lit("'.")),
            "learning_objective": F.concat(F.lit("Master key vocabulary term '"), w, F.lit("'.")),
            "tags": F.array(F.lit("Vocabulary"), F.lit("Spelling"), tx.capitalized(pos)),
            "card_id": F.concat_ws("_", F.lit("card_text"), *(F.col(c).cast("string") for c in doc), F.col("place").cast("string")),
        }
    )
    front = F.struct(
        F.concat(F.lit("Vocabulary Explorer: "), tx.capitalized(w)).alias("title"), F.concat(F.lit("What is the child-friendly definition and part of speech for '"), w, F.lit("'?")).alias("prompt"),
        F.col("original_sentence").alias("context_sentence"), w.alias("target_word"), w.alias("highlight"), F.concat(F.lit("Part of speech: "), pos).alias("hint"),
    )
    back = F.struct(
        w.alias("target_word"), pos.alias("part_of_speech"), F.col("child_definition").alias("definition"), F.col("child_definition"), F.col("example").alias("example_sentence"), F.col("explanation"), F.col("rule"),
        F.col("synonyms"), F.col("antonyms"), F.col("pronunciation"), F.col("source").alias("dictionary_source"),
    )
    flags = {f: F.lit(False) for f in ("is_mastered", "is_bookmarked", "needs_review")}
    own = own.withColumns({"front": front, "back": back, "card_style": F.lit("Vocabulary_Explorer"), "confidence": F.lit(0.92), "n_merged": F.lit(1), "extra_examples": F.array().cast("array<string>"), "created_at": F.lit(created_at)} | flags)
    return own.select(
        *doc, "card_id", "title", "category", "card_style", "original", "proposed", "original_sentence", "corrected_sentence", "front", "back", "explanation", "rule", "learning_objective", "difficulty", "confidence", "tags", "pos",
        "is_vocabulary", "sense", "definition", "child_definition", "example", "synonyms", "antonyms", "pronunciation", "source", "verify", "n_merged", "extra_examples", "created_at", *flags,
    )


def decks(cards: DataFrame, doc: list[str]) -> DataFrame:
    """Deck headers: deck_id, total_flashcards, categories and difficulties (maps), estimated_study_time_min."""
    by_category = cards.groupBy(*doc, "category").count().groupBy(*doc).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "count")))).alias("categories"))
    by_level = cards.groupBy(*doc).agg(
        F.count(F.lit(1)).alias("total_flashcards"),
        F.map_from_arrays(F.array(*(F.lit(x) for x in ("Easy", "Medium", "Hard"))), F.array(*(F.count_if(F.col("difficulty") == x) for x in ("Easy", "Medium", "Hard")))).alias("difficulties"),
    )
    n = F.col("total_flashcards")
    out = by_level.join(by_category, doc).withColumn("estimated_study_time_min", F.greatest(F.lit(1), F.bround(n * 1.5).cast("int")))
    return out.withColumn("deck_id", F.concat(F.lit("deck_"), F.substring(F.md5(F.concat_ws("|", *(F.col(c).cast("string") for c in doc))), 1, 10))).withColumn("mastery_percentage", F.lit(0.0))


def telemetry(corrections: DataFrame, cards: DataFrame, doc: list[str], digits: int = 4) -> DataFrame:
    """accepted_corrections_processed, unconvertible_corrections, duplicate_cards_removed, flashcards_generated, mean_confidence."""
    own = with_defaults(corrections)
    seen = own.groupBy(*doc).agg(F.count(F.lit(1)).alias("accepted_corrections_processed"), F.count_if(~convertible(own)).alias("unconvertible_corrections"))
    made = cards.groupBy(*doc).agg(F.sum(F.col("n_merged") - 1).alias("__d"), F.count(F.lit(1)).alias("__n"), F.round(F.avg("confidence"), digits).alias("__c"))
    out = seen.join(made, doc, "left")
    zero = {"duplicate_cards_removed": "__d", "flashcards_generated": "__n"}
    return out.withColumns({k: F.coalesce(v, F.lit(0)).cast("long") for k, v in zero.items()} | {"mean_confidence": F.coalesce("__c", F.lit(0.0))}).drop("__d", "__n", "__c")


FLAGS = ("is_mastered", "is_bookmarked", "needs_review")


def progress(cards: DataFrame, updates: DataFrame, deck: list[str]) -> tuple[DataFrame, DataFrame]:
    """(cards with new flags, decks with progress): the last update of a card (card_id, ord, flags) wins, and only the flags that it has."""
    last = updates.groupBy("card_id").agg(F.max_by(F.struct(*FLAGS), "ord").alias("__u"))
    out = cards.join(last, "card_id", "left").withColumns({f: F.coalesce(F.col("__u")[f], F.col(f), F.lit(False)) for f in FLAGS}).drop("__u")
    n = F.count(F.lit(1))
    summary = out.groupBy(*deck).agg(
        n.alias("cards_completed"), F.count_if("is_mastered").alias("cards_mastered"), F.count_if("is_bookmarked").alias("cards_bookmarked"),
        F.round(F.count_if("is_mastered") * 100.0 / n, 1).alias("mastery_percentage"),
    )
    return out, summary


def matching(cards: DataFrame, category: str = "all", level: str = "all", review: bool = False, search: str = "") -> DataFrame:
    """Cards of a category and difficulty; in review without the mastered ones that aren't bookmarked; with a substring in a text or tag."""
    out = cards
    if category != "all":
        out = out.where(F.col("category") == category)
    if level != "all":
        out = out.where(F.col("difficulty") == level)
    if review:
        out = out.where("NOT is_mastered OR is_bookmarked")
    if search:
        s = F.lit(search.lower())
        fields = F.contains(F.lower(F.concat_ws("\n", "original_sentence", "corrected_sentence", "explanation")), s)
        out = out.where(fields | F.exists("tags", lambda t: F.contains(F.lower(t), s)))
    return out


def is_right(answer: Column, expected: Column) -> Column:
    return F.lower(tx.strip(answer)) == F.lower(tx.strip(expected))


MODES = ("fill_in_blank", "multiple_choice", "type_answer", "sentence_rewrite")


def expected_answer(mode: Column, correct: Column, proposed: Column, corrected_sentence: Column) -> Column:
    """What a study mode counts as right: the card's answer (the proposed word without one), the proposed word, or the whole sentence."""
    own = F.when(F.coalesce(correct, F.lit("")) != "", correct).otherwise(proposed)
    return F.when(mode.isin("fill_in_blank", "multiple_choice"), own).when(mode == "type_answer", proposed).when(mode == "sentence_rewrite", tx.strip(corrected_sentence))


def answer_options(options: Column, answer: Column, original: Column) -> Column:
    """Distinct options of a multiple-choice card; a card with fewer than two gets its answer, what was read, and two common words."""
    return F.array_distinct(F.when(F.size(options) > 1, options).otherwise(F.array(answer, original, F.lit("however"), F.lit("which"))))


def distribution(decks: DataFrame, deck: list[str], counts: str) -> DataFrame:
    """Rows (deck, name, n) of a map column of counts."""
    return decks.select(*deck, F.explode(counts).alias("name", "n"))


def history_matching(items: DataFrame, search: str = "", kind: str = "all") -> DataFrame:
    """Items (title, category, has_deck) with a substring in title or category; ``documents`` are those without a deck, ``flashcards`` those with."""
    out = items
    if search:
        s = F.lit(search.lower())
        out = out.where(F.contains(F.lower("title"), s) | F.contains(F.lower("category"), s))
    return out.where(~F.col("has_deck")) if kind == "documents" else out.where("has_deck") if kind == "flashcards" else out


def shuffled(cards: DataFrame, seed: int) -> DataFrame:
    return cards.orderBy(F.xxhash64(F.lit(seed), "card_id"))
