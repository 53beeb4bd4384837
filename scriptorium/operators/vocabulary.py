"""Vocabulary: parts of speech, routing, senses and what a learner reads about a word."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions import lexicons as lx
from scriptorium.functions import scores as sc
from scriptorium.functions import text as tx

_SYMBOLS = r"[\d@#$%^&*()_+=\[\]{}<>\\/|]"


def part_of_speech(word: Column) -> tuple[Column, Column]:
    """(part of speech, confidence) from a word's ending."""
    w = tx.letters(word)
    rules = (
        (w == "", "grammar", 0.0),
        (w.endswith("ly"), "adverb", 0.75),
        (w.rlike("(?:ed|ing)$"), "verb", 0.75),
        (w.rlike("(?:tion|ment|ness|ity)$"), "noun", 0.75),
        (w.isin("very", "extremely", "really", "so", "too"), "adverb", 0.95),
        (w.isin("dirty", "clean", "happy", "sad", "big", "small"), "adjective", 0.95),
    )
    pos = conf = F
    for test, p, c in rules:
        pos, conf = pos.when(test, p), conf.when(test, F.lit(c))
    return pos.otherwise("noun"), conf.otherwise(F.lit(0.60))


def is_vocabulary(proposed: Column, category: Column, explanation: Column, pos: Column | None = None) -> Column:
    """Whether a correction is about a word, and not about grammar. Without ``pos`` the category's punctuation doesn't count."""
    w = tx.strip(proposed)
    clean = tx.letters(w)
    e, c = F.lower(F.coalesce(explanation, F.lit(""))), F.lower(F.coalesce(category, F.lit("")))
    no = clean.isin(*lx.FUNCTION_WORDS) | w.rlike(_SYMBOLS) | e.rlike("article|subject-verb|preposition|comma|period|punctuation")
    no = no | ((F.length(w) > 1) & w.rlike(r"^\p{Lu}") & (F.upper(w) == w))
    if pos is not None:
        no = no | pos.isin("determiner", "preposition", "conjunction", "pronoun", "number", "particle", "interjection") | F.contains(c, F.lit("punctuation"))
    return (F.length(clean) >= 2) & ~no


def rank_senses(words: DataFrame, senses: DataFrame, keys: list[str]) -> DataFrame:
    """Best sense per key of rows (keys, word, pos, sentence): keys, sense_id, definition, child_def, example, synonyms, antonyms,
    source, similarity. ``senses``: word, pos, ord, sense_id, definition, child_def, example, synonyms, antonyms, priority, source.

    The lexicon is joined by word and part of speech; equal definitions of a word count once, at their best priority.
    """
    one = senses.groupBy("word", "pos", "definition").agg(F.min_by(F.struct(*(c for c in senses.columns if c not in ("word", "pos", "definition"))), F.struct("priority", "ord")).alias("s"))
    one = one.select(F.col("word").alias("__w"), F.col("pos").alias("__p"), "definition", "s.*")
    own = words.join(one, (tx.letters(F.col("word")) == F.col("__w")) & (F.col("pos") == F.col("__p")))
    stop = F.array(*(F.lit(x) for x in "the and was were this that".split()))

    def bag(c: Column) -> Column:
        found = F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"(?U)\b([a-z]{3,})\b"), 1))
        return F.array_except(F.array_remove(found, F.lower("word")), stop)

    a, b = bag(F.col("sentence")), bag(F.concat_ws(" ", "definition", F.coalesce("example", F.lit(""))))
    shared = F.size(F.array_intersect(a, b))
    score = shared / F.greatest(F.lit(1), F.size(F.array_union(a, b))).cast("double") * 0.30
    score = score + F.when(F.col("priority") == 1, 0.25).when(F.col("priority") == 2, 0.10).otherwise(0.0) + F.when(shared > 0, 0.15).otherwise(0.0)
    scored = own.withColumn("similarity", F.round(sc.clamp(score, 0.20, 1.0), 4))
    fields = F.struct("sense_id", "definition", "child_def", "example", "synonyms", "antonyms", "source", "similarity")
    best = F.struct((-F.col("similarity")).alias("less"), "priority", "ord")
    return scored.groupBy(*keys).agg(F.min_by(fields, best).alias("b")).select(*keys, "b.*")


def confidence(pos_confidence: Column, similarity: Column, found: Column | bool = True) -> tuple[Column, Column]:
    """(overall confidence, whether to verify by hand)"""
    known = F.when(F.lit(found) if isinstance(found, bool) else found, 0.90).otherwise(0.40)
    c = F.round(pos_confidence * 0.35 + sc.clamp(similarity, 0.30, 1.0) * 0.45 + known * 0.20, 4)
    return c, c < 0.70


def simplified(word: Column, definition: Column, pos: Column, hint: Column) -> Column:
    """A definition in a learner's words."""
    t = F.regexp_replace(tx.strip(F.regexp_replace(definition, r"\(.*?\)", "")), r"(?U)\s+", " ")
    t = F.when(t.endswith("."), t).otherwise(F.concat(t, F.lit(".")))
    w = tx.letters(word)
    lead = {"noun": ("A ", ": "), "verb": ("To ", ": "), "adjective": ("Describes something that is ", ": "), "adverb": ("In a ", " manner: ")}
    out = F.when(F.length(hint) > 5, hint)
    for p, (a, b) in lead.items():
        out = out.when(pos == p, F.concat(F.lit(a), w, F.lit(b), t))
    return out.otherwise(t)


def example(word: Column, pos: Column, hint: Column | None = None) -> Column:
    """A sentence of 8 to 20 words with the word."""
    frames = {
        "noun": "The student noticed a very interesting %s during the afternoon science lesson.",
        "verb": "We decided to %s together after completing our morning school assignments.",
        "adjective": "The teacher shared a very %s example with the whole classroom today.",
        "adverb": "The children worked %s to finish their creative writing project on time.",
    }
    s = F
    for p, frame in frames.items():
        s = s.when(pos == p, F.format_string(frame, word))
    s = s.otherwise(F.format_string("Learning how to use %s correctly helps make your writing clear.", word))
    n = F.size(tx.tokens(s))
    s = F.when(n < 8, F.concat(s, F.lit(" It was very helpful."))).when(n > 20, F.concat(F.array_join(F.slice(tx.tokens(s), 1, 18), " "), F.lit("."))).otherwise(s)
    return s if hint is None else F.when(F.size(tx.tokens(hint)) >= 8, hint).otherwise(s)


def describe(corrections: DataFrame, keys: list[str], senses: DataFrame | None = None, tagger: Callable | None = None) -> DataFrame:
    """Adds what a learner reads about the proposed word of rows (keys, proposed, category, explanation, corrected_sentence):
    is_vocabulary, pos, sense, definition, child_definition, example, synonyms, antonyms, pronunciation, source,
    lexical_confidence, verify. Without a sense in the lexicon the context stands in. ``tagger`` (``tagging.in_context``, say) gives
    the part of speech in the corrected sentence; without one it follows from the word's ending."""
    if tagger is not None:
        own = tagger(corrections, F.col("proposed"), F.col("corrected_sentence")).withColumnRenamed("pos_confidence", "__pc")
    else:
        pos, pos_conf = part_of_speech(F.col("proposed"))
        own = corrections.withColumn("pos", pos).withColumn("__pc", pos_conf)
    own = own.withColumn("is_vocabulary", is_vocabulary(F.col("proposed"), F.col("category"), F.col("explanation"), F.col("pos")))
    none = F.array().cast("array<string>")
    if senses is None:
        own = own.withColumns({c: F.lit(None).cast("string") for c in ("__id", "__def", "__child", "__ex", "__src")} | {"__syn": none, "__ant": none, "__sim": F.lit(None).cast("double")})
    else:
        words = own.where("is_vocabulary").select(*keys, F.col("proposed").alias("word"), "pos", F.col("corrected_sentence").alias("sentence"))
        best = rank_senses(words, senses, keys)
        names = {"sense_id": "__id", "definition": "__def", "child_def": "__child", "example": "__ex", "source": "__src", "synonyms": "__syn", "antonyms": "__ant", "similarity": "__sim"}
        own = own.join(best.select(*keys, *(F.col(a).alias(b) for a, b in names.items())), keys, "left")
    v, s, low = F.col("is_vocabulary"), F.col("__id").isNotNull(), F.lower("proposed")
    conf, verify = confidence(F.col("__pc"), F.col("__sim"))
    p = F.col("pos")

    def three(with_sense: Column, without: Column, grammar: Column) -> Column:
        return F.when(v & s, with_sense).when(v, without).otherwise(grammar)

    empty = F.lit("")
    return own.withColumns(
        {
            "sense": three(F.col("__id"), F.concat(low, F.lit("."), p, F.lit(".fallback")), F.lit("grammar_rule")),
            "definition": three(F.col("__def"), F.concat(F.lit("A term functioning as an "), p, F.lit(" in context.")), empty),
            "child_definition": three(simplified(F.col("proposed"), F.col("__def"), p, F.col("__child")), F.concat(F.lit("Describes or represents '"), F.col("proposed"), F.lit("' as used in this sentence.")), empty),
            "example": three(example(F.col("proposed"), p, F.col("__ex")), example(F.col("proposed"), p), empty),
            "synonyms": three(F.coalesce("__syn", none), none, none),
            "antonyms": three(F.coalesce("__ant", none), none, none),
            "pronunciation": three(F.concat(F.lit("/"), tx.letters(F.col("proposed")), F.lit("/")), F.concat(F.lit("/"), low, F.lit("/")), empty),
            "source": three(F.col("__src"), F.lit("Contextual Inference"), F.lit("Grammar Engine Rule")),
            "lexical_confidence": three(conf, F.lit(0.50), F.lit(1.0)),
            "verify": three(verify, F.lit(True), F.lit(False)),
        }
    ).drop("__pc", "__id", "__def", "__child", "__ex", "__src", "__syn", "__ant", "__sim")


def child_entry(words: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Rows (word) with their entry of a child dictionary (word, ...), by the word or its stem without s, ed or ing; the first that is found."""
    w = tx.letters(F.col("word"))
    forms = F.array(w, *(F.when(w.endswith(e), F.substring(w, F.lit(1), F.length(w) - len(e))) for e in ("s", "ed", "ing")))
    own = words.withColumn("__rid", F.monotonically_increasing_id()).select("*", F.posexplode(forms).alias("__k", "__form")).where("__form is not null")
    entry = dictionary.select(F.col("word").alias("__form"), F.struct(*(c for c in dictionary.columns if c != "word")).alias("entry"))
    return own.join(entry, "__form").groupBy("__rid", *words.columns).agg(F.min_by("entry", "__k").alias("entry")).drop("__rid")
