"""Scores of recognised text and error rates."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptorium.functions import lexicons as lx
from scriptorium.functions import text as tx


def clamp(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def language_consistency(text: Column) -> Column:
    """Share of words that are known or have a vowel; reduced without any vowel."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\b([a-z]{2,})\b"), 1)
    valid = F.size(F.filter(words, lambda w: w.isin(*lx.LANGUAGE_WORDS) | w.rlike("[aeiouy]")))
    ratio = valid / F.size(words).cast("double")
    vowels = F.exists(words, lambda w: w.rlike("[aeiouy]"))
    some = clamp(F.when(vowels, ratio).otherwise(ratio * 0.3), 0.10, 1.0)
    none = F.when(F.length(text) <= 5, 0.70).otherwise(0.30)
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, 0.0).when(F.size(words) == 0, none).otherwise(some)


def quality(text: Column, confidence: Column, ink: Column, width: Column, height: Column) -> dict[str, Column]:
    """Calibrated quality and its parts."""
    t = tx.strip(text)
    conf, lang = clamp(confidence, 0.0, 1.0), language_consistency(t)
    density = F.when(ink > 0, ink).otherwise(0.05)
    box = F.when((width >= 10) & (height >= 8), 0.90).otherwise(0.40)
    q = clamp(conf * 0.40 + lang * 0.35 + clamp(density / 0.15, 0.20, 1.0) * 0.15 + box * 0.10, 0.0, 1.0)
    return {"language_consistency": lang, "quality": q, "gibberish": (conf >= 0.70) & (lang <= 0.20) & (F.size(tx.tokens(t)) > 0)}


def word_confidences(text: Column, confidence: Column, low: float = 0.70) -> Column:
    """array<struct<word, confidence, is_low>>; noise characters cost a fifth."""

    def entry(w: Column) -> Column:
        c = F.greatest(F.lit(0.40), confidence - F.when(w.rlike(r"[@~{}\[\]\\|_]"), 0.20).otherwise(0.0))
        return F.struct(w.alias("word"), F.round(c, 4).alias("confidence"), (c < low).alias("is_low"))

    return F.transform(tx.tokens(text), entry)


def candidate_words(text: Column) -> Column:
    return F.transform(tx.tokens(text), lambda w: F.regexp_replace(F.lower(w), r"""^[.,!?;:"'()]+|[.,!?;:"'()]+$""", ""))


def candidate_base(text: Column, words: Column, confidence: Column, known: Iterable[str], keywords: Column) -> Column:
    """Visual confidence, share of known words, noise and subject words. ``words``: :func:`candidate_words` of the text."""
    hits = F.size(F.filter(words, lambda w: F.array_contains(keywords, w)))
    valid = F.size(F.filter(words, lambda w: w.isin(*known) | F.array_contains(keywords, w)))
    noise = F.length(F.regexp_replace(text, r"""(?U)[\p{L}\p{N} .,!?;:\-'"]""", ""))
    language = F.when(F.size(words) > 0, valid / F.size(words).cast("double") * 0.25 - F.least(F.lit(0.20), noise * 0.03)).otherwise(0.05)
    return F.coalesce(confidence, F.lit(0.5)) * 0.40 + language + F.least(F.lit(0.20), hits * 0.10)


def scale_score(text: Column, words: Column, confidence: Column, scale: Column, keywords: Column, boosts: Column) -> Column:
    """Score of a candidate from one image scale; ``boosts`` is a map from text or word to what the user's profile adds."""
    partial = F.aggregate(words, F.lit(0.0), lambda a, w: a + F.coalesce(F.try_element_at(boosts, w), F.lit(0.0)))
    adapt = F.coalesce(F.try_element_at(boosts, F.lower(text)), F.least(F.lit(0.15), partial))
    plain = F.when(scale.isin("original", "clahe_contrast", "unsharp_sharpened"), 0.05).otherwise(0.0)
    return clamp(candidate_base(text, words, confidence, lx.SCALE_WORDS, keywords) + adapt + plain, 0.05, 0.99)


def model_score(text: Column, words: Column, confidence: Column, model: Column, keywords: Column, boosts: Column) -> Column:
    """Score of a candidate from one recogniser."""
    adapt = F.coalesce(F.try_element_at(boosts, F.lower(text)), F.lit(0.0))
    name = F.lower(model)
    liked = F.when(name.contains("trocr"), 0.08).when(name.contains("got"), 0.06).otherwise(0.0)
    return clamp(candidate_base(text, words, confidence, lx.MODEL_WORDS, keywords) + adapt + liked, 0.05, 0.99)


def cer(hypothesis: Column, reference: Column) -> Column:
    """Character error rate."""
    n = F.length(reference)
    return F.when(n == 0, F.when(F.length(hypothesis) == 0, 0.0).otherwise(1.0)).otherwise(F.levenshtein(hypothesis, reference) / n.cast("double"))


def word_distance(a: list[str], b: list[str]) -> int:
    """Fewest words to insert, delete or replace. A column of the table of distances is two numbers of as many bits as ``a`` has words, so
    time grows with the words of ``b`` times a 64th of those of ``a``, and memory with their sum."""
    if not len(a) or not len(b):
        return max(len(a), len(b))
    places: dict[str, int] = {}
    for k, w in enumerate(a):
        places[w] = places.get(w, 0) | 1 << k
    full, last = (1 << len(a)) - 1, 1 << len(a) - 1
    up, down, score = full, 0, len(a)
    for w in b:
        same = places.get(w, 0)
        either = same | down
        across = (((same & up) + up) ^ up) | same
        more, less = down | full & ~(across | up), up & across
        score += bool(more & last) - bool(less & last)
        more, less = (more << 1 | 1) & full, less << 1 & full
        up, down = less | full & ~(either | more), more & either
    return score


@F.pandas_udf(T.LongType())
def _distances(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else word_distance(list(x), list(y)) for x, y in zip(a, b, strict=True)], dtype="Int64")


def wer(hypothesis: Column, reference: Column) -> Column:
    """Word error rate, of texts of any length; a text is compared in Arrow batches."""
    h, r = tx.tokens(hypothesis), tx.tokens(reference)
    return F.when(F.size(r) == 0, F.when(F.size(h) == 0, 0.0).otherwise(1.0)).otherwise(_distances(h, r) / F.size(r).cast("double"))


def cosine(a: Column, b: Column) -> Column:
    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
