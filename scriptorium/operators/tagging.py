"""Parts of speech in context: hidden Markov tags of a sentence's words.

A token is seen through its class: a function word is a class of its own, other words share that of their ending. A model holds
scores (thousandths of natural logarithms, whole numbers, so that sums and ties are the same everywhere) for the first tag, for
a tag after another, and for a class under a tag. The best tags of a sentence are Viterbi's: of equal ones, those of the lower
number, seen from the end.

``learn`` re-estimates a model over any corpus by expectation-maximisation. Each pass sends the model to the tasks (tags x classes, whatever
the corpus holds) and adds expected counts in the cluster; counts are rounded to whole 65536ths for each sentence, so the order of adding
doesn't matter. What the prior rules out (a function word under a tag that it never has) stays ruled out, and the prior counts as
PRIOR observations of each tag, however large the corpus is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptorium.operators.vocabulary import part_of_speech
from scriptorium.sources.scratch import stored

TAGS = ("noun", "verb", "adjective", "adverb", "pronoun", "determiner", "preposition", "conjunction", "number", "particle", "interjection", "other")
OPEN = ("noun", "verb", "adjective", "adverb")
NEVER = -10_000_000
PRIOR = 500.0
ROUNDS = 4
UNIT = 1 << 16
#: tokens that a kernel takes at once, and sentences
TOKENS, SENTENCES = 100_000, 2000
TEXT = 1 << 20  # characters that are tagged at once

CLOSED = {
    "pronoun": "i you he she it we they me him her us them myself yourself himself herself itself ourselves themselves who whom whose what which this that these those someone something anyone anything everyone everything nobody nothing mine yours hers ours theirs",
    "determiner": "a an the this that these those my your his her its our their some any no every each either neither both all such another which what",
    "preposition": "of in on at by for with from to into onto over under about above below between among through during before after against without within upon across behind beyond near since until like as than",
    "conjunction": "and or but nor so yet because although though while whereas if unless when where that as since until than whether before after",
    "particle": "to not up out off down away back",
    "interjection": "oh ah hey hello wow ouch yes no please well alas",
    "verb": "am is are was were be been being have has had do does did can could will would shall should may might must",
    "adverb": "very extremely really so too not never always often again also just still now then here there when where how why well away back",
    "adjective": "dirty clean happy sad big small good new old other own same such",
    "number": "one two three four five six seven eight nine ten hundred thousand",
}
#: ending, and how often words of a thousand of each open tag have it; the first that fits counts
ENDINGS = (
    ("ly", {"adverb": 650, "adjective": 20, "noun": 5}),
    ("ing", {"verb": 160, "noun": 30, "adjective": 20}),
    ("ed", {"verb": 220, "adjective": 40, "noun": 3}),
    ("tion", {"noun": 60}),
    ("ment", {"noun": 30, "verb": 2}),
    ("ness", {"noun": 20}),
    ("ity", {"noun": 25}),
    ("ous", {"adjective": 50}),
    ("ful", {"adjective": 30, "noun": 2}),
    ("ive", {"adjective": 40, "verb": 10, "noun": 5}),
    ("able", {"adjective": 40}),
    ("ible", {"adjective": 10}),
    ("al", {"adjective": 90, "noun": 15}),
    ("ic", {"adjective": 60, "noun": 8}),
    ("less", {"adjective": 20}),
    ("est", {"adjective": 30, "noun": 5, "verb": 5}),
    ("er", {"noun": 60, "adjective": 40, "verb": 25, "adverb": 10}),
    ("ise", {"verb": 15, "noun": 4}),
    ("ize", {"verb": 15}),
    ("ify", {"verb": 8}),
    ("s", {"noun": 230, "verb": 110, "adjective": 5, "adverb": 5}),
    ("", {"noun": 390, "verb": 350, "adjective": 420, "adverb": 150}),
)
#: of a thousand words after a tag (or at the start), how many have which; what is left is shared by all tags
FOLLOWS = {
    "start": {"determiner": 250, "noun": 180, "pronoun": 220, "preposition": 80, "adverb": 70, "verb": 60, "conjunction": 50, "adjective": 40},
    "noun": {"verb": 240, "preposition": 220, "other": 200, "noun": 110, "conjunction": 80, "determiner": 20, "adverb": 40, "particle": 15, "pronoun": 20},
    "verb": {"determiner": 210, "noun": 120, "preposition": 150, "adverb": 110, "verb": 120, "adjective": 90, "pronoun": 70, "particle": 50, "other": 40},
    "adjective": {"noun": 640, "adjective": 60, "conjunction": 70, "preposition": 60, "other": 90},
    "adverb": {"verb": 260, "adjective": 200, "adverb": 90, "preposition": 90, "determiner": 80, "other": 130, "noun": 50},
    "pronoun": {"verb": 640, "adverb": 90, "noun": 50, "preposition": 50, "other": 60},
    "determiner": {"noun": 620, "adjective": 250, "number": 30, "adverb": 30, "verb": 10},
    "preposition": {"determiner": 380, "noun": 300, "pronoun": 90, "adjective": 80, "number": 40, "verb": 40},
    "conjunction": {"determiner": 190, "noun": 210, "pronoun": 190, "verb": 140, "adjective": 70, "adverb": 80},
    "number": {"noun": 520, "other": 180, "adjective": 70, "preposition": 60, "number": 40},
    "particle": {"verb": 680, "other": 60, "preposition": 60, "determiner": 60},
    "interjection": {"other": 600, "pronoun": 120, "determiner": 60, "noun": 60},
    "other": {"noun": 190, "determiner": 150, "pronoun": 130, "conjunction": 130, "other": 110, "verb": 80, "adverb": 70, "adjective": 60, "preposition": 60},
}

SENTENCE = r"[^.!?\n]+[.!?]*"
TOKEN = r"\p{L}+(?:['’-]\p{L}+)*|\p{N}+(?:[.,]\p{N}+)*|[^ \t\n\x0B\f\r\p{L}\p{N}]"
_SENTENCE, _TOKEN = regex.compile(SENTENCE), regex.compile(TOKEN)
_LOWER = {c: c + 32 for c in range(65, 91)}


@cache
def closed() -> dict[str, tuple[str, ...]]:
    """Function words with their tags."""
    out: dict[str, list[str]] = {}
    for tag, words in CLOSED.items():
        for w in words.split():
            out.setdefault(w, []).append(tag)
    return {w: tuple(t) for w, t in out.items()}


@cache
def classes() -> dict[str, int]:
    """Numbers of the classes: numbers, signs, endings, function words."""
    return {c: k for k, c in enumerate(["#", ".", *("-" + e for e, _ in ENDINGS), *("=" + w for w in closed())])}


@cache
def class_of(token: str) -> int:
    w, known = token.translate(_LOWER), classes()
    if "=" + w in known:
        return known["=" + w]
    if not w[0].isalpha():
        return known["#"] if w[0].isnumeric() else known["."]
    return known["-" + next(e for e, _ in ENDINGS if w.endswith(e))]


def sentences(text: str | None) -> list[list[str]]:
    """The tokens of each sentence of a text (up to a full stop, an exclamation or question mark, or a line's end)."""
    found = (_TOKEN.findall(s) for s in _SENTENCE.findall(text or ""))
    return [x for x in found if x]


@dataclass
class Model:
    """Scores of the first tag, of a tag (column) after a tag (row), and of a class (column) under a tag (row)."""

    start: np.ndarray
    after: np.ndarray
    emit: np.ndarray

    @classmethod
    def of(cls, start: np.ndarray, after: np.ndarray, emit: np.ndarray) -> Model:
        """From probabilities."""
        return cls(*(np.where(p > 0, np.rint(1000 * np.log(np.maximum(p, 1e-300))), NEVER).astype(np.int64) for p in (start, after, emit)))


def prior_probabilities() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, known = len(TAGS), classes()

    def row(counts: dict[str, int]) -> np.ndarray:
        p = np.array([counts.get(t, 0) for t in TAGS], float)
        p += max(20.0, 1000 - p.sum()) / n
        return p / p.sum()

    emit = np.zeros((n, len(known)))
    for word, tags in closed().items():
        for t in tags:
            emit[TAGS.index(t), known["=" + word]] = 8.0
    for e, counts in ENDINGS:
        for t, v in counts.items():
            emit[TAGS.index(t), known["-" + e]] = v
    emit[TAGS.index("number"), known["#"]] = 400.0
    emit[TAGS.index("other"), known["."]] = 1000.0
    return row(FOLLOWS["start"]), np.stack([row(FOLLOWS[t]) for t in TAGS]), emit / emit.sum(1, keepdims=True)


@cache
def prior() -> Model:
    return Model.of(*prior_probabilities())


# -- kernels: many sentences at once, longest first, so that those still running are the first rows ----------


def _stacked(codes: list[np.ndarray]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """(which sentences, their lengths descending, codes by place and sentence) of a bounded size; a sentence at least."""
    order = sorted(range(len(codes)), key=lambda k: -len(codes[k]))
    at = 0
    while at < len(order):
        n = max(1, min(SENTENCES, TOKENS // max(1, len(codes[order[at]]))))
        which = order[at : at + n]
        lens = np.array([len(codes[k]) for k in which])
        block = np.zeros((int(lens[0]), len(which)), np.int64)
        for j, k in enumerate(which):
            block[: lens[j], j] = codes[k]
        yield which, lens, block
        at += n


def viterbi(model: Model, codes: list[np.ndarray]) -> list[np.ndarray]:
    """Best tags of each sentence (an array of class numbers, one at least)."""
    out: list = [None] * len(codes)
    for which, lens, block in _stacked(codes):
        back = np.zeros((*block.shape, len(TAGS)), np.int8)
        score = model.start + model.emit[:, block[0]].T
        for t in range(1, len(block)):
            n = int(np.searchsorted(-lens, -t, "left"))  # sentences of more than t tokens
            step = score[:n, :, None] + model.after
            back[t, :n] = np.argmax(step, 1)
            score[:n] = step.max(1) + model.emit[:, block[t, :n]].T
        tags = np.zeros(block.shape, np.int8)
        rows = np.arange(len(which))
        tags[lens - 1, rows] = np.argmax(score, 1)
        for t in range(len(block) - 1, 0, -1):
            n = int(np.searchsorted(-lens, -t, "left"))
            tags[t - 1, :n] = back[t, rows[:n], tags[t, :n]]
        for j, k in enumerate(which):
            out[k] = tags[: lens[j], j]
    return out


def expected(p: tuple[np.ndarray, np.ndarray, np.ndarray], codes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected counts of first tags, of pairs of tags, and of classes under tags, in UNITs."""
    start, after, emit = p
    n_tags = len(TAGS)
    first, pairs, seen = np.zeros(n_tags, np.int64), np.zeros((n_tags, n_tags), np.int64), np.zeros((emit.shape[1], n_tags), np.int64)
    whole = lambda x: np.rint(x * UNIT).astype(np.int64)
    for _, lens, block in _stacked(codes):
        forward, scale = np.zeros((*block.shape, n_tags)), np.ones(block.shape)
        for t in range(len(block)):
            n = int(np.searchsorted(-lens, -t, "left"))
            own = (start if t == 0 else forward[t - 1, :n] @ after) * emit[:, block[t, :n]].T
            scale[t, :n] = own.sum(1)
            forward[t, :n] = own / scale[t, :n, None]
        backward = np.ones((block.shape[1], n_tags))
        inner = np.zeros((block.shape[1], n_tags, n_tags))
        for t in range(len(block) - 1, -1, -1):
            n = int(np.searchsorted(-lens, -t, "left"))
            here = forward[t, :n] * backward[:n]
            np.add.at(seen, block[t, :n], whole(here))
            if t:
                ahead = emit[:, block[t, :n]].T * backward[:n] / scale[t, :n, None]
                inner[:n] += forward[t - 1, :n, :, None] * after * ahead[:, None, :]
                backward[:n] = ahead @ after.T
            else:
                first += whole(here).sum(0)
        pairs += whole(inner).sum(0)
    return first, pairs, seen.T


# -- operators -------------------------------------------------------------


def _codes(text: str | None) -> list[np.ndarray]:
    return [np.fromiter(map(class_of, s), np.int64, len(s)) for s in sentences(text)]


def learn(docs: DataFrame, text: str = "text", rounds: int = ROUNDS) -> Model:
    """A model re-estimated over all of ``docs``, from the prior. Null and blank texts count nothing; without any text it is the prior."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [s.astype(np.uint8 if len(classes()) < 256 else np.uint16).tobytes() for t in b.column(0).to_pylist() for s in _codes(t)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], names=["codes"])

    def count(batches: Iterator[pa.RecordBatch], p: tuple) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            codes = [np.frombuffer(x, np.uint8 if len(classes()) < 256 else np.uint16).astype(np.int64) for x in b.column(0).to_pylist()]
            got = expected(p, codes)
            total = got if total is None else [x + y for x, y in zip(total, got, strict=True)]
        if total is not None:
            flat = np.concatenate([x.ravel() for x in total])
            at = np.flatnonzero(flat)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(flat[at])], names=["at", "n"])

    seen = stored(docs.select(F.col(text).cast("string").alias("text")).mapInArrow(encode, "codes binary"), "tag-codes")
    base = prior_probabilities()
    p = base
    shapes = [x.shape for x in base]
    cuts = np.cumsum([int(np.prod(s)) for s in shapes])[:-1]
    for _ in range(rounds):
        flat = np.zeros(sum(int(np.prod(s)) for s in shapes))
        for r in seen.mapInArrow(lambda it, now=p: count(it, now), "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():  # a row for each number of the model
            flat[r["at"]] = r["n"] / UNIT
        counts = [x.reshape(s) for x, s in zip(np.split(flat, cuts), shapes, strict=True)]
        p = tuple((c + PRIOR * b) / (c + PRIOR * b).sum(-1, keepdims=True) for c, b in zip(counts, base, strict=True))
    return Model.of(*p)


def tokens(docs: DataFrame, keys: list[str], text: str = "text", model: Model | None = None) -> DataFrame:
    """One row per token of ``docs``: the keys, sentence (from 1), place (from 1), token, tag. Null and blank texts have none."""
    own = model or prior()
    wanted = docs.select(F.struct(*(F.col(k) for k in keys)).alias("key"), F.col(text).cast("string").alias("text"))
    schema = T.StructType([wanted.schema["key"], *(T.StructField(c, t) for c, t in (("sentence", T.IntegerType()), ("place", T.IntegerType()), ("token", T.StringType()), ("tag", T.StringType())))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, text in enumerate(b.column("text").to_pylist()):  # a text at a time: its tokens are many times as large
                found = sentences(text)
                tags = viterbi(own, [np.fromiter(map(class_of, s), np.int64, len(s)) for s in found])
                n = [len(s) for s in found]
                if n:
                    cols = [
                        b.column("key").take(pa.array([k] * sum(n))), pa.array(np.repeat(np.arange(1, len(n) + 1, dtype=np.int32), n)), pa.array(np.concatenate([np.arange(1, x + 1, dtype=np.int32) for x in n])),
                        pa.array([t for s in found for t in s], pa.string()), pa.array([TAGS[t] for s in tags for t in s], pa.string()),
                    ]
                    yield pa.RecordBatch.from_arrays(cols, names=["key", "sentence", "place", "token", "tag"])

    return wanted.mapInArrow(run, schema).select("key.*", "sentence", "place", "token", "tag")


def letters(word: str) -> str:
    return "".join(c for c in word if "a" <= c <= "z" or "A" <= c <= "Z").lower()


def _first_tags(model: Model, asked: dict[str, dict[str, str | None]]) -> None:
    """Puts the tag of each text's first token with the letters that are asked for; texts are tagged many at once."""
    low: dict[str, str] = {}
    every, at = list(asked), 0
    while at < len(every):
        to, size = at, 0
        while to < len(every) and (to == at or size + len(every[to]) <= TEXT):
            size += len(every[to])
            to += 1
        found = [(asked[t], s) for t in every[at:to] for s in sentences(t)]
        tags = viterbi(model, [np.fromiter(map(class_of, s), np.int64, len(s)) for _, s in found])
        for (want, s), own in zip(found, tags, strict=True):
            for token, t in zip(s, own.tolist(), strict=True):
                key = low.get(token)
                if key is None:
                    key = low[token] = letters(token)
                if key and key in want and want[key] is None:
                    want[key] = TAGS[t]
        at = to


def in_context(rows: DataFrame, word: Column, sentence: Column, model: Model | None = None) -> DataFrame:
    """``rows`` with pos and pos_confidence of ``word`` in ``sentence``: the tag of the sentence's first token that has the same letters,
    with 0.98 for nouns, verbs, adjectives and adverbs and 0.85 for others; where there is none, by the word's ending. A word without a letter
    is "grammar" with 0.0. Columns of any name are carried along."""
    own = model or prior()
    wanted = rows.select(F.struct("*").alias("row"), F.coalesce(word, F.lit("")).alias("word"), F.coalesce(sentence, F.lit("")).alias("text"))
    schema = T.StructType([wanted.schema["row"], T.StructField("word", T.StringType()), T.StructField("tag", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, texts = b.column("word").to_pylist(), b.column("text").to_pylist()
            asked: dict[str, dict[str, str | None]] = {}
            for w, text in zip(words, texts, strict=True):
                asked.setdefault(text, {})[letters(w)] = None
            _first_tags(own, asked)
            out = [asked[text][letters(w)] for w, text in zip(words, texts, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("word"), pa.array(out, pa.string())], names=["row", "word", "tag"])

    found = wanted.mapInArrow(run, schema)
    pos, conf = part_of_speech(F.col("word"))
    tag = F.when(F.col("tag") == "other", "noun").otherwise(F.col("tag"))
    sure = F.when(F.col("tag").isNotNull(), F.when(tag.isin(*OPEN), 0.98).otherwise(0.85)).otherwise(conf)
    return found.select("row.*", F.coalesce(tag, pos).alias("pos"), sure.alias("pos_confidence"))


# -- SQL -------------------------------------------------------------------


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql(model: Model | None = None, source: str = "conversations", keys: str = "conv_id, turn") -> str:
    """CTEs (for WITH RECURSIVE) that end in ``tags``: the keys, sentence, place, token, tag of all tokens of ``source``."""
    own, known = model or prior(), classes()
    rows = lambda it: ", ".join(f"({', '.join(map(str, r))})" for r in it)
    n = range(len(TAGS))
    ends = " ".join(f"WHEN w LIKE '%{e}' THEN {known['-' + e]}" for e, _ in ENDINGS)
    same = " AND ".join(f"s.{k} = d.{k}" for k in keys.split(", "))
    of = lambda a: ", ".join(f"{a}.{k}" for k in keys.split(", "))
    return f"""hstart(tag, s) AS (VALUES {rows((t, own.start[t]) for t in n)}),
hafter(a, b, s) AS (VALUES {rows((a, b, own.after[a, b]) for a in n for b in n)}),
hemit(tag, c, s) AS (VALUES {rows((t, c, own.emit[t, c]) for t in n for c in known.values() if own.emit[t, c] > NEVER)}),
hname(tag, name) AS (VALUES {rows((t, _quoted(TAGS[t])) for t in n)}),
hword(w, c) AS (VALUES {rows((_quoted(w), known["=" + w]) for w in closed())}),
hs AS MATERIALIZED (SELECT {keys}, regexp_extract_all(text, '{SENTENCE.replace(chr(92) + "n", chr(10))}') AS all_s FROM {source} WHERE text IS NOT NULL),
hf AS MATERIALIZED (SELECT {keys}, list_filter(list_transform(all_s, lambda x: regexp_extract_all(x, {_quoted(TOKEN)})), lambda x: len(x) > 0) AS f FROM hs),
hu AS (SELECT {keys}, unnest(f) AS toks, unnest(range(1, len(f) + 1)) AS sentence FROM hf),
ht AS (SELECT {keys}, sentence, unnest(toks) AS token, unnest(range(1, len(toks) + 1)) AS place FROM hu),
hw AS (SELECT *, translate(token, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM ht),
seq AS MATERIALIZED (SELECT {of("h")}, sentence, place, token, coalesce(hword.c, CASE WHEN regexp_matches(h.w, '^\\p{{N}}') THEN {known["#"]} WHEN NOT regexp_matches(h.w, '^\\p{{L}}') THEN {known["."]} {ends} END) AS c
  FROM hw h LEFT JOIN hword USING (w)),
dp AS (
  SELECT {of("s")}, s.sentence, s.place, e.tag, b.s + e.s AS score, [e.tag] AS path FROM seq s JOIN hemit e USING (c) JOIN hstart b ON b.tag = e.tag WHERE s.place = 1
  UNION ALL
  SELECT {of("s")}, s.sentence, s.place, e.tag, max(d.score + t.s + e.s) AS score, list_append(arg_max(d.path, {{'s': d.score + t.s, 'p': -d.tag}}), e.tag) AS path
  FROM dp d JOIN seq s ON {same} AND s.sentence = d.sentence AND s.place = d.place + 1 JOIN hemit e USING (c) JOIN hafter t ON t.a = d.tag AND t.b = e.tag GROUP BY {of("s")}, s.sentence, s.place, e.tag),
hlast AS (SELECT {keys}, sentence, max(place) AS place FROM seq GROUP BY ALL),
hbest AS (SELECT {of("d")}, d.sentence, arg_max(d.path, {{'s': d.score, 'p': -d.tag}}) AS path FROM dp d JOIN hlast s ON {same} AND s.sentence = d.sentence AND s.place = d.place GROUP BY ALL),
hp AS (SELECT {keys}, sentence, unnest(path) AS tag, unnest(range(1, len(path) + 1)) AS place FROM hbest),
tags AS MATERIALIZED (SELECT {of("s")}, CAST(s.sentence AS INT) AS sentence, CAST(s.place AS INT) AS place, s.token, hname.name AS tag
  FROM seq s JOIN hp d ON {same} AND s.sentence = d.sentence AND s.place = d.place JOIN hname ON hname.tag = d.tag)"""
