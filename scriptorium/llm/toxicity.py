"""Operator 9: toxicity from a learned lexicon, Levenshtein automata and context windows.

Terms are learned from the labels of the training documents: words, and stems (word beginnings), that
are many times likelier in toxic documents. The lexicon is a trie. A word that is no term runs through the intersection of the
trie with the Levenshtein automata of its terms (distance 1, for long terms 2): a state is a set of trie nodes with
the edits so far, those that cannot reach acceptance any more are left out, and states and steps are made when a word first
needs them. Most words die within a few letters, whatever the number of terms. Hits are then weighed by their context window:
hits between quotation marks, or next to a word of reporting, count apart from plain ones. A logistic model turns
the counts into a score. It is cross-fitted: a document's counts in the fit come from terms that were learned on the other folds
of the labels, so no term vouches for the document that taught it.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm import common

THRESHOLD = 0.3
STEMS = (4, 5, 6)
MIN_DOCS = 4  # toxic training documents that hold a term
MIN_LOG_ODDS = 1.5  # less SURE standard errors
SURE = 1.64
SIEVE = 25  # bits of the position in the sieve of candidates
FOLDS = 4  # of the training labels in cross-fitting
FIT_ROWS = 50_000  # labelled rows in the logistic fit
FUZZY = 5  # letters of a term that misspellings are looked up for
LONG = 9  # letters of a term from which two edits are let pass
STATES = 100_000  # of an automaton, before it starts afresh
PREFIX = 4  # letters whose state is kept, so that a word that dies in them costs one look-up
SEEN = 1_000_000  # words that a lexicon remembers
WINDOW = 3
LIKE = ((3, 0), (4, 1))  # features of misspelled hits, and of plain ones
QUOTES = "\"“”„«»‘’"
#: words of reporting that mark a quotation
REPORTING = ("said", "says", "quote", "quoted", "wrote", "called", "dit", "dijo", "sagte")
_QUOTES, _REPORTING = frozenset(QUOTES), frozenset(REPORTING)
_TOKEN = re.compile(r"[^\W_]+(?:[*@$!0-9'-]+[^\W_]+)*|[" + QUOTES + "]")
_LEET = str.maketrans("013457@$!", "oleastasi")


def tokens(text: str) -> list[str]:
    return _TOKEN.findall(text.lower())


def plain(word: str) -> str:
    """Look-alike characters inside a word as letters."""
    return word if word.isalpha() else re.sub(r"[^\w]", "", word.translate(_LEET))


class Automaton:
    """The trie ``root`` with the Levenshtein automata of its whole terms, made deterministic as words come."""

    def __init__(self, root: dict):
        self.children: list[dict[str, int]] = []
        self.reach: list[int] = []  # edits that a term below lets pass; -1 without a term
        self.ends: list[tuple[float, int]] = []  # weight of the term that ends here, and its edits

        def add(node: dict, depth: int) -> int:
            k = len(self.children)
            end = node.get("$", (0.0, False, 0.0))[2] if depth >= FUZZY else 0.0
            edits = (1 + (depth >= LONG)) if end else -1
            self.children.append({})
            self.reach.append(edits)
            self.ends.append((end, edits))
            for c, child in node.items():
                if c != "$":
                    self.children[k][c] = at = add(child, depth + 1)
                    self.reach[k] = max(self.reach[k], self.reach[at])
            return k

        add(root, 0)
        self.clear()

    def clear(self) -> None:
        self.numbers: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.steps: list[dict[str, int]] = []
        self.weights: list[float] = []
        self.jumps: dict[str, int] = {}
        self.start = self.number({0: 0})

    def number(self, least: dict[int, int]) -> int:
        """The state of these nodes with their edits, and of those that letters missing from the word lead to; -1 if none is left."""
        todo = list(least.items())
        while todo:
            node, e = todo.pop()
            if e > least[node]:
                continue
            for child in self.children[node].values():
                if e + 1 <= self.reach[child] and e + 1 < least.get(child, 9):
                    least[child] = e + 1
                    todo.append((child, e + 1))
        state = tuple(sorted((n, e) for n, e in least.items() if e <= self.reach[n]))
        if not state:
            return -1
        if state not in self.numbers:
            self.numbers[state] = len(self.states)
            self.states.append(state)
            self.steps.append({})
            self.weights.append(max((w for (w, edits), e in ((self.ends[n], e) for n, e in state) if w and e <= edits), default=0.0))
        return self.numbers[state]

    def step(self, state: int, c: str) -> int:
        least: dict[int, int] = {}

        def reach(node, e):
            if e <= self.reach[node] and e < least.get(node, 9):
                least[node] = e

        for node, e in self.states[state]:
            reach(node, e + 1)  # a letter too many
            for letter, child in self.children[node].items():
                reach(child, e + (letter != c))
        out = self.steps[state][c] = self.number(least)
        return out

    def walk(self, state: int, letters: str) -> int:
        steps = self.steps
        for c in letters:
            if state < 0:
                return state
            to = steps[state].get(c)
            state = self.step(state, c) if to is None else to
        return state

    def weight(self, word: str) -> float:
        """Largest weight of a term that the word misspells; 0 without."""
        begin = word[:PREFIX]
        state = self.jumps.get(begin)
        if state is None:
            if len(self.states) > STATES or len(self.jumps) > 4 * STATES:
                self.clear()
            state = self.jumps[begin] = self.walk(self.start, begin)
        if state >= 0 and len(word) > PREFIX:
            state = self.walk(state, word[PREFIX:])
        return self.weights[state] if state >= 0 else 0.0


class Lexicon:
    """Terms with exact and stem look-up, and their trie ({"$": (weight, is_stem, weight as a whole word)} at their ends) for misspellings."""

    def __init__(self, terms: list[tuple[str, bool, float]], remember: int = SEEN):
        self.root: dict = {}
        self.seen: set[str] = set()
        self.remember = remember
        self.hot: dict[str, tuple[float, int]] = {}
        self.whole: dict[str, float] = {}
        self.stems: dict[str, float] = {}
        for term, stem, weight in terms:
            node = self.root
            for c in term:
                node = node.setdefault(c, {})
            old = node.get("$", (weight, False, 0.0))
            node["$"] = max(weight, old[0]), stem or old[1], old[2] if stem else max(weight, old[2])
            self.whole[term] = node["$"][0]
            if stem:
                self.stems[term] = node["$"][0]
        for term in self.stems:
            self.stems[term] = self.whole[term]
        self.stem_lengths = sorted({len(t) for t in self.stems}, reverse=True)
        self.automaton = Automaton(self.root)

    def exact(self, word: str) -> float:
        """Weight of the word, or of the longest stem that it begins with; 0 if neither."""
        own = self.whole.get(word)
        if own is not None:
            return own
        for k in self.stem_lengths:
            own = self.stems.get(word[:k])
            if own is not None:
                return own
        return 0.0

    def fuzzy(self, word: str) -> float:
        """Largest weight of a whole term (FUZZY letters or more) at Levenshtein distance 1 at most (2 from LONG letters on)."""
        return self.automaton.weight(word)

    def learn(self, words: set[str]) -> None:
        """Weighs the words that are new; ``hot`` keeps those with a weight as (weight, distance)."""
        fresh = words - self.seen
        if len(self.seen) + len(fresh) > self.remember:
            self.seen.clear()
            self.hot.clear()
            fresh = words
        for word in fresh:
            p = plain(word)
            w = self.exact(word) or (self.exact(p) if p != word else 0.0)
            if w:
                self.hot[word] = w, 0
            elif w := self.fuzzy(p):
                self.hot[word] = w, 1
        self.seen |= fresh


def features(text: str, lexicon: Lexicon) -> tuple[float, ...]:
    """Strongest plain hit, number of plain hits, their share of the words, strongest misspelled hit, their number,
    strongest quoted hit, number of quoted hits."""
    found = tokens(text)
    words = set(found)
    lexicon.learn(words)
    if lexicon.hot.keys().isdisjoint(words):
        return (0.0,) * 7
    hot = lexicon.hot
    hits = [(k, hot[t]) for k, t in enumerate(found) if t in hot]
    quotes = [k for k, t in enumerate(found) if t in _QUOTES]
    out = [0.0] * 7
    for k, (w, distance) in hits:
        before = bisect_left(quotes, k)
        inside = before % 2 == 1 and before < len(quotes)
        around = found[max(0, k - WINDOW) : k + WINDOW + 1]
        kind = 5 if inside or not _REPORTING.isdisjoint(around) else 3 if distance else 0
        out[kind] = max(out[kind], w)
        out[kind + 1] += 1
    share = 100 * out[1] / max(1, len(found) - len(quotes))
    return out[0], np.log1p(out[1]), np.log1p(share), out[3], np.log1p(out[4]), out[5], np.log1p(out[6])


def _terms_of(word: str) -> list[str]:
    """The word, and its stems with a star."""
    w = plain(word)
    return [w, *(w[:k] + "*" for k in STEMS if len(w) > k)]


class Sieve:
    """Bits at the hashes of terms: every term is in it, few others are. Its size is fixed."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits.tobytes()

    @staticmethod
    def place(term: str) -> int:
        return xxhash.xxh64_intdigest(term) >> (64 - SIEVE)

    def __contains__(self, term: str) -> bool:
        k = self.place(term)
        return bool(self.bits[k >> 3] >> (k & 7) & 1)


def _sieves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bits = np.zeros(1 << SIEVE >> 3, np.uint8)
    for b in batches:
        k = np.fromiter(map(Sieve.place, b.column("term").to_pylist()), np.int64, b.num_rows)
        np.bitwise_or.at(bits, k >> 3, (1 << (k & 7)).astype(np.uint8))
    yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(bits.tobytes(), 1)], pa.binary())], names=["bits"])


def _sieve(terms: DataFrame) -> Sieve:
    bits = np.zeros(1 << SIEVE >> 3, np.uint8)
    for r in terms.select("term").coalesce(8).mapInArrow(_sieves, "bits binary").collect():
        bits |= np.frombuffer(zlib.decompress(r[0]), np.uint8)
    return Sieve(bits)


def _count(batches: Iterator[pa.RecordBatch], sieve) -> Iterator[pa.RecordBatch]:
    """(term, number of texts of each fold that hold it) of the terms in the broadcast ``sieve``, or of all."""
    only = sieve.value if sieve else None
    counts: list[Counter] = [Counter() for _ in range(FOLDS)]
    memo: dict[str, list[str]] = {}

    def rows():
        terms = list(set().union(*counts))
        return pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), *(pa.array([c[t] for t in terms], pa.int64()) for c in counts)], names=["term", *_N])

    for b in batches:
        for t, fold in zip(b.column("text").to_pylist(), b.column("fold").to_pylist(), strict=True):
            found: set[str] = set()
            for w in set(tokens(t or "")):
                own = memo.get(w)
                if own is None:
                    if len(memo) > 300_000:
                        memo.clear()
                    own = memo[w] = [x for x in _terms_of(w) if only is None or x in only]
                found.update(own)
            counts[fold].update(found)
            if sum(map(len, counts)) > 500_000:
                yield rows()
                for c in counts:
                    c.clear()
    yield rows()


_N = [f"n{k}" for k in range(FOLDS)]
_COUNTS = "term string, " + ", ".join(f"{c} long" for c in _N)
Terms = list[tuple[str, bool, float]]


def learn_terms(toxic: DataFrame, clean: DataFrame, n_toxic: list[int], n_clean: list[int]) -> list[Terms]:
    """(term, is a stem, lower bound of the log odds) learned from two tables of texts (text, fold): for each fold from all others,
    and last from all. All terms whose bound is high enough, however small their share. Counts are joined in DataFrames; only terms
    that pass come to the driver. ``n_toxic`` and ``n_clean``: number of texts of each fold."""
    spark = toxic.sparkSession
    sums = [F.sum(c).alias(c) for c in _N]

    def odds(without: int, with_clean: bool):
        k = [i for i in range(FOLDS) if i != without]
        n = sum(F.col(f"n{i}") for i in k)
        few = sum(F.coalesce(f"c{i}", F.lit(0)) for i in k) if with_clean else F.lit(0)
        a, b = n + 0.5, few + 0.5
        bound = F.log(a / (sum(n_toxic[i] for i in k) + 1)) - F.log(b / (sum(n_clean[i] for i in k) + 1)) - SURE * F.sqrt(1 / a + 1 / b)
        return F.when((n >= MIN_DOCS) & (bound >= MIN_LOG_ODDS), bound)

    many = toxic.mapInArrow(lambda it: _count(it, None), _COUNTS).groupBy("term").agg(*sums).where(sum(F.col(c) for c in _N) >= MIN_DOCS)
    # terms that would not pass without any clean text need no clean count
    many = common.stored(spark, many.where(F.coalesce(*(odds(k, False) for k in range(FOLDS + 1))).isNotNull()), "toxic-terms")
    sieve = spark.sparkContext.broadcast(_sieve(many))
    few = clean.mapInArrow(lambda it: _count(it, sieve), _COUNTS).groupBy("term").agg(*sums).toDF("term", *(f"c{k}" for k in range(FOLDS)))
    rows = many.join(few, "term", "left").select("term", F.array(*(odds(k, True) for k in range(FOLDS + 1))).alias("odds")).where("exists(odds, x -> x is not null)").collect()
    return [_own({r["term"]: r["odds"][k] for r in rows if r["odds"][k] is not None}) for k in range(FOLDS + 1)]


def _own(strong: dict[str, float]) -> Terms:
    """Without longer stems, which say no more than a shorter one; whole words stay beside their stems, as the automaton runs over them."""
    own = [t for t in strong if (len(t) >= FUZZY and not t.endswith("*")) or not any(t[:k] + "*" in strong for k in STEMS if len(t.removesuffix("*")) > k)]
    return [(t.removesuffix("*"), t.endswith("*"), strong[t]) for t in sorted(own, key=lambda t: (-strong[t], t))]


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> np.ndarray:
    """Logistic regression by Newton steps; the last weight is the constant. The ridge draws the weights of misspelled hits
    to those of plain ones and the others to zero, so misspellings that the labels don't show count like their terms."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    drawn = np.eye(len(w))
    for k, like in LIKE:
        drawn[k, like] = -1
    drawn = ridge * drawn.T @ drawn
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (y - p) - drawn @ w
        h = (x * (p * (1 - p))[:, None]).T @ x + drawn + 1e-6 * np.eye(len(w))
        d = np.linalg.solve(h, g)
        w += d
        if np.abs(d).max() < 1e-8:
            break
    return w


_lexicons: dict[int, Lexicon] = {}


def _lexicon(terms: Terms, remember: int = SEEN // (2 * FOLDS)) -> Lexicon:
    """Kept by a worker for its next tasks."""
    key = hash(tuple(terms))
    if key not in _lexicons:
        while len(_lexicons) > FOLDS:
            _lexicons.pop(next(iter(_lexicons)))
        _lexicons[key] = Lexicon(terms, remember)
    return _lexicons[key]


def _features(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    """y and the features of each text, by the terms of the folds that it is not in."""
    other = [_lexicon(t) for t in model.value[:FOLDS]]
    for b in batches:
        got = [list(features(t or "", other[fold])) for t, fold in zip(b.column("text").to_pylist(), b.column("fold").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column("y"), pa.array(got, pa.list_(pa.float64()))], names=["y", "x"])


def _score(batches: Iterator[pa.RecordBatch], model, weights: np.ndarray, threshold: float) -> Iterator[pa.RecordBatch]:
    for key in [k for k in _lexicons if k != hash(tuple(model.value[FOLDS]))]:  # those of the folds are done with
        del _lexicons[key]
    lexicon = _lexicon(model.value[FOLDS], SEEN)
    for b in batches:
        x = np.array([features(t or "", lexicon) for t in b.column("text").to_pylist()]).reshape(-1, 7)
        p = 1 / (1 + np.exp(-np.clip(x @ weights[:-1] + weights[-1], -30, 30)))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])


def held_out(folds: int, fold: int):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == fold, F.lit(False))


def score(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document of ``docs`` (doc_id, text): doc_id, held_out, score, predicted, learned from the ``toxic`` column
    of ``labels`` (doc_id, toxic) on the documents with crc32(doc_id as text) mod 4 other than 2.

    A document with several labels counts as toxic if one says so; null labels and null ids teach
    nothing. Null and empty texts get the score of a text without hits. Without a toxic and a clean
    training label all scores are the training share of toxic labels (0 without any). Repeated
    rows are scored each; an empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    # bucketed by document: labels come to the texts, which are never shuffled
    own = common.bucketed(spark, common.id_text(docs).withColumn("held_out", held_out(4, 2)).withColumn("h", F.xxhash64("text")), "doc_id", "texts")
    y = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("toxic is not null and doc_id is not null")
    y = y.groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic"))
    # copies are no further evidence for a term: of equal texts the first document teaches
    seen = own.where("not held_out").select("doc_id", "h").join(y, "doc_id").groupBy("h").agg(F.min_by(F.struct("doc_id", "toxic"), "doc_id").alias("d")).select("d.doc_id", "d.toxic")
    seen = common.stored(spark, seen.withColumn("fold", F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(FOLDS)).cast("int")), "teachers")
    train = own.select("doc_id", "text").join(seen.hint("shuffle_hash"), "doc_id").select("doc_id", "text", "toxic", "fold")
    n = {(bool(r[0]), r[1]): r[2] for r in seen.groupBy("toxic", "fold").count().collect()}
    n_clean, n_toxic = ([n.get((y, k), 0) for k in range(FOLDS)] for y in (False, True))
    total = sum(n.values())
    if not sum(n_clean) or not sum(n_toxic):
        share = sum(n_toxic) / total if total else 0.0
        return own.select("doc_id", "held_out", F.lit(share).alias("score"), F.lit(int(share >= threshold)).cast("int").alias("predicted"))
    model = spark.sparkContext.broadcast(learn_terms(train.where("toxic").select("text", "fold"), train.where("not toxic").select("text", "fold"), n_toxic, n_clean))
    sample = train.withColumn("r", F.xxhash64("doc_id")).where(F.abs(F.col("r") % 1_000_000) < max(1, int(1_000_000 * min(1, FIT_ROWS / total))))
    rows = sample.select("text", "fold", F.col("toxic").cast("int").alias("y")).mapInArrow(lambda it: _features(it, model), "y int, x array<double>").collect()
    if not rows:
        rows = [(0, [0.0] * 7), (1, [0.0] * 7)]
    weights = fit(np.array([r[1] for r in rows]), np.array([r[0] for r in rows], float))
    return own.select("doc_id", "held_out", "text").mapInArrow(lambda it: _score(it, model, weights, threshold), "doc_id long, held_out boolean, score double, predicted int")
