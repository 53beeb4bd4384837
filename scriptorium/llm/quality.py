"""Operator 3: weak supervision of document quality.

Rules vote good (1), bad (-1) or abstain (0). Documents with equal votes are one pattern; the
number of patterns is bounded by 3 to the number of rules, whatever the corpus holds, so the
expectation-maximisation that estimates each rule's accuracy from the agreement of the rules
runs over the pattern counts of all documents. The posterior probability of quality replaces
"all rules must pass".
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptorium.llm import common

MIN_WORDS = 50
PRIOR_DOCUMENTS = 2000.0
MAX_REPEAT_PERCENT = 50
SYMBOLS = b"#*$%&|<>"
RULES = ("symbols", "repeats", "lines", "word_length", "sentences", "capitals", "variety", "marks")


def word_ids(words: list[bytes]) -> np.ndarray:
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))


def repeated_words(ids: np.ndarray) -> int:
    """Words in windows of three words that occur twice or more."""
    n = len(ids)
    if n < 4:
        return 0
    k = int(ids.max()) + 1
    if k < 2_000_000:
        key = (ids[:-2] * k + ids[1:-1]) * k + ids[2:]
    else:
        pair = np.unique(ids[:-1] * k + ids[1:], return_inverse=True)[1]
        key = pair[:-1] * k + ids[2:]
    order = np.argsort(key, kind="stable")
    s = key[order]
    same = s[1:] == s[:-1]
    hit = np.zeros(n - 2, bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    word = np.zeros(n, bool)
    for d in range(3):
        word[d : n - 2 + d] |= hit
    return int(np.count_nonzero(word))


def measure(text: bytes) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the votes as a base-3 number."""
    words = text.split()
    n = len(words)
    spaces = sum(text.count(c) for c in (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r"))
    raw = np.frombuffer(text, np.uint8)
    chars = len(raw) - int(np.count_nonzero((raw & 0xC0) == 0x80)) - spaces
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = [x for x in text.split(b"\n") if x.strip()]
    dup = len(lines) - len(set(lines))
    ids = word_ids(words)
    repeats = repeated_words(ids)
    if not n:
        return 0, chars, symbols, dup, 0, 0
    upper = int(np.count_nonzero((raw >= 65) & (raw <= 90)))
    lower = int(np.count_nonzero((raw >= 97) & (raw <= 122)))
    ends = sum(w[-1] in b".!?" for w in words)
    marks = text.count(b"!") + text.count(b"?")
    distinct = int(ids.max()) + 1
    mean = chars / n

    def high(x, bad, good):
        return -1 if x > bad else 1 if x <= good else 0

    votes = (
        high(symbols / n, 0.10, 0.02),
        high(repeats / n, 0.30, 0.10),
        high(dup / max(1, len(lines)), 0.40, 0.10) if len(lines) > 1 else 0,
        -1 if not 2 <= mean <= 15 else 1 if 3 <= mean <= 10 else 0,
        (-1 if ends / n < 0.01 or ends / n > 0.6 else 1 if 0.02 <= ends / n <= 0.4 else 0) if n >= 50 else 0,
        high(upper / max(1, upper + lower), 0.50, 0.20),
        0 if n < 20 else -1 if distinct / n < 0.08 else 1 if distinct / n >= 0.30 else 0,
        high(marks / n, 0.40, 0.15),
    )
    return n, chars, symbols, dup, repeats, sum((v + 1) * 3**k for k, v in enumerate(votes))


_COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "pattern")
_SCHEMA = "doc_id long, " + ", ".join(f"{c} long" for c in _COLUMNS)


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            got = np.array([measure(t or b"") for t in b.column(1).cast(pa.binary()).to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(got[:, k]) for k in range(6))], names=["doc_id", *_COLUMNS])


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200, prior_documents: float = PRIOR_DOCUMENTS) -> tuple[np.ndarray, np.ndarray]:
    """(posterior probability of quality per pattern, accuracy per rule) by expectation-maximisation.

    Each rule has two rates: how often it votes bad on bad documents and on good ones, where it votes;
    an abstention tells nothing. It begins from "one bad vote is enough": kinds of junk are caught by
    different rules, and a start from the majority would take each rule's finds for noise. The rate on good
    documents has a prior of one in 500 worth as many documents as there are, and ``prior_documents`` at most: it keeps the classes' meaning where
    little is known, and a rule that calls many documents bad which all others call good is outvoted. That on bad documents has a prior of a
    half worth one document.
    """
    k = len(RULES)
    if not len(patterns):
        return np.zeros(0), np.zeros(k)
    votes = (patterns[:, None] // 3 ** np.arange(k)) % 3
    bad, cast = votes == 0, votes != 1
    good = np.where(bad.any(1), 0.05, 0.95)
    known = min(counts.sum(), prior_documents) + 1
    for _ in range(rounds):
        rates = []
        for p, r, n in ((1 - good, 0.5, 1.0), (good, 0.002, known)):
            w = (counts * p)[:, None]
            rates.append(((w * bad).sum(0) + n * r) / ((w * cast).sum(0) + n))
        prior = ((counts * good).sum() + 1) / (counts.sum() + 2)
        logs = [np.log(q) + (np.log(t) * bad + np.log1p(-t) * (cast & ~bad)).sum(1) for q, t in zip((1 - prior, prior), rates, strict=True)]
        now = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))
        done, good = np.abs(now - good).max() < 1e-9, now
        if done:
            break
    right = ((counts * good)[:, None] * (cast & ~bad) + (counts * (1 - good))[:, None] * bad).sum(0)
    return good, right / np.maximum((counts[:, None] * cast).sum(0), 1e-9)


def _failed():
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def _estimated(measured: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(patterns, posterior probability of each, accuracy of each rule) from all documents that the base leaves to the rules."""
    counted = measured.groupBy("pattern").agg(F.count_if(~_failed())).collect()  # 3 ** 8 rows at most
    patterns = np.array([r[0] for r in counted], np.int64)
    return patterns, *estimate(patterns, np.array([r[1] for r in counted], float))


def accuracies(docs: DataFrame) -> DataFrame:
    """rule, accuracy: the share of each rule's votes that agree with the posterior, over all documents that the base passes; 0 of a rule
    that never votes, and of an empty table."""
    spark = docs.sparkSession
    right = _estimated(common.stored(spark, common.id_text(docs).mapInArrow(_measured, _SCHEMA), "measures"))[2]
    return spark.createDataFrame([(r, float(a)) for r, a in zip(RULES, right, strict=True)], "rule string, accuracy double")


def _judged(measured: DataFrame) -> DataFrame:
    """base_failed and p_quality beside the columns of ``measured`` (a stored table)."""
    spark = measured.sparkSession
    patterns, p, _ = _estimated(measured)
    posterior = spark.createDataFrame([(int(a), float(b)) for a, b in zip(patterns, p, strict=True)], "pattern long, p_quality double")
    return measured.join(F.broadcast(posterior), "pattern").withColumn("base_failed", _failed())


def judge(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row per document of ``docs`` (doc_id, text): doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept, p_quality.

    Null and blank texts have zero words and fail the base; repeated rows are rows of their
    own; an empty table gives no rows; other columns are ignored.
    """
    m = common.stored(docs.sparkSession, common.id_text(docs).mapInArrow(_measured, _SCHEMA), "measures")
    out = _judged(m)
    return out.select("doc_id", *_COLUMNS[:5], "base_failed", (~F.col("base_failed") & (F.col("p_quality") >= threshold)).alias("kept"), "p_quality")


def keep(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, with all their columns, that :func:`judge` keeps; each row is judged by its own text.

    Null and blank texts fail the base and go; repeated rows stay or go each; an empty table gives no rows; columns of
    any name are carried along.
    """
    rows = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                got = np.array([measure(t or b"") for t in b.column("text").cast(pa.binary()).to_pylist()], np.int64)
                yield pa.RecordBatch.from_arrays([b.column("row"), *(pa.array(got[:, k]) for k in range(6))], names=["row", *_COLUMNS])

    own = docs.select(rows, F.col("text").cast("string").alias("text"))
    schema = T.StructType([own.schema["row"], *(T.StructField(c, T.LongType()) for c in _COLUMNS)])
    m = common.stored(docs.sparkSession, own.mapInArrow(measured, schema), "measures")
    return _judged(m).where(~F.col("base_failed") & (F.col("p_quality") >= threshold)).select("row.*")
