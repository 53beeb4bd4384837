"""Operator 2: best-fit packing of token sequences by large-item matching.

There are at most ``capacity`` different lengths, so the plan for the whole corpus is made over
the number of pieces of each length, which the cluster counts: its size is bounded by the
lengths and not by the corpus. Pieces above a third of the capacity fit at most twice in a bin:
the largest is matched with the largest that still fits. Smaller pieces, longest first, go
to the tightest gap that is left. The plan is a list of runs ("the next n pieces of length l go
to bins b, b+1, ... at offset o"), and a piece finds its place from its rank among the pieces of its
length. Ranks come from salted groups, so a length that a third of all pieces share is dealt
out like any other.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.llm import common

CAPACITY = 2048
END = 0
CACHE = 1_000_000  # words that a worker keeps, some 200 bytes each
SALT_ROWS = 50_000
MARKS = re.compile(rb"(?<=[a-z])([.,:;!?]+)(?=[ \t-\r]|\Z)")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


# How a vocabulary splits texts that may be encoded word by word (normalizers, and the pattern whose matches are kept).
BY_WORD = (["NFC", "Replace", "Lowercase"], "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+")


def splits_at_spaces(path: str) -> bool:
    """Whether a tokenizer file lower-cases, and drops white space between the pieces of BY_WORD: then no token spans two words."""
    spec = json.loads(Path(path).read_text("utf-8"))
    normal, parts = spec.get("normalizer") or {}, (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    kinds = [n["type"] for n in normal.get("normalizers", [])]
    return kinds == BY_WORD[0] and parts[0].get("pattern") == {"Regex": BY_WORD[1]} and parts[0].get("behavior") == "Removed" and parts[0].get("invert") is True


class WordTokens:
    """Ids of a text: word by word where the vocabulary never joins characters across white space, else as a whole."""

    def __init__(self, path: str, cache: int = CACHE):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.cache, self.known = Tokenizer.from_file(path), cache, {}
        self.by_word = splits_at_spaces(path)

    def learn(self, words: set[bytes]) -> None:
        known = self.known
        fresh = list(words.difference(known))
        if len(known) + len(fresh) > self.cache:
            known.clear()
            fresh = list(words)
        for at in range(0, len(fresh), 20_000):
            part = fresh[at : at + 20_000]
            for w, e in zip(part, self.tokenizer.encode_batch_fast([w.decode() for w in part], add_special_tokens=False), strict=True):
                known[w] = array("I", e.ids).tobytes()

    def ids(self, texts: list[bytes]) -> Iterator[bytes]:
        """Little-endian 32-bit ids of each text."""
        if not self.by_word:
            for t in texts:
                yield np.array(self.tokenizer.encode(t.decode(), add_special_tokens=False).ids, "<u4").tobytes()
            return
        for at in range(0, len(texts), 200):
            # the tokenizer lower-cases too, but finds its special strings before that; a letter and the marks that
            # end its word are always tokens apart, so words are known without their marks
            split = [(t if b"<|" in t else MARKS.sub(rb" \1", t.lower())).split() for t in texts[at : at + 200]]
            self.learn(set().union(*split))
            for words in split:
                yield b"".join(map(self.known.__getitem__, words))


_workers: dict[tuple[str, int], WordTokens] = {}


def _pieces(batches: Iterator[pa.RecordBatch], path: str, capacity: int, cache: int) -> Iterator[pa.RecordBatch]:
    if (path, cache) not in _workers:
        _workers[path, cache] = WordTokens(path, cache)
    tokens = _workers[path, cache]
    end = np.array([END], "<u4").tobytes()
    step = 4 * capacity
    for b in batches:
        rows = []
        for doc, ids in zip(b.column(0).to_pylist(), tokens.ids([t or b"" for t in b.column(1).cast(pa.binary()).to_pylist()]), strict=True):
            ids += end
            for k, at in enumerate(range(0, len(ids), step)):
                part = ids[at : at + step]
                rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
        if rows:
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])


_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, rank, n, bin, each, offset): from that rank, n pieces go to bins bin, bin+1, ..., ``each`` to a bin,
    one after another from ``offset``."""
    left = {k: n for k, n in counts.items() if n}
    rank = dict.fromkeys(left, 0)
    gaps: dict[int, list[list[int]]] = {}
    runs, bins = [], 0

    def put(length, n, at, each, offset):
        runs.append((length, rank[length], n, at, each, offset))
        rank[length] += n
        left[length] -= n

    def leave(gap, at, n):
        if gap:
            gaps.setdefault(gap, []).append([at, n])

    large = sorted(k for k in left if 3 * k > capacity)
    while large:
        a = large[-1]
        i = bisect_right(large, capacity - a) - 1
        if i >= 0 and large[i] == a and left[a] == 1:
            i -= 1
        if i < 0:
            n = left[a]
            put(a, n, bins, 1, 0)
            leave(capacity - a, bins, n)
        else:
            b = large[i]
            n = left[a] // 2 if a == b else min(left[a], left[b])
            put(a, n, bins, 1, 0)
            put(b, n, bins, 1, a)
            leave(capacity - a - b, bins, n)
        bins += n
        large = [k for k in large if left[k]]
    for length in sorted((k for k in left if left[k]), reverse=True):
        tight = sorted(g for g in gaps if g >= length)
        at = 0
        while left[length]:
            if at < len(tight):
                gap = tight[at]
                first, n = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap]
                    at += 1
            else:
                gap, first, n = capacity, bins, -(-left[length] // (capacity // length))
                bins += n
            each = gap // length
            full = min(n, left[length] // each)
            if full:
                put(length, full * each, first, each, capacity - gap)
                leave(gap - each * length, first, full)
            rest = 0
            if full < n and left[length]:
                rest = left[length]
                put(length, rest, first + full, rest, capacity - gap)
                leave(gap - rest * length, first + full, 1)
            done = full + (rest > 0)
            if done < n:
                leave(gap, first + done, n - done)
    return runs


def _place(batches: Iterator[pa.RecordBatch], runs: np.ndarray) -> Iterator[pa.RecordBatch]:
    """``runs`` sorted by (length, rank); the last columns of a batch are rank and length."""
    key = runs[:, 0] * (1 << 45) + runs[:, 1]
    for b in batches:
        length, rank = np.asarray(b.column("length")), np.asarray(b.column("rank"))
        r = runs[np.searchsorted(key, length * (1 << 45) + rank, "right") - 1]
        k = rank - r[:, 1]
        cols = [b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
        yield pa.RecordBatch.from_arrays(
            [*cols, pa.array(r[:, 3] + k // r[:, 4]), pa.array(r[:, 5] + k % r[:, 4] * length)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
        )


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, cache: int = CACHE) -> DataFrame:
    """One row per piece of the documents of ``docs`` (doc_id, text): doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids and id 0; longer ones than ``capacity`` are cut. Null and empty texts are
    one piece of one token; repeated rows are packed each; an empty table gives no rows; other
    columns are ignored. ``tokenizer`` is a path that every worker can open; a worker keeps the ids of ``cache`` words.
    """
    spark = docs.sparkSession
    path = tokenizer or default_tokenizer()
    pieces = common.stored(spark, common.id_text(docs).mapInArrow(lambda it: _pieces(it, path, capacity, cache), _SCHEMA), "pieces")
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # ``capacity`` rows at most
    runs = np.array(sorted(plan(counts, capacity)) or np.zeros((0, 6)), np.int64)
    salts = common.buckets_for(spark, sum(counts.values()), SALT_ROWS)
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    sizes = salted.groupBy("length", "salt").count()
    before = F.coalesce(F.sum("count").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("length", "salt", before.alias("before"))
    within = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32"))
    ranked = salted.withColumn("within", within).join(sizes, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("within") - 1)
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(lambda it: _place(it, runs), _SCHEMA + ", sequence_id long, offset long")
