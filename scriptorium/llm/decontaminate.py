"""Operator 5: benchmark decontamination by MinHash containment search, partitioned by the size of the test item.

A test item with n distinct shingles is contained when c = ceil(0.8 n) or more of them occur in a document. Items fall into
size classes by n (powers of two). Each class has a signature length of its own: the n - c + m smallest shingle hashes of an
item (a bottom-k MinHash sketch) and m, the hits that a candidate needs, more for larger items. A document that contains
the item lacks n - c of its shingles at most, so m at least of the sketch occur in it: no item is missed, wherever it hides in
however long a text. Documents have no signatures of their own, as one of fixed length can't show twenty words in twenty thousand;
all their shingle hashes are probed. Each candidate pair is verified on the shingles themselves.

The sketches are broadcast in blocks of items, each of a bounded size of text; documents are searched once per block.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm import common, words

WIDTH = 5
THRESHOLD = 0.8
BLOCK_BYTES = 32 << 20
_TABLE = 20  # bits of the first test


def item_shingles(text: bytes, width: int = WIDTH) -> tuple[int, set[bytes]]:
    """(words per shingle, shingles): an item of fewer words is one shingle of its own width."""
    w = words.split(text)
    width = min(width, len(w))
    return width, {b" ".join(w[i : i + width]) for i in range(len(w) - width + 1)} if width else set()


def size_class(n: int) -> int:
    """Of items with n shingles: 0 for one, 1 up to 3, 2 up to 7, ..."""
    return n.bit_length() - 1


def hits_needed(n: int, need: int) -> int:
    """Of the sketch: one for small items, an eighth of what must occur for larger ones, alike in a size class."""
    return max(1, min(need, (1 << size_class(n)) // 8))


class Sketches:
    """Of one block of items [(item_id, text)]: an index for each (words per shingle, size class)."""

    def __init__(self, items: list[tuple], width: int = WIDTH, threshold: float = THRESHOLD):
        self.items, self.need, self.hits = [], [], []
        keys: dict[tuple[int, int], list] = defaultdict(list)
        for item, text in items:
            w, found = item_shingles(text, width)
            if found:
                n, need = len(found), math.ceil(threshold * len(found) - 1e-9)
                hits = hits_needed(n, need)
                h = np.unique(words.shingles(*words.hashes([text]), w)[0])
                keys[w, size_class(n)].append((h[: n - need + hits], len(self.items)))
                self.items.append((item, w, text))
                self.need.append(need)
                self.hits.append(hits)
        self.hits = np.array(self.hits, np.int64)
        self.index = {}
        for k, pairs in keys.items():
            h = np.concatenate([x for x, _ in pairs])
            owner = np.repeat([i for _, i in pairs], [len(x) for x, _ in pairs])
            order = np.argsort(h, kind="stable")
            first = np.zeros(1 << _TABLE, bool)
            first[(h & np.uint64((1 << _TABLE) - 1)).astype(np.int64)] = True
            self.index[k] = h[order], owner[order], first

    def candidates(self, texts: list[bytes]) -> list[tuple[int, int]]:
        """(text number, item number) of the pairs with as many hits as the item's class needs."""
        h, owner = words.hashes(texts)
        out: list[tuple[int, int]] = []
        of_width = {w: words.shingles(h, owner, w) for w in {w for w, _ in self.index}}
        for (w, _), (keys, item, first) in self.index.items():
            s, o = of_width[w]
            near = first[(s & np.uint64((1 << _TABLE) - 1)).astype(np.int64)]
            s, o = s[near], o[near]
            a = np.searchsorted(keys, s, "left")
            n = np.searchsorted(keys, s, "right") - a
            at = np.repeat(a - np.cumsum(n) + n, n) + np.arange(n.sum())
            # a shingle that a text repeats is one hit
            once = np.unique(np.stack((np.repeat(o, n), item[at], keys[at].view(np.int64)), 1), axis=0)
            pairs, hits = np.unique(once[:, :2], axis=0, return_counts=True)
            out.extend(map(tuple, pairs[hits >= self.hits[pairs[:, 1]]].tolist()))
        return out

    def search(self, texts: list[bytes]) -> Iterator[tuple]:
        """(text number, item_id, shingles of the item, shared)"""
        by_text = defaultdict(list)
        for t, i in self.candidates(texts):
            by_text[t].append(i)
        for t, found in sorted(by_text.items()):
            own: dict[int, set[bytes]] = {}
            w = words.split(texts[t])
            for i in sorted(found):
                item, width, text = self.items[i]
                if width not in own:
                    own[width] = {b" ".join(w[k : k + width]) for k in range(len(w) - width + 1)}
                shingles = item_shingles(text, width)[1]
                shared = len(shingles & own[width])
                if shared >= self.need[i]:
                    yield t, item, len(shingles), shared


_SCHEMA = "doc_id long, item_id long, n_shingles long, n_shared long, containment double"


def _slices(texts: list[bytes], size: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Stretches of a few MB, a text at least."""
    at = 0
    while at < len(texts):
        to, total = at + 1, len(texts[at])
        while to < len(texts) and total + len(texts[to]) < size:
            total += len(texts[to])
            to += 1
        yield at, to
        at = to


def _search(batches: Iterator[pa.RecordBatch], sketches) -> Iterator[pa.RecordBatch]:
    own = sketches.value
    for b in batches:
        ids, texts = b.column(0).to_pylist(), [t or b"" for t in b.column(1).cast(pa.binary()).to_pylist()]
        for at, to in _slices(texts):
            rows = [(ids[at + t], item, n, shared, shared / n) for t, item, n, shared in own.search(texts[at:to])]
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "item_id", "n_shingles", "n_shared", "containment"])


def _blocks(benchmark: DataFrame, width: int, threshold: float, block_bytes: int) -> Iterator:
    """Broadcast sketches of the items, in blocks of about ``block_bytes`` of text."""
    spark = benchmark.sparkSession
    items = benchmark.selectExpr("cast(item_id as long) item_id", "cast(text as string) text").where("text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(total / block_bytes))
    for k in range(blocks):
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        yield spark.sparkContext.broadcast(Sketches([(r[0], r[1].encode()) for r in block.toLocalIterator()], width, threshold))


def contained(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document of ``docs`` (doc_id, text) and item of ``benchmark`` (item_id, text) that it contains: doc_id,
    item_id, n_shingles (distinct, of the item), n_shared, containment.

    Words are lower-cased and split at ASCII white space. An item of fewer than ``width`` words is
    one shingle of all its words; null and blank items and texts match nothing; repeated rows
    match each; empty tables give no rows; other columns are ignored.
    """
    out = None
    for sketches in _blocks(benchmark, width, threshold, block_bytes):
        found = common.id_text(docs).mapInArrow(lambda it, s=sketches: _search(it, s), _SCHEMA)
        out = found if out is None else out.union(found)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs``, with all their columns (of any name), whose own text contains no item.

    Null and blank texts contain nothing and stay; repeated rows stay or go each; an empty ``benchmark`` keeps all rows, an
    empty ``docs`` gives none.
    """
    # the user's other columns travel as one, so their names mean nothing here
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("row"), F.col("text").cast("string").alias("text"))
    for sketches in _blocks(benchmark, width, threshold, block_bytes):

        def free(batches: Iterator[pa.RecordBatch], s=sketches) -> Iterator[pa.RecordBatch]:
            for b in batches:
                texts = [t or b"" for t in b.column("text").cast(pa.binary()).to_pylist()]
                bad = {t for a, z in _slices(texts) for t in (a + x[0] for x in s.value.search(texts[a:z]))}
                yield b.filter(pa.array([k not in bad for k in range(len(texts))], pa.bool_()))

        own = own.mapInArrow(free, own.schema)
    return own.select(*(F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns))


SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
b AS (
  SELECT item_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM benchmark),
i AS (
  SELECT DISTINCT item_id, least(5, len(w)) AS width, unnest(list_transform(range(1, len(w) - least(5, len(w)) + 2), lambda k: array_to_string(w[k:k + least(5, len(w)) - 1], ' '))) AS s FROM b WHERE len(w) > 0),
n AS (SELECT item_id, count(*) AS n FROM i GROUP BY item_id),
s AS (
  SELECT DISTINCT doc_id, width, unnest(list_transform(range(1, len(w) - width + 2), lambda k: array_to_string(w[k:k + width - 1], ' '))) AS s
  FROM d, (SELECT DISTINCT width FROM i) WHERE len(w) >= width),
m AS (SELECT doc_id, item_id, count(*) AS shared FROM s JOIN i USING (width, s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n AS n_shingles, shared AS n_shared, CAST(shared AS DOUBLE) / n AS containment
FROM m JOIN n USING (item_id) WHERE shared >= ceil(0.8 * n - 1e-9)"""
