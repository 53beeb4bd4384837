"""Operator 13: ranked lexical search over a two-level quantised index.

The index is cut by documents: each row holds the terms of some megabytes of text, their postings (document, occurrences, and the
impact of both in a byte), and for each term the largest byte among them. An impact

    f = (10^9 * tf) div (1000 * tf + 8 * m)      below 10^6, m from the document's length and the corpus's mean

is rounded up to a multiple of STEP, so ``byte * STEP`` is never below f, and ``(byte - 1) * STEP + 1`` never above it. Weighted by
the terms of an item these give each document an upper and a lower bound of its score without touching an exact number. Tasks
report the k highest lower bounds that they have seen; the kth of all of them is a score that k documents reach. Then every document
whose upper bound reaches it is scored in exact integers, and the best k remain. The first level, a row's largest bytes, rules out a
row of the index for an item before its postings are read.

No posting is shuffled: the corpus's number of documents and of terms are known before the index is written, the frequency of an
item's terms is the sum of what the rows of the index hold, and only bounds and winners (k a task and item) move. Items go out
in blocks of a bounded size of text.
"""

from __future__ import annotations

import heapq
import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptorium.llm import common

BEST = 10
SCALE = 1_000_000_000
#: 255 steps cover all impacts
STEP = 3922
ROW_BYTES = 2 << 20
BLOCK_BYTES = 4 << 20
PART = 1 << 20
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_INSIDE = np.array([c != 32 for c in _TABLE])


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a UTF-8 text in order, some megabyte at a time."""
    low = text.translate(_TABLE)
    at = 0
    while at < len(low):
        to = low.find(b" ", at + PART)
        to = len(low) if to < 0 else to
        yield low[at:to].split()
        at = to


def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with a term, and terms, of each batch."""
    for b in batches:
        n = []
        for t in b.column("text").cast(pa.binary()).to_pylist():
            own = _INSIDE[np.frombuffer(t or b"", np.uint8)]
            n.append(int(np.count_nonzero(own[1:] & ~own[:-1])) + bool(len(own) and own[0]))
        yield pa.RecordBatch.from_arrays([pa.array([sum(map(bool, n))], pa.int64()), pa.array([sum(n)], pa.int64())], names=["n_docs", "n_terms"])


def measures(n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """m of documents of ``n`` terms: 10 + (90 * n * n_docs) div n_terms."""
    if 90 * int(n.max(initial=0)) * n_docs < 1 << 63:
        return 10 + (90 * n * n_docs) // n_terms
    return np.array([10 + (90 * int(x) * n_docs) // n_terms for x in n], np.int64)


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (SCALE * tf) // (1000 * tf + 8 * m)


_SCHEMA = "ids array<long>, n binary, terms binary, begins binary, most binary, doc binary, byte binary, tf binary"


def _index(batches: Iterator[pa.RecordBatch], n_docs: int, n_terms: int, row_bytes: int) -> Iterator[pa.RecordBatch]:
    ids: list = []
    lengths: list[int] = []
    found: list[tuple[np.ndarray, np.ndarray, int]] = []
    vocabulary: defaultdict = defaultdict()
    vocabulary.default_factory = vocabulary.__len__
    size = 0

    def row() -> pa.RecordBatch:
        order = sorted(vocabulary)
        place = np.empty(len(order), np.int64)
        place[[vocabulary[t] for t in order]] = np.arange(len(order))
        term = place[np.concatenate([t for t, _, _ in found])]
        tf = np.concatenate([c for _, c, _ in found])
        doc = np.repeat([d for _, _, d in found], [len(t) for t, _, _ in found])
        by = np.argsort(term, kind="stable")
        term, tf, doc = term[by], tf[by], doc[by]
        n = np.array(lengths, np.int64)
        byte = -(-impacts(tf, measures(n, n_docs, n_terms)[doc]) // STEP)
        begins = np.searchsorted(term, np.arange(len(order) + 1))
        most = np.maximum.reduceat(byte, begins[:-1])
        blobs = (n, b" ".join(order), begins.astype("<i8"), most.astype(np.uint8), doc.astype("<i4"), byte.astype(np.uint8), tf.astype("<i4"))
        return pa.RecordBatch.from_arrays(
            [pa.array([ids], pa.list_(pa.int64())), *(pa.array([x if isinstance(x, bytes) else x.tobytes()], pa.binary()) for x in blobs)], names=["ids", "n", "terms", "begins", "most", "doc", "byte", "tf"]
        )

    for b in batches:
        for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").cast(pa.binary()).to_pylist(), strict=True):
            parts = [np.fromiter(map(vocabulary.__getitem__, words), np.int64, len(words)) for words in terms(t or b"")]
            own = np.concatenate(parts) if parts else np.zeros(0, np.int64)
            if not len(own):
                continue
            kinds, counts = np.unique(own, return_counts=True)
            found.append((kinds, counts, len(ids)))
            ids.append(i)
            lengths.append(len(own))
            size += len(t)
            if size >= row_bytes:
                yield row()
                ids, lengths, found, size = [], [], [], 0
                vocabulary.clear()
    if ids:
        yield row()


class Row:
    """One row of the index, for the items of a block."""

    def __init__(self, batch: pa.RecordBatch, at: int):
        self.batch, self.at = batch, at
        order = self.blob("terms").split(b" ")
        self.place = dict(zip(order, range(len(order)), strict=True))
        self.begins = np.frombuffer(self.blob("begins"), "<i8")

    def blob(self, name: str) -> bytes:
        return self.batch.column(name)[self.at].as_py()

    def postings(self) -> None:
        self.most = np.frombuffer(self.blob("most"), np.uint8).astype(np.int64)
        self.doc, self.byte = np.frombuffer(self.blob("doc"), "<i4"), np.frombuffer(self.blob("byte"), np.uint8)
        self.size = len(self.blob("n")) // 8

    def of(self, vocabulary: list[bytes]) -> np.ndarray:
        """Place of each term among those of the row, -1 where it has none."""
        return np.fromiter((self.place.get(t, -1) for t in vocabulary), np.int64, len(vocabulary))

    def upper(self, places: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Upper bounds of all documents, and lower ones."""
        top, least = np.zeros(self.size, np.int64), np.zeros(self.size, np.int64)
        for p, w in zip(places.tolist(), weights.tolist(), strict=True):
            a, z = self.begins[p], self.begins[p + 1]
            doc, byte = self.doc[a:z], self.byte[a:z]
            top[doc] += w * STEP * byte.astype(np.int64)
            least[doc] += np.where(byte > 0, w, 0)
        return top, top - (STEP - 1) * least

    def exact(self, places: np.ndarray, weights: np.ndarray, wanted: np.ndarray, m: np.ndarray, tf: np.ndarray) -> np.ndarray:
        score = np.zeros(self.size, np.int64)
        for p, w in zip(places.tolist(), weights.tolist(), strict=True):
            a, z = self.begins[p], self.begins[p + 1]
            doc = self.doc[a:z]
            near = wanted[doc]
            doc = doc[near]
            score[doc] += w * impacts(tf[a:z][near].astype(np.int64), m[doc])
        return score


class Block:
    """Items of a block: their terms as numbers in a common vocabulary; weights follow once frequencies are known."""

    def __init__(self, items: list[tuple]):
        number: defaultdict = defaultdict()
        number.default_factory = number.__len__
        self.items = [item for item, _ in items]
        self.terms = [np.array(list(dict.fromkeys(number[w] for words in terms(text) for w in words)), np.int64) for _, text in items]
        self.vocabulary = list(number)
        self.weights = np.zeros(len(number), np.int64)

    def weigh(self, frequency: dict[int, int], n_docs: int) -> None:
        self.weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * frequency[k] + 1))) if k in frequency else 0 for k in range(len(self.vocabulary))], np.int64)

    def near(self, row: Row) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
        """(item, places, weights, upper bound of the whole row) of the items that share a weighty term with a row."""
        places = row.of(self.vocabulary)
        for i, own in enumerate(self.terms):
            p, w = places[own], self.weights[own]
            there = (p >= 0) & (w > 0)
            if there.any():
                p, w = p[there], w[there]
                yield i, p, w, int((w * row.most[p]).sum()) * STEP


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[Row]:
    for b in batches:
        for at in range(b.num_rows):
            yield Row(b, at)


def _frequency(batches: Iterator[pa.RecordBatch], vocabulary) -> Iterator[pa.RecordBatch]:
    total = np.zeros(len(vocabulary.value), np.int64)
    for row in _rows(batches):
        p = row.of(vocabulary.value)
        total += np.where(p >= 0, row.begins[p + 1] - row.begins[p], 0)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["term", "n"])


def _bounds(batches: Iterator[pa.RecordBatch], block, k: int) -> Iterator[pa.RecordBatch]:
    """The k highest lower bounds of each item over a task's rows."""
    own: Block = block.value
    best = [np.zeros(0, np.int64) for _ in own.items]
    for row in _rows(batches):
        row.postings()
        for i, p, w, most in own.near(row):
            if len(best[i]) < k or most > best[i][0]:
                low = row.upper(p, w)[1]
                low = np.concatenate((best[i], low[low > 0]))
                best[i] = np.sort(np.partition(low, len(low) - k)[-k:] if len(low) > k else low)
    item = np.repeat(np.arange(len(best)), [len(x) for x in best])
    if len(item):
        yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(np.concatenate(best))], names=["item", "low"])


def _winners(batches: Iterator[pa.RecordBatch], block, floors, k: int, n_docs: int, n_terms: int) -> Iterator[pa.RecordBatch]:
    """The k best documents of each item over a task's rows, in exact scores, among all whose upper bound reaches the item's floor."""
    own: Block = block.value
    best: list[list[tuple]] = [[] for _ in own.items]
    for row in _rows(batches):
        row.postings()
        exact = None
        for i, p, w, most in own.near(row):
            floor = floors[i]
            if most < floor:
                continue
            wanted = row.upper(p, w)[0] >= max(floor, 1)
            if not wanted.any():
                continue
            if exact is None:
                ids = row.batch.column("ids")[row.at].as_py()
                no_id = np.array([d is None for d in ids])
                exact = ids, no_id, np.array([d or 0 for d in ids], np.int64), measures(np.frombuffer(row.blob("n"), np.int64), n_docs, n_terms), np.frombuffer(row.blob("tf"), "<i4")
            ids, no_id, number, m, tf = exact
            score = row.exact(p, w, wanted, m, tf)
            at = np.flatnonzero(wanted & (score > 0))
            at = at[np.lexsort((number[at], no_id[at], -score[at]))[:k]]
            best[i] = heapq.nsmallest(k, [*best[i], *((-int(score[d]), bool(no_id[d]), int(number[d])) for d in at)])
    rows = [(own.items[i], None if no_id else d, -s) for i, found in enumerate(best) for s, no_id, d in found]
    if rows:
        kinds = (pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["row", "doc_id", "score"])


class Index:
    """An index in a folder that driver and executors share: its rows, and the counts that its bytes rest on."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.rows = spark.read.schema(_SCHEMA).parquet(f"{path}/rows")
        counts = spark.read.parquet(f"{path}/counts").first()
        self.n_docs, self.n_terms = counts.n_docs, counts.n_terms

    @classmethod
    def write(cls, docs: DataFrame, path: str, row_bytes: int = ROW_BYTES) -> Index:
        """Of ``docs`` (doc_id, text); documents without a term are not in it."""
        spark = docs.sparkSession
        own = common.id_text(docs)
        counts = own.select("text").mapInArrow(_lengths, "n_docs long, n_terms long").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_docs", "n_terms")))
        n_docs, n_terms = counts.first()
        rows = own.mapInArrow(lambda it: _index(it, n_docs, n_terms, row_bytes), _SCHEMA)
        rows.write.option("compression", "zstd").parquet(f"{path}/rows")
        spark.createDataFrame([(n_docs, n_terms)], "n_docs long, n_terms long").write.parquet(f"{path}/counts")
        return cls(spark, path)

    def _block(self, items: list[tuple], k: int) -> DataFrame:
        sc = self.spark.sparkContext
        block = Block(items)
        vocabulary = sc.broadcast(block.vocabulary)
        found = self.rows.select("terms", "begins").mapInArrow(lambda it: _frequency(it, vocabulary), "term long, n long")
        block.weigh({r.term: r.n for r in found.groupBy("term").agg(F.sum("n").alias("n")).collect()}, self.n_docs)  # the block's terms
        vocabulary.unpersist()
        sent = sc.broadcast(block)
        low = self.rows.select("n", "terms", "begins", "most", "doc", "byte").mapInArrow(lambda it: _bounds(it, sent, k), "item long, low long")
        place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("low")))
        kth = {r.item: r.low for r in low.withColumn("place", place).where(F.col("place") <= k).where(F.col("place") == k).collect()}  # a row for an item
        floors = [kth.get(i, 0) for i in range(len(block.items))]
        n_docs, n_terms = self.n_docs, self.n_terms
        winners = self.rows.mapInArrow(lambda it: _winners(it, sent, floors, k, n_docs, n_terms), "row long, doc_id long, score long")
        out = common.stored(self.spark, winners, "winners")
        sent.unpersist()
        return out

    def search(self, items: DataFrame, k: int = BEST, block_bytes: int = BLOCK_BYTES) -> DataFrame:
        """The ``k`` best documents for each row of ``items`` (item_id, text): item_id, rank, doc_id, score."""
        spark = self.spark
        own = items.select(F.monotonically_increasing_id().alias("row"), F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
        own = common.stored(spark, own.where(F.col("text").isNotNull()), "items")
        total = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        blocks = max(1, math.ceil(total / block_bytes))
        every = None
        for b in range(blocks):
            block = [(r.row, r.text.encode()) for r in own.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == b).select("row", "text").toLocalIterator()]
            if block or every is None:
                found = self._block(block, k)
                every = found if every is None else every.union(found)
        rank = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
        best = every.withColumn("rank", rank).where(F.col("rank") <= k)
        return best.join(own.select("row", "item_id"), "row").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = BEST) -> DataFrame:
    """The ``k`` documents of ``docs`` (doc_id, text) with the highest scores above 0 for each row of ``items`` (item_id, text): item_id,
    rank (from 1), doc_id, score; all of them where there are fewer.

    Equal scores go by ascending doc_id, a null doc_id last. Null and blank texts have no terms: such documents are not counted, such items
    give no rows. Repeated documents count and rank each, repeated items give rows each. Empty tables give no rows. Other
    columns are ignored.
    """
    return Index.write(docs, common.scratch(docs.sparkSession, "index")).search(items, k)


_TERMS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
SQL = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS t FROM documents),
n AS MATERIALIZED (SELECT r, doc_id, len(t) AS n FROM d WHERE len(t) > 0),
g AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM n),
tf AS MATERIALIZED (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM d) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, g GROUP BY term, n_docs),
b AS MATERIALIZED (SELECT row_number() OVER () AS q, item_id, {_TERMS} AS t FROM benchmark),
i AS (SELECT DISTINCT q, item_id, unnest(t) AS term FROM b),
s AS (SELECT q, item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM i JOIN w USING (term) JOIN tf USING (term) JOIN n USING (r), g GROUP BY ALL)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0) WHERE rank <= {BEST}"""
