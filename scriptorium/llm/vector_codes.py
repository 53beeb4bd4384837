"""Operator 12: vector codes by integer codebooks, with segment-mean lower bounds before exact distances.

A vector is cut into PARTS parts, each coded by the nearest of ENTRIES entries. For a block of m components with sums s (of the part) and t
(of the entry), and residuals about the block's mean with squared norms a / m and b / m, the squared distance d over the block has

    m * d >= (s - t)^2 + (sqrt(a) - sqrt(b))^2        a = m * sum(x^2) - s^2

All of it is in integers, and the square roots are rounded so that the bound only falls. Blocks are a whole part first, then
halves, quarters and so on, whose bounds add up. At each level an entry whose bound is above the least exact distance found so far goes; the
survivors of the last level receive exact integer distances, so ties and their lower index are those of a full search.

The codebook (PARTS x ENTRIES entries, whatever the table holds) goes out with the tasks; back come its sums and counts, one row for an
entry and task, added in the cluster.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm import common

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
#: components within this bound have distances within 64 bits, larger ones are handled as Python's integers
SMALL = 1 << 26
STRIDE = 4096
_isqrt = np.frompyfunc(math.isqrt, 1, 1)


def roots(a: np.ndarray) -> np.ndarray:
    """Square roots, rounded down."""
    if a.dtype == object:
        return _isqrt(a) if a.size else a
    r = np.sqrt(a.astype(np.float64)).astype(np.int64)
    r -= r * r > a
    return r + ((r + 1) * (r + 1) <= a)


def levels(width: int) -> list[int]:
    """Numbers of blocks of a part, coarse to fine; blocks of one component are the distance itself."""
    out = [1]
    while width % (2 * out[-1]) == 0 and width // (2 * out[-1]) > 1:
        out.append(2 * out[-1])
    return out


def summary(x: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row and block: the sum, and the root of m^2 times the variance."""
    cut = x.reshape(len(x), blocks, -1)
    s = cut.sum(2)
    return s, roots(cut.shape[2] * (cut * cut).sum(2) - s * s)


def bounds(s: np.ndarray, r: np.ndarray, t: np.ndarray, q: np.ndarray, m: int) -> np.ndarray:
    """Lower bounds of squared distances from the summaries of both sides (last axis: blocks), rounded down."""
    residual = abs(r - q) - 1
    residual = np.where(residual > 0, residual, 0)
    return ((s - t) ** 2 + residual * residual).sum(-1) // m


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(index, squared distance) of the nearest entry to each row, ties to the lower index, and how many exact distances it took."""
    n, k, width = len(x), len(entries), x.shape[1]
    exact = lambda rows, cols: ((x[rows] - entries[cols]) ** 2).sum(1)
    depth = levels(width)
    own, theirs = [summary(x, d) for d in depth], [summary(entries, d) for d in depth]
    first = bounds(own[0][0][:, None], own[0][1][:, None], theirs[0][0][None], theirs[0][1][None], width)
    guess = np.argmin(first, 1)
    best, dist = guess.astype(np.int64), exact(np.arange(n), guess)
    rows, cols = np.nonzero((first <= dist[:, None]) & (np.arange(k) != guess[:, None]))
    for d, (s, r), (t, q) in zip(depth[1:], own[1:], theirs[1:], strict=True):
        near = bounds(s[rows], r[rows], t[cols], q[cols], width // d) <= dist[rows]
        rows, cols = rows[near], cols[near]
    full = np.full((n, k), -1, x.dtype)
    full[rows, cols] = exact(rows, cols)
    for c in range(k):
        better = (full[:, c] >= 0) & ((full[:, c] < dist) | ((full[:, c] == dist) & (c < best)))
        best, dist = np.where(better, c, best), np.where(better, full[:, c], dist)
    return best, dist, n + len(rows)


def _ints(b: pa.RecordBatch) -> np.ndarray:
    """Integer vectors of a batch, a row each."""
    v = b.column("vector")
    x = np.asarray(v.flatten()).astype(np.float64).reshape(b.num_rows, -1)
    x = np.floor(x * SCALE)
    if np.abs(x).max(initial=0) < SMALL:
        return x.astype(np.int64)
    return np.frompyfunc(int, 1, 1)(x)


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, STRIDE):
            yield b.slice(at, STRIDE)


def _book(book: list) -> list[np.ndarray]:
    """Entries of each part, as 64-bit integers where they fit."""
    large = max((abs(c) for part in book for e in part for c in e), default=0) >= SMALL
    return [np.array(part, object if large else np.int64) for part in book]


def _parts(x: np.ndarray, book: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Number, rows and entries of each part, both of the same kind of integer."""
    width = x.shape[1] // len(book)
    for p, entries in enumerate(book):
        own = x[:, p * width : (p + 1) * width]
        if own.dtype != entries.dtype:
            own, entries = own.astype(object), entries.astype(object)
        yield p, own, entries


def limbs(v: int) -> Iterator[tuple[int, int]]:
    """(limb, digits) of a number in base 2^32, each digit with the number's sign."""
    sign, v, k = (-1 if v < 0 else 1), abs(v), 0
    while v or not k:
        yield k, sign * (v & 0xFFFFFFFF)
        v >>= 32
        k += 1


def _sums(batches: Iterator[pa.RecordBatch], book: list) -> Iterator[pa.RecordBatch]:
    """Of all rows of a task: for each entry in use the sums of its parts by place, and at place -1 their number; in limbs, as they may
    pass 64 bits."""
    total: dict[tuple[int, int], list] = {}
    own = _book(book)
    for b in _stretches(batches):
        for p, x, entries in _parts(_ints(b), own):
            best = nearest(x, entries)[0]
            for e in np.unique(best):
                mine = x[best == e]
                had = total.setdefault((p, int(e)), [0, [0] * x.shape[1]])
                had[0] += len(mine)
                had[1] = [a + int(c) for a, c in zip(had[1], mine.sum(0), strict=True)]
    rows = [(p, e, place, limb, v) for (p, e), (n, s) in total.items() for place, c in ((-1, n), *enumerate(s)) for limb, v in limbs(c)]
    if rows:
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["part", "entry", "place", "limb", "value"])


def _codes(batches: Iterator[pa.RecordBatch], book: list) -> Iterator[pa.RecordBatch]:
    own = _book(book)
    for b in _stretches(batches):
        x = _ints(b)
        code, error = np.zeros((b.num_rows, len(own)), np.uint8), [0] * b.num_rows
        for p, part, entries in _parts(x, own):
            best, dist, _ = nearest(part, entries)
            code[:, p] = best
            error = [a + int(d) for a, d in zip(error, dist, strict=True)]
        hexed = code.tobytes().hex()
        step = 2 * len(own)
        codes = [hexed[at : at + step] for at in range(0, len(hexed), step)]
        fits = [e if e < 1 << 63 else None for e in error]
        yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array(codes, pa.string()), pa.array(fits, pa.int64())], names=["vec_id", "label", "code", "error"])


def updated(book: list, sums: DataFrame) -> list:
    """Every entry that is in use becomes floor(sum / count) of its parts; the others stay."""
    total: dict[tuple, int] = {}
    for r in sums.groupBy("part", "entry", "place", "limb").agg(F.sum("value").alias("value")).collect():  # entries x width x a number's limbs
        total[r.part, r.entry, r.place] = total.get((r.part, r.entry, r.place), 0) + (r.value << 32 * r.limb)
    book = [[list(e) for e in part] for part in book]
    for (p, e, place), v in total.items():
        if place >= 0:
            book[p][e][place] = v // total[p, e, -1]
    return book


def digest(book: list) -> str:
    return hashlib.sha256(",".join(str(c) for part in book for e in part for c in e).encode()).hexdigest()


def smallest(kept: DataFrame, n: int) -> list[list[float]]:
    """Vectors of the ``n`` smallest vec_ids, ascending, each id once; nothing but the rows asked for is moved."""
    ids: list[int] = []
    while len(ids) < n:
        more = kept.where(F.col("vec_id") > ids[-1]) if ids else kept.where(F.col("vec_id").isNotNull())
        found = [r.vec_id for r in more.select("vec_id").orderBy("vec_id").limit(n).collect()]  # repeated ids may fill it
        if not found:
            break
        ids = [*ids, *dict.fromkeys(found)][:n]
    wanted = F.col("vec_id").isin(ids) if len(ids) == n else F.col("vec_id").isin(ids) | F.col("vec_id").isNull()
    return [r.vector for r in kept.where(wanted).groupBy("vec_id").agg(F.min("vector").alias("vector")).orderBy(F.asc_nulls_last("vec_id")).collect()]


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list]:
    """Codes of the kept rows of ``vectors`` (vec_id, embedding, label), and the codebook (by part, entry and place): vec_id, label, code
    (two hex digits a part), error (squared distance in integer components).

    Rows go whose vector is null, holds a null or a number that is not finite, or whose length is not the usual one: of the lengths
    that ``parts`` divides the most frequent, the smaller at a tie. The codebook starts with the smallest vec_ids, each once (of rows with
    the same id the least vector; a null id comes last). With fewer ids than ``entries`` there are fewer entries. Repeated rows are
    coded each; null ids and labels stay. An error beyond a long is null. An empty table gives no rows and an empty codebook.
    Other columns are ignored.
    """
    if not 1 <= entries <= 256 or parts < 1:
        raise ValueError("entries go from 1 to 256, and there is a part at least")
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").cast("array<double>").alias("vector"))
    bad = F.exists("vector", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    size = F.size("vector")
    rows = rows.where(F.col("vector").isNotNull() & (size > 0) & (size % parts == 0) & ~F.coalesce(bad, F.lit(False)))
    kept = common.stored(spark, rows.withColumn("width", F.size("vector")), "vectors")
    schema = f"vec_id long, label {kept.schema['label'].dataType.simpleString()}, code string, error long"
    widths = kept.groupBy("width").count().orderBy(F.desc("count"), "width").limit(1).collect()
    if not widths:
        return spark.createDataFrame([], schema), [[] for _ in range(parts)]
    kept = kept.where(F.col("width") == widths[0].width)
    step = widths[0].width // parts
    book = [[[math.floor(v * SCALE) for v in x[p * step : (p + 1) * step]] for x in smallest(kept, entries)] for p in range(parts)]
    vector = kept.select("vector")
    for _ in range(rounds):
        book = updated(book, vector.mapInArrow(lambda it, own=book: _sums(it, own), "part int, entry int, place int, limb int, value long"))
    return kept.select("vec_id", "label", "vector").mapInArrow(lambda it, own=book: _codes(it, own), schema), book


def decoded(codes: DataFrame, book: list) -> DataFrame:
    """``codes`` with the integer vector that its code stands for, as ``ints``."""
    flat = F.array(*(F.array(*(F.array(*(F.lit(c).cast("long") for c in e)) for e in part)) for part in book))
    at = F.sequence(F.lit(0), F.lit(len(book) - 1))
    entry = lambda p: F.conv(F.substring("code", p * 2 + 1, F.lit(2)), 16, 10).cast("int")
    return codes.withColumn("ints", F.flatten(F.transform(at, lambda p: F.get(F.get(flat, p), entry(p)))))


def coded(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error (error summed over equal labels, nulls together; null past a long), codebooks_sha256 of the kept
    rows, as ``compress`` takes them."""
    spark = vectors.sparkSession
    codes, book = compress(vectors, parts, entries, rounds)
    codes = common.stored(spark, codes, "codes")
    total = F.when(F.count("*") == F.count("error"), F.sum(F.col("error").cast("decimal(38,0)")))
    labels = common.stored(spark, codes.groupBy("label").agg(total.try_cast("long").alias("label_error")).withColumnRenamed("label", "of"), "labels")
    out = codes.join(labels, F.col("label").eqNullSafe(F.col("of")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest(book)).alias("codebooks_sha256"))


def sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """The same rows by full searches."""
    step = f"(n // {parts})"
    assign = """SELECT vec_id, label, p, x, arg_min(e, (d, e)) AS e, min(d) AS d FROM (
  SELECT v.vec_id, v.label, v.p, v.x, b.e, list_sum(list_transform(list_zip(v.x, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM part v JOIN {book} b USING (p)) GROUP BY ALL"""
    out = f"""WITH kept AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS HUGEINT)) AS x, len(embedding) AS n FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
part AS MATERIALIZED (SELECT vec_id, label, p, x[p * {step} + 1 : (p + 1) * {step}] AS x FROM kept, (SELECT unnest(range({parts})) AS p)),
book0 AS MATERIALIZED (SELECT p, e, x AS c FROM part JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept ORDER BY vec_id LIMIT {entries}) USING (vec_id))"""
    for k in range(rounds):
        out += f""",
near{k} AS MATERIALIZED ({assign.format(book=f"book{k}")}),
mean{k} AS (SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM (SELECT p, e, i, sum(v) AS s, count(*) AS n FROM (SELECT p, e, unnest(x) AS v, unnest(range(len(x))) AS i FROM near{k}) GROUP BY ALL) GROUP BY p, e),
book{k + 1} AS MATERIALIZED (SELECT p, e, coalesce(m.c, b.c) AS c FROM book{k} b LEFT JOIN mean{k} m USING (p, e))"""
    return (
        out
        + f""",
last AS MATERIALIZED ({assign.format(book=f"book{rounds}")}),
codes AS (SELECT vec_id, label, string_agg(lower(lpad(to_hex(e), 2, '0')), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM last GROUP BY vec_id, label)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM book{rounds}) AS codebooks_sha256 FROM codes"""
    )
