"""Operator 1: removal of long repeated byte strings with a difference cover.

A byte goes if a string of LENGTH bytes covers it that starts somewhere else too, in the
same document or another. The classic construction sorts only the suffixes at positions
in a difference cover modulo v, names them, recurses on the names, and places all other
suffixes by the sampled suffix that follows them; equal prefixes then stand next to each
other. Here only prefixes of LENGTH bytes matter, so the recursion ends after fixed steps:

* sample: positions whose offset modulo v = 183 lies in a perfect difference set of 14
  residues. For any two positions there is a shift below v that takes both into the sample,
  so two equal strings of LENGTH bytes hold, at one such shift, sampled windows of
  LENGTH - v + 1 bytes that are equal;
* sort sampled tuples: those windows get names (hashes), sorted in buckets over the key
  space; a name that stands alone drops out;
* recurse on names: each remaining sample is named again by its whole reach (all strings of
  LENGTH bytes that contain its window at a shift below v). Equal neighbours settle the
  whole reach at once;
* merge the remaining suffixes: what is left is named in runs of 13 start positions and at last
  one by one, anchored to the sample, and compared with its neighbours in sorted order.

A name in a step is kept by one representative where equal copies exist, so a group of
copies costs one entry per chunk of text and moves on as a single member.
Decisions rest on two independent 64-bit hashes.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Generator, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from scriptorium.llm import common, exchange
from scriptorium.llm.bytehash import Windows, mix

LENGTH = 400
ORDER = 13  # of the finite field behind the difference set: v = ORDER**2 + ORDER + 1
RUN = 13
_U = np.uint64


@functools.cache
def difference_set(q: int = ORDER) -> tuple[int, np.ndarray]:
    """(v, D): every nonzero residue modulo v = q*q+q+1 is a difference of two members of D exactly once (q prime).

    Powers of a root of a cubic over GF(q) that lie on one line of the projective plane.
    """
    v = q * q + q + 1
    for c in range(1, q):
        for b in range(q):
            for a in range(q):
                x, line = (1, 0, 0), []
                for i in range(v):
                    if not x[2]:
                        line.append(i)
                    top = x[2]
                    x = (top * c % q, (x[0] + top * b) % q, (x[1] + top * a) % q)
                if len(line) == q + 1 and len({(s - t) % v for s in line for t in line if s != t}) == v - 1:
                    return v, np.array(line, np.int64)
    raise ValueError(f"no difference set of order {q}")


def _pack(bits: np.ndarray, buckets: np.ndarray) -> list[tuple[int, np.ndarray]]:
    which, at = exchange.split(buckets)
    return [(int(w), slice(at[k], at[k + 1])) for k, w in enumerate(which)]


def _unpack(blob: bytes, counts: list[int], width: int) -> np.ndarray:
    """Answers of all buckets in order: each packed to whole bytes, ``width`` bits a key."""
    out, at = [], 0
    for n in counts:
        size = (n * width + 7) // 8
        out.append(np.unpackbits(np.frombuffer(blob, np.uint8, size, at), count=n * width))
        at += size
    return np.concatenate(out).reshape(-1, width).astype(bool) if out else np.zeros((0, width), bool)


def _names(cls: np.ndarray, n_buckets: int) -> Generator:
    """Asks which names other chunks have too; returns for each entry whether its name occurs twice."""
    order, begins, number = exchange.group(cls, None)
    keys = cls[order][begins]
    parts = _pack(keys, exchange.bucket_of(keys, n_buckets))
    low = keys.view(np.uint8).reshape(-1, 8)[:, :5]  # with the bucket: 40 bits and more; a chance match costs work only
    got = yield [(b, low[s].tobytes()) for b, s in parts]
    twice = _unpack(got, [s.stop - s.start for _, s in parts], 1)[:, 0] if len(keys) else np.zeros(0, bool)
    twice = twice | (np.bincount(number, minlength=len(keys)) > 1)
    out = np.empty(len(cls), bool)
    out[order] = twice[number]
    return out


def _answer_names(messages: list[bytes]) -> list[bytes]:
    parts = []
    for m in messages:
        key = np.zeros((len(m) // 5, 8), np.uint8)
        key[:, :5] = np.frombuffer(m, np.uint8).reshape(-1, 5)
        parts.append(key.view(np.uint64)[:, 0])
    order, begins, number = exchange.group(np.concatenate(parts), None)
    twice = np.empty(len(order), bool)
    twice[order] = (np.bincount(number) > 1)[number]
    at = np.cumsum([0, *map(len, parts)])
    return [np.packbits(twice[at[k] : at[k + 1]]).tobytes() for k in range(len(parts))]


def _members(cls: np.ndarray, item: np.ndarray, n_buckets: int) -> Generator:
    """Asks about members of classes; returns (settled, goes on) for each entry: another entry equals it;
    its class needs it in the next step, as it stands alone or as the representative of equal ones."""
    order, begins, number = exchange.group(cls, item)
    keys, items, n = cls[order][begins], item[order][begins], np.bincount(number, minlength=len(begins))
    parts = _pack(keys, exchange.bucket_of(keys, n_buckets))
    got = yield [(b, keys[s].tobytes() + items[s].tobytes() + np.packbits(n[s] > 1).tobytes()) for b, s in parts]
    bits = _unpack(got, [s.stop - s.start for _, s in parts], 2)
    settled, on = np.zeros(len(cls), bool), np.zeros(len(cls), bool)
    settled[order] = bits[number, 0] if len(order) else False
    on[order[begins]] = bits[:, 1]
    return settled, on


def _answer_members(messages: list[bytes]) -> list[bytes]:
    sizes = [(8 * len(m)) // 129 for m in messages]
    cls = np.concatenate([np.frombuffer(m, _U, n) for m, n in zip(messages, sizes, strict=True)])
    item = np.concatenate([np.frombuffer(m, _U, n, 8 * n) for m, n in zip(messages, sizes, strict=True)])
    local = np.concatenate([np.unpackbits(np.frombuffer(m, np.uint8, offset=16 * n), count=n) for m, n in zip(messages, sizes, strict=True)])
    order, begins, number = exchange.group(cls, item)
    equal = (np.bincount(number) > 1) | (np.bincount(number, local[order]) > 0)
    c = cls[order][begins]
    new = np.ones(len(c), bool)
    new[1:] = c[1:] != c[:-1]
    klass = np.cumsum(new) - 1
    open_ = (np.bincount(klass) > 1) & (np.bincount(klass, ~equal) > 0)
    bits = np.zeros((len(cls), 2), np.uint8)
    bits[order, 0] = equal[number]
    bits[order[begins], 1] = open_[klass]
    at = np.cumsum([0, *sizes])
    return [np.packbits(bits[at[k] : at[k + 1]]).tobytes() for k in range(len(sizes))]


def _spread(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """All numbers of the ranges lo..hi, one range after another."""
    n = hi - lo + 1
    ends = np.cumsum(n)
    return np.arange(n.sum()) - np.repeat(ends - n - lo, n)


def _protocol(blob: np.ndarray, lens: np.ndarray, ids: list, n_buckets: int, length: int) -> Generator:
    v, cover = difference_set()
    core = length - v + 1
    starts = np.cumsum(lens) - lens
    longest = int(lens.max()) if len(lens) else 0
    grid = (np.arange(longest // v + 1)[:, None] * v + cover).ravel()
    s, lo, hi = [], [], []
    for start, n in zip(starts.tolist(), lens.tolist(), strict=True):
        if n >= length:
            own = grid[: np.searchsorted(grid, n - core, "right")]
            s.append(start + own)
            lo.append(start + np.maximum(own - v + 1, 0))
            hi.append(start + np.minimum(own, n - length))
    if not s:
        s = lo = hi = [np.zeros(0, np.int64)]
    s, lo, hi = np.concatenate(s), np.concatenate(lo), np.concatenate(hi)
    one = Windows(blob, 0)
    name = one.hash(s, core)
    twice = yield from _names(name, n_buckets)
    s, lo, hi, name = s[twice], lo[twice], hi[twice], name[twice]
    two = Windows(blob, 1)
    shape = lambda x, y: mix((x.astype(_U) << _U(20)) + y.astype(_U))
    edges = np.zeros(len(blob) + 1, np.int32)

    def settle(settled, a, b):
        np.add.at(edges, a[settled], 1)
        np.add.at(edges, b[settled] + length, -1)

    settled, on = yield from _members(name, two.hash(lo, hi + length - lo) ^ shape(s - lo, s - hi), n_buckets)
    settle(settled, lo, hi)
    s, lo, hi, name = s[on], lo[on], hi[on], name[on]
    m = np.arange(0, v, RUN)
    a = np.maximum(lo[:, None], s[:, None] - np.minimum(m + RUN, v) + 1)
    b = np.minimum(hi[:, None], s[:, None] - m)
    real = a <= b
    cls = mix(name[:, None] + (m.astype(_U) + _U(1)) * _U(0x9E3779B97F4A7C15))[real]
    at = np.broadcast_to(s[:, None], real.shape)[real]
    a, b = a[real], b[real]
    settled, on = yield from _members(cls, two.hash(a, b + length - a) ^ shape(at - a, at - b), n_buckets)
    settle(settled, a, b)
    i = np.unique(_spread(a[on], b[on]))
    settled, _ = yield from _members(one.hash(i, length), two.hash(i, length), n_buckets)
    settle(settled, i, i)
    return np.cumsum(edges[:-1]) > 0, starts


def _report(blob_rows: Iterator[pa.RecordBatch], protocol) -> Iterator[pa.RecordBatch]:
    for batch in blob_rows:
        for row in range(batch.num_rows):
            one = batch.slice(row, 1)
            blob = np.frombuffer(one.column("blob")[0].as_buffer() or b"", np.uint8)
            lens = np.frombuffer(one.column("lens")[0].as_py(), np.int64)
            (_, ids, (gone, starts)), *_ = exchange.replay([one], protocol, 4)
            out = []
            for doc, start, n in zip(ids, starts.tolist(), lens.tolist(), strict=True):
                g, t = gone[start : start + n], blob[start : start + n]
                removed = int(np.count_nonzero(g))
                spans = int(np.count_nonzero(g[1:] & ~g[:-1]) + g[0]) if removed else 0
                out.append((doc, n, removed, spans, hashlib.sha256(t[~g].tobytes() if removed else t).hexdigest()))
            cols = list(zip(*out, strict=True))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _kept_text(blob_rows: Iterator[pa.RecordBatch], protocol) -> Iterator[pa.RecordBatch]:
    for batch in blob_rows:
        for row in range(batch.num_rows):
            one = batch.slice(row, 1)
            blob = np.frombuffer(one.column("blob")[0].as_buffer() or b"", np.uint8)
            lens = np.frombuffer(one.column("lens")[0].as_py(), np.int64)
            (_, ids, (gone, starts)), *_ = exchange.replay([one], protocol, 4)
            keep = [blob[s : s + n][~gone[s : s + n]].tobytes() for s, n in zip(starts.tolist(), lens.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keep, pa.binary())], names=["doc_id", "kept"])


_REPORT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
_TEXT = "doc_id long, kept binary"


def remove_repeats(docs: DataFrame, length: int = LENGTH, text: bool = False) -> DataFrame:
    """One row per document of ``docs`` (doc_id, text; other columns are ignored).

    doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256; with ``text``: doc_id and kept, the
    remaining bytes (removal may cut a code point). Null texts are empty; texts under ``length`` bytes lose
    nothing; repeated rows are documents of their own; an empty table gives no rows.
    """
    v, _ = difference_set()
    if length < v + 32:
        raise ValueError(f"length must be {v + 32} at least")
    spark = docs.sparkSession
    quiet = {"spark__sql__execution__arrow__maxRecordsPerBatch": 1}
    with common.settings(spark):
        table = exchange.Table.write(docs)
    # a bucket gets about 4 million of the 14/183 sampled positions
    n = common.buckets_for(spark, table.n_bytes * (ORDER + 1) / v, 4e6)
    protocol = lambda blob, lens, ids: _protocol(blob, lens, ids, n, length)
    answers: list[DataFrame] = []
    with common.settings(spark, **quiet):
        for name, answer in (("names", _answer_names), ("reach", _answer_members), ("runs", _answer_members), ("starts", _answer_members)):
            answers.append(exchange.ask(table, answers, protocol, answer, n, name))
        rows = table.rows(answers)
        if text:
            out = rows.mapInArrow(lambda it: _kept_text(it, protocol), _TEXT)
        else:
            out = rows.mapInArrow(lambda it: _report(it, protocol), _REPORT)
        out = common.stored(spark, out, "repeats")
    return out


#: Every 400-byte window (as hex, cut from overlapping stretches of 1024 starts) by its MD5; covered runs from the starts of repeated ones.
SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(hex(encode(text)), '') AS x FROM documents),
s AS (
  SELECT r, k * 1024 AS base, substr(x, 1 + 2048 * k, 2 * (1024 + 399)) AS y
  FROM (SELECT r, x, unnest(range(0, CAST(ceil(length(x) / 2048.0) AS BIGINT))) AS k FROM d WHERE length(x) >= 800)),
w AS (
  SELECT r, base + k AS p, md5(substr(y, 1 + 2 * k, 800)) AS h
  FROM (SELECT r, base, y, unnest(range(0, greatest(0, length(y) // 2 - 399))) AS k FROM s)),
g AS (
  SELECT r, p FROM w WHERE h IN (SELECT h FROM w GROUP BY h HAVING count(*) > 1)),
i AS (
  SELECT r, p, sum(fresh) OVER (PARTITION BY r ORDER BY p ROWS UNBOUNDED PRECEDING) AS n
  FROM (SELECT r, p, CASE WHEN p <= lag(p) OVER (PARTITION BY r ORDER BY p) + 400 THEN 0 ELSE 1 END AS fresh FROM g)),
c AS (SELECT r, n, min(p) AS a, max(p) + 400 AS z FROM i GROUP BY r, n),
k AS (SELECT r, a, z, coalesce(lag(z) OVER (PARTITION BY r ORDER BY a), 0) AS before FROM c),
t AS (
  SELECT r, sum(z - a) AS gone, count(*) AS spans, max(z) AS last, string_agg(substr(x, 1 + 2 * before, 2 * (a - before)), '' ORDER BY a) AS kept
  FROM k JOIN d USING (r) GROUP BY r)
SELECT doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(CASE WHEN gone IS NULL THEN x ELSE kept || substr(x, 1 + 2 * last) END)) AS kept_sha256
FROM d LEFT JOIN t USING (r)"""
