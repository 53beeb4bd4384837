"""Operator 7: near-duplicate detection with SimHash and covering locality-sensitive hashing.

Fingerprints of 64 bits link when at most RADIUS = 4 bits differ. Each bit position gets a
nonzero vector of GF(2)^5; table v (one of the 31 nonzero vectors) keeps the bits whose vector has
product 1 with v and masks the others out. The vectors of any four positions span at most
four dimensions, so some v is orthogonal to all of them: two fingerprints within the radius have
the same key in that table. No pair is missed, by construction.

Equal fingerprints are one member. In a bucket the members are linked by a spanning forest of
their true links, never by all pairs. A bucket above LIMIT members is dealt out again by a
covering of the bits that its key leaves free; each level halves these, so the second level is
bounded by 2**16 members whatever the corpus holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm import common
from scriptorium.llm.components import components

RADIUS = 4
SHINGLE = 4
SEED = 42
LIMIT = 1 << 14
TASK_ROWS = 2_000_000  # (table, fingerprint) rows that a task sorts
_U = np.uint64


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """SimHash of the lower-cased word shingles of a text; zero without words."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    else:
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        begins = np.concatenate(([0], ends[: -shingle] + 1)).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], SEED) for a, b in zip(begins, ends[shingle - 1 :].tolist(), strict=True)]
    h = np.array(hashes, np.uint64)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 15):
        counts += np.unpackbits(h[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * counts > len(h), bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        got = [fingerprint(t or b"", shingle) for t in b.column(1).cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(got, np.uint64).view(np.int64))], names=["doc_id", "fp"])


def submasks(free: int) -> list[int]:
    """For the free bits, 31 masks of which one at least avoids any RADIUS of them."""
    places = [i for i in range(64) if free >> i & 1]
    dim = RADIUS + 1
    out = []
    for v in range(1, 1 << dim):
        out.append(sum(1 << p for k, p in enumerate(places) if (1 + k % ((1 << dim) - 1) & v).bit_count() & 1))
    return out


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(fixed, fp) to a row per table: the bits fixed now, the key, and fp."""
    for b in batches:
        fixed, fp = (np.asarray(b.column(k)).view(np.uint64) for k in (0, 1))
        for f in np.unique(fixed):
            own = fp[fixed == f]
            for m in submasks(~int(f) & (1 << 64) - 1):
                now = _U(int(f) | m)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(own), now).view(np.int64)), pa.array((own & now).view(np.int64)), pa.array(own.view(np.int64))], names=["fixed", "key", "fp"]
                )


def forest(f: np.ndarray) -> tuple[list, list]:
    """Links within the radius that connect whatever is connected in ``f`` (distinct fingerprints)."""
    a, b = [], []
    left = f.copy()
    while len(left):
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            x = todo.pop()
            near = np.bitwise_count(left ^ x) <= RADIUS
            if near.any():
                found = left[near]
                left = left[~near]
                a.extend([x] * len(found))
                b.extend(found)
                todo.extend(found)
    return a, b


def _link(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Rows (over, a, b): a link, or for buckets over the limit (its fixed bits, fp). Buckets come one after another;
    no more than a batch and an unfinished bucket below the limit is held."""

    def rows(over, a, b):
        a, b = np.asarray(a, _U), np.asarray(b, _U)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), over)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["over", "a", "b"])

    def dealt(f) -> bool:
        return int(f).bit_count() < 48

    def linked(x: np.ndarray) -> Iterator[pa.RecordBatch]:
        fixed, key, fp = x
        begins, sizes = _buckets(fixed, key)
        two = begins[sizes == 2]
        two = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= RADIUS]
        yield rows(False, fp[two], fp[two + 1])
        for at, n in zip(begins[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
            f = fp[at : at + n]
            if n > limit and dealt(fixed[at]):
                yield rows(True, fixed[at : at + n], f)
            else:
                a, b = forest(f)
                if a:
                    yield rows(False, a, b)

    rest, over = np.zeros((3, 0), _U), None
    for b in batches:
        x = np.stack([np.asarray(b.column(k)).view(_U) for k in range(3)])
        if over is not None:  # the bucket that is being dealt out goes on
            n = int(np.argmin(np.append((x[0] == over[0]) & (x[1] == over[1]), False)))
            yield rows(True, x[0, :n], x[2, :n])
            x = x[:, n:]
            if not x.shape[1]:
                continue
            over = None
        x = np.concatenate((rest, x), axis=1)
        if not x.shape[1]:
            continue
        last = int(_buckets(x[0], x[1])[0][-1])
        yield from linked(x[:, :last])
        rest = x[:, last:]
        if rest.shape[1] > limit and dealt(rest[0, 0]):
            yield rows(True, rest[0], rest[2])
            over, rest = (rest[0, 0], rest[1, 0]), np.zeros((3, 0), _U)
    yield from linked(rest)


def _buckets(fixed: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each stretch of equal (fixed, key) begins, and its length."""
    new = np.ones(len(key), bool)
    new[1:] = (fixed[1:] != fixed[:-1]) | (key[1:] != key[:-1])
    begins = np.flatnonzero(new)
    return begins, np.diff(np.append(begins, len(key)))


def links(fps: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp), enough to connect all that are linked."""
    spark = fps.sparkSession
    todo = fps.select(F.lit(0).cast("long").alias("fixed"), "fp")
    found = []
    while True:
        n = common.buckets_for(spark, todo.count() * float((1 << RADIUS + 1) - 1), TASK_ROWS)
        dealt = todo.mapInArrow(_spread, "fixed long, key long, fp long").repartition(n, "fixed", "key").sortWithinPartitions("fixed", "key")
        out = common.stored(spark, dealt.mapInArrow(lambda it: _link(it, limit), "over boolean, a long, b long"), "links")
        found.append(out.where(~F.col("over")).select("a", "b"))
        todo = out.where("over").select(F.col("a").alias("fixed"), F.col("b").alias("fp"))
        if todo.isEmpty():
            break
    every = found[0]
    for f in found[1:]:
        every = every.union(f)
    return every.distinct()


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, limit: int = LIMIT) -> DataFrame:
    """One row per document of ``docs`` (doc_id, text): doc_id, fingerprint (16 hex digits), component_id, the smallest
    doc_id that links of at most RADIUS differing bits reach.

    Null and blank texts have fingerprint zero and are linked like any other. Repeated rows
    give repeated result rows. A null doc_id stays null and is never the smallest while its
    component has another; an empty table gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    prints = common.stored(spark, common.id_text(docs).mapInArrow(lambda it: _fingerprints(it, shingle), "doc_id long, fp long"), "fingerprints")
    firsts = common.stored(spark, prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "firsts")
    roots = components(common.stored(spark, links(firsts.select("fp"), limit), "edges"))
    member = firsts.join(roots, firsts.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = member.groupBy("root").agg(F.min("first").alias("component_id"))
    member = common.stored(spark, member.join(least, "root").select("fp", "component_id"), "members")
    return prints.join(member, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, limit: int = LIMIT) -> DataFrame:
    """The rows of ``docs``, with all their columns, that stand for their component: of each, the row with the smallest doc_id
    (nulls last; equal ids in a fixed order).

    Null and blank texts are one component; of repeated rows one stays; an empty table gives no rows; other columns
    are carried along, whatever their names.
    """
    spark = docs.sparkSession
    rid = common.unused(docs.columns, "rid")
    own = common.bucketed(spark, docs.withColumn(rid, F.monotonically_increasing_id()), rid, "rows")
    found = near_duplicates(own.select(F.col(rid).alias("doc_id"), "text"), shingle, limit).select(F.col("doc_id").alias(rid), F.col("component_id").alias("group"))
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col(rid).alias("rid"))
    stay = own.select(rid, "doc_id").join(found, rid).groupBy("group").agg(F.min(order)["rid"].alias(rid))
    return own.join(stay.select(rid).hint("shuffle_hash"), rid, "left_semi").drop(rid)
