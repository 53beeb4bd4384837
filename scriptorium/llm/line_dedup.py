"""Operator 10: line deduplication by pairwise alignment.

A run is the fewest consecutive lines (with a word) from a line on, or up to it, that reach MIN_BLOCK
characters: every line of a block that two documents share lies in a run of the block. A run that several documents share
names the earliest of them; a document is paired with each earliest holder that its runs name, never with all documents
that share a run, so pairs grow with the lines and not with the square of a group, and no run that an earlier document has is lost.
A run that no other document has, however often its lines occur alone, pairs nothing.
Only the places of shared runs travel: the later document rebuilds from its own lines what the earlier one has there.
Each pair is aligned with patience diff: lines unique in both anchor a longest increasing
subsequence, and the gaps between anchors are aligned likewise. Blocks of aligned lines,
consecutive in both, with MIN_BLOCK characters or more are deleted from the later document. Where a shared run is left (lines
that moved, or that the later document repeats), the stretches that it names in both are aligned again. Only aligned lines are deleted.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptorium.llm import common
from scriptorium.llm.bytehash import mix

_U = np.uint64

MIN_BLOCK = 50


def _anchors(a: list, b: list, alo: int, ahi: int, blo: int, bhi: int) -> list[tuple[int, int]]:
    """Lines unique in both stretches, as a longest run that ascends in both."""
    ca, cb = Counter(a[alo:ahi]), Counter(b[blo:bhi])
    at = {x: j for j, x in enumerate(b[blo:bhi], blo) if cb[x] == 1}
    pairs = [(i, at[x]) for i, x in enumerate(a[alo:ahi], alo) if ca[x] == 1 and x in at]
    tails, last, back = [], [], [-1] * len(pairs)
    for k, (_, j) in enumerate(pairs):
        p = bisect_left(tails, j)
        back[k] = last[p - 1] if p else -1
        if p == len(tails):
            tails.append(j)
            last.append(k)
        else:
            tails[p], last[p] = j, k
    out, k = [], last[-1] if last else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Aligned positions (i, j) of equal lines, ascending in both."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        alo, ahi, blo, bhi = todo.pop()
        while alo < ahi and blo < bhi and a[alo] == b[blo]:
            out.append((alo, blo))
            alo, blo = alo + 1, blo + 1
        while alo < ahi and blo < bhi and a[ahi - 1] == b[bhi - 1]:
            ahi, bhi = ahi - 1, bhi - 1
            out.append((ahi, bhi))
        if alo < ahi and blo < bhi:
            found = _anchors(a, b, alo, ahi, blo, bhi)
            out.extend(found)
            if found:
                ends = [(alo - 1, blo - 1), *found, (ahi, bhi)]
                todo.extend((i + 1, ni, j + 1, nj) for (i, j), (ni, nj) in zip(ends, ends[1:], strict=False))
    return sorted(out)


def spans(sizes, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(begin, end) of the fewest consecutive lines from each line on, and up to each, that sum up to ``least``."""
    total = np.concatenate(([0], np.cumsum(np.asarray(sizes, np.int64))))
    at = np.arange(len(total))
    ends = np.searchsorted(total, total + least, "left")
    begins = np.searchsorted(total, total - least, "right") - 1
    on, upto = ends < len(total), begins >= 0
    both = np.unique(np.concatenate((np.stack((at[on], ends[on]), 1), np.stack((begins[upto], at[upto]), 1))), axis=0)
    return both[:, 0], both[:, 1]


def aligned_blocks(early: list, late: list, sizes: list, least: int) -> set[int]:
    """Positions of ``late`` in blocks of aligned lines, consecutive in both, whose ``sizes`` sum up to ``least`` or more."""
    out, block, before = set(), [], None
    for i, j in [*patience(early, late), (-2, -2)]:
        if before is None or (i, j) != (before[0] + 1, before[1] + 1):
            if sum(sizes[k] for k in block) >= least:
                out.update(block)
            block = []
        block.append(j)
        before = i, j
    return out


def common_blocks(early: list, late: list, sizes: list, least: int = MIN_BLOCK) -> list[int]:
    """Positions of ``late`` in aligned blocks of ``least`` or more: of the whole documents, then, as long as a run of that size is left
    that the early one has too (its lines moved, or repeated), of the stretches that the run names in both. What no alignment has found
    stays."""
    out = aligned_blocks(early, late, sizes, least)
    there = set(early)
    # of the runs of the later document only those count that have a line left, and none that the early one lacks
    open_ = np.cumsum([0, *(x in there and k not in out for k, x in enumerate(late))])
    if open_[-1]:
        begins, ends = spans(sizes, least)
        has = np.cumsum([0, *(x in there for x in late)])
        left = (has[ends] - has[begins] == ends - begins) & (open_[ends] > open_[begins])
        if left.any():
            size = dict(zip(late, sizes, strict=True))
            known = [size.get(x, least) for x in early]  # a line that ``late`` lacks (None too) is in no common run
            runs: dict[tuple, int] = {}
            for a, b in zip(*(x.tolist() for x in spans(known, least)), strict=True):
                runs.setdefault(tuple(early[a:b]), a)
            for a, b in zip(begins[left].tolist(), ends[left].tolist(), strict=True):
                at = runs.get(tuple(late[a:b]))
                if at is not None:
                    out.update(a + j for j in aligned_blocks(early[at : at + b - a], late[a:b], sizes[a:b], least))
    return sorted(out)


def _hashed(lines: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each run from the hashes of its lines."""
    keys = np.zeros(len(begins), _U)
    for k in range(int((ends - begins).max(initial=0))):
        more = begins + k < ends
        keys[more] = mix(keys[more] + lines[begins[more] + k])
    return keys.view(np.int64)


def _lists(column) -> Iterator[np.ndarray]:
    """The rows of a list column without nulls, as arrays."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    ends = np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False)).tolist()
    return (flat[a:z] for a, z in zip([0, *ends], ends, strict=False))


def _keys(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """The rows' keys with both hashes of each of their distinct runs and where it begins first."""
    for b in batches:
        found, sizes_of = [], []
        for h, g, sizes in zip(*(_lists(b.column(c)) for c in ("h", "g", "size")), strict=True):
            begins, ends = spans(sizes, least)
            h, g = (_hashed(x.view(_U), begins, ends) for x in (h, g))
            first = np.unique(np.stack((h, g), 1), axis=0, return_index=True)[1] if len(h) else np.zeros(0, np.int64)
            found.append((h[first], g[first], begins[first].astype(np.int32)))
            sizes_of.append(len(first))
        flat = [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)]
        runs = pa.StructArray.from_arrays([pa.array(x) for x in flat], names=["h", "g", "at"])
        runs = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes_of))), pa.int32()), runs)
        yield pa.RecordBatch.from_arrays([b.column("key"), runs], names=["key", "runs"])


def rebuilt(late: list, begins: list, ends: list, runs: list, hits: list) -> list:
    """The lines of an earlier document in its runs ``hits`` [(place there, run)], from the lines of ``late``; None where others stand between."""
    span = dict(zip(reversed(runs), zip(reversed(begins), reversed(ends), strict=True), strict=True))
    place = {}
    for at, run in hits:
        a, z = span[run]
        place.update(zip(range(at, at + z - a), late[a:z], strict=True))
    out, before = [], None
    for at in sorted(place):
        if before is not None and at != before + 1:
            out.append(None)
        out.append(place[at])
        before = at
    return out


def _align(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rid, gone = [], []
        columns = [_lists(b.column(c)) for c in ("h", "g", "size", "place")]
        for r, hits, h, g, sizes, places in zip(b.column("rid").to_pylist(), b.column("hits").to_pylist(), *columns, strict=True):
            begins, ends = spans(sizes, least)
            runs = list(zip(*(_hashed(x.view(_U), begins, ends).tolist() for x in (h, g)), strict=True))
            late = list(zip(h.tolist(), g.tolist(), strict=True))
            of: dict[int, list] = {}
            for x in hits:
                of.setdefault(x["early"], []).append((x["at"], (x["h"], x["g"])))
            found: set[int] = set()
            for own in of.values():
                found.update(common_blocks(rebuilt(late, begins.tolist(), ends.tolist(), runs, own), late, sizes.tolist(), least))
            rid.append(r)
            gone.append(places[sorted(found)].tolist())
        yield pa.RecordBatch.from_arrays([pa.array(rid, pa.int64()), pa.array(gone, pa.list_(pa.int32()))], names=["rid", "gone"])


def _lines(docs: DataFrame, order: str) -> DataFrame:
    """rid, key (order of documents), and for each line with a word its place, two hashes and length."""
    whole = F.split("text", "\n", -1)
    real = F.filter(
        F.transform(
            whole,
            lambda x, k: F.struct(k.alias("place"), F.xxhash64(x).alias("h"), F.xxhash64(F.lit(7), x).alias("g"), F.length(x).alias("size"), x.rlike(r"[^\x20\x09-\x0D]").alias("word")),
        ),
        lambda s: s["word"],
    )
    return docs.select("rid", F.struct(F.coalesce(F.col(order).cast("long"), F.lit((1 << 63) - 1)).alias("o"), "rid").alias("key"), real.alias("lines"))


def _removed(own: DataFrame, least: int) -> DataFrame:
    """(rid, gone): places of the lines to delete. ``own`` has rid, doc_id and text without nulls."""
    spark = own.sparkSession
    lines = common.stored(spark, _lines(own, "doc_id").where(F.size("lines") > 0), "lines")
    kind = "key struct<o: bigint, rid: bigint>, runs array<struct<h: bigint, g: bigint, at: int>>"
    runs = common.stored(spark, lines.select("key", *(F.col(f"lines.{c}").alias(c) for c in ("h", "g", "size"))).mapInArrow(lambda it: _keys(it, least), kind), "runs")
    held = runs.select("key", F.explode("runs").alias("run")).select("key", "run.*")
    # stored, so that both sides of the join are dealt out for it and a run of a third of all documents can be split
    shared = held.groupBy("h", "g").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("key", "at")).alias("first")).where("n > 1")
    shared = common.stored(spark, shared.select("h", "g", F.col("first.key").alias("first"), F.col("first.at").alias("early_at")), "shared")
    hits = held.drop("at").join(shared, ["h", "g"]).where("key <> first")
    hits = common.stored(spark, hits.select(F.col("key.rid").alias("rid"), F.struct(F.col("first.rid").alias("early"), F.col("early_at").alias("at"), "h", "g").alias("hit")), "hits")
    # a document has at most two runs a line, each with one earliest holder
    late = lines.select("rid", *(F.col(f"lines.{c}").alias(c) for c in ("h", "g", "size", "place")))
    sides = late.join(hits.groupBy("rid").agg(F.collect_list("hit").alias("hits")), "rid")
    with common.settings(spark, spark__sql__execution__arrow__maxRecordsPerBatch=500):
        return common.stored(spark, sides.mapInArrow(lambda it: _align(it, least), "rid long, gone array<int>"), "gone")


def deduplicate(docs: DataFrame, least: int = MIN_BLOCK) -> DataFrame:
    """The rows of ``docs`` with all their columns, ``text`` without the deleted lines, and n_removed_lines.

    The earlier document is that with the smaller doc_id (nulls last; equal ids in a fixed order).
    Lines are ``\\n``-split and compared whole; blank ones are no part of a block. Null texts stay null;
    a document may be left empty; an empty table gives no rows. Other columns are carried along, whatever
    their names, but a column n_removed_lines gives way to the new one.
    """
    spark = docs.sparkSession
    docs = docs.drop("n_removed_lines")
    # the user's other columns travel as one, so their names mean nothing here
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("row")
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), row, F.col("doc_id").alias("doc_id"), F.col("text").cast("string").alias("text"))
    own = common.bucketed(spark, rows, "rid", "rows")
    gone = _removed(own.select("rid", "doc_id", F.coalesce("text", F.lit("")).alias("text")), least)
    # the rows stay in their buckets; only the places of deleted lines travel
    marked = own.select("rid", "row", "text").join(gone.hint("shuffle_hash"), "rid", "left").drop("rid")
    schema = T.StructType([marked.schema["row"], T.StructField("text", T.StringType()), T.StructField("n_removed_lines", T.LongType())])

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, removed = [], []
            for t, places in zip(b.column("text").to_pylist(), b.column("gone").to_pylist(), strict=True):
                places = set(places or ()) if t is not None else ()
                texts.append("\n".join(x for k, x in enumerate(t.split("\n")) if k not in places) if places else t)
                removed.append(len(places))
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(texts, pa.string()), pa.array(removed, pa.int64())], names=["row", "text", "n_removed_lines"])

    out = marked.mapInArrow(strip, schema)
    columns = [F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns]
    return out.select(*columns, "n_removed_lines")
