"""Operator 6: WARC records and Merkle fixity audits.

Records are hashed (SHA-256), and ordered ranges of record offsets into trees: a leaf is a record
with its file, place, offset and length; a node is the hash of its up to FAN children, each with its
offset range. Two replicas agree when their roots agree; otherwise only the children of
nodes that differ are compared, level by level, down to the damaged records.

Records are hashed where their pages are read: only digests and lengths are sorted into files. Places and offsets come from
evenly cut ranges of the sorted digests, so neither many copies of a page_id nor a large file is one task's work.
"""

from __future__ import annotations

import gzip
import io
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import BinaryIO
from urllib.parse import unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptorium.llm import common

FAN = 16
PER_FILE = 1024
TASK_RECORDS = 500_000
READ = 4 << 20  # bytes read at once
VERSION = "WARC/1.0"


def _record() -> Column:
    html, url = F.coalesce(F.col("html").cast("string"), F.lit("")), F.coalesce(F.col("url").cast("string"), F.lit(""))
    page = F.col("page_id").cast("long")
    return F.concat(
        F.lit(f"{VERSION}\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page.cast("string"), F.lit("")), F.lit(">\r\nWARC-Target-URI: "), url,
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(html).cast("string"), F.lit("\r\n\r\n"), html, F.lit("\r\n\r\n"),
    )


def records(pages: DataFrame, per_file: int = PER_FILE) -> DataFrame:
    """``pages`` (page_id, url, html) as WARC response records: page_id, file, digest (SHA-256), length (bytes), record.

    Files hold the pages of ``per_file`` consecutive page_ids in the order of page_id and digest (negative ids and, by their
    hash, null ids have files of their own). Null urls and bodies are empty; repeated rows are records of their own; an empty
    table gives none; other columns are ignored.
    """
    page = F.col("page_id").cast("long")
    own = pages.select(page.alias("page_id"), _record().alias("record")).withColumn("digest", F.sha2("record", 256))
    page = F.col("page_id")
    # never negative, so that halving file numbers ends at one root
    file = F.when(page >= 0, F.floor(page / per_file)).when(page < 0, F.floor(-page / per_file) + (1 << 41)).otherwise(F.conv(F.substring("digest", 1, 3), 16, 10).cast("long") + (1 << 42))
    return own.select("page_id", file.cast("long").alias("file"), "digest", F.octet_length("record").cast("long").alias("length"), "record")


def leaves(archive: DataFrame) -> DataFrame:
    """The records of ``archive`` (page_id, file, digest, length) at their places: page_id, file, seq, start, length, digest."""
    spark = archive.sparkSession
    slim = common.stored(spark, archive.select("page_id", "file", "digest", "length"), "digests")
    order = ("file", "page_id", "digest")
    n = common.buckets_for(spark, slim.count(), TASK_RECORDS)
    # equal records are dealt out by a salt: which of them comes first makes no difference
    cut = slim.withColumn("salt", F.rand(7)).repartitionByRange(n, *order, "salt").withColumn("part", F.spark_partition_id())
    cut = common.stored(spark, cut, "ranges")
    sums = cut.groupBy("file", "part").agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("bytes"))
    before = Window.partitionBy("file").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("file", "part", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("n", "bytes")))
    within = Window.partitionBy("file", "part").orderBy(*order, "salt")
    upto = F.sum("length").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("length")
    placed = cut.withColumn("seq", F.row_number().over(within) - 1).withColumn("start", upto).join(sums, ["file", "part"])
    placed = placed.select("page_id", "file", (F.col("seq") + F.col("n_before")).alias("seq"), (F.col("start") + F.col("bytes_before")).alias("start"), "length", "digest")
    return common.stored(spark, placed, "leaves")


@dataclass
class Shape:
    """Levels of a tree above its records: inside files, then over file numbers."""

    in_file: int
    over_files: int

    @classmethod
    def of(cls, *sides: DataFrame) -> Shape:
        """The smallest that leads every side to one root."""
        most = [side.agg(F.max("seq"), F.max("file")).first() for side in sides]
        seq, file = (max((r[k] or 0) for r in most) for k in (0, 1))
        levels = [0, 0]
        for k, top in enumerate((seq, file)):
            while top:
                top //= FAN
                levels[k] += 1
        return cls(*levels)


def _parent(level: int, shape: Shape) -> list[Column]:
    """(file, seq) of the node above a node of ``level``."""
    if level < shape.in_file:
        return [F.col("file"), F.floor(F.col("seq") / FAN).alias("seq")]
    return [F.floor(F.col("file") / FAN).alias("file"), F.lit(0).cast("long").alias("seq")]


def tree(leaf: DataFrame, shape: Shape | None = None) -> list[DataFrame]:
    """Levels of (file, seq, start, stop, digest), from the records (as from :func:`leaves`) up to the root. First each file to its
    root, then files by their numbers. No records give empty levels."""
    spark = leaf.sparkSession
    shape = shape or Shape.of(leaf)
    out = [leaf.select("file", "seq", "start", (F.col("start") + F.col("length")).alias("stop"), "digest")]
    for k in range(shape.in_file + shape.over_files):
        child = F.struct(F.col("file").alias("f"), F.col("seq").alias("s"), F.concat_ws(":", "file", "seq", "start", "stop", "digest").alias("text"))
        names = F.array_join(F.transform(F.array_sort(F.collect_list(child)), lambda c: c["text"]), "\n")
        level = out[-1].groupBy(*_parent(k, shape)).agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.sha2(names, 256).alias("digest"))
        out.append(common.stored(spark, level, "level"))
    return out


def audit(ours: list[DataFrame], theirs: list[DataFrame], shape: Shape) -> DataFrame:
    """(file, seq) of the records that differ or stand on one side only, found by descent from the roots of two trees of one
    shape. Equal roots end the descent; empty archives on both sides give no rows."""
    spark = ours[0].sparkSession
    suspects = None
    for k in range(len(ours) - 1, -1, -1):
        a, b = (x.select("file", "seq", F.struct("start", "stop", "digest").alias(n)) for x, n in ((ours[k], "a"), (theirs[k], "b")))
        if suspects is not None:
            above = [p.alias(n) for p, n in zip(_parent(k, shape), ("pf", "ps"), strict=True)]
            up = suspects.toDF("pf", "ps")
            a, b = (x.select("*", *above).join(up, ["pf", "ps"], "left_semi").drop("pf", "ps") for x in (a, b))
        diff = a.join(b, ["file", "seq"], "full_outer").where("NOT (a <=> b)").select("file", "seq")
        suspects = common.stored(spark, diff, "suspects")
        if suspects.isEmpty():
            break
    return suspects


def fixity(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """One row per record of ``ours`` (as from :func:`records`): page_id, warc_file, record_offset, record_length, sha256, intact:
    whether the replica ``theirs`` has the same record in the same file, at its place or moved by others that were lost or added.

    Null page_ids are records like others, repeated records have places of their own, an empty replica leaves none intact,
    an empty archive gives no rows.
    """
    mine, other = leaves(ours), leaves(theirs)
    shape = Shape.of(mine, other)
    differ = audit(tree(mine, shape), tree(other, shape), shape)
    # of the records that differ by place, those that the replica's differing places hold too have only moved: a lost record shifts all
    # that follow it in its file, and is the only one that is missing
    same, number = ["file", "page_id", "digest"], F.row_number().over(Window.partitionBy("file", "page_id", "digest").orderBy("seq"))
    a, b = (side.join(differ, ["file", "seq"], "left_semi").select(*same, "seq", number.alias("k")) for side in (mine, other))
    there = b.select(*(F.col(c).alias(f"b_{c}") for c in same), F.col("k").alias("b_k"))
    damaged = a.join(there, [F.col(c).eqNullSafe(F.col(f"b_{c}")) for c in same] + [F.col("k") == F.col("b_k")], "left_anti")
    out = mine.join(damaged.select("file", "seq").withColumn("damaged", F.lit(True)), ["file", "seq"], "left")
    return out.select(
        "page_id", F.col("file").alias("warc_file"), F.col("start").alias("record_offset"), F.col("length").alias("record_length"), F.col("digest").alias("sha256"), F.col("damaged").isNull().alias("intact")
    )


# -- files -----------------------------------------------------------------


class Damaged(ValueError):
    """A WARC file that can't be read on from an offset."""


def _filled(stream: BinaryIO, buffer: bytearray, n: int) -> bool:
    """Reads until ``buffer`` has ``n`` bytes; false at the end of the stream."""
    while len(buffer) < n:
        got = stream.read(max(READ, n - len(buffer)))
        if not got:
            return False
        buffer += got
    return True


def _record_at(read: Callable[[int], bool], buffer: bytearray, at: int) -> tuple[dict[str, str], bytes, int]:
    """Headers, payload and length of the record that ``buffer`` begins with; ``read`` fills it to a size."""
    end = buffer.find(b"\r\n\r\n")
    while end < 0:
        if not read(len(buffer) + 1):
            raise Damaged(f"no end of the headers after offset {at}")
        end = buffer.find(b"\r\n\r\n")
    head = bytes(buffer[:end])
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise Damaged(f"no record at offset {at}")
    n = _length(head)
    if n is None:
        raise Damaged(f"no Content-Length at offset {at}")
    size = end + 4 + n
    if not read(size):
        raise Damaged(f"the record at offset {at} is cut off")
    whole = size + 4 if read(size + 4) or len(buffer) >= size + 4 else len(buffer)
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}, bytes(buffer[end + 4 : size]), whole


def parse(data: bytes | BinaryIO) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, headers with lower-case names, payload) of the records of a WARC file (bytes, or a stream that is read
    once), plain or gzip by record. One record is held at a time. A record without Content-Length, or cut off, raises
    :class:`Damaged`, as what follows can't be found; an empty file has no records."""
    stream = io.BytesIO(data) if isinstance(data, bytes) else data
    buffer, at = bytearray(), 0
    while _filled(stream, buffer, 2):
        if buffer[:2] == b"\x1f\x8b":
            inflate, raw, used = zlib.decompressobj(31), bytearray(), 0
            while not inflate.eof:
                if used == len(buffer) and not _filled(stream, buffer, used + 1):
                    raise Damaged(f"the member at offset {at} is cut off")
                raw += inflate.decompress(bytes(buffer[used:]))
                used = len(buffer)
            used -= len(inflate.unused_data)
            headers, body, _ = _record_at(lambda n, raw=raw: len(raw) >= n, raw, at)
        else:
            headers, body, used = _record_at(lambda n: _filled(stream, buffer, n), buffer, at)
        yield at, used, headers, body
        del buffer[:used]
        at += used


def _length(head: bytes) -> int | None:
    m = re.search(rb"(?im)^content-length:[ \t]*(\d+)", head)
    return int(m[1]) if m else None


def compress(record: bytes) -> bytes:
    return gzip.compress(record, mtime=0)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(path, start, length, url, payload, error) of the response records below ``path``.

    Files are listed by Spark and read as streams by the workers through the file system of ``path`` (pyarrow's), a record at a
    time, so their size is not bounded. A damaged file gives the records before the damage and one row with an ``error``, its
    other columns but path and start null. Files without records give no rows.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    kinds = {"path": pa.string(), "start": pa.int64(), "length": pa.int64(), "url": pa.string(), "payload": pa.binary(), "error": pa.string()}

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(got):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*got, strict=True), kinds.values(), strict=True)], names=list(kinds))

        for b in batches:
            for p in b.column("path").to_pylist():
                files, inside = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", p))
                got, size, end = [], 0, 0
                with files.open_input_stream(unquote(inside) if p.startswith("file:") else inside, compression=None) as stream:
                    try:
                        for start, n, headers, body in parse(stream):
                            end = start + n
                            if headers.get("warc-type") == "response":
                                got.append((p, start, n, headers.get("warc-target-uri"), body, None))
                                size += len(body)
                            if size > READ:
                                yield batch(got)
                                got, size = [], 0
                    except (Damaged, zlib.error) as e:
                        got.append((p, end, None, None, None, str(e)))
                if got:
                    yield batch(got)

    return listed.mapInArrow(rows, "path string, start long, length long, url string, payload binary, error string")


def replica_with_damage(pages: DataFrame) -> DataFrame:
    """A second copy of ``pages`` whose bodies have a wrong first byte where page_id mod 97 is 13."""
    hit = (F.col("page_id") % 97 == 13) & (F.length("html") > 0)
    return pages.withColumn("html", F.when(hit, F.concat(F.lit("#"), F.expr("substring(html, 2)"))).otherwise(F.col("html")))


SQL = r"""
WITH p AS (
  SELECT page_id, CAST(floor(page_id / 1024) AS BIGINT) AS warc_file,
    'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '')
    || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS record,
    NOT (page_id % 97 = 13 AND length(coalesce(html, '')) > 0 AND html NOT LIKE '#%') AS intact
  FROM pages)
SELECT page_id, warc_file, CAST(coalesce(sum(strlen(record)) OVER (PARTITION BY warc_file ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS record_offset,
  CAST(strlen(record) AS BIGINT) AS record_length, sha256(record) AS sha256, intact
FROM p"""
