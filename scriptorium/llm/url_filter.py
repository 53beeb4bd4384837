"""Operator 4: URL rules and blocklists in a sorted digest array.

Each entry (a host and a path prefix) is one 64-bit xxhash key in a sorted array, with the
entry's full string beside it. The array is cut by key ranges into shards of a bounded size, written by the cluster from a table of
entries of any length; every executor copies the shards once and its workers map them into memory. Keys of URLs (one for
each host suffix and path length that an entry has) are computed in the JVM; a batch is probed with one vectorised
binary search a shard, and a hit counts only if the stored string is the one asked for.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm import common

#: (verdict, host, path) of the production rules
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: special-use names (RFC 2606, 6762, 7686): no public page stands under them
BLOCKED_HOSTS = ("example", "invalid", "local", "localhost", "onion", "test")
SHARD_BYTES = 64 << 20
BLOCK, RULE = 1, 2  # flags of an entry
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _key(text: Column) -> Column:
    return F.xxhash64(text)


def entries_of(spark: SparkSession, rules: Iterable[tuple[str, str, str]] = (), blocked: Iterable[str] | DataFrame = ()) -> DataFrame:
    """(host, path, flags) of rules (verdict, host, path) and of blocked hosts (names, or a table with a column host). Of equal
    hosts and paths one stays: a rule rather than a blocked host, a block rather than an allowance. Null hosts are no entry."""
    kind = "host string, path string, flags int"
    out = spark.createDataFrame([(h, p, RULE + (v == "block") * BLOCK) for v, h, p in rules], kind)
    hosts = blocked.select("host") if isinstance(blocked, DataFrame) else spark.createDataFrame([(h,) for h in blocked], "host string")
    out = out.union(hosts.where("host is not null").select("host", F.lit("").alias("path"), F.lit(BLOCK).alias("flags")))
    return out.groupBy("host", "path").agg(F.max("flags").alias("flags"))


def pack_shard(keys: np.ndarray, strings: list[bytes], flags: np.ndarray, lengths: np.ndarray) -> bytes:
    """n, keys in ascending order, string offsets, flags, path lengths and the strings, ready to map."""
    ends = np.cumsum([0, *map(len, strings)])
    return b"".join([np.array([len(keys)], np.int64).tobytes(), *(np.asarray(x, np.int64).tobytes() for x in (keys, ends, flags, lengths)), *strings])


class Shard:
    """A mapped shard."""

    def __init__(self, raw: np.ndarray):
        n = int(raw[:8].view(np.int64)[0])
        at, fields = 8, []
        for size in (n, n + 1, n, n):
            fields.append(raw[at : at + 8 * size].view(np.int64))
            at += 8 * size
        self.keys, self.ends, self.flags, self.lengths = fields
        self.strings = raw[at:]

    def string(self, k: int) -> str:
        return self.strings[self.ends[k] : self.ends[k + 1]].tobytes().decode()

    def find(self, keys: np.ndarray, lengths: np.ndarray, text) -> tuple[np.ndarray, np.ndarray]:
        """(probe, entry) of the probes whose string ``text(probe)`` and path length an entry has."""
        at = np.searchsorted(self.keys, keys)
        probe = np.flatnonzero(at < len(self.keys))
        at = at[probe]
        found = [np.zeros((0, 2), np.int64)]
        asked: dict[int, str] = {}
        stored: dict[int, str] = {}
        while len(probe):  # equal keys stand together: one pass, but for collisions
            same = self.keys[at] == keys[probe]
            probe, at = probe[same], at[same]
            alike = self.lengths[at] == lengths[probe]
            for k, p in zip(at[alike].tolist(), probe[alike].tolist(), strict=True):
                if k not in stored:
                    stored[k] = self.string(k)
                if p not in asked:
                    asked[p] = text(p)
            right = alike.copy()
            right[alike] = [stored[k] == asked[p] for k, p in zip(at[alike].tolist(), probe[alike].tolist(), strict=True)]
            found.append(np.stack((probe[right], at[right]), 1))
            more = ~right & (at + 1 < len(self.keys))
            probe, at = probe[more], at[more] + 1
        both = np.concatenate(found)
        return both[:, 0], both[:, 1]


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [b for b in batches if b.num_rows]
    if parts:
        t = pa.Table.from_batches(parts)
        strings = [x.encode() for x in t.column("text").to_pylist()]
        blob = pack_shard(*(t.column(c).to_numpy() if c != "text" else strings for c in ("key", "text", "flags", "length")))
        yield pa.RecordBatch.from_arrays([pa.array([t.column("key")[0].as_py()], pa.int64()), pa.array([blob], pa.binary())], names=["first", "blob"])


def publish(entries: DataFrame, shard_bytes: int = SHARD_BYTES) -> tuple[list[tuple[int, str]], list[int]]:
    """Writes the index of ``entries`` to the shared folder, shard by shard, and has each executor copy them: (first key, file
    name) of each shard in order, and the path lengths that entries have. The driver holds one shard at a time."""
    spark = entries.sparkSession
    text = F.concat("host", "path")
    own = entries.select(_key(text).alias("key"), text.alias("text"), F.col("flags").cast("long").alias("flags"), F.length("path").cast("long").alias("length"))
    own = common.stored(spark, own, "url-entries")
    size = own.agg(F.coalesce(F.sum(F.octet_length("text") + 40), F.lit(0))).first()[0]
    lengths = sorted(r[0] for r in own.select("length").distinct().collect())  # bounded by the longest path
    n = max(1, math.ceil(size / shard_bytes))
    shards = own.repartitionByRange(n, "key").sortWithinPartitions("key").mapInArrow(_pack, "first long, blob binary")
    folder, sc = common.scratch(spark, "urls"), spark.sparkContext
    out = []
    for first, blob in common.stored(spark, shards, "url-shards").orderBy("first").toLocalIterator():
        name = f"urls-{hashlib.sha256(blob).hexdigest()[:24]}.index"
        path = sc._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        file = path.getFileSystem(sc._jsc.hadoopConfiguration()).create(path, True)
        file.write(bytes(blob))
        file.close()
        if not any(f.endswith("/" + name) for f in sc.listFiles):
            sc.addFile(path.toString())
        out.append((first, name))
    return out, lengths


_open: dict[str, Shard] = {}


def _mapped(name: str) -> Shard:
    if name not in _open:
        _open[name] = Shard(np.memmap(SparkFiles.get(name), np.uint8, "r"))
    return _open[name]


def _suffix(host: str, labels: int) -> str:
    """``host`` without its first ``labels`` labels."""
    return host.split(".", labels)[labels]


def _judge(batches: Iterator[pa.RecordBatch], shards: list[tuple[int, str]], lengths: list[int]) -> Iterator[pa.RecordBatch]:
    firsts = np.array([f for f, _ in shards], np.int64)
    each = np.array(lengths, np.int64)
    for b in batches:
        hosts, paths = b.column("host").to_pylist(), b.column("path").to_pylist()
        lists = b.column("keys")
        flat = lists.flatten()
        sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(hosts)), sizes)
        place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        real = flat.is_valid().to_numpy(zero_copy_only=False)
        key, row, place = flat.fill_null(0).to_numpy(zero_copy_only=False)[real], row[real], place[real]
        labels, length = place // max(1, len(each)), each[place % max(1, len(each))] if len(each) else place
        shard = np.searchsorted(firsts, key, "right") - 1
        best: dict[int, tuple] = {}
        listed = set()
        for k in np.unique(shard[shard >= 0]).tolist():
            own = np.flatnonzero(shard == k)
            index = _mapped(shards[k][1])
            r, n, skip = row[own], length[own], labels[own]
            for p, e in zip(*index.find(key[own], n, lambda p, r=r, n=n, skip=skip: _suffix(hosts[r[p]], skip[p]) + paths[r[p]][: n[p]]), strict=True):
                i, flags = int(r[p]), int(index.flags[e])
                if flags & RULE:
                    text = index.string(e)
                    best[i] = max(best.get(i, ((0, 0), "", 0)), ((len(text), len(text) - int(n[p])), text, flags))
                else:
                    listed.add(i)
        rules = [best[i][1] if i in best else None for i in range(len(hosts))]
        verdicts = ["block" if (best[i][2] & BLOCK if i in best else i in listed) else "allow" for i in range(len(hosts))]
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("page_id", "host", "path")), pa.array(rules, pa.string()), pa.array(verdicts, pa.string())], names=["page_id", "host", "path", "rule", "verdict"])


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path): both empty for a null or a URL without ``://``."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    raw = F.regexp_extract(rest, "^[^/?#]*", 0)
    return F.translate(raw, _UPPER, _LOWER), F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.length(rest)), "^[^?#]*", 0)


def judge(pages: DataFrame, rules=RULES, blocked: Iterable[str] | DataFrame = BLOCKED_HOSTS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row per row of ``pages`` (page_id, url): page_id, host, path, rule, verdict.

    A rule fits its host and all subdomains where the path starts with the rule's; the longest wins (of
    equally long ones that with the longer host). Where no rule fits, ``blocked`` hosts (names, or a table of any size with a
    column host) and their subdomains are blocked and all else is allowed. A null URL or one without ``://`` has
    empty host and path, fits nothing and is allowed; repeated rows and nulls stay; an empty
    table gives no rows; other columns are ignored.
    """
    shards, lengths = publish(entries_of(pages.sparkSession, rules, blocked), shard_bytes)
    host, path = parts(F.col("url").cast("string"))
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    labels = F.split("host", r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    probes = F.flatten(F.transform(suffixes, lambda s: F.array(*(F.when(F.length("path") >= n, _key(F.concat(s, F.substring("path", 1, n)))) for n in lengths))))
    none = F.array().cast("array<bigint>")
    own = own.withColumn("keys", F.when(F.col("host") != "", probes).otherwise(none) if lengths else none)
    return own.mapInArrow(lambda it: _judge(it, shards, lengths), "page_id long, host string, path string, rule string, verdict string")


SQL = r"""
WITH u AS (
  SELECT page_id, url, strpos(coalesce(url, ''), '://') AS cut FROM pages),
h AS (
  SELECT page_id, CASE WHEN cut = 0 THEN '' ELSE regexp_extract(substr(url, cut + 3), '^[^/?#]*') END AS raw,
    CASE WHEN cut = 0 THEN '' ELSE substr(url, cut + 3) END AS rest FROM u),
p AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
r AS (
  SELECT *, CASE
    WHEN ('.' || host) LIKE '%.example.org' AND path LIKE '/en/1%' THEN 'example.org/en/1'
    WHEN ('.' || host) LIKE '%.example.org' AND path LIKE '/es/%' THEN 'example.org/es/'
    WHEN ('.' || host) LIKE '%.org' AND path LIKE '/%' THEN 'org/'
    WHEN ('.' || host) LIKE '%.com' AND path LIKE '/fr/%' THEN 'com/fr/'
    WHEN ('.' || host) LIKE '%.com' AND path LIKE '/de/%' THEN 'com/de/' END AS rule FROM p),
blocked AS (SELECT DISTINCT host FROM p WHERE host <> '' AND page_id IN (SELECT doc_id FROM labels WHERE quality = 0))
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
    WHEN EXISTS (SELECT 1 FROM blocked b WHERE ends_with('.' || r.host, '.' || b.host)) THEN 'block' ELSE 'allow' END AS verdict
FROM r"""
