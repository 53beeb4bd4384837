"""Operator 11: token counts from a cache of digests.

The cache is a Parquet table (tokenizer, digest, n_tokens), partitioned by the digest of the tokenizer's file, library and library
version, so that another vocabulary never meets the counts of this one. A text stands in it under the SHA-256 of its
normalised content: null is the empty text, and everything else stays as it is, since a tokenizer that folds case or white space does so
after it has looked for its special strings. A run

1. takes the digest and the length of each text (JVM), and the distinct digests;
2. leaves out those that the cache has, with the tokenizer's partition alone read;
3. brings one text for each digest that is missing: copies fold together in the task that reads them, before they move. Where few are
   missing (a measured number, below BROADCAST_ROWS), their digests are broadcast and no other text moves;
4. encodes these texts, each once, and appends their counts;
5. joins the digests of the rows with the counts.

Counts are facts: a run that repeats another's rows adds equal rows, which reading folds, so writers need no lock and a lost
executor costs its tasks only.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm import common

LIMIT = 1024
BROADCAST_ROWS = 100_000
KNOWN = 1_000_000
PIECE = 1 << 16
CACHE = "digest binary, n_tokens long, tokenizer string"
BEFORE_SPACE = re.compile(r"(?<=\S)(?= \S)")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def version(path: str) -> str:
    """Of a tokenizer: digest of its file, and of the library that runs it."""
    import sentencepiece
    import tokenizers

    library = f"sentencepiece {sentencepiece.__version__}" if path.endswith(".model") else f"tokenizers {tokenizers.__version__}"
    return hashlib.sha256(library.encode() + b"\0" + Path(path).read_bytes()).hexdigest()


def starts_at_spaces(path: str) -> bool:
    """Whether a vocabulary's own words begin at a single blank between other characters, so that a text may be cut there: a byte-level
    one with its usual pattern, no normaliser, and no special string with white space."""
    spec = json.loads(Path(path).read_text("utf-8"))
    parts = spec.get("pre_tokenizer") or {}
    usual = parts.get("type") == "ByteLevel" and parts.get("use_regex") is True and parts.get("add_prefix_space") is False
    plain = not any(t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(r"\s", t["content"]) for t in spec.get("added_tokens", []))
    return usual and plain and not spec.get("normalizer") and not spec.get("post_processor") and not spec["model"].get("dropout")


class Counter:
    """Number of tokens of a text, as the library gives it for the whole text."""

    def __init__(self, path: str, known: int = KNOWN):
        self.by_word = False
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.sizes: Callable = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
        else:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(path)
            model.no_truncation()
            model.no_padding()
            self.sizes = lambda texts: [len(x) for x in model.encode_batch_fast(texts, add_special_tokens=False)]
            self.by_word = starts_at_spaces(path)
        self.limit, self.known = known, {}

    def of(self, text: str) -> int:
        if not self.by_word:
            return self.sizes([text])[0]
        words = BEFORE_SPACE.split(text)
        try:
            return sum(map(self.known.__getitem__, words))
        except KeyError:
            pass
        fresh = [w for w in dict.fromkeys(words) if w not in self.known]
        if len(self.known) + len(fresh) > self.limit:
            self.known.clear()
            fresh = list(dict.fromkeys(words))
        at = 0
        while at < len(fresh):  # some text at a time: what the library returns is many times as large
            to, size = at + 1, len(fresh[at])
            while to < len(fresh) and size < PIECE:
                size += len(fresh[to])
                to += 1
            self.known.update(zip(fresh[at:to], self.sizes(fresh[at:to]), strict=True))
            at = to
        return sum(map(self.known.__getitem__, words))


@functools.cache
def _counter(path: str) -> Counter:
    return Counter(path)


def _encode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    counter = _counter(path)
    for b in batches:
        counts = [counter.of(t) for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("digest").cast(pa.binary()), pa.array(counts, pa.int64())], names=["digest", "n_tokens"])


def known(spark: SparkSession, cache: str, tokenizer: str) -> DataFrame:
    """(digest, n_tokens) that the cache holds for a tokenizer's version; none where there is no cache yet."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(cache)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], CACHE).drop("tokenizer")
    return spark.read.schema(CACHE).parquet(cache).where(F.col("tokenizer") == tokenizer).drop("tokenizer")


def fill(docs: DataFrame, cache: str, path: str) -> tuple[DataFrame, int]:
    """Encodes the texts of ``docs`` that the cache lacks, each once, and appends their counts: the counts of all distinct texts of
    ``docs`` (digest, n_tokens), and how many were missing."""
    spark = docs.sparkSession
    own = version(path)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    digest = F.unhex(F.sha2(text, 256))
    distinct = common.stored(spark, docs.select(digest.alias("digest")).distinct(), "digests")
    missing = common.stored(spark, distinct.join(known(spark, cache, own), "digest", "left_anti"), "missing-digests")
    n = missing.count()
    if n:
        texts = docs.select(digest.alias("digest"), text.alias("text"))
        if n < BROADCAST_ROWS:
            texts = texts.join(F.broadcast(missing), "digest", "left_semi").groupBy("digest").agg(F.first("text").alias("text"))
        else:
            texts = texts.groupBy("digest").agg(F.first("text").alias("text")).join(missing, "digest", "left_semi")
        counts = texts.select("digest", "text").mapInArrow(lambda it: _encode(it, path), "digest binary, n_tokens long")
        counts.withColumn("tokenizer", F.lit(own)).write.mode("append").partitionBy("tokenizer").parquet(cache)
    found = known(spark, cache, own).join(distinct, "digest", "left_semi").groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))
    return common.stored(spark, found, "counts"), n


def count_tokens(docs: DataFrame, cache: str | None = None, tokenizer: str | None = None, limit: int = LIMIT) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_bytes (UTF-8), n_tokens (no special tokens added; special strings in a text as
    the library takes them), over_limit (n_tokens > limit).

    ``cache`` is a folder that driver and executors share; without one, the run starts an empty cache of its own. ``tokenizer`` is
    a path that every worker can open, of a ``.json`` for tokenizers or a ``.model`` for sentencepiece. Null texts are empty ones,
    of no bytes; repeated rows give repeated rows, their text is encoded once; null ids stay; an empty table gives no rows and leaves the
    cache as it is; other columns are ignored.
    """
    spark = docs.sparkSession
    path = tokenizer or default_tokenizer()
    counts, _ = fill(docs, cache or common.scratch(spark, "token-cache"), path)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), F.unhex(F.sha2(text, 256)).alias("digest"))
    return common.stored(spark, rows, "keyed").join(counts, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
