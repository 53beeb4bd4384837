"""Question-and-answer rounds between text chunks and key buckets.

Chunks of text hold the state; buckets hold one slice of a key space. In each round a
chunk sends every bucket one blob of its distinct keys, the bucket compares the keys of
all chunks, and a blob of answers goes back. Only keys and answers move: texts are written
once, bucketed by chunk, and joined with their answers without another shuffle. A key
that a third of the corpus shares costs a bucket one entry per *chunk*, not per occurrence.

What a chunk asks is written as a Python generator that yields requests and receives the
answers, so a round replays the answers stored so far and stops at the next question.
"""

from __future__ import annotations

from collections.abc import Callable, Generator, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm import common

Protocol = Callable[[np.ndarray, np.ndarray, list], Generator]


@dataclass
class Table:
    """Chunks bucketed by chunk."""

    spark: SparkSession
    chunks: DataFrame
    n_bytes: int

    @classmethod
    def write(cls, docs: DataFrame, chunk_bytes: int = common.CHUNK_BYTES) -> Table:
        spark = docs.sparkSession
        rows = common.id_text(docs).mapInArrow(lambda it: common.chunk_rows(it, chunk_bytes), common.CHUNK_SCHEMA)
        rows = rows.withColumn("size", F.octet_length("blob").cast("long"))
        with common.settings(spark, spark__sql__execution__arrow__maxRecordsPerBatch=1000):
            chunks = common.bucketed(spark, rows, "chunk", "chunks")
        return cls(spark, chunks, chunks.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0])

    def rows(self, answers: list[DataFrame]) -> DataFrame:
        """Chunks with the answers of each round: array<struct<bucket, bits>>, in columns a0, a1, ..."""
        out = self.chunks.drop("size")
        for k, a in enumerate(answers):
            own = a.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "bits")).alias(f"a{k}"))
            out = out.join(own.hint("shuffle_hash"), "chunk", "left")
        return out


def replay(batches: Iterator[pa.RecordBatch], protocol: Protocol, n_rounds: int) -> Iterator[tuple[int, list, object]]:
    """(chunk, ids, next request or result) for each chunk."""
    for batch in batches:
        for row in range(batch.num_rows):
            chunk, ids = batch.column("chunk")[row].as_py(), batch.column("ids")[row].as_py()
            blob = np.frombuffer(batch.column("blob")[row].as_buffer() or b"", np.uint8)
            lens = np.frombuffer(batch.column("lens")[row].as_py(), np.int64)
            run = protocol(blob, lens, ids)
            try:
                out = next(run)
                for k in range(n_rounds):
                    got = batch.column(f"a{k}")[row].as_py() or []
                    out = run.send(b"".join(x["bits"] for x in sorted(got, key=lambda x: x["bucket"])))
            except StopIteration as stop:
                out = stop.value
            yield chunk, ids, out


def ask(table: Table, answers: list[DataFrame], protocol: Protocol, answer: Callable, n_buckets: int, name: str) -> DataFrame:
    """One round. A request is a list of (bucket, message) with ascending buckets; ``answer`` turns the messages
    of a bucket, in the order of their chunks, into one answer each."""
    k = len(answers)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, _, request in replay(batches, protocol, k):
            if request:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b for b, _ in request], pa.int32()), pa.array([chunk] * len(request), pa.int64()), pa.array([m for _, m in request], pa.binary())],
                    names=["bucket", "chunk", "message"],
                )

    def reply(group: pa.Table) -> pa.Table:
        group = group.sort_by("chunk")
        got = answer(group.column("message").to_pylist())
        return pa.table({"bucket": group.column("bucket"), "chunk": group.column("chunk"), "bits": pa.array(got, pa.binary())})

    spark = table.spark
    messages = table.rows(answers).mapInArrow(send, "bucket int, chunk long, message binary")
    out = messages.repartition(n_buckets, "bucket").groupBy("bucket").applyInArrow(reply, "bucket int, chunk long, bits binary")
    out = common.stored(spark, out, name)
    common.free(spark)
    return out


# -- keys ------------------------------------------------------------------


def bucket_of(keys: np.ndarray, n_buckets: int) -> np.ndarray:
    """Ascending in the key, so sorted keys are sorted by bucket."""
    return ((keys >> np.uint64(32)) * np.uint64(n_buckets)) >> np.uint64(32)


def split(buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of an ascending array and where each begins (with the end)."""
    if not len(buckets):
        return buckets, np.zeros(1, np.int64)
    at = np.flatnonzero(np.diff(buckets)) + 1
    at = np.concatenate(([0], at, [len(buckets)]))
    return buckets[at[:-1]], at


def group(cls: np.ndarray, item: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, begins, number): a sort by (cls, item), where each distinct pair begins in it, and its number per row."""
    order = np.argsort(cls, kind="stable") if item is None else np.lexsort((item, cls))
    c = cls[order]
    new = np.ones(len(c), bool)
    if len(c):
        new[1:] = c[1:] != c[:-1]
        if item is not None:
            i = item[order]
            new[1:] |= i[1:] != i[:-1]
    return order, np.flatnonzero(new), np.cumsum(new) - 1
