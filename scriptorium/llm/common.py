"""Plumbing shared by the corpus operators: scratch tables, sessions, text chunks.

Every operator cuts its lineage with Parquet tables below ``spark.checkpoint.dir``
(the folder that driver and executors share), so a lost executor costs a re-read and
not a recomputation of everything before it.
"""

from __future__ import annotations

import contextlib
import math
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.sources.scratch import shared_dir

CHUNK_BYTES = 2 << 20
BATCH_ROWS = 2000


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/scriptorium/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def settings(spark: SparkSession, **conf) -> Iterator[None]:
    """SQL settings that hold while the body runs its own jobs (keys with ``__`` for dots)."""
    keys = {k.replace("__", "."): str(v) for k, v in conf.items()}
    before = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def stored(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back; Python workers get batches of BATCH_ROWS at most."""
    path = scratch(spark, name)
    rows = min(BATCH_ROWS, int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")))
    with settings(spark, spark__sql__execution__arrow__maxRecordsPerBatch=rows):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(spark: SparkSession, df: DataFrame, key: str, name: str) -> DataFrame:
    """``df`` in a table bucketed by ``key`` in the shared folder: joins on the key leave its rows where they are.

    The catalog forgets the table at once; its files stay for the returned DataFrame."""
    path = scratch(spark, name)
    table = f"{name}_{path.rpartition('-')[2]}"
    df.write.option("path", path).option("compression", "zstd").bucketBy(partitions(spark), key).saveAsTable(table)
    out = spark.table(table)
    spark.sql(f"DROP TABLE {table}")
    return out


def unused(names: Iterable[str], wanted: str) -> str:
    """``wanted``, with as many underscores before it as it takes to clash with none of ``names`` (case aside)."""
    taken = {n.lower() for n in names}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def free(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of finished rounds (its cleaner follows the driver's GC)."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def chunk_rows(batches: Iterator[pa.RecordBatch], chunk_bytes: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Packs (doc_id, text) rows into rows of about ``chunk_bytes``: one blob of texts each.

    A text is never split; a chunk holds one text at least. Null texts are empty texts.
    """
    from pyspark import TaskContext

    part, seq = TaskContext.get().partitionId(), 0
    ids: list = []
    texts: list[bytes] = []
    size = 0

    def row():
        lens = np.fromiter(map(len, texts), np.int64, len(texts))
        return pa.RecordBatch.from_arrays(
            [
                pa.array([(part << 32) + seq], pa.int64()),
                pa.array([ids], pa.list_(pa.int64())),
                pa.array([lens.tobytes()], pa.binary()),
                pa.array([b"".join(texts)], pa.binary()),
            ],
            names=["chunk", "ids", "lens", "blob"],
        )

    for b in batches:
        for i, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
            ids.append(i)
            texts.append(t or b"")
            size += len(texts[-1])
            if size >= chunk_bytes:
                yield row()
                ids, texts, size, seq = [], [], 0, seq + 1
    if ids:
        yield row()


CHUNK_SCHEMA = "chunk long, ids array<long>, lens binary, blob binary"


def id_text(docs: DataFrame) -> DataFrame:
    """The two columns an operator on whole texts reads."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def buckets_for(spark: SparkSession, amount: float, per_bucket: float) -> int:
    return max(partitions(spark), math.ceil(amount / per_bucket))
