"""Corrections as they come: accepted suggestions reach the texts and the profiles once, histories grow by their events."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from scriptorium.operators import proofreading

KEYS = ("doc_id", "suggestion_id")


def apply_with_feedback(docs: DataFrame, accepted: DataFrame, keys: tuple[str, ...] = ("doc_id",), text: str = "text", user: str = "user_id") -> tuple[DataFrame, DataFrame]:
    """(documents with corrected_text, feedback): the accepted suggestions (keys, user, suggestion_id, begin, stop, original, proposed) applied to
    their documents, and each of them as an event (user_id, doc_id..., suggestion_id, original, accepted) for its user's profile. A
    suggestion that is there twice counts once."""
    once = accepted.dropDuplicates([*keys, "suggestion_id"])
    events = once.select(F.col(user).alias("user_id"), *keys, "suggestion_id", "original", F.col("proposed").alias("accepted"))
    return proofreading.apply(docs, text, once, keys), events


# -- a ledger of feedback --------------------------------------------------


def _exists(spark: SparkSession, path: str) -> bool:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)


def entries(spark: SparkSession, path: str, schema) -> DataFrame:
    """All feedback of a ledger; none where there is no ledger yet."""
    return spark.read.schema(schema).parquet(path) if _exists(spark, path) else spark.createDataFrame([], schema)


def to_ledger(stream: DataFrame, path: str, checkpoint: str, keys: tuple[str, ...] = KEYS) -> StreamingQuery:
    """Feedback (``keys``: which correction; any other columns) into a ledger, each correction once: what there is, in batches.

    A batch is a folder of the ledger, named by the stream (an id kept in the checkpoint) and the batch, and is written over when it is
    repeated. What other batches have is left out, so neither a batch that is replayed nor a stream that starts anew over the same
    events changes the ledger. Of the ledger only ``keys`` are read for that, once a batch.
    """
    schema, spark = stream.schema, stream.sparkSession
    name = _stream_name(spark, checkpoint)

    def write(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        own = f"stream={name}/batch={number}"
        new = batch.dropDuplicates(list(keys))
        if _exists(session, path):
            known = session.read.schema(schema).option("basePath", path).parquet(path).select(*keys, F.col("_metadata.file_path").alias("__file"))
            new = new.join(known.where(~F.contains("__file", F.lit(f"/{own}/"))).drop("__file"), list(keys), "left_anti")
        new.write.mode("overwrite").parquet(f"{path}/{own}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _stream_name(spark: SparkSession, checkpoint: str) -> str:
    """An id that stays with the checkpoint."""
    file = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}-name")
    fs = file.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(file):
        out = fs.create(file, False)
        out.write(bytearray(uuid.uuid4().hex.encode()))
        out.close()
    return spark.read.text(file.toString()).first()[0]


# -- histories -------------------------------------------------------------


class History(StatefulProcessor):
    """Undo and redo of one key: texts by their place, and where it stands. An event reads and writes the texts that it touches, however
    long the history is; events up to the last one seen are replays and change nothing."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.texts = handle.getMapState("texts", "place int", "text string")
        self.at = handle.getValueState("at", "place int, top int, last long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        place, top, last = self.at.get() if self.at.exists() else (-1, -1, None)
        events = pd.concat(rows).sort_values(["ord", "action", "text"], kind="stable")
        out = []
        for event, action, text in zip(events["ord"], events["action"], events["text"], strict=True):
            event = int(event)
            if last is not None and event <= last:
                continue
            last = event
            if action == "push":
                place = top = place + 1
                self.texts.updateValue((place,), (text,))
            elif action == "undo" and place > 0:
                place -= 1
            elif action == "redo" and place < top:
                place += 1
            out.append((*key, event, place, self.texts.getValue((place,))[0] if place >= 0 else None))
        self.at.update((place, top, last))
        if out:
            yield pd.DataFrame(out, columns=[*(f"k{i}" for i in range(len(key))), "ord", "place", "current"])

    def close(self) -> None:
        pass


def live_history(actions: DataFrame, keys: list[str]) -> DataFrame:
    """:func:`proofreading.history` of a stream of actions (keys, ord, action, text): a row for each event as it comes. The order of a key's
    events is that of ``ord``, and one that comes behind a later one of its key is left out. The state is kept by RocksDB
    (``spark.sql.streaming.stateStore.providerClass``)."""
    types = dict(actions.dtypes)
    schema = ", ".join([*(f"k{i} {types[c]}" for i, c in enumerate(keys)), "ord long, place int, current string"])
    own = actions.select(*keys, F.col("ord").cast("long").alias("ord"), "action", "text")
    out = own.groupBy(*keys).transformWithStateInPandas(statefulProcessor=History(), outputStructType=schema, outputMode="Append", timeMode="None")
    return out.toDF(*keys, "ord", "place", "current")


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
