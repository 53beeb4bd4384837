"""What stages take and give: counted while they run, without a second pass over the data."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from scriptorium.sources.scratch import stored

#: seconds in which a finished job's counts arrive
WAIT = 5.0
SCHEMA = "place int, stage string, rows_in bigint, rows_out bigint, bytes_in bigint, bytes_out bigint, seconds double"


def _measured(df: DataFrame, text: str | None) -> tuple[DataFrame, Observation]:
    seen = Observation()
    size = F.octet_length(F.col(f"`{text}`").cast("string")) if text in df.columns else F.lit(None).cast("bigint")
    return df.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(size).alias("bytes")), seen


def run_stages(docs: DataFrame, stages: list[tuple[str, Callable[[DataFrame], DataFrame]]], text: str | None = "text") -> tuple[DataFrame, DataFrame]:
    """(result, telemetry): ``stages`` (name, function of a DataFrame) one after another, each written to the shared folder and read again; per stage
    place, stage, rows_in, rows_out, bytes_in, bytes_out (of the column ``text``; null where there is none), seconds (of writing it).

    Rows are counted by the first job that reads them; rows_in is null for a stage that doesn't read its input.
    """
    spark: SparkSession = docs.sparkSession
    rows = []
    for k, (name, stage) in enumerate(stages, 1):
        before, taken = _measured(docs, text)
        out, given = _measured(stage(before), text)
        began = time.perf_counter()
        docs = stored(out, f"stage-{k}")
        seconds = time.perf_counter() - began
        a, z = _got(taken), _got(given)
        rows.append((k, name, a.get("n"), z.get("n"), a.get("bytes"), z.get("bytes"), seconds))
    return docs, spark.createDataFrame(rows, SCHEMA)


def _got(seen: Observation) -> dict:
    """What was observed; nothing of an input that no job has read. Spark reports it a moment after the job."""
    until = time.monotonic() + WAIT
    while not seen._jo.future().isCompleted():
        if time.monotonic() > until:
            return {}
        time.sleep(0.01)
    return dict(seen.get)
