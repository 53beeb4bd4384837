"""A store of profiles: a table of versions with an atomic log, for any number of readers and writers.

A version adds rows (whole profiles of the users that it changes) in a folder of its own, and becomes visible when its entry in the log
appears: ``_log/<version>`` is written beside and renamed into place, which fails if that version is there already. A writer names
the version that it has read; if another has committed since, its entry is refused (:class:`Conflict`) and nothing of it is
visible. Readers of a version see the same rows for ever. A user's profile is the newest of its rows.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions import lexicons as lx
from scriptorium.operators import profiles

RETRIES = 20
VERSION = "1.0.0"
#: fixed values of a new profile
STYLE = {"avg_stroke_width": 2.5, "avg_letter_spacing": 1.2, "slant": "vertical", "uppercase_frequency": 0.15}

SCHEMA = """user_id string, documents_processed bigint, corrections_accepted bigint, systematic_errors map<string,bigint>, custom_vocabulary map<string,bigint>,
character_confusions map<string,map<string,double>>, writing_style struct<avg_stroke_width:double,avg_letter_spacing:double,slant:string,uppercase_frequency:double>, version string"""


class Conflict(Exception):
    """Another writer has committed the version."""


def _hadoop(spark: SparkSession):
    return spark.sparkContext._jvm.org.apache.hadoop, spark.sparkContext._jsc.hadoopConfiguration()


def _entries(spark: SparkSession, path: str) -> dict[int, str]:
    """Versions in the log, with their files."""
    hadoop, conf = _hadoop(spark)
    log = hadoop.fs.Path(f"{path}/_log")
    fs = log.getFileSystem(conf)
    if not fs.exists(log):
        return {}
    names = (s.getPath() for s in fs.listStatus(log))
    return {int(p.getName()): p.toString() for p in names if p.getName().isdigit()}


def latest(spark: SparkSession, path: str) -> int:
    """The newest version; 0 where there is none."""
    return max(_entries(spark, path), default=0)


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """All profiles as of a version (the newest without one); an empty table at version 0."""
    known = _entries(spark, path)
    at = max(known, default=0) if version is None else version
    if at and at not in known:
        raise ValueError(f"there is no version {at}")
    folders = [json.loads(spark.read.option("wholetext", "true").text(known[v]).first()[0])["folder"] for v in sorted(known) if v <= at]
    if not folders:
        return spark.createDataFrame([], SCHEMA)
    rows = spark.read.schema(f"{SCHEMA}, at bigint").parquet(*(f"{path}/data/{f}" for f in folders))
    fields = [f.name for f in rows.schema if f.name not in ("user_id", "at")]
    newest = rows.groupBy("user_id").agg(F.max_by(F.struct(*fields), "at").alias("p"))
    return newest.select("user_id", "p.*")


def commit(changed: DataFrame, path: str, base: int) -> int:
    """Adds whole profiles (one row for a user) as version ``base`` + 1; :class:`Conflict` if that exists."""
    spark = changed.sparkSession
    hadoop, conf = _hadoop(spark)
    folder = uuid.uuid4().hex
    names = [f.name for f in spark.createDataFrame([], SCHEMA).schema]
    changed.select(*names).withColumn("at", F.lit(base + 1).cast("bigint")).write.parquet(f"{path}/data/{folder}")
    entry, beside = hadoop.fs.Path(f"{path}/_log/{base + 1:020d}"), hadoop.fs.Path(f"{path}/_log/.{folder}")
    fs = entry.getFileSystem(conf)
    fs.mkdirs(entry.getParent())
    out = fs.create(beside, False)
    out.write(bytearray(json.dumps({"folder": folder}).encode()))
    out.close()
    context = hadoop.fs.FileContext.getFileContext(entry.toUri(), conf)
    none = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    none[0] = spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename.NONE
    try:
        context.rename(beside, entry, none)
    except Exception as e:
        if fs.exists(entry):
            fs.delete(beside, False)
            fs.delete(hadoop.fs.Path(f"{path}/data/{folder}"), True)
            raise Conflict(f"version {base + 1} has been committed by another writer") from e
        raise
    return base + 1


def update(spark: SparkSession, path: str, change: Callable[[DataFrame], DataFrame], retries: int = RETRIES) -> int:
    """Commits ``change(profiles)``, the whole profiles that differ, and reads and changes again as long as others commit first."""
    for _ in range(retries):
        base = latest(spark, path)
        try:
            return commit(change(read(spark, path, base)), path, base)
        except Conflict:
            continue
    raise Conflict(f"{retries} other versions came first")


def _confusions() -> Column:
    return F.create_map(*(x for a, m in lx.CHAR_CONFUSIONS.items() for x in (F.lit(a), F.create_map(*(F.lit(y) for p in m.items() for y in p)))))


def fresh(user_id: Column) -> list[Column]:
    """A new profile's columns."""
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<bigint>"))
    style = F.struct(*(F.lit(v).alias(k) for k, v in STYLE.items()))
    zero = F.lit(0).cast("bigint")
    return [
        profiles.safe_id(user_id).alias("user_id"), zero.alias("documents_processed"), zero.alias("corrections_accepted"), none.alias("systematic_errors"), none.alias("custom_vocabulary"),
        _confusions().alias("character_confusions"), style.alias("writing_style"), F.lit(VERSION).alias("version"),
    ]


def load(spark: SparkSession, path: str, user_id: str) -> DataFrame:
    """A user's profile, one row; a user without one gets a new profile, which is saved."""
    wanted = spark.range(1).select(*fresh(F.lit(user_id)))
    mine = lambda: read(spark, path).join(wanted.select("user_id"), "user_id", "left_semi")
    if mine().isEmpty():
        update(spark, path, lambda all_: wanted.join(all_, "user_id", "left_anti"))
    return mine()


def reset(spark: SparkSession, path: str, user_id: str) -> int:
    """A new profile in place of the user's."""
    return update(spark, path, lambda _: spark.range(1).select(*fresh(F.lit(user_id))))


def _added(a: str, b: str) -> Column:
    both = F.map_zip_with(F.col(a), F.col(b), lambda _, x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0)))
    return both.cast("map<string,bigint>")


def record(events: DataFrame, path: str) -> int:
    """Adds feedback (user_id, original, accepted) to its users' profiles in one version; users without one begin with a new profile."""
    spark = events.sparkSession
    counts = profiles.summary(events).withColumnsRenamed({"documents_processed": "__d", "corrections_accepted": "__c"})
    learned = profiles.export(events).select("user_id", F.col("systematic_errors").alias("__e"), F.col("custom_vocabulary").alias("__v"))
    steps = profiles.confusions(events, weights=False)
    each = steps.groupBy("user_id", "from").agg(F.map_from_entries(F.collect_list(F.struct("to", "n"))).alias("m")).groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("from", "m"))).alias("__k"))
    more = counts.join(learned, "user_id").join(each, "user_id", "left")
    empty = "cast(map() as map<string,bigint>)"

    def change(known: DataFrame) -> DataFrame:
        new = more.join(known.select("user_id"), "user_id", "left_anti").select(*fresh(F.col("user_id")))
        own = known.join(more.select("user_id"), "user_id", "left_semi").unionByName(new).join(more, "user_id")
        own = own.withColumns({c: F.coalesce(c, F.expr(empty)) for c in ("__e", "__v")} | {"__k": F.coalesce("__k", F.expr("cast(map() as map<string,map<string,bigint>>)"))})

        def weights(_: Column, old: Column, n: Column) -> Column:
            start = F.coalesce(old, F.expr("cast(map() as map<string,double>)"))
            steps = F.coalesce(n, F.expr(empty))
            return F.map_zip_with(start, steps, lambda _, w, k: F.when(k.isNull(), w).otherwise(F.round(F.coalesce(w, F.lit(0.20)) + k * 0.05, 3)))

        return own.withColumns(
            {
                "documents_processed": F.col("documents_processed") + F.col("__d"), "corrections_accepted": F.col("corrections_accepted") + F.col("__c"),
                "systematic_errors": _added("systematic_errors", "__e"), "custom_vocabulary": _added("custom_vocabulary", "__v"),
                "character_confusions": F.map_zip_with("character_confusions", "__k", weights),
            }
        ).drop("__d", "__c", "__e", "__v", "__k")

    return update(spark, path, change)
