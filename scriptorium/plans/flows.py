"""Queries on what goes in and out: verdicts on inputs, records of unlike shapes, stages and their counts, profiles kept by a log and by streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.operators import profiles as ad
from scriptorium.plans import learning
from scriptorium.plans.registry import query, table
from scriptorium.sources import files, profile_store, records, telemetry
from scriptorium.sources.scratch import shared_dir
from scriptorium.streaming import corrections


def _scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/scriptorium/{name}-{uuid.uuid4().hex}"


# -- inputs ----------------------------------------------------------------


def paragraphs(path: str, content: bytes) -> list[tuple[bytes, int, int]]:
    """The paragraphs of a page as pages of a document; a page that isn't closed is broken."""
    if b"</html>" not in content:
        raise ValueError("the page is cut off")
    return [(part, len(part), 1) for part in content.split(b"<p>")[1:]]


_WANTED = """want AS (SELECT doc_id, CASE lang WHEN 'en' THEN '.pdf' WHEN 'fr' THEN '.PNG' WHEN 'de' THEN '.doc' ELSE '.jpeg' END AS ext FROM documents),
got AS (SELECT w.doc_id || w.ext AS path, w.ext <> '.doc' AS known, p.page_id IS NOT NULL AS there, p.html LIKE '%</html>%' AS whole, len(string_split(p.html, '<p>')) - 1 AS n FROM want w LEFT JOIN pages p ON p.page_id = w.doc_id)"""


def _ingested(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    lang = F.col("lang")
    ext = F.when(lang == "en", ".pdf").when(lang == "fr", ".PNG").when(lang == "de", ".doc").otherwise(".jpeg")
    wanted = table(spark, sf_dir, "documents").select(F.concat(F.col("doc_id").cast("string"), ext).alias("path"))
    stored_pages = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("id"), F.encode(F.coalesce("html", F.lit("")), "utf-8").alias("content"))
    found = stored_pages.select(F.explode(F.transform(F.array(*(F.lit(e) for e in (".pdf", ".PNG", ".doc", ".jpeg"))), lambda e: F.concat("id", e))).alias("path"), F.octet_length("content").cast("long").alias("size"), "content")
    return files.judged(wanted, found, paragraphs)


@query(
    f"""WITH {_WANTED} SELECT path, CASE WHEN NOT known THEN 'skipped' WHEN NOT there OR NOT whole OR n = 0 THEN 'failed' ELSE 'accepted' END AS status, CAST(CASE WHEN known AND there AND whole THEN n ELSE 0 END AS INT) AS total_pages,
  CASE WHEN NOT known THEN '{files.UNSUPPORTED}' WHEN NOT there THEN '{files.MISSING}' WHEN NOT whole THEN 'ValueError: the page is cut off' WHEN n = 0 THEN '{files.EMPTY}' END AS error FROM got"""
)
def io_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document asked for by a name, and what came of it: pages stand for the files of a folder, their paragraphs for a document's pages."""
    return _ingested(spark, sf_dir)[1]


@query(
    f"""WITH {_WANTED} SELECT count(*) AS batch_size, count(*) FILTER (known AND there AND whole AND n > 0) AS accepted, count(*) FILTER (NOT known) AS skipped, count(*) FILTER (known AND (NOT there OR NOT whole OR n = 0)) AS failed,
  CAST(sum(CASE WHEN known AND there AND whole THEN n ELSE 0 END) AS BIGINT) AS total_pages FROM got"""
)
def io_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as one batch."""
    return files.batch_summary(_ingested(spark, sf_dir)[1])


# -- records ---------------------------------------------------------------


@query(
    """SELECT * FROM (SELECT 'conversations' AS source, role AS kind, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS size, CAST(NULL AS VARCHAR) AS last FROM conversations GROUP BY role
UNION ALL SELECT 'benchmark', NULL, count(*), CAST(sum(length(text)) AS BIGINT), NULL FROM benchmark
UNION ALL SELECT 'events', event_type, count(*), NULL, CAST(max(event_id) AS VARCHAR) FROM events GROUP BY event_type
UNION ALL SELECT 'embeddings', CAST(label AS VARCHAR), count(*), CAST(sum(len(embedding)) AS BIGINT), NULL FROM embeddings GROUP BY label) WHERE n > 0"""
)
def io_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of four tables of unlike shapes in one column, written as JSON, read again, and counted by path."""
    every = None
    for name in ("conversations", "benchmark", "events", "embeddings"):
        own = records.to_variant(table(spark, sf_dir, name)).select(F.lit(name).alias("source"), F.to_json("record").alias("text"))
        every = own if every is None else every.union(own)
    own = records.parsed(every)
    get = lambda path, kind="string": records.value(F.col("record"), path, kind)
    kind = F.coalesce(get("$.role"), get("$.event_type"), F.when(F.col("source") == "embeddings", get("$.label")))
    size = F.coalesce(F.length(get("$.text")), F.size(get("$.embedding", "array<double>")))
    last = F.max(F.when(F.col("source") == "events", get("$.event_id", "bigint")))
    return own.groupBy("source", kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(size >= 0, size)).cast("long").alias("size"), last.cast("string").alias("last"))


# -- stages ----------------------------------------------------------------


@query(
    """WITH a AS (SELECT doc_id, text FROM documents), b AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text FROM a), c AS (SELECT doc_id, text FROM b WHERE length(text) >= 40), d AS (SELECT DISTINCT text FROM c),
n AS (SELECT 0 AS k, count(*) AS n, sum(strlen(text)) AS s FROM a UNION ALL SELECT 1, count(*), sum(strlen(text)) FROM b UNION ALL SELECT 2, count(*), sum(strlen(text)) FROM c UNION ALL SELECT 3, count(*), sum(strlen(text)) FROM d)
SELECT CAST(x.k + 1 AS INT) AS place, ['lines', 'long lines', 'distinct lines'][x.k + 1] AS stage, x.n AS rows_in, y.n AS rows_out, CAST(x.s AS BIGINT) AS bytes_in, CAST(y.s AS BIGINT) AS bytes_out FROM n x JOIN n y ON y.k = x.k + 1"""
)
def io_telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three stages over all documents, counted while they run."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    stages = [
        ("lines", lambda d: d.select("doc_id", F.explode(F.split("text", "\n", -1)).alias("text"))),
        ("long lines", lambda d: d.where(F.length("text") >= 40)),
        ("distinct lines", lambda d: d.select("text").distinct()),
    ]
    return telemetry.run_stages(docs, stages)[1].drop("seconds")


# -- profiles --------------------------------------------------------------


@query(
    f"""WITH {learning.FEEDBACK}, c AS (SELECT user_id, original, accepted FROM fb), n AS (SELECT user_id, count(*) AS documents_processed, count(*) FILTER (original <> accepted) AS corrections_accepted FROM c GROUP BY user_id),
w AS (SELECT user_id, unnest(range(1, length(original) + 1)) AS i, original, accepted FROM c WHERE original <> accepted AND length(original) = length(accepted)),
il AS (SELECT user_id, count(*) AS n FROM w WHERE substr(original, i, 1) = 'i' AND substr(accepted, i, 1) = 'l' GROUP BY user_id),
e AS (SELECT user_id, count(DISTINCT original) AS n_errors, count(DISTINCT accepted) AS n_words, count(*) AS n FROM c WHERE original <> accepted GROUP BY user_id)
SELECT user_id, documents_processed, corrections_accepted, coalesce(n_errors, 0) AS n_errors, coalesce(n_words, 0) AS n_words, CASE WHEN il.n IS NULL THEN NULL ELSE round(0.20::DOUBLE + 0.05::DOUBLE * il.n, 3) END AS i_for_l
FROM n LEFT JOIN e USING (user_id) LEFT JOIN il USING (user_id)"""
)
def ad_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All feedback recorded in a store in two versions, and the profiles that it then has."""
    path = _scratch(spark, "profiles")
    events = learning.feedback(spark, sf_dir)
    for part in (F.col("original") < "m", F.col("original") >= "m"):
        profile_store.record(events.where(part), path)
    own = profile_store.read(spark, path)
    size = lambda c: F.size(c).cast("long")
    weight = F.try_element_at(F.try_element_at("character_confusions", F.lit("i")), F.lit("l"))
    return own.select("user_id", "documents_processed", "corrections_accepted", size("systematic_errors").alias("n_errors"), size("custom_vocabulary").alias("n_words"), F.round(weight, 3).alias("i_for_l"))


@query(f"WITH {learning.FEEDBACK} SELECT user_id, count(*) AS documents_processed, count(*) FILTER (original <> accepted) AS corrections_accepted FROM fb GROUP BY user_id")
def ad_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as a stream of accepted suggestions into a ledger, twice over: each counts once."""
    path = _scratch(spark, "ledger")
    events = table(spark, sf_dir, "events")
    kind, k = F.col("event_type"), F.col("event_id") % 3
    accepted = F.when(k == 0, kind).when(k == 1, F.replace(kind, F.lit("i"), F.lit("l"))).otherwise(F.reverse(kind))
    for n in range(2):
        live = spark.readStream.schema(events.schema).option("pathGlobFilter", "events*").parquet(sf_dir)
        stream = live.select(F.col("user_id").cast("string").alias("user_id"), F.col("user_id").alias("doc_id"), F.col("event_id").cast("string").alias("suggestion_id"), kind.alias("original"), accepted.alias("accepted"))
        corrections.to_ledger(stream, f"{path}/ledger", f"{path}/state-{n}").awaitTermination()
    return ad.summary(corrections.entries(spark, f"{path}/ledger", stream.schema))
