"""Files in and out: documents as bytes with a verdict on each, decks as JSON, texts and Markdown."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions import lexicons as lx
from scriptorium.sources.scratch import stored


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def is_supported(path: Column) -> Column:
    return extension(path).isin(*lx.EXTENSIONS)


def with_status(files: DataFrame) -> DataFrame:
    """Adds status to files (path, ...): skipped for kinds that can't be read; is_pdf for those with pages."""
    return files.withColumn("status", F.when(is_supported(F.col("path")), "accepted").otherwise("skipped")).withColumn("is_pdf", extension(F.col("path")) == ".pdf")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """path, content, status, is_pdf of all files below ``path``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return with_status(files.select("path", F.col("length").alias("size"), "content"))


def pages(documents: DataFrame, decode: Callable[[str, bytes], list[tuple[bytes, int, int]]]) -> DataFrame:
    """A row per page (path, page_number from 1, total_pages, image, width, height, error) by a decoder of (path, bytes); a file that
    fails is one row with its error."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for path, content in zip(f["path"], f["content"], strict=True):
                try:
                    got = decode(path, content)
                    rows.extend((path, k, len(got), image, w, h, None) for k, (image, w, h) in enumerate(got, 1))
                except Exception as e:  # a broken file is data
                    rows.append((path, 0, 0, None, 0, 0, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "page_number", "total_pages", "image", "width", "height", "error"])

    return documents.where("status = 'accepted'").select("path", "content").mapInPandas(run, "path string, page_number int, total_pages int, image binary, width int, height int, error string")


MISSING, UNSUPPORTED, EMPTY = "no such file, or one without a byte", "unsupported format", "no pages"


def _below(spark: SparkSession, root: str) -> DataFrame:
    """path, size, content of all files below a folder; none where it doesn't exist."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], "path string, size bigint, content binary")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select("path", F.col("length").alias("size"), "content")


def judged(wanted: DataFrame, found: DataFrame, decode: Callable[[str, bytes], list[tuple[bytes, int, int]]]) -> tuple[DataFrame, DataFrame]:
    """(pages, verdicts) of the inputs ``wanted`` (path) among the files ``found`` (path, size, content), as a batch: no input is lost, and none
    stops the others.

    Each input has one verdict: accepted (total_pages), skipped (a kind that can't be read) or failed (it isn't there or is empty, its decoder
    fails, or it has no pages), with the reason in ``error``. An input that is named twice is one file with two verdicts. ``pages`` has the
    pages of the accepted ones. Files that nobody wants are not decoded.
    """
    kinds = wanted.select("path").where(is_supported(F.col("path"))).distinct()
    read = with_status(found.where(F.octet_length("content") > 0).join(kinds, "path", "left_semi"))
    decoded = pages(read, decode)
    # a file without pages has a row too, so that it is decoded once
    marked = decoded.withColumn("is_page", F.col("error").isNull()).unionByName(read.select("path", F.lit(False).alias("is_page")), allowMissingColumns=True)
    marked = stored(marked, "pages")
    counts = marked.groupBy("path").agg(F.count_if("is_page").alias("n"), F.first("error", ignorenulls=True).alias("problem"), F.lit(True).alias("is_there"))
    own = wanted.select("path").join(counts, "path", "left")
    error = (
        F.when(~is_supported(F.col("path")) | F.col("path").isNull(), UNSUPPORTED)
        .when(F.col("is_there").isNull(), MISSING)
        .when(F.col("problem").isNotNull(), F.col("problem"))
        .when(F.col("n") == 0, EMPTY)
    )
    status = F.when(error.isNull(), "accepted").when(error == UNSUPPORTED, "skipped").otherwise("failed")
    verdicts = own.select("path", status.alias("status"), F.when(error.isNull(), F.col("n")).otherwise(F.lit(0)).cast("int").alias("total_pages"), error.alias("error"))
    return marked.where("is_page").drop("error", "is_page"), verdicts


def ingest(wanted: DataFrame, root: str, decode: Callable[[str, bytes], list[tuple[bytes, int, int]]]) -> tuple[DataFrame, DataFrame]:
    """:func:`judged` of inputs (path: below ``root``) and the files there. A root that isn't there has none."""
    spark = wanted.sparkSession
    # names as the file system gives them, whatever scheme the root is written with
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    prefix = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toUri().getPath().rstrip("/") + "/"
    return judged(wanted, _below(spark, root).withColumn("path", F.substring_index(F.col("path"), prefix, -1)), decode)


def batch_summary(verdicts: DataFrame) -> DataFrame:
    """One row: batch_size (all inputs), accepted, skipped, failed, total_pages."""
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    return verdicts.agg(F.count(F.lit(1)).alias("batch_size"), n("accepted"), n("skipped"), n("failed"), F.coalesce(F.sum("total_pages"), F.lit(0)).alias("total_pages"))


def data_uri(image: Column, kind: str = "image/jpeg") -> Column:
    return F.concat(F.lit(f"data:{kind};base64,"), F.base64(image))


def export(docs: DataFrame, path: str, base: Column, plain: str = "plain_text", markdown: str = "markdown") -> None:
    """Plain text, Markdown and JSON of each document below ``path``, in folders by base name."""
    own = docs.withColumn("base", F.regexp_replace(base, r"[^a-zA-Z0-9_.\-]", "_"))
    own.select("base", F.col(plain).alias("value")).write.mode("overwrite").partitionBy("base").text(f"{path}/txt")
    own.select("base", F.col(markdown).alias("value")).write.mode("overwrite").partitionBy("base").text(f"{path}/md")
    own.write.mode("overwrite").partitionBy("base").json(f"{path}/json")


def distinct_texts(docs: DataFrame, text: str = "text", with_candidates: str | None = None) -> DataFrame:
    """One row per distinct content: content_hash and text; a result computed once is joined back by the hash.
    Where candidates change a result they are part of the hash."""
    parts = [F.coalesce(text, F.lit(""))] + ([F.to_json(with_candidates)] if with_candidates else [])
    return docs.select(F.md5(F.concat_ws("\u0000", *parts)).alias("content_hash"), F.col(text).alias("text")).dropDuplicates(["content_hash"])
