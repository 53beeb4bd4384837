"""The corpus operators as queries over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm import decontaminate, line_dedup, mixing, packing, quality, ranked_search, simhash, suffix_dedup, token_counts, toxicity, url_filter, vector_codes, warc
from scriptorium.llm.common import documents


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(documents(spark, sf_dir))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(documents(spark, sf_dir))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocked are the hosts of pages whose documents are labelled as of no quality."""
    pages, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("pages", "labels"))
    bad = labels.where("quality = 0").select(F.col("doc_id").alias("page_id"))
    hosts = pages.join(bad, "page_id", "left_semi").select(url_filter.parts(F.col("url"))[0].alias("host")).where("host <> ''")
    return url_filter.judge(pages, blocked=hosts.distinct())


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op6_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return warc.fixity(warc.records(pages), warc.records(warc.replica_with_damage(pages)))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op8_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.score(documents(spark, sf_dir))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    n_lines = F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1)).cast("long")
    kept = line_dedup.deduplicate(docs.select("doc_id", "text", n_lines.alias("n_lines")))
    return kept.select("doc_id", "n_lines", "n_removed_lines", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts from an empty cache, so that every distinct text is encoded."""
    return token_counts.count_tokens(documents(spark, sf_dir))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.coded(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_suffix_dedup,
        op2_best_fit_packing,
        op3_quality_rules,
        op4_url_filter,
        op5_decontamination,
        op6_warc_fixity,
        op7_simhash,
        op8_context_mixing,
        op9_toxicity,
        op10_line_dedup,
        op11_token_counts,
        op12_vector_codes,
        op13_ranked_search,
    )
}
ORACLES: dict[str, str] = {
    "op1_suffix_dedup": suffix_dedup.SQL,
    "op4_url_filter": url_filter.SQL,
    "op5_decontamination": decontaminate.SQL,
    "op6_warc_fixity": warc.SQL,
    "op12_vector_codes": vector_codes.sql(),
    "op13_ranked_search": ranked_search.SQL,
}
