"""The corpus operators' registered queries and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.llm import decontaminate, line_dedup, mixing, near_dedup, quality, secret_scan, sharding, token_counts, top_k, url_filter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best of all other vectors for every vector whose id is divisible by 50."""
    return top_k.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines whose template recurs."""
    return line_dedup.drop_recurring_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    drawn = mixing.mixed(table(spark, sf_dir, "documents"), payload=("doc_id",))
    return drawn.select("doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), (F.col("_size") * F.col("_copies")).alias("taken"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the class of its near copies."""
    return near_dedup.near_classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size", "is_kept")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The secrets in every document."""
    return secret_scan.scan_secrets(table(spark, sf_dir, "documents"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard and slot of every document."""
    return sharding.shard(table(spark, sf_dir, "documents"), payload=("doc_id",))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's URL."""
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), url_filter.rule_table(spark))


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of a document and a benchmark item that it contains."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens of every document."""
    import public_tokenizers

    counted = token_counts.token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 512)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    voters = quality.fit_voters(docs, table(spark, sf_dir, "labels"))
    scored = quality.with_quality(docs, voters).drop("text")
    return scored.select("doc_id", quality.held_out().alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (
        op1_top_k,
        op2_line_dedup,
        op3_mixing,
        op4_near_dedup,
        op5_secret_scan,
        op6_sharding,
        op7_url_filter,
        op8_benchmark_decontamination,
        op9_token_counts,
        op10_quality,
    )
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_top_k": top_k.ORACLE,
        "op3_mixing": mixing.ORACLE,
        "op5_secret_scan": secret_scan.ORACLE,
        "op7_url_filter": url_filter.ORACLE,
    }
