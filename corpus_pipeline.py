"""A corpus pipeline: quality, near copies, benchmark passages, mixture, shards.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and
read again as the next stage's docs. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.llm.common import materialize, sweep
from rivulet.llm.decontaminate import decontaminate
from rivulet.llm.mixing import mix
from rivulet.llm.near_dedup import drop_near_duplicates
from rivulet.llm.quality import THRESHOLD, fit_voters, with_quality
from rivulet.llm.sharding import shard

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold.

    Null and empty texts score like the labelled sample's mean; repeated rows are judged alike; an
    empty table stays empty; columns besides those of ``documents`` are dropped.
    """
    docs = docs.select(*COLUMNS)
    voters = fit_voters(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return with_quality(docs, voters).filter(F.col("score") >= THRESHOLD).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies.

    Null and empty texts all stay; of rows that agree in id and text one stays; null ids come last.
    """
    return drop_near_duplicates(docs.select(*COLUMNS))


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages; null and empty texts stay, repeated rows go together."""
    return decontaminate(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture of their sources takes them; null sources are one source, texts without words
    are drawn like their source's others, repeated rows each."""
    return mix(docs.select(*COLUMNS))


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' columns with their shard and slot; null texts count as empty, repeated rows are placed each."""
    return shard(docs.select(*COLUMNS))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("benchmark_passages", benchmark_passages),
    ("mixture", mixture),
    ("shards", shards),
]

#: The classifier and the near-duplicate classes aren't expressible in SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stage's table written to the shared folder and read again.

    What a stage wrote on its way is deleted when its result is there. An empty ``documents`` gives an empty table.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs)
            sweep(spark, docs)
    return docs
