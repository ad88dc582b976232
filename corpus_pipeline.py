"""The corpus pipeline: stages over documents, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from soundgrid.llm import bpe, decontaminate, hyperminhash, lines, quality
from soundgrid.llm.common import written
from soundgrid.llm.queries import WORD_BPE

MIN_DOCS = 10


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts, at the same 0.7 as its query."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.scored(docs, model, "_quality").where("_quality >= 0.7").drop("_quality")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines in at least MIN_DOCS documents go from every text; n_chars follows the text."""
    out = lines.dropped_from(docs, MIN_DOCS)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates stays: the one with the least doc_id (null last).

    Rows are told apart by a number of their own, so a repeated or null doc_id neither drags rows along nor keeps them.
    """
    rows = written(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")  # numbers are fixed once written
    found = hyperminhash.near_duplicates(rows.select(F.col("_row").alias("doc_id"), "text"), percent=80)
    found = rows.select("_row", "doc_id").join(found.select(F.col("doc_id").alias("_row"), "component_id"), "_row")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row"))
    stays = found.groupBy("component_id").agg(least.alias("least")).select("least._row")
    return rows.join(stays, "_row", "left_semi").select(*[f"`{c}`" for c in docs.columns])


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    model = decontaminate.fit(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return decontaminate.scan(docs, model).where(F.size("items") == 0).drop("items")


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids and the decoded text of each document that is left, as digests."""
    return bpe.digests(bpe.encode(docs, public_tokenizers.path(WORD_BPE)))


STAGES = [("quality", good_quality), ("lines", line_dedup), ("near_duplicates", near_dedup), ("benchmark", decontaminated), ("bpe", encoded)]
#: The classifier, the latent search and the tokenizer can't be expressed in SQL; tests/llm/test_pipeline.py holds the last three stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
