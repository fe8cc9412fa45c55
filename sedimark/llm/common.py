"""Shared plumbing of the training-data operators: tables, the shared folder, Arrow limits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimark.sources.scratch import written  # noqa: F401  tables in the folder that executors share

TABLES = ("documents", "pages", "benchmark", "labels", "conversations", "embeddings")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_limits(spark: SparkSession, rows: int = 2000, size: str = "32m") -> None:
    """Bounds an Arrow batch in rows and bytes, so that long texts do not add up in a worker.
    Settings that are stricter already stay."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > rows:
        spark.conf.set(key, str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))
