"""Append-only logs as Parquet folders, read at once or as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "seq long, kind string, pid long, image string, cnt long, bad boolean"


def append(records: DataFrame, path: str) -> None:
    records.select("seq", "kind", "pid", "image", "cnt", "bad").write.mode("append").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def follow(spark: SparkSession, path: str, files_per_batch: int = 64) -> DataFrame:
    """New files of the log as they come."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(path)
