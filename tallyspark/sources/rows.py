"""Saved feature rows and predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions.text import parse_date


def read_feature_rows(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Feature rows with ``year`` derived from ``date``; CSV columns arrive as text."""
    reader = spark.read.option("header", True) if fmt == "csv" else spark.read
    rows = reader.format(fmt).load(path)
    return rows.withColumn("date", parse_date(F.col("date").cast("string"))).withColumn("year", F.year("date"))


def write_feature_rows(df: DataFrame, path: str, fmt: str = "parquet", partitions: tuple[str, ...] = ("pool", "year")) -> None:
    """One folder per pool and year, so later readers prune by both."""
    writer = df.write.mode("overwrite").partitionBy(*partitions)
    (writer.option("header", True) if fmt == "csv" else writer).format(fmt).save(path)
