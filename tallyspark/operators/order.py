"""Positions in a global order without a single-task sort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.session import cut_lineage


def numbered(df: DataFrame, order: Sequence[str], out: str) -> DataFrame:
    """1-based position of every row in the given order.

    Rows are range-partitioned and written once with their range number, which fixes the ranges;
    each range is numbered on its own and shifted by the sizes of the ranges before it.
    """
    ranged = cut_lineage(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    local = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return (
        ranged.withColumn("_r", local)
        .join(offsets, "_range")
        .withColumn(out, (F.col("_off") + F.col("_r")).cast("bigint"))
        .drop("_r", "_off", "_range")
    )


def numbered_within(df: DataFrame, group: str, order: Sequence[str], out: str) -> DataFrame:
    """1-based position within each group; a group of any size spans as many ranges as it needs."""
    placed = cut_lineage(numbered(df, [group, *order], "_pos"))
    first = placed.groupBy(group).agg(F.min("_pos").alias("_first"))
    return placed.join(first, group).withColumn(out, F.col("_pos") - F.col("_first") + 1).drop("_pos", "_first")
