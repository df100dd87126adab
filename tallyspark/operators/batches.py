"""Batches of matches that must not see each other's results, and the two sides of a match."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

VENUE_BATCH = ("venue",)
ROUND_BATCH = ("venue", "round_order")


def batch_numbers(m: DataFrame, inside_day: Sequence[str] = ROUND_BATCH) -> DataFrame:
    """Dense batch number per pool in (date, *inside_day) order, one row per batch.

    Only distinct batch keys are sorted: within a day, then over the days of a pool, whose
    number is bounded by the calendar.
    """
    keyset = m.select("pool", "match_date", *inside_day).distinct()
    per_day = keyset.groupBy("pool", "match_date").agg(F.count(F.lit(1)).alias("_n"))
    days = Window.partitionBy("pool").orderBy("match_date").rowsBetween(Window.unboundedPreceding, -1)
    offset = per_day.select("pool", "match_date", F.coalesce(F.sum("_n").over(days), F.lit(0)).alias("_off"))
    inside = Window.partitionBy("pool", "match_date").orderBy(*inside_day)
    return (
        keyset.withColumn("_rn", F.row_number().over(inside))
        .join(offset, ["pool", "match_date"])
        .select("pool", "match_date", *inside_day, (F.col("_off") + F.col("_rn")).cast("bigint").alias("batch_no"))
    )


def with_batch(m: DataFrame, inside_day: Sequence[str] = ROUND_BATCH, source: DataFrame | None = None) -> DataFrame:
    """Attach the batch number. ``source`` may be a slimmer frame with the same batch keys."""
    numbers = batch_numbers(source if source is not None else m, inside_day)
    return m.join(numbers, ["pool", "match_date", *inside_day])


def oriented(m: DataFrame, flip: Column) -> DataFrame:
    """Name the sides p1/p2; the label is 1 when the winner is p1."""
    return m.withColumn("_flip", flip).select(
        "*",
        F.when(F.col("_flip"), F.col("loser")).otherwise(F.col("winner")).alias("p1"),
        F.when(F.col("_flip"), F.col("winner")).otherwise(F.col("loser")).alias("p2"),
        F.when(F.col("_flip"), 0).otherwise(1).alias("label"),
    ).drop("_flip")


def paired(sides: DataFrame, keys: Sequence[str], cols: Sequence[str], first: Column) -> DataFrame:
    """Two participation rows back to one match row with ``<col>_1`` and ``<col>_2``.

    ``first`` is true on the row of side 1. One aggregation replaces two joins. Rows are dealt before they are merged: two
    rows of a match rarely stand in one task, and merged rows are twice as wide.
    """
    picked = []
    for c in cols:
        picked.append(F.max(F.when(first, F.col(c))).alias(f"{c}_1"))
        picked.append(F.max(F.when(~first, F.col(c))).alias(f"{c}_2"))
    return sides.repartition(*keys).groupBy(*keys).agg(*picked)
