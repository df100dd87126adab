"""Accuracy, log loss, Brier score, AUC and calibration per group.

Everything but the AUC is one map-side combined aggregate over the rows: per group, or per group and
bucket. The AUC alone needs an order: it reads a table of (group, probability) -> positives, negatives,
scanned in probability chunks.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.prob import clamp
from tallyspark.operators.prefix import prior_totals

AUC_CHUNKS = 1 << 20
BINS = 10


def outcome_counts(df: DataFrame, keys: Sequence[str], p: str | Column, label: str = "label", eps: float = 1e-6) -> DataFrame:
    prob = clamp(F.col(p) if isinstance(p, str) else p, eps, 1.0 - eps)
    y = F.col(label)
    return df.groupBy(*keys, prob.alias("p")).agg(
        F.sum(y).cast("bigint").alias("pos"), F.sum(1 - y).cast("bigint").alias("neg")
    )


def outcomes(df: DataFrame, keys: Sequence[str], p: str | Column, label: str = "label", eps: float = 1e-6) -> DataFrame:
    """One row per row: the clamped probability and the label as positives and negatives. No shuffle."""
    prob = clamp(F.col(p) if isinstance(p, str) else p, eps, 1.0 - eps)
    y = F.col(label).cast("bigint")
    return df.select(*keys, prob.alias("p"), y.alias("pos"), (1 - y).alias("neg"))


def basic_metrics(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    p, pos, neg = F.col("p"), F.col("pos"), F.col("neg")
    n = F.sum(pos + neg)
    right = F.sum(F.when(p >= 0.5, pos).otherwise(neg))
    return counts.groupBy(*keys).agg(
        n.alias("n"),
        (right / n).alias("accuracy"),
        (-F.sum(pos * F.log(p) + neg * F.log1p(-p)) / n).alias("log_loss"),
        (F.sum(pos * (p - 1) * (p - 1) + neg * p * p) / n).alias("brier"),
    )


def auc(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Tie-averaged area under the ROC curve; .5 where one class is empty."""
    # the scan carries the counts along: read apart, they would be dealt once more to meet their sums
    known = counts.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in (*keys, "p")]))
    scored = prior_totals(
        known, keys, "p", sums={"below": F.col("neg")}, chunk=F.floor(F.col("p") * AUC_CHUNKS), carried={"pos": F.col("pos"), "neg": F.col("neg")}
    )
    pos, neg = F.sum("pos"), F.sum("neg")
    pairs = F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2.0))
    return scored.groupBy(*keys).agg(
        F.when((pos > 0) & (neg > 0), pairs / (pos.cast("double") * neg.cast("double"))).otherwise(0.5).alias("auc")
    )


def average_ranks(df: DataFrame, keys: Sequence[str], value: str, chunk: Column) -> DataFrame:
    """Rank of each distinct value, ties sharing the mean of their positions."""
    per = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    before = prior_totals(per, keys, value, sums={"before": F.col("n")}, chunk=chunk)
    return per.join(before, [*keys, value]).select(
        *keys, value, "n", (F.col("before") + (F.col("n") + 1) / 2.0).alias("avg_rank")
    )


def _bucket() -> Column:
    return F.least(F.floor(F.col("p") * BINS), F.lit(BINS - 1)).cast("int")


def calibration_table(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    n = F.sum(F.col("pos") + F.col("neg"))
    return (
        counts.withColumn("bucket", _bucket())
        .groupBy(*keys, "bucket")
        .agg(
            n.alias("n"),
            (F.sum(F.col("p") * (F.col("pos") + F.col("neg"))) / n).alias("mean_p"),
            (F.sum("pos") / n).alias("win_rate"),
        )
    )


def calibration_error(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    gap = F.sum(F.col("n") * F.abs(F.col("mean_p") - F.col("win_rate")))
    return calibration_table(counts, keys).groupBy(*keys).agg((gap / F.sum("n")).alias("ece"))


def _flat_metrics(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Accuracy, log loss, Brier and calibration error in one pass: a few bucket rows per group are shuffled."""
    p, pos, neg = F.col("p"), F.col("pos"), F.col("neg")
    per = points.groupBy(*keys, _bucket().alias("_b")).agg(
        F.sum(pos + neg).alias("n"),
        F.sum(F.when(p >= 0.5, pos).otherwise(neg)).alias("_right"),
        F.sum(pos * F.log(p) + neg * F.log1p(-p)).alias("_log"),
        F.sum(pos * (p - 1) * (p - 1) + neg * p * p).alias("_square"),
        F.abs(F.sum(p * (pos + neg)) - F.sum(pos)).alias("_gap"),
    )
    n = F.sum("n")
    return per.groupBy(*keys).agg(
        n.alias("n"), (F.sum("_right") / n).alias("accuracy"), (-F.sum("_log") / n).alias("log_loss"), (F.sum("_square") / n).alias("brier"), (F.sum("_gap") / n).alias("ece")
    )


def bundle(df: DataFrame, keys: Sequence[str], p: str | Column, label: str = "label", min_rows: int = 0) -> DataFrame:
    """Accuracy, AUC, log loss, Brier and calibration error per group with enough rows."""
    groups = list(keys) or ["_all"]
    rows = df if keys else df.withColumn("_all", F.lit(0))
    flat = _flat_metrics(outcomes(rows, groups, p, label), groups)
    out = flat.join(auc(outcome_counts(rows, groups, p, label), groups), groups)
    out = out.select(*keys, "n", "accuracy", "log_loss", "brier", "auc", "ece")
    return out.where(F.col("n") >= min_rows) if min_rows else out


def by_dimensions(df: DataFrame, dims: dict[str, Column], p: str, label: str = "label", min_rows: int = 0) -> DataFrame:
    """The metric bundle for every value of several independent dimensions in one pass."""
    pairs = F.array(*[F.struct(F.lit(n).alias("dim"), c.cast("string").alias("value")) for n, c in dims.items()])
    flat = df.select(F.inline(pairs), F.col(p), F.col(label)).where(F.col("value").isNotNull())
    return bundle(flat, ["dim", "value"], p, label, min_rows)


# ---- bands -----------------------------------------------------------------------------


def right_closed(c: Column, cuts: Sequence[float], labels: Sequence[str], include_lowest: bool = False) -> Column:
    """Band of (low, high]; null outside. ``include_lowest`` also admits the first cut."""
    low_ok = (c >= cuts[0]) if include_lowest else (c > cuts[0])
    out = None
    for high, name in zip(cuts[1:], labels, strict=True):
        out = F.when(c <= high, name) if out is None else out.when(c <= high, name)
    return F.when(low_ok, out)


def below_cuts(c: Column, cuts: Sequence[float], labels: Sequence[str]) -> Column:
    """First label whose cut exceeds the value; the last label takes the rest."""
    out = None
    for cut, name in zip(cuts, labels, strict=False):
        out = F.when(c < cut, name) if out is None else out.when(c < cut, name)
    return out.otherwise(labels[len(cuts)])


def favourite(p: Column) -> Column:
    return F.greatest(p, 1.0 - p)


# The cuts and names of the four bands below, and the confidence thresholds.
def favourite_band(p: Column) -> Column:
    return below_cuts(favourite(p), (0.55, 0.65, 0.75, 0.85), ("50-55", "55-65", "65-75", "75-85", "85-100"))


def favourite_band_named(p: Column) -> Column:
    return below_cuts(
        favourite(p), (0.55, 0.65, 0.80), ("close_50_55", "lean_55_65", "favorite_65_80", "heavy_favorite_80_plus")
    )


def favourite_band_closed(p: Column) -> Column:
    labels = ("50-55", "55-60", "60-70", "70-80", "80-100")
    return right_closed(favourite(p), (0.5, 0.55, 0.6, 0.7, 0.8, 1.0), labels, True)


def rank_gap_band(diff: Column) -> Column:
    return below_cuts(
        F.abs(diff * 998.0), (25.0, 75.0, 200.0), ("rank_gap_0_25", "rank_gap_25_75", "rank_gap_75_200", "rank_gap_200_plus")
    )


def rank_edge_band(diff: Column) -> Column:
    return right_closed(F.abs(diff), (-1.0, 0.03, 0.12, 0.35, 10.0), ("near", "small", "medium", "large"))


THRESHOLDS = (0.55, 0.60, 0.65, 0.70, 0.75, 0.80)


def selective(df: DataFrame, p: str, label: str = "label", thresholds: Sequence[float] = THRESHOLDS) -> DataFrame:
    """Coverage and metrics among rows whose confidence reaches each threshold."""
    levels = F.filter(F.array(*[F.lit(t) for t in (0.0, *thresholds)]), lambda t: t <= favourite(F.col(p)))
    flat = df.select(p, label, F.explode(levels).alias("threshold"))
    out = bundle(flat, ["threshold"], p, label)
    everyone = Window.partitionBy(F.lit(0))
    return out.withColumn("coverage", F.col("n") / F.max("n").over(everyone)).where(F.col("threshold") > 0)
