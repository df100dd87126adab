"""Validation of artifacts, requests and evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

METRIC_NAMES = ("accuracy", "roc_auc", "log_loss", "brier_score", "ece")
REQUIRED_HEAD = ("model_version", "generated_at", "tour", "training_cutoff", "temporal_policy_version")


def _finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def _all_finite(values: Column) -> Column:
    return F.forall(F.coalesce(values, F.array().cast("array<double>")), _finite)


def artifact_violations(heads: DataFrame, players: DataFrame, pools: tuple[str, ...] = ("atp", "wta")) -> DataFrame:
    """One row per artifact with a flag per rule; players are judged in one aggregation."""
    per = players.groupBy("model_version").agg(
        F.count(F.lit(1)).alias("_players"), F.count_distinct(F.lower("tour")).alias("_tours"), F.min(F.lower("tour")).alias("_tour")
    )
    x = heads.join(per, "model_version", "left")
    m = F.col("model")
    names, coef = m["feature_names"], m["coefficients"]
    size = lambda a: F.coalesce(F.size(a), F.lit(0))
    count = F.greatest(size(names), F.lit(0))
    length_ok = lambda a: (F.coalesce(F.size(a), F.lit(0)) <= 0) | (F.size(a) == F.size(names))
    missing = F.lit(False)
    for c in REQUIRED_HEAD:
        missing = missing | F.coalesce(F.col(c) == "", F.lit(True))
    cal = m["calibration"]
    flags = {
        "missing_metadata": missing,
        "unknown_pool": ~F.coalesce(F.lower("tour").isin(*pools), F.lit(False)),
        "no_players": F.coalesce(F.col("_players"), F.lit(0)) == 0,
        "wrong_pool_players": F.coalesce((F.col("_tours") > 1) | (F.col("_tour") != F.lower("tour")), F.lit(False)),
        "no_parameters": (count <= 0) | (size(coef) <= 0),
        "unequal_lengths": (size(names) != size(coef)) | ~length_ok(m["center"]) | ~length_ok(m["scale"]),
        "repeated_names": F.size(F.array_distinct(names)) != F.size(names),
        "not_finite": ~(_all_finite(coef) & _all_finite(m["center"]) & _all_finite(m["scale"]) & _finite(F.coalesce(m["intercept"], F.lit(0.0)))),
        "bad_calibration": F.coalesce(~_finite(cal["slope"]) | (cal["slope"] <= 0), F.lit(False)) & cal.isNotNull(),
    }
    return x.select("model_version", *[F.coalesce(c, F.lit(True)).cast("int").alias(n) for n, c in flags.items()])


def missing_features(needed: DataFrame, available: DataFrame) -> DataFrame:
    """Features an artifact needs that the frame lacks."""
    return needed.select("feature").exceptAll(available.select("feature"))


def check_requests(requests: DataFrame, pools: tuple[str, ...] = ("atp", "wta")) -> DataFrame:
    """Cleaned request columns, the list of broken rules and ``valid``."""
    surface = F.replace(F.lower(F.trim("surface")), F.lit(" court"), F.lit(""))
    pool = F.lower(F.trim("pool"))
    short = lambda c: ~F.length(F.trim(c)).between(2, 80)
    rules = {
        "pool": ~pool.isin(*pools),
        "best_of": F.col("best_of").isNotNull() & ~F.col("best_of").isin(3, 5),
        "surface": F.col("surface").isNotNull() & ~surface.isin("hard", "clay", "grass"),
        "name_length": short("player1") | short("player2"),
        "same_player": F.lower(F.trim("player1")) == F.lower(F.trim("player2")),
    }
    broken = F.array_compact(F.array(*[F.when(c, n) for n, c in rules.items()]))
    out = requests.withColumns({"broken": broken, "pool_clean": pool, "surface_clean": surface})
    return out.withColumn("valid", (F.size("broken") == 0).cast("int"))


def evidence_gate(artifacts: DataFrame, reports: DataFrame) -> DataFrame:
    """Metrics pass only when every provenance check of the matching report holds.

    ``artifacts`` carries ``model_version, model_sha, policy, status_flag, retired`` and the metric
    columns; ``reports`` the same identity columns with a ``r_`` prefix, its checks and metrics.
    """
    x = artifacts.join(reports, artifacts["model_version"] == reports["r_model_version"], "left")
    same = F.lit(True)
    for n in METRIC_NAMES:
        same = same & F.col(n).isNotNull() & (F.col(n) == F.col(f"r_{n}"))
    verified = F.coalesce(
        (F.col("status_flag") == "independently_reproduced")
        & (F.col("r_status") == "reproduced")
        & (F.col("model_sha") == F.col("r_model_sha"))
        & (F.col("policy") == F.col("r_policy"))
        & (F.col("r_rows") > 0)
        & F.col("r_regenerated")
        & F.col("r_parameters_match")
        & F.col("r_independent_formulas")
        & F.coalesce("r_cached_match", F.lit(True))
        & same,
        F.lit(False),
    )
    flagged = F.coalesce("retired", F.lit(False)) | (F.col("status_flag") == "unverified")
    status = F.when(verified, "independently_reproduced").when(flagged, "unverified").otherwise("artifact_reported")
    x = x.withColumn("evidence", status)
    return x.select(
        "model_version", "evidence", *[F.when(F.col("evidence") != "unverified", F.col(n)).alias(n) for n in METRIC_NAMES]
    )


def artifact_catalogue(heads: DataFrame, players: DataFrame) -> DataFrame:
    """Version, matches processed, player count and evaluation status per pool."""
    n = players.groupBy("model_version").agg(F.count(F.lit(1)).alias("players"))
    return heads.join(n, "model_version", "left").select(
        "tour", "model_version", "matches_processed", F.coalesce("players", F.lit(0)).alias("players"), "evaluation_status"
    )
