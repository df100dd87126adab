"""Table contracts: columns, allowed values, unique keys and references."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# The relational target schema.
TABLES = {
    "players": "id bigint, canonical_name string, tour string, hand string, birth_date date, country_code string, created_at timestamp",
    "player_aliases": "id bigint, player_id bigint, alias string",
    "tournaments": "id bigint, name string, level string, surface string, location string, country_code string",
    "matches": (
        "id bigint, source_match_id string, tour string, match_date date, tournament_id bigint, round string, best_of smallint, "
        "surface string, winner_id bigint, loser_id bigint, winner_rank int, loser_rank int, winner_rank_points int, "
        "loser_rank_points int, score string, minutes int, is_walkover boolean"
    ),
    "match_statistics": "match_id bigint, "
    + ", ".join(
        f"{side}_{c} int"
        for c in (
            "aces", "double_faults", "first_serve_in", "first_serve_total", "first_serve_points_won", "first_serve_points_total",
            "second_serve_points_won", "second_serve_points_total", "break_points_saved", "break_points_faced",
        )
        for side in ("winner", "loser")
    ),
    "point_events": (
        "id bigint, match_id bigint, point_number int, server_id bigint, winner_id bigint, set_number smallint, game_number smallint, "
        "score_before string, rally_length int, serve_number smallint, serve_direction string, point_ending string, created_at timestamp"
    ),
    "elo_history": (
        "id bigint, player_id bigint, match_id bigint, rating_date date, overall_elo decimal(8,2), hard_elo decimal(8,2), "
        "clay_elo decimal(8,2), grass_elo decimal(8,2), matches_played int, created_at timestamp"
    ),
    "model_versions": (
        "id bigint, version string, feature_version string, trained_at timestamp, train_start date, train_end date, "
        "metrics_json string, artifact_path string"
    ),
    "model_predictions": (
        "id bigint, model_version_id bigint, match_id bigint, player1_id bigint, player2_id bigint, player1_win_probability decimal(6,5), "
        "predicted_at timestamp, features_json string, factors_json string"
    ),
    "model_backtests": (
        "id bigint, model_version_id bigint, evaluated_at timestamp, test_start date, test_end date, tour string, surface string, "
        "matches_tested int, accuracy decimal(6,5), roc_auc decimal(6,5), log_loss decimal(8,5), brier_score decimal(8,5), calibration_json string"
    ),
    "player_surface_snapshots": (
        "id bigint, player_id bigint, snapshot_date date, tour string, hard_matches int, clay_matches int, grass_matches int, "
        "hold_rate decimal(6,5), break_rate decimal(6,5), first_serve_points_won decimal(6,5), second_serve_points_won decimal(6,5), "
        "recent_form_rating decimal(8,2)"
    ),
    "uploaded_analysis_jobs": (
        "id string, player_id bigint, status string, media_sha256 string, created_at timestamp, expires_at timestamp, result_json string"
    ),
}
ENUMS = {
    ("players", "tour"): ("atp", "wta"),
    ("tournaments", "surface"): ("Hard", "Clay", "Grass", "Carpet", "Unknown"),
    ("matches", "tour"): ("atp", "wta"),
    ("matches", "best_of"): (3, 5),
    ("point_events", "serve_number"): (1, 2),
    ("point_events", "serve_direction"): ("wide", "body", "t", "unknown"),
    ("model_backtests", "tour"): ("atp", "wta", "combined"),
    ("player_surface_snapshots", "tour"): ("atp", "wta"),
    ("uploaded_analysis_jobs", "status"): ("queued", "processing", "completed", "failed", "expired"),
}
UNIQUE = {
    "players": (("id",), ("canonical_name", "tour")),
    "player_aliases": (("id",), ("alias", "player_id")),
    "tournaments": (("id",),),
    "matches": (("id",), ("source_match_id",)),
    "match_statistics": (("match_id",),),
    "point_events": (("id",), ("match_id", "point_number")),
    "elo_history": (("id",),),
    "model_versions": (("id",), ("version",)),
    "model_predictions": (("id",),),
    "model_backtests": (("id",),),
    "player_surface_snapshots": (("id",), ("player_id", "snapshot_date")),
    "uploaded_analysis_jobs": (("id",),),
}
REFERENCES = {
    ("player_aliases", "player_id"): ("players", "id"),
    ("matches", "tournament_id"): ("tournaments", "id"),
    ("matches", "winner_id"): ("players", "id"),
    ("matches", "loser_id"): ("players", "id"),
    ("match_statistics", "match_id"): ("matches", "id"),
    ("point_events", "match_id"): ("matches", "id"),
    ("point_events", "server_id"): ("players", "id"),
    ("point_events", "winner_id"): ("players", "id"),
    ("elo_history", "player_id"): ("players", "id"),
    ("elo_history", "match_id"): ("matches", "id"),
    ("model_predictions", "model_version_id"): ("model_versions", "id"),
    ("model_predictions", "match_id"): ("matches", "id"),
    ("model_predictions", "player1_id"): ("players", "id"),
    ("model_predictions", "player2_id"): ("players", "id"),
    ("model_backtests", "model_version_id"): ("model_versions", "id"),
    ("player_surface_snapshots", "player_id"): ("players", "id"),
    ("uploaded_analysis_jobs", "player_id"): ("players", "id"),
}
# Columns that may not fall while the ordering column rises within its group.
ORDERS = {"point_events": ("match_id", "point_number", ("set_number", "game_number"))}


def declared_types(name: str) -> dict[str, str]:
    return {f.name: f.dataType.simpleString() for f in StructType.fromDDL(TABLES[name])}


def type_violations(name: str, df: DataFrame) -> DataFrame:
    """How many of the frame's declared columns have another type."""
    declared = declared_types(name)
    wrong = sum(t != declared[c] for c, t in df.dtypes if c in declared)
    return df.sparkSession.createDataFrame([("types", wrong)], "rule string, violations bigint")


def order_violations(df: DataFrame, group: str, order: str, rising: tuple[str, ...]) -> DataFrame:
    """Rows whose (rising...) is below that of the row before them in the group."""
    before = Window.partitionBy(group).orderBy(order, *(c for c in ("id",) if c in df.columns))
    pair = F.struct(*rising)
    fallen = df.withColumn("_b", F.lag(pair).over(before)).where(F.col("_b").isNotNull() & (pair < F.col("_b")))
    return fallen.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(f"order:{order}").alias("rule"), "violations")


def enum_violations(df: DataFrame, rules: dict[str, Iterable]) -> DataFrame:
    """Rows outside the allowed values per column, all columns in one pass; null passes."""
    counts = [
        F.struct(F.lit(f"enum:{c}").alias("rule"), F.count_if(~F.col(c).isin(*v)).alias("violations")) for c, v in rules.items()
    ]
    return df.agg(F.array(*counts).alias("_r")).select(F.inline("_r"))


def unique_violations(df: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """Key values that occur more than once; keys with a null are exempt."""
    known = F.lit(True)
    for c in key:
        known = known & F.col(c).isNotNull()
    repeated = df.where(known).groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return repeated.agg(F.count(F.lit(1)).alias("violations")).select(F.lit("unique:" + ",".join(key)).alias("rule"), "violations")


def reference_violations(df: DataFrame, column: str, parent: DataFrame, parent_key: str) -> DataFrame:
    orphans = df.where(F.col(column).isNotNull()).join(
        parent.select(F.col(parent_key).alias("_pk")).distinct(), F.col(column) == F.col("_pk"), "left_anti"
    )
    return orphans.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(f"reference:{column}").alias("rule"), "violations")


def check_table(name: str, frames: dict[str, DataFrame]) -> DataFrame:
    """Violations of every rule of a table that its frame has the columns for."""
    df = frames[name]
    enums = {c: v for (t, c), v in ENUMS.items() if t == name and c in df.columns}
    pieces = [type_violations(name, df)]
    pieces += [enum_violations(df, enums)] if enums else []
    pieces += [unique_violations(df, k) for k in UNIQUE.get(name, ()) if set(k) <= set(df.columns)]
    pieces += [
        reference_violations(df, c, frames[p], k)
        for (t, c), (p, k) in REFERENCES.items()
        if t == name and c in df.columns and p in frames
    ]
    group, order, rising = ORDERS.get(name, (None, None, ()))
    if group and {group, order, *rising} <= set(df.columns):
        pieces.append(order_violations(df, group, order, rising))
    out = pieces[0]
    for p in pieces[1:]:
        out = out.unionByName(p)
    return out.select(F.lit(name).alias("table_name"), "rule", "violations")
