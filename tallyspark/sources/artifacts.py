"""Model artifacts and directory exports as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STAT_MAP = "map<string,double>"
PLAYER = (
    f"name string, tour string, overall_elo double, surface_elo {STAT_MAP}, form_5 double, form_10 double, form_20 double, "
    f"surface_form {STAT_MAP}, stat_averages {STAT_MAP}, last_date string, matches bigint, ranking double, ranking_points double"
)
MODEL = (
    "type string, feature_names array<string>, coefficients array<double>, intercept double, center array<double>, "
    "scale array<double>, calibration struct<method:string,slope:double,intercept:double>"
)
def _struct(ddl: str) -> str:
    out = []
    depth = 0
    word = ""
    for ch in ddl:
        depth += (ch in "<(") - (ch in ">)")
        if ch == "," and depth == 0:
            out.append(word.strip())
            word = ""
        else:
            word += ch
    out.append(word.strip())
    return ", ".join(f"{f.split(' ', 1)[0]}: {f.split(' ', 1)[1]}" for f in out)


HEAD_SCHEMA = (
    "model_version string, generated_at string, tour string, training_cutoff string, temporal_policy_version string, "
    f"matches_processed bigint, evaluation_status string, metrics map<string,double>, model struct<{_struct(MODEL)}>"
)
ARTIFACT_SCHEMA = f"{HEAD_SCHEMA}, players map<string, struct<{_struct(PLAYER)}>>"


def read_artifacts(spark: SparkSession, path: str) -> DataFrame:
    """One row per artifact document."""
    return spark.read.schema(ARTIFACT_SCHEMA).option("multiLine", True).option("recursiveFileLookup", True).json(path)


def coefficient_table(artifacts: DataFrame) -> DataFrame:
    """(model_version, position, feature, coefficient, center, scale)."""
    m = F.col("model")
    zipped = F.arrays_zip(
        m["feature_names"].alias("feature"),
        m["coefficients"].alias("coefficient"),
        m["center"].alias("center"),
        m["scale"].alias("scale"),
    )
    return artifacts.select("model_version", "tour", F.posexplode(zipped).alias("position", "_c")).select(
        "model_version", "tour", "position", "_c.*"
    )


def player_table(artifacts: DataFrame) -> DataFrame:
    """(model_version, key, player columns) from the artifact's player map."""
    return artifacts.select("model_version", F.explode("players").alias("key", "_p")).select("model_version", "key", "_p.*")


def write_artifact_heads(heads: DataFrame, path: str) -> None:
    """Model documents, one JSON line each; players go to their own table."""
    heads.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def write_players(players: DataFrame, path: str) -> None:
    """Player states as JSON lines, one folder per pool, written by all tasks in parallel."""
    players.write.mode("overwrite").partitionBy("pool").json(path)


def read_artifact_heads(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(HEAD_SCHEMA).json(path)


DIRECTORY_SCHEMA = (
    "id string, name string, tour string, ranking double, matches bigint, last_date string, overall_elo double, hard_elo double, "
    "clay_elo double, grass_elo double, serve_point_won double, return_point_won double, form_5 double, status string, position bigint"
)


def export_directory(states: DataFrame, path: str) -> None:
    """Directory rows in list order (tour, known rankings first, ranking, name) as JSON lines.

    ``position`` keeps the order; it comes from a range-partitioned sort with per-range offsets,
    not from a single-task numbering.
    """
    tenth = lambda c: F.round(c + 1e-9, 1)
    elo = lambda c: tenth(F.coalesce(F.col(c), F.col("overall")))
    rows = states.select(
        F.regexp_replace("key", "::", ":").alias("id"),
        "name",
        F.upper("pool").alias("tour"),
        F.round("ranking", 0).alias("ranking"),
        "matches",
        F.col("last_date").cast("string").alias("last_date"),
        elo("overall").alias("overall_elo"),
        elo("hard").alias("hard_elo"),
        elo("clay").alias("clay_elo"),
        elo("grass").alias("grass_elo"),
        tenth(100 * F.coalesce("serve_point_won", F.lit(0.635))).alias("serve_point_won"),
        tenth(100 * F.coalesce("return_point_won", F.lit(0.365))).alias("return_point_won"),
        tenth(100 * F.coalesce("form_5", F.lit(0.5))).alias("form_5"),
        F.lit("trained").alias("status"),
    )
    from tallyspark.operators.order import numbered

    ranked = rows.withColumn("_null", F.col("ranking").isNull()).withColumn(
        "_rank", F.coalesce(F.nullif("ranking", F.lit(0.0)), F.lit(99999.0))
    )
    out = numbered(ranked, ["tour", "_null", "_rank", "name"], "position").drop("_null", "_rank")
    out.write.mode("overwrite").json(path)


def read_directory(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(DIRECTORY_SCHEMA).json(path)
