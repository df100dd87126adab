"""Joint metrics of body landmarks and what a clip supports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.operators.prefix import sequence_rows

# Landmark indices of the body-pose model.
ANGLES = {
    "left_knee": (23, 25, 27),
    "right_knee": (24, 26, 28),
    "left_elbow": (11, 13, 15),
    "right_elbow": (12, 14, 16),
}
TILTS = {"shoulder_tilt": (11, 12), "hip_tilt": (23, 24)}
METRICS = (*ANGLES, *TILTS)
MIN_VISIBILITY = 0.55
MAX_FRAMES = 90


def point(i: int, landmarks: str = "landmarks") -> Column:
    return F.get(F.col(landmarks), F.lit(i))


def joint_angle(a: Column, b: Column, c: Column) -> Column:
    """Angle at b in degrees; zero where a side has no length."""
    ux, uy, vx, vy = a["x"] - b["x"], a["y"] - b["y"], c["x"] - b["x"], c["y"] - b["y"]
    size = F.sqrt(ux * ux + uy * uy) * F.sqrt(vx * vx + vy * vy)
    cosine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (ux * vx + uy * vy) / F.nullif(size, F.lit(0.0))))
    return F.when(size == 0, F.lit(0.0)).otherwise(F.degrees(F.acos(cosine)))


def tilt(a: Column, b: Column) -> Column:
    """Degrees from horizontal; 90 for a vertical line."""
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    return F.when(dx == 0, F.lit(90.0)).otherwise(F.degrees(F.atan2(dy, dx)))


def frame_metrics(frames: DataFrame, min_visibility: float = MIN_VISIBILITY) -> DataFrame:
    """Six metrics per frame; null where one of their points is not visible enough."""

    def seen(*ids: int) -> Column:
        out = F.lit(True)
        for i in ids:
            out = out & (point(i)["visibility"] >= min_visibility)
        return out

    cols = {n: F.when(seen(*ids), joint_angle(*[point(i) for i in ids])) for n, ids in ANGLES.items()}
    cols |= {n: F.when(seen(*ids), tilt(*[point(i) for i in ids])) for n, ids in TILTS.items()}
    return frames.select("clip_id", "frame_idx", *[c.alias(n) for n, c in cols.items()])


def sampled_frames(frames: DataFrame, most: int = MAX_FRAMES) -> DataFrame:
    """Every k-th frame of a clip, k = max(1, frames div most), at most ``most`` of them."""
    sizes = frames.groupBy("clip_id").agg(F.count(F.lit(1)).alias("frame_count"))
    ordered = sequence_rows(frames, ["clip_id"], "frame_idx", "frame_idx", out="_pos").join(sizes, "clip_id")
    step = F.greatest(F.lit(1), F.floor(F.col("frame_count") / most))
    pos = F.col("_pos") - 1
    kept = ordered.where((pos % step == 0) & (F.floor(pos / step) < most))
    return kept.drop("_pos", "_pos_before")


def long_metrics(metrics: DataFrame) -> DataFrame:
    flat = F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in METRICS]))
    return metrics.select("clip_id", "frame_idx", flat).where("value is not null")


def clip_summary(metrics: DataFrame) -> DataFrame:
    """Mean, range and detection rate per clip and metric."""
    processed = metrics.groupBy("clip_id").agg(F.count(F.lit(1)).alias("processed"))
    per = long_metrics(metrics).groupBy("clip_id", "metric").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("value").alias("mean"),
        F.min("value").alias("low"),
        F.max("value").alias("high"),
    )
    return per.join(processed, "clip_id").withColumn(
        "confidence", F.least(F.lit(1.0), F.col("n") / F.greatest(F.col("processed"), F.lit(1)))
    )


def quality_label(confidence: Column) -> Column:
    return (
        F.when(confidence >= 0.72, "High visibility")
        .when(confidence >= 0.48, "Usable visibility")
        .when(confidence > 0, "Low visibility")
        .otherwise("Not measured")
    )


def clip_status(metrics: DataFrame) -> DataFrame:
    """Whether a clip has any reliable landmark, and its best metric's visibility."""
    found = [F.count(m) for m in METRICS]
    best = F.greatest(*found) / F.count(F.lit(1))
    total = sum(found[1:], found[0])
    return metrics.groupBy("clip_id").agg(
        F.when(total > 0, "ok").otherwise("insufficient_confidence").alias("status"),
        quality_label(best).alias("quality"),
    )


def timeline(metrics: DataFrame, fps: float = 30.0, most: int = 40) -> DataFrame:
    """The first detected frames of each clip with their time in seconds."""
    any_seen = F.coalesce(*[F.col(m) for m in METRICS]).isNotNull()
    w = Window.partitionBy("clip_id").orderBy("frame_idx")
    first = metrics.where(any_seen).withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= most)
    return first.select("clip_id", "frame_idx", F.round(F.col("frame_idx") / fps + 1e-9, 3).alias("time"), *METRICS)


# Texts of the content report.
ACTIONS = {
    "player_visible": "player visible",
    "serve": "serve-like upper-body loading",
    "groundstroke": "groundstroke-style torso rotation",
    "movement": "lower-body movement",
    "rally": "multi-moment rally/movement sample",
}
NO_ACTION = "no reliable tennis action confirmed"
SECTIONS = {
    "serve": ("Serve/body loading",),
    "groundstroke": ("Stroke mechanics",),
    "movement": ("Footwork", "Recovery"),
    "rally": ("Consistency",),
}
FEW_FRAMES = "Limited usable landmark frames; confidence is reduced."
NO_LOWER = "Lower body was not visible often enough for reliable footwork claims."
NO_UPPER = "Upper body was not visible often enough for reliable stroke mechanics."
ALWAYS = "Ball speed, spin, racket angle and shot outcome are not measured by this pose-only analyzer."


def content_flags(metrics: DataFrame, clips: DataFrame) -> DataFrame:
    """What each clip supports. ``clips`` carries ``frame_count, fps, width, height`` per clip."""
    wide = metrics.groupBy("clip_id").agg(
        F.count(F.lit(1)).alias("processed"),
        *[F.count(m).alias(f"n_{m}") for m in METRICS],
        *[F.coalesce(F.max(m) - F.min(m), F.lit(0.0)).alias(f"r_{m}") for m in METRICS],
        F.coalesce(
            F.max(F.greatest("left_elbow", "right_elbow")) - F.min(F.least("left_elbow", "right_elbow")), F.lit(0.0)
        ).alias("r_elbow"),
    )
    n = lambda *ms: F.greatest(*[F.col(f"n_{m}") for m in ms])
    base = F.greatest(F.col("processed"), F.lit(1))
    x = wide.join(clips, "clip_id").withColumns(
        {
            "usable_frames": n(*METRICS),
            "usable_ratio": F.round(n(*METRICS) / base + 1e-9, 3),
            "upper": n("left_elbow", "right_elbow", "shoulder_tilt") / base,
            "lower": n("left_knee", "right_knee", "hip_tilt") / base,
        }
    )
    upper, lower = F.col("upper"), F.col("lower")
    x = x.withColumns(
        {
            "player_visible": F.col("usable_ratio") >= 0.12,
            "serve": (upper >= 0.35) & (F.col("r_elbow") >= 28) & (F.col("r_shoulder_tilt") >= 8),
            "groundstroke": (upper >= 0.30) & (F.col("r_shoulder_tilt") >= 6),
            "movement": (lower >= 0.32) & ((F.col("r_left_knee") >= 12) | (F.col("r_right_knee") >= 12)),
        }
    ).withColumn("rally", (F.col("processed") >= 35) & (F.col("groundstroke") | F.col("movement")))
    body = (
        F.when((upper >= 0.35) & (lower >= 0.35), "full body visible often enough")
        .when((upper >= 0.25) | (lower >= 0.25), "partial body visible")
        .otherwise("body visibility too limited")
    )
    view = F.when(
        (F.col("width") > 0) & (F.col("height") > 0),
        F.when(F.col("width") / F.greatest("height", F.lit(1)) >= 1.25, "landscape court view").otherwise("portrait or cropped view"),
    ).otherwise("unknown view")
    actions = F.array_compact(F.array(*[F.when(F.col(c), t) for c, t in ACTIONS.items()]))
    sections = F.array_compact(F.array(F.lit("Data quality"), *[F.when(F.col(c), t) for c, ts in SECTIONS.items() for t in ts]))
    limits = F.array_compact(
        F.array(
            F.when(F.col("usable_ratio") < 0.35, FEW_FRAMES),
            F.when(lower < 0.25, NO_LOWER),
            F.when(upper < 0.25, NO_UPPER),
            F.lit(ALWAYS),
        )
    )
    return x.select(
        "clip_id",
        "usable_frames",
        "usable_ratio",
        *[F.col(c).cast("int").alias(c) for c in ("player_visible", "serve", "groundstroke", "movement", "rally")],
        body.alias("body_visibility"),
        view.alias("view_orientation"),
        F.when(F.size(actions) > 0, actions).otherwise(F.array(F.lit(NO_ACTION))).alias("detected_actions"),
        F.array_sort(F.array_distinct(sections)).alias("supported_sections"),
        limits.alias("limitations"),
        F.when((F.col("frame_count") > 0) & (F.col("fps") > 0), F.round(F.col("frame_count") / F.col("fps"), 2)).alias("seconds"),
    )


def region(metric: Column) -> Column:
    return (
        F.when(metric.contains("knee") | metric.contains("hip"), "Lower body")
        .when(metric.contains("elbow") | metric.contains("shoulder"), "Upper body")
        .when(metric.contains("tilt"), "Posture")
        .otherwise("Movement")
    )


def top_metrics(summary: DataFrame, most: int = 4) -> DataFrame:
    """The most reliable metrics of each clip; equal confidence keeps the metric order."""
    order = F.array_position(F.array(*[F.lit(m) for m in METRICS]), F.col("metric"))
    w = Window.partitionBy("clip_id").orderBy(F.desc("confidence"), order)
    return summary.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)
