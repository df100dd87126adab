"""Queries over pose frames and practice plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.operators import pose, training
from tallyspark.plans.registry import query, r6, view
from tallyspark.plans.rows import rnd
from tallyspark.sources.fixtures import frames, requests, table

TRI = """(SELECT clip_id, frame_idx, max(CASE WHEN idx = {a} THEN x END) AS ax, max(CASE WHEN idx = {a} THEN y END) AS ay,
  max(CASE WHEN idx = {b} THEN x END) AS bx, max(CASE WHEN idx = {b} THEN y END) AS by_, max(CASE WHEN idx = {c} THEN x END) AS cx,
  max(CASE WHEN idx = {c} THEN y END) AS cy, min(CASE WHEN idx IN ({a}, {b}, {c}) THEN visibility END) AS vis FROM lm GROUP BY clip_id, frame_idx)"""
DENOM = "(sqrt((ax - bx) * (ax - bx) + (ay - by_) * (ay - by_)) * sqrt((cx - bx) * (cx - bx) + (cy - by_) * (cy - by_)))"
ANGLE = f"CASE WHEN {DENOM} = 0 THEN 0 ELSE degrees(acos(greatest(-1, least(1, ((ax - bx) * (cx - bx) + (ay - by_) * (cy - by_)) / {DENOM})))) END"
TILT = "CASE WHEN bx - ax = 0 THEN 90 ELSE degrees(atan2(by_ - ay, bx - ax)) END"
view(
    "fm",
    " UNION ALL ".join(
        [
            f"SELECT clip_id, frame_idx, '{n}' AS metric, {ANGLE} AS value FROM {TRI.format(a=a, b=b, c=c)} WHERE vis >= 0.55"
            for n, (a, b, c) in pose.ANGLES.items()
        ]
        + [
            f"SELECT clip_id, frame_idx, '{n}', {TILT} FROM {TRI.format(a=a, b=b, c=b)} WHERE vis >= 0.55"
            for n, (a, b) in pose.TILTS.items()
        ]
    ),
)


@query(
    "v1_joint_angle",
    f"SELECT clip_id, frame_idx, {r6(ANGLE)} AS angle FROM {TRI.format(a=23, b=25, c=27)}",
)
def _(spark, d):
    p = pose.point
    return frames(spark, d).select("clip_id", "frame_idx", rnd(pose.joint_angle(p(23), p(25), p(27))).alias("angle"))


@query("v2_frame_metrics", f"SELECT clip_id, frame_idx, metric, {r6('value')} AS value FROM fm")
def _(spark, d):
    out = pose.long_metrics(pose.frame_metrics(frames(spark, d)))
    return out.select("clip_id", "frame_idx", "metric", rnd("value").alias("value"))


@query(
    "v3_timeline",
    f"""WITH seen AS (SELECT clip_id, frame_idx, dense_rank() OVER (PARTITION BY clip_id ORDER BY frame_idx) AS k FROM fm)
        SELECT DISTINCT clip_id, frame_idx, round(frame_idx / 30.0 + 1e-9, 3) + 0.0 AS time FROM seen WHERE k <= 40""",
)
def _(spark, d):
    return pose.timeline(pose.frame_metrics(frames(spark, d))).select("clip_id", "frame_idx", "time")


@query(
    "v4_clip_status",
    """WITH c AS (SELECT label AS clip_id, count(*) AS processed FROM embeddings GROUP BY label),
       n AS (SELECT clip_id, metric, count(*) AS n FROM fm GROUP BY ALL), b AS (SELECT clip_id, max(n) AS best FROM n GROUP BY clip_id)
       SELECT c.clip_id, CASE WHEN best > 0 THEN 'ok' ELSE 'insufficient_confidence' END AS status,
       CASE WHEN best / processed >= 0.72 THEN 'High visibility' WHEN best / processed >= 0.48 THEN 'Usable visibility'
       WHEN best > 0 THEN 'Low visibility' ELSE 'Not measured' END AS quality FROM c LEFT JOIN b ON b.clip_id = c.clip_id""",
)
def _(spark, d):
    return pose.clip_status(pose.frame_metrics(frames(spark, d)))


SUMMARY = """(SELECT f.clip_id, metric, count(*) AS n, avg(value) AS mean, min(value) AS low, max(value) AS high,
   least(1.0, count(*) / CAST(any_value(processed) AS DOUBLE)) AS confidence FROM fm f
   JOIN (SELECT label AS clip_id, count(*) AS processed FROM embeddings GROUP BY label) c ON c.clip_id = f.clip_id GROUP BY f.clip_id, metric)"""


@query(
    "a16_clip_summary",
    f"""SELECT clip_id, metric, CAST(n AS BIGINT) AS n, {r6('mean')} AS mean, {r6('low')} AS low, {r6('high')} AS high,
        {r6('confidence')} AS confidence FROM {SUMMARY}""",
)
def _(spark, d):
    out = pose.clip_summary(pose.frame_metrics(frames(spark, d)))
    return out.select("clip_id", "metric", "n", *[rnd(c).alias(c) for c in ("mean", "low", "high", "confidence")])


def clips_of(spark, d):
    c = table(spark, d, "embeddings").groupBy(F.col("label").alias("clip_id")).agg((F.count(F.lit(1)) * 3).alias("frame_count"))
    return c.select(
        "clip_id",
        "frame_count",
        F.lit(30.0).alias("fps"),
        F.when(F.col("clip_id") % 3 == 0, 0).when(F.col("clip_id") % 2 == 0, 1920).otherwise(720).alias("width"),
        F.lit(1080).alias("height"),
    )


def _n(*ms):
    return "greatest(" + ", ".join(f"n_{m}" for m in ms) + ")"


_WIDE = ", ".join(
    f"count(value) FILTER (metric = '{m}') AS n_{m}, coalesce(max(value) FILTER (metric = '{m}') - min(value) FILTER (metric = '{m}'), 0) AS r_{m}"
    for m in pose.METRICS
)
_ACT = ", ".join(f"CASE WHEN {c} THEN '{t}' END" for c, t in pose.ACTIONS.items())
_SEC = ", ".join(["'Data quality'"] + [f"CASE WHEN {c} THEN '{t}' END" for c, ts in pose.SECTIONS.items() for t in ts])


@query(
    "a17_content_flags",
    f"""WITH c AS (SELECT label AS clip_id, count(*) AS processed FROM embeddings GROUP BY label),
      w AS (SELECT c.clip_id, processed, {_WIDE}, coalesce(max(value) FILTER (metric LIKE '%elbow') - min(value) FILTER (metric LIKE '%elbow'), 0) AS r_elbow
        FROM c LEFT JOIN fm f ON f.clip_id = c.clip_id GROUP BY c.clip_id, processed),
      u AS (SELECT *, {_n(*pose.METRICS)} AS usable_frames, round({_n(*pose.METRICS)} / CAST(processed AS DOUBLE) + 1e-9, 3) AS usable_ratio,
        {_n('left_elbow', 'right_elbow', 'shoulder_tilt')} / CAST(processed AS DOUBLE) AS upper_,
        {_n('left_knee', 'right_knee', 'hip_tilt')} / CAST(processed AS DOUBLE) AS lower_ FROM w),
      f AS (SELECT *, usable_ratio >= 0.12 AS player_visible, upper_ >= 0.35 AND r_elbow >= 28 AND r_shoulder_tilt >= 8 AS serve,
        upper_ >= 0.30 AND r_shoulder_tilt >= 6 AS groundstroke, lower_ >= 0.32 AND (r_left_knee >= 12 OR r_right_knee >= 12) AS movement FROM u),
      g AS (SELECT *, processed >= 35 AND (groundstroke OR movement) AS rally FROM f)
      SELECT clip_id, CAST(usable_frames AS BIGINT) AS usable_frames, usable_ratio + 0.0 AS usable_ratio, CAST(player_visible AS INTEGER) AS player_visible,
        CAST(serve AS INTEGER) AS serve, CAST(groundstroke AS INTEGER) AS groundstroke, CAST(movement AS INTEGER) AS movement, CAST(rally AS INTEGER) AS rally,
        CASE WHEN upper_ >= 0.35 AND lower_ >= 0.35 THEN 'full body visible often enough' WHEN upper_ >= 0.25 OR lower_ >= 0.25
          THEN 'partial body visible' ELSE 'body visibility too limited' END AS body_visibility,
        CASE WHEN clip_id % 3 = 0 THEN 'unknown view' WHEN clip_id % 2 = 0 THEN 'landscape court view' ELSE 'portrait or cropped view' END AS view_orientation,
        coalesce(nullif(concat_ws('; ', {_ACT}), ''), '{pose.NO_ACTION}') AS detected_actions,
        array_to_string(list_sort(list_distinct([{_SEC}])), '; ') AS supported_sections,
        concat_ws('; ', CASE WHEN usable_ratio < 0.35 THEN '{pose.FEW_FRAMES}' END, CASE WHEN lower_ < 0.25 THEN '{pose.NO_LOWER}' END,
          CASE WHEN upper_ < 0.25 THEN '{pose.NO_UPPER}' END, '{pose.ALWAYS}') AS limitations, round(processed * 3 / 30.0, 2) + 0.0 AS seconds FROM g""",
)
def _(spark, d):
    out = pose.content_flags(pose.frame_metrics(frames(spark, d)), clips_of(spark, d))
    lists = ("detected_actions", "supported_sections", "limitations")
    return out.withColumns({c: F.array_join(c, "; ") for c in lists})


@query(
    "v6_metric_regions",
    f"""SELECT clip_id, CASE WHEN contains(metric, 'knee') OR contains(metric, 'hip') THEN 'Lower body' WHEN contains(metric, 'elbow')
        OR contains(metric, 'shoulder') THEN 'Upper body' WHEN contains(metric, 'tilt') THEN 'Posture' ELSE 'Movement' END AS region,
        string_agg(metric, ',' ORDER BY metric) AS metrics FROM {SUMMARY} GROUP BY ALL""",
)
def _(spark, d):
    s = pose.clip_summary(pose.frame_metrics(frames(spark, d)))
    return s.groupBy("clip_id", pose.region(F.col("metric")).alias("region")).agg(
        F.array_join(F.sort_array(F.collect_set("metric")), ",").alias("metrics")
    )


_ORDER = " ".join(f"WHEN '{m}' THEN {i}" for i, m in enumerate(pose.METRICS))


@query(
    "k3_top_metrics",
    f"""SELECT clip_id, metric, CAST(k AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY confidence DESC,
        CASE metric {_ORDER} END) AS k FROM {SUMMARY}) WHERE k <= 4""",
)
def _(spark, d):
    s = pose.clip_summary(pose.frame_metrics(frames(spark, d)))
    return pose.top_metrics(s).select("clip_id", "metric", "rank")


@query(
    "k6_frame_sampling",
    """SELECT clip_id, frame_idx FROM (SELECT label AS clip_id, vec_id AS frame_idx, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS pos,
       greatest(1, count(*) OVER (PARTITION BY label) // 20) AS step FROM embeddings) WHERE pos % step = 0 AND pos // step < 20""",
)
def _(spark, d):
    return pose.sampled_frames(frames(spark, d), 20).select("clip_id", "frame_idx")


@query(
    "j13_recommendation_rules",
    f"""SELECT clip_id, metric, CASE {' '.join(f"WHEN contains(metric, '{w}') THEN '{t}'" for w, t, _ in training.RULES)}
        ELSE '{training.OTHER_RULE[0]}' END AS title FROM {SUMMARY}""",
)
def _(spark, d):
    s = pose.clip_summary(pose.frame_metrics(frames(spark, d)))
    return training.recommendations(s).select("clip_id", "metric", "title")


# ---- plans -----------------------------------------------------------------------------

# Fixture goal by market segment.
SEGMENT_GOAL = {"AUTOMOBILE": "Serve", "BUILDING": "Volleys", "FURNITURE": "Footwork", "HOUSEHOLD": "Pressure points"}


def plan_requests(spark, d):
    goal = F.lit("something else")
    for seg, g in SEGMENT_GOAL.items():
        goal = F.when(F.col("segment") == seg, g).otherwise(goal)
    tags = F.when(F.col("request_id") % 7 == 0, F.array(F.lit("Defense"), F.lit("Net play")))
    return requests(spark, d).withColumn("goal", goal).withColumn("tags", tags)


_TAGS = " UNION ALL ".join(
    f"SELECT {i} AS idx, '{n}' AS name, {h} AS difficulty, unnest([{', '.join(chr(39) + t + chr(39) for t in tags)}]) AS tag"
    for i, (n, h, tags) in enumerate(training.DRILLS)
)
_HALF = "CAST(floor({} + 0.5) AS INTEGER)"


@query(
    "v5_plan_expansion",
    f"""WITH tags AS ({_TAGS}), drills AS (SELECT DISTINCT idx, name, difficulty FROM tags),
      rq AS (SELECT request_id, level, duration, CASE weeks WHEN 0 THEN 1 ELSE weeks END AS weeks, CASE weeks WHEN 0 THEN 1 ELSE days END AS days,
        CASE segment {' '.join(f"WHEN '{s}' THEN '{g}'" for s, g in SEGMENT_GOAL.items())} ELSE 'General match preparation' END AS goal,
        request_id % 7 = 0 AS extra FROM requests),
      goals AS (SELECT DISTINCT goal, extra FROM rq),
      rk AS (SELECT goal, extra, idx, name, row_number() OVER (PARTITION BY goal, extra ORDER BY hit DESC, difficulty, idx) - 1 AS pos FROM
        (SELECT g.goal, g.extra, d.idx, d.name, d.difficulty, (SELECT max(CASE WHEN t.tag = g.goal OR (g.extra AND t.tag IN ('Defense', 'Net play'))
          THEN 1 ELSE 0 END) FROM tags t WHERE t.idx = d.idx) AS hit FROM goals g, drills d)),
      s AS (SELECT rq.*, w AS week, dd AS day FROM rq, (SELECT unnest(range(1, 9)) AS w), (SELECT unnest(range(1, 7)) AS dd) WHERE w <= weeks AND dd <= days),
      p AS (SELECT *, CASE WHEN weeks <= 1 OR week / weeks <= 0.25 THEN '{training.PHASES[0]}' WHEN week / weeks <= 0.5 THEN '{training.PHASES[1]}'
        WHEN week / weeks <= 0.75 THEN '{training.PHASES[2]}' ELSE '{training.PHASES[3]}' END AS phase, greatest(5, {_HALF.format('duration * 0.12')}) AS warm,
        greatest(4, {_HALF.format('duration * 0.08')}) AS cool, greatest(6, {_HALF.format('duration * 0.16')}) AS mv,
        greatest(6, {_HALF.format('duration * (CASE WHEN week = weeks THEN 0.2 ELSE 0.14 END)')}) AS pr FROM s),
      l AS (SELECT *, duration - warm - cool - mv - pr AS rest, {_HALF.format('(duration - warm - cool - mv - pr) * 0.56')} AS tech FROM p),
      n AS (SELECT l.*, a.name AS technical, b.name AS tactical, coalesce((SELECT arg_min(r.name, r.pos) FROM rk r JOIN tags t ON t.idx = r.idx
          WHERE r.goal = l.goal AND r.extra = l.extra AND t.tag = CASE WHEN starts_with(phase, 'Pressure') THEN 'Pressure points' ELSE l.goal END), c.name) AS pressure
        FROM l JOIN rk a ON a.goal = l.goal AND a.extra = l.extra AND a.pos = (week + day - 2) % 5
        JOIN rk b ON b.goal = l.goal AND b.extra = l.extra AND b.pos = (week * 2 + day + 2) % 12
        JOIN rk c ON c.goal = l.goal AND c.extra = l.extra AND c.pos = (week + day + 5) % 12),
      o AS (SELECT request_id, week, day, phase, level, 1 AS position, 'Warm-up' AS block, 'Dynamic court preparation' AS title, warm AS minutes FROM n
        UNION ALL SELECT request_id, week, day, phase, level, 2, 'Technical block', technical, tech FROM n
        UNION ALL SELECT request_id, week, day, phase, level, 3, 'Movement / footwork', 'Recovery triangle', mv FROM n
        UNION ALL SELECT request_id, week, day, phase, level, 4, 'Pattern / tactical block', tactical, rest - tech FROM n
        UNION ALL SELECT request_id, week, day, phase, level, 5, 'Pressure / competitive block', pressure, pr FROM n
        UNION ALL SELECT request_id, week, day, phase, level, 6, 'Cooldown / review', 'Reset and review', cool FROM n)
      SELECT request_id, CAST(week AS INTEGER) AS week, CAST(day AS INTEGER) AS day, phase, CAST(position AS INTEGER) AS position, block, title,
        CAST(minutes AS INTEGER) AS minutes, CASE WHEN position IN (2, 4) THEN minutes || ' min · ' || greatest(2, {_HALF.format('minutes / 5')}) || ' focused sets · '
        || phase || CASE WHEN level = 'Beginner' THEN ' at controlled pace' ELSE '' END END AS dose FROM o""",
)
def _(spark, d):
    return training.expand_plan(plan_requests(spark, d))


@query(
    "v7_goal_tags",
    """WITH t AS (SELECT p_brand AS owner, lower(p_name || ' / ' || p_type) AS txt FROM part)
       SELECT DISTINCT owner, g AS tag FROM t, (SELECT unnest(['Red', 'Ring', 'Economy', 'Widget', 'Rally tolerance']) AS g) WHERE contains(txt, lower(g))""",
)
def _(spark, d):
    p = table(spark, d, "part").select(F.col("p_brand").alias("owner"), F.concat_ws(" / ", "p_name", "p_type").alias("txt"))
    return training.goal_tags(p, "owner", "txt", ("Red", "Ring", "Economy", "Widget", "Rally tolerance"))


@query(
    "v8_merge_plan",
    """WITH it AS (SELECT o_custkey AS user_id, o_orderpriority || '/' || CAST(month(o_orderdate) AS VARCHAR) AS title, o_orderkey AS position, o_orderkey % 3 = 0 AS fresh FROM orders),
       b AS (SELECT user_id, title, position, 1 AS old FROM it WHERE NOT fresh UNION ALL SELECT user_id, title, position, 0 FROM it f WHERE fresh
         AND NOT EXISTS (SELECT 1 FROM it p WHERE NOT p.fresh AND p.user_id = f.user_id AND p.title = f.title))
       SELECT user_id, title, CAST(k AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY old, position) AS k FROM b) WHERE k <= 10""",
)
def _(spark, d):
    o = table(spark, d, "orders").select(
        F.col("o_custkey").alias("user_id"),
        F.concat_ws("/", "o_orderpriority", F.month("o_orderdate").cast("string")).alias("title"),
        F.col("o_orderkey").alias("position"),
    )
    fresh = F.col("position") % 3 == 0
    return training.merge_plan(o.where(~fresh), o.where(fresh)).select("user_id", "title", "place")


@query(
    "v8_latest_analyses",
    """SELECT user_id, event_id, CAST(k AS INTEGER) AS place FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k
       FROM events) WHERE k <= 12""",
)
def _(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "ts")
    newest = F.struct("ts", "event_id").desc()
    return training.latest(e, "user_id", newest).select("user_id", "event_id", "place")
