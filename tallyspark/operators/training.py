"""Practice plans: session expansion, drill choice, recommendations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Goals, levels, lengths and the drill library.
GOALS = (
    "Serve", "Return", "Forehand", "Backhand", "Volleys", "Footwork", "Movement", "Consistency", "Rally tolerance",
    "Defense", "Attack", "Transition game", "Net play", "Serve +1", "Return +1", "Match fitness", "Pressure points",
    "Tiebreak preparation", "Clay-court movement", "Hard-court patterns", "Grass-court patterns", "General match preparation",
)
LEVELS = ("Beginner", "Intermediate", "Advanced", "Competitive")
LENGTHS = (0, 1, 2, 4, 6, 8)
DURATIONS = (30, 45, 60, 75, 90)
DEFAULT_GOAL, DEFAULT_LEVEL = "General match preparation", "Intermediate"
DRILLS = (
    ("Service-box rhythm", 1, ("Serve", "Consistency")),
    ("Serve +1 lanes", 3, ("Serve", "Serve +1", "Attack")),
    ("Split-read return", 2, ("Return", "Return +1", "Defense")),
    ("Crosscourt height ladder", 2, ("Forehand", "Backhand", "Consistency", "Rally tolerance")),
    ("Recovery triangle", 2, ("Footwork", "Movement", "Defense", "Clay-court movement")),
    ("Short-ball transition", 3, ("Attack", "Transition game", "Net play", "Volleys")),
    ("Two-volley close", 2, ("Volleys", "Net play", "Transition game")),
    ("Defense-to-neutral", 3, ("Defense", "Movement", "Rally tolerance")),
    ("Twenty-ball tolerance", 2, ("Consistency", "Rally tolerance", "Match fitness")),
    ("Scoreboard pressure set", 4, ("Pressure points", "Tiebreak preparation", "General match preparation")),
    ("Surface pattern rehearsal", 3, ("Clay-court movement", "Hard-court patterns", "Grass-court patterns", "General match preparation")),
    ("Movement interval six", 3, ("Match fitness", "Footwork", "Movement")),
)
PHASES = ("Technique and repeatability", "Movement integration", "Pattern execution", "Pressure and match transfer")


def _half_up(c: Column) -> Column:
    return F.floor(c + 0.5).cast("int")


def normalized_requests(requests: DataFrame) -> DataFrame:
    """Out-of-range fields fall back to their defaults; a null ``tags`` becomes empty."""
    weeks = F.when(F.col("weeks").isin(*LENGTHS), F.col("weeks")).otherwise(1)
    days = F.greatest(F.lit(1), F.least(F.lit(6), F.coalesce(F.nullif("days", F.lit(0)), F.lit(3))))
    return requests.select(
        "request_id",
        F.when(F.col("goal").isin(*GOALS), F.col("goal")).otherwise(DEFAULT_GOAL).alias("goal"),
        F.when(F.col("level").isin(*LEVELS), F.col("level")).otherwise(DEFAULT_LEVEL).alias("level"),
        F.when(F.col("duration").isin(*DURATIONS), F.col("duration")).otherwise(60).alias("duration"),
        F.coalesce("tags", F.array().cast("array<string>")).alias("tags"),
        F.when(weeks == 0, 1).otherwise(weeks).alias("weeks"),
        F.when(weeks == 0, 1).otherwise(days).alias("days"),
    )


def _drills() -> Column:
    return F.array(
        *[
            F.struct(
                F.lit(i).alias("idx"),
                F.lit(n).alias("name"),
                F.lit(h).alias("difficulty"),
                F.array(*[F.lit(t) for t in tags]).alias("tags"),
            )
            for i, (n, h, tags) in enumerate(DRILLS)
        ]
    )


def expand_plan(requests: DataFrame) -> DataFrame:
    """One row per block: request -> weeks x days -> six blocks with drill, minutes and dose.

    The drill ranking is sorted once per request inside its row; no join and no shuffle.
    """
    r = normalized_requests(requests)
    wanted = F.array_append(F.col("tags"), F.col("goal"))
    keyed = F.transform(
        _drills(),
        lambda x: F.struct(
            (~F.arrays_overlap(x["tags"], wanted)).cast("int").alias("miss"),
            x["difficulty"].alias("difficulty"),
            x["idx"].alias("idx"),
            x["name"].alias("name"),
            x["tags"].alias("tags"),
        ),
    )
    r = r.withColumn("ranked", F.array_sort(keyed))
    s = r.withColumn("week", F.explode(F.sequence(F.lit(1), F.col("weeks")))).withColumn(
        "day", F.explode(F.sequence(F.lit(1), F.col("days")))
    )
    ratio = F.col("week") / F.col("weeks")
    phase = (
        F.when((F.col("weeks") <= 1) | (ratio <= 0.25), PHASES[0])
        .when(ratio <= 0.5, PHASES[1])
        .when(ratio <= 0.75, PHASES[2])
        .otherwise(PHASES[3])
    )
    s = s.withColumn("phase", phase)
    week, day, length = F.col("week"), F.col("day"), F.col("duration")
    need = F.when(F.col("phase").startswith("Pressure"), "Pressure points").otherwise(F.col("goal"))
    at = lambda i: F.get(F.col("ranked"), i.cast("int"))["name"]
    fit = F.filter("ranked", lambda x: F.array_contains(x["tags"], need))
    s = s.withColumns(
        {
            "technical": at((week + day - 2) % min(5, len(DRILLS))),
            "tactical": at((week * 2 + day + 2) % len(DRILLS)),
            "pressure": F.coalesce(F.get(fit, F.lit(0))["name"], at((week + day + 5) % len(DRILLS))),
            "warm": F.greatest(F.lit(5), _half_up(length * 0.12)),
            "cool": F.greatest(F.lit(4), _half_up(length * 0.08)),
            "move": F.greatest(F.lit(6), _half_up(length * 0.16)),
            "press": F.greatest(
                F.lit(6), _half_up(length * F.when(week == F.col("weeks"), F.lit(0.2)).otherwise(F.lit(0.14)))
            ),
        }
    )
    s = s.withColumn("left", length - F.col("warm") - F.col("cool") - F.col("move") - F.col("press"))
    s = s.withColumn("tech", _half_up(F.col("left") * 0.56))

    def block(pos: int, kind: str, title: Column, minutes: Column, dosed: bool = False) -> Column:
        sets = F.greatest(F.lit(2), _half_up(minutes / 5))
        pace = F.when(F.col("level") == "Beginner", " at controlled pace").otherwise("")
        dose = F.concat(minutes.cast("string"), F.lit(" min · "), sets.cast("string"), F.lit(" focused sets · "), F.col("phase"), pace)
        return F.struct(
            F.lit(pos).alias("position"),
            F.lit(kind).alias("block"),
            title.alias("title"),
            minutes.cast("int").alias("minutes"),
            (dose if dosed else F.lit(None).cast("string")).alias("dose"),
        )

    blocks = F.array(
        block(1, "Warm-up", F.lit("Dynamic court preparation"), F.col("warm")),
        block(2, "Technical block", F.col("technical"), F.col("tech"), True),
        block(3, "Movement / footwork", F.lit("Recovery triangle"), F.col("move")),
        block(4, "Pattern / tactical block", F.col("tactical"), F.col("left") - F.col("tech"), True),
        block(5, "Pressure / competitive block", F.col("pressure"), F.col("press")),
        block(6, "Cooldown / review", F.lit("Reset and review"), F.col("cool")),
    )
    return s.select("request_id", "week", "day", "phase", F.inline(blocks))


# Recommendation per metric keyword, first match wins.
RULES = (
    ("knee", "Build a stable athletic base", "Quiet landing with knee tracking over toes."),
    ("elbow", "Create cleaner contact spacing", "Contact feels in front, not jammed beside the body."),
    ("shoulder", "Turn before the ball arrives", "Preparation finished before the bounce."),
    ("hip", "Link hips to recovery", "First recovery step starts immediately after finish."),
)
OTHER_RULE = ("Improve the clearest visible metric", "Cleaner repeatability from clip to clip.")


def recommendations(metrics: DataFrame) -> DataFrame:
    """Title and target for each metric row by the first keyword in its name."""
    title = target = None
    for word, a, b in RULES:
        hit = F.col("metric").contains(word)
        title = F.when(hit, a) if title is None else title.when(hit, a)
        target = F.when(hit, b) if target is None else target.when(hit, b)
    return metrics.withColumn("title", title.otherwise(OTHER_RULE[0])).withColumn("target", target.otherwise(OTHER_RULE[1]))


def goal_tags(texts: DataFrame, key: str, text: str, goals: tuple[str, ...] = GOALS) -> DataFrame:
    """Goals named in a key's texts; the goal list is a literal, so there is no join."""
    low = F.lower(F.col(text))
    named = F.array_compact(F.array(*[F.when(low.contains(g.lower()), g) for g in goals]))
    return texts.select(key, F.explode(named).alias("tag")).distinct()


def merge_plan(plan: DataFrame, fresh: DataFrame, keep: int = 10) -> DataFrame:
    """New items whose title the user does not have yet come first; the newest ``keep`` stay.

    Both carry ``user_id, title, position``; lower positions are newer.
    """
    added = fresh.join(plan.select("user_id", "title").distinct(), ["user_id", "title"], "left_anti")
    both = added.withColumn("_old", F.lit(0)).unionByName(plan.withColumn("_old", F.lit(1)))
    w = Window.partitionBy("user_id").orderBy("_old", "position")
    return both.withColumn("place", F.row_number().over(w)).where(F.col("place") <= keep).drop("position")


def latest(rows: DataFrame, key: str, order: Column, keep: int = 12) -> DataFrame:
    w = Window.partitionBy(key).orderBy(order)
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= keep)
