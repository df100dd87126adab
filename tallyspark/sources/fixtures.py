"""Domain views over the benchmark tables: match results, participations, scored rows, pose frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Score templates by match_id % 6.
SCORES = ("6-4 6-4", "7-6(5) 6-3", "6-3 3-6 7-5", "6-0 6-1", "4-6 7-6(7) 6-4", "6-2 RET")
LEVELS = ("Beginner", "Intermediate", "Advanced", "Competitive")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def div(a: Column, n: int) -> Column:
    return F.floor(a / F.lit(n)).cast("bigint")


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events 2k and 2k+1 meet in one aggregation; equal users and equal values drop out."""
    ev = table(spark, sf_dir, "events")
    side = F.struct("value", "user_id", "event_id")
    first = F.col("event_id") % 2 == 0
    paired = (
        ev.groupBy(div(F.col("event_id"), 2).alias("match_id"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.max(F.when(first, F.col("ts"))).alias("ts"),
            F.max(F.when(first, F.col("event_type"))).alias("kind"),
            F.max(side).alias("hi"),
            F.min(side).alias("lo"),
        )
        .where("n = 2 and hi.user_id <> lo.user_id and hi.value <> lo.value")
    )
    m = F.col("match_id")
    return paired.select(
        "match_id",
        F.when(m % 2 == 0, "north").otherwise("south").alias("pool"),
        F.to_date("ts").alias("match_date"),
        F.concat(F.lit("V"), (m % 7).cast("string")).alias("venue"),
        (F.lit(1) + F.floor(F.hour("ts") / 6)).cast("int").alias("round_order"),
        F.when(F.col("kind") == "view", "clay")
        .when(F.col("kind") == "purchase", "grass")
        .when(F.col("kind") == "signup", "carpet")
        .otherwise("hard")
        .alias("surface"),
        F.when(m % 5 == 0, 5).otherwise(3).alias("best_of"),
        F.col("hi.user_id").alias("winner"),
        F.col("lo.user_id").alias("loser"),
        F.col("hi.event_id").alias("w_ev"),
        F.col("lo.event_id").alias("l_ev"),
        F.element_at(F.array(*[F.lit(s) for s in SCORES]), (m % 6 + 1).cast("int")).alias("score"),
    )


def with_participations(m: DataFrame) -> DataFrame:
    """Winner and loser rows of every match from one pass over the matches."""
    keep = [c for c in m.columns if c not in ("winner", "loser", "w_ev", "l_ev")]

    def row(me: str, other: str, ev: str, oev: str, won: int) -> Column:
        return F.struct(
            F.col(me).alias("entity"),
            F.col(other).alias("opponent"),
            F.lit(won).alias("won"),
            F.col(ev).alias("ev"),
            F.col(oev).alias("oev"),
        )

    return m.select(
        *keep, F.inline(F.array(row("winner", "loser", "w_ev", "l_ev", 1), row("loser", "winner", "l_ev", "w_ev", 0)))
    )


def serve_columns(ev: Column) -> dict[str, Column]:
    svpt = F.lit(50) + (F.lit(7) * ev) % 40
    first_in = F.lit(30) + (F.lit(11) * ev) % 20
    second = svpt - first_in
    bp_faced = ev % 11
    return {
        "svpt": svpt,
        "first_in": first_in,
        "first_won": F.lit(18) + (F.lit(5) * ev) % 12,
        "svpt_second": second,
        "second_won": div(second * ((F.lit(3) * ev) % 60 + 20), 100),
        "bp_faced": bp_faced,
        "bp_saved": div(bp_faced * (ev % 5), 5),
        "aces": (F.lit(13) * ev) % 9,
        "dfs": ev % 5,
    }


def parts(spark: SparkSession, sf_dir: str, m: DataFrame | None = None) -> DataFrame:
    """Participations with their raw counts; ``m`` may carry further match columns."""
    p = with_participations(m if m is not None else matches(spark, sf_dir))
    mine = {k: v.alias(k) for k, v in serve_columns(F.col("ev")).items()}
    theirs = {k: v.alias(f"o_{k}") for k, v in serve_columns(F.col("oev")).items()}
    ev, who = F.col("ev"), F.col("entity")
    bio = {
        "ranking": F.when(ev % 17 != 0, F.lit(1) + who % 200).cast("double"),
        "ranking_points": F.when(ev % 19 != 0, F.lit(100) * (who % 80)).cast("double"),
        "age": F.when(ev % 13 != 0, F.lit(18) + ev % 20).cast("double"),
        "height": F.when(ev % 7 != 0, F.lit(165) + who % 35).cast("double"),
        "hand": F.when(ev % 23 == 0, "").when(who % 5 == 0, "L").otherwise("R"),
    }
    return p.select("*", *mine.values(), *theirs.values(), *[c.alias(n) for n, c in bio.items()])


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    p = (F.col("l_quantity") + 1) / 52.0
    return li.select(
        "l_orderkey",
        "l_linenumber",
        p.alias("p"),
        (0.5 * p + 0.5 * (0.02 + 9 * F.col("l_discount"))).alias("p2"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("label"),
        F.col("l_linestatus").alias("grp"),
        F.to_date(F.date_trunc("month", "l_shipdate")).alias("block"),
        F.year("l_shipdate").alias("yr"),
        "l_discount",
        "l_tax",
        "l_extendedprice",
    )


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        F.col("label").alias("clip_id"),
        F.col("vec_id").alias("frame_idx"),
        F.transform(
            F.sequence(F.lit(0), F.lit(31)),
            lambda i: F.struct(
                F.get(F.col("embedding"), i * 2).cast("double").alias("x"),
                F.get(F.col("embedding"), i * 2 + 1).cast("double").alias("y"),
                (F.lit(0.5) + ((F.col("vec_id") + i * 7) % 10) / 20.0).alias("visibility"),
            ),
        ).alias("landmarks"),
    )


def entrants(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(
        div(F.col("c_custkey"), 8).alias("draw_id"),
        (F.col("c_custkey") % 8).cast("int").alias("slot"),
        F.col("c_acctbal").alias("strength"),
        F.col("c_name").alias("name"),
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    pick = lambda values, i: F.element_at(F.array(*[F.lit(v) for v in values]), (i + 1).cast("int"))
    return table(spark, sf_dir, "customer").select(
        k.alias("request_id"),
        (F.lit(1) + k % 6).cast("int").alias("days"),
        pick([0, 1, 2, 4, 6, 8], div(k, 6) % 6).alias("weeks"),
        pick([30, 45, 60, 75, 90], k % 5).alias("duration"),
        pick(LEVELS, k % 4).alias("level"),
        F.col("c_mktsegment").alias("segment"),
    )
