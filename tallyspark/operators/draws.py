"""Single-elimination draws: validation, pair tables, exact advancement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_DRAW = 128


def validate_draws(entrants: DataFrame) -> DataFrame:
    """Size, distinct names and validity per draw: a power of two from 2 to 128, no name twice."""
    n = F.col("size")
    out = entrants.groupBy("draw_id").agg(
        F.count(F.lit(1)).alias("size"),
        F.count_distinct(F.lower(F.trim("name"))).alias("names"),
        F.count_distinct("slot").alias("slots"),
    )
    ok = (n >= 2) & (n <= MAX_DRAW) & (n.bitwiseAND(n - 1) == 0) & (F.col("names") == n) & (F.col("slots") == n)
    return out.select("draw_id", "size", "names", ok.cast("int").alias("valid"))


def valid_entrants(entrants: DataFrame) -> DataFrame:
    """Entrants of valid draws with the draw size; a draw has at most 128 rows from here on."""
    good = validate_draws(entrants).where("valid = 1").select("draw_id", "size")
    return entrants.join(good, "draw_id")


def pair_table(entrants: DataFrame, probability) -> DataFrame:
    """Both directions of every pair of a draw; ``probability(s_i, s_j)`` is computed once per pair."""
    a = entrants.select("draw_id", F.col("slot").alias("i"), F.col("strength").alias("_si"))
    b = entrants.select("draw_id", F.col("slot").alias("j"), F.col("strength").alias("_sj"))
    once = a.join(b, "draw_id").where(F.col("i") < F.col("j")).withColumn("_p", probability(F.col("_si"), F.col("_sj")))
    both = F.array(
        F.struct(F.col("i").alias("i"), F.col("j").alias("j"), F.col("_p").alias("p")),
        F.struct(F.col("j").alias("i"), F.col("i").alias("j"), (1.0 - F.col("_p")).alias("p")),
    )
    return once.select("draw_id", F.inline(both))


def round_label(players: Column) -> Column:
    """Label of the round with that many players left."""
    return (
        F.when(players == 2, "Final")
        .when(players == 4, "SF")
        .when(players == 8, "QF")
        .otherwise(F.concat(F.lit("R"), players.cast("string")))
    )


def advancement(entrants: DataFrame, pairs: DataFrame, largest: int | None = None) -> DataFrame:
    """Exact probability that each entrant wins each of its rounds, for all draws at once.

    A round joins sibling sub-brackets with the pair table. ``largest`` is the largest draw size
    present (looked up when omitted); it sets the number of rounds, at most seven.
    """
    if largest is None:
        largest = entrants.agg(F.max("size")).first()[0] or 0
    alive = entrants.select("draw_id", "slot", "size", F.lit(1.0).alias("p"))
    rounds = []
    step = 1
    while step < largest:
        live = alive.where(F.col("size") > step)
        mine = live.withColumn("_block", F.floor(F.col("slot") / step).bitwiseXOR(F.lit(1).cast("bigint")))
        theirs = live.select(
            "draw_id",
            F.col("slot").alias("_other"),
            F.col("p").alias("_q"),
            F.floor(F.col("slot") / step).alias("_block"),
        )
        met = mine.join(theirs, ["draw_id", "_block"]).join(
            pairs.select("draw_id", F.col("i").alias("slot"), F.col("j").alias("_other"), F.col("p").alias("_pij")),
            ["draw_id", "slot", "_other"],
        )
        alive = met.groupBy("draw_id", "slot", "size").agg(
            F.sum(F.col("p") * F.col("_q") * F.col("_pij")).alias("p")
        )
        rounds.append(alive.select("draw_id", "slot", round_label(F.floor(F.col("size") / step)).alias("round"), "p"))
        step *= 2
    if not rounds:
        return alive.select("draw_id", "slot", F.lit("").alias("round"), "p").where(F.lit(False))
    out = rounds[0]
    for r in rounds[1:]:
        out = out.unionByName(r)
    return out
