"""Ratings kept up to date by micro-batches of results, late ones included.

A result changes every rating that follows from it, and nothing before its date. Solved matches are stored by period
(a month, unless told otherwise) next to the sums of each entity's changes in that period. A micro-batch finds the first
period it touches in every pool; only matches from there on are solved again, starting from the changes already
known, and what entities bring along is the sum over their stored periods before. Matches that a new result does not
reach settle in the first sweeps and leave them.

Every version is written under its epoch. Epoch n reads only versions before it and overwrites its own, so a repeated
epoch gives the same files. A version of a period counts until a later epoch has solved that period again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.operators import ratings as rt
from tallyspark.operators.batches import ROUND_BATCH, with_batch
from tallyspark.operators.state import ENTITY
from tallyspark.session import cut_lineage

KEYS = ("match_id", "pool", "match_date")
RESULT = "match_id bigint, pool string, match_date date, venue string, round_order int, surface string, best_of int, winner bigint, loser bigint"
RATED = ("delta", "overall_w", "overall_l", "surface_w", "surface_l")
SOLVED = f"{RESULT}, period date, {', '.join(f'{c} double' for c in RATED)}, epoch int"
TOTALS = f"pool string, entity bigint, period date, matches bigint, last_date date, overall double, {', '.join(f'{s} double' for s in rt.SURFACES)}, {', '.join(f'n_{s} bigint' for s in rt.SURFACES)}, epoch int"
SINCE = "pool string, since date, epoch int"


def _sides(matches: DataFrame) -> DataFrame:
    """Winner's and loser's row of every match."""
    keep = [c for c in matches.columns if c not in ("winner", "loser")]
    row = lambda who, won: F.struct(F.col(who).alias("entity"), F.lit(won).alias("won"))
    return matches.select(*keep, F.inline(F.array(row("winner", 1), row("loser", 0))))


class RatingFolder:
    """Folds match results (RESULT) into ratings, one micro-batch after the other.

    After any cut of the results into batches, in any order, the stored changes and ratings are those of one
    ``solve_ratings`` run over all of them. A result is known by KEYS and counts once; of several versions in
    one batch the smallest by its other columns counts, of versions in several batches the first.
    """

    def __init__(self, spark: SparkSession, root: str, spec: rt.RatingSpec = rt.DEVIATION, period: str = "month", log: list[tuple[int, int]] | None = None):
        self.spark, self.root, self.spec, self.period, self.log = spark, root, spec, period, log

    def _read(self, name: str, schema: str, epochs: int) -> DataFrame:
        paths = [f"{self.root}/{name}/epoch={e}" for e in range(epochs)]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.root}/{name}").parquet(*paths)

    def _current(self, name: str, schema: str, epochs: int) -> DataFrame:
        """The rows of the latest version of every (pool, period) before epoch ``epochs``."""
        rows = self._read(name, schema, epochs)
        since = self._read("since", SINCE, epochs).withColumnRenamed("epoch", "latest")
        periods = rows.select("pool", "period").distinct()
        latest = periods.join(since, "pool").where("since <= period").groupBy("pool", "period").agg(F.max("latest").alias("latest"))
        return rows.join(latest, ["pool", "period"]).where("epoch = latest").drop("latest", "epoch")

    def _write(self, rows: DataFrame, name: str, epoch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.root}/{name}/epoch={epoch}")

    def __call__(self, rows: DataFrame, epoch: int) -> None:
        columns = [c.split()[0] for c in RESULT.split(", ")]
        rest = [c for c in columns if c not in KEYS]
        one = rows.groupBy(*KEYS).agg(F.min(F.struct(*rest)).alias("r")).select(*KEYS, "r.*").select(columns)
        arrived = cut_lineage(one.withColumn("period", F.trunc("match_date", self.period)), "arrived")
        touched = arrived.groupBy("pool").agg(F.min("period").alias("since"))
        kept = self._current("solved", SOLVED, epoch).join(touched, "pool").where("period >= since").drop("since")
        fresh = cut_lineage(arrived.join(kept.select(*KEYS), list(KEYS), "left_anti"), "fresh")
        since = fresh.groupBy("pool").agg(F.min("period").alias("since"))
        self._write(since, "since", epoch)
        since = self.spark.read.schema("pool string, since date").parquet(f"{self.root}/since/epoch={epoch}")
        tail = kept.join(since, "pool").where("period >= since").select(*columns, "period", F.col("delta").alias("begin"))
        again = cut_lineage(tail.unionByName(fresh.withColumn("begin", F.lit(None).cast("double"))), "again")
        if self.log is not None:
            self.log.append((fresh.count(), again.count()))
        solved = rt.solve_ratings(_sides(with_batch(again.drop("begin"), ROUND_BATCH)), self.spec, carry=self._carried(since, epoch), begin=again)
        solved = cut_lineage(solved, "solved")
        self._write(again.drop("begin").join(solved.select("match_id", *RATED), "match_id"), "solved", epoch)
        changes = rt.rating_changes(solved, self.spec).select("match_id", "pool", "entity", "surface", "d_overall", "d_surface").join(again.select("match_id", "match_date", "period"), "match_id")
        on = lambda s: F.col("surface") == s
        sums = [F.count(F.lit(1)).alias("matches"), F.max("match_date").alias("last_date"), F.sum("d_overall").alias("overall")]
        sums += [F.coalesce(F.sum(F.when(on(s), F.col("d_surface"))), F.lit(0.0)).alias(s) for s in rt.SURFACES] + [F.count_if(on(s)).alias(f"n_{s}") for s in rt.SURFACES]
        self._write(changes.groupBy(*ENTITY, "period").agg(*sums), "totals", epoch)

    def _sum(self, totals: DataFrame) -> DataFrame:
        sums = [F.sum("matches").alias("matches"), F.max("last_date").alias("last_date"), *[(rt.START + F.sum(c)).alias(c) for c in ("overall", *rt.SURFACES)], *[F.sum(f"n_{s}").alias(f"n_{s}") for s in rt.SURFACES]]
        return totals.groupBy(*ENTITY).agg(*sums)

    def _carried(self, since: DataFrame, epoch: int) -> DataFrame:
        """What entities bring into the first period that is solved again."""
        return self._sum(self._current("totals", TOTALS, epoch).join(since, "pool").where("period < since"))


def current_matches(spark: SparkSession, root: str, epochs: int) -> DataFrame:
    """RESULT columns with each match's change and the ratings it was played at."""
    return RatingFolder(spark, root)._current("solved", SOLVED, epochs).drop("period")


def current_ratings(spark: SparkSession, root: str, epochs: int) -> DataFrame:
    """Every entity's matches, last date and ratings after the last match."""
    folder = RatingFolder(spark, root)
    return folder._sum(folder._current("totals", TOTALS, epochs))


def maintain_ratings(stream: DataFrame, root: str, checkpoint: str, spec: rt.RatingSpec = rt.DEVIATION, period: str = "month") -> int:
    """Take in everything that has arrived and stop; returns the number of epochs taken in so far."""
    last: list[int] = []
    folder = RatingFolder(stream.sparkSession, root, spec, period)

    def fold(rows: DataFrame, epoch: int) -> None:
        folder(rows, epoch)
        last.append(epoch)

    stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return max(last, default=-1) + 1
