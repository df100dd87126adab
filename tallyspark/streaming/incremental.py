"""Entity state kept up to date by micro-batches of results.

A micro-batch may reach back: its entities' snapshots are then taken anew from the first date it touches on.
What lies before it enters as one total per entity, read from the stored rows of those entities alone. Every version is written under its epoch; epoch n reads only versions
before it and overwrites its own, so a repeated epoch gives the same files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark.operators.batches import VENUE_BATCH, with_batch
from tallyspark.operators.prefix import prior_totals
from tallyspark.operators.state import ENTITY
from tallyspark.session import cut_lineage
from tallyspark.streaming.ingest import earlier_epochs, first_arrivals

SNAPSHOT_SCHEMA = "match_id bigint, pool string, entity bigint, n bigint, wins bigint, svpt double, last_date date"
SIDE = ["match_id", *ENTITY]


class StateFolder:
    """Folds participations into per-entity totals, one micro-batch after the other.

    The snapshots after any cut of the files into batches, in any order, are those of one batch run. A repeated
    participation counts once.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root

    def __call__(self, rows: DataFrame, epoch: int) -> None:
        kept = earlier_epochs(self.spark, f"{self.root}/rows", rows.schema, epoch)
        fresh = cut_lineage(first_arrivals(rows, kept, SIDE))
        fresh.write.mode("overwrite").parquet(f"{self.root}/rows/epoch={epoch}")
        since = cut_lineage(fresh.groupBy(*ENTITY).agg(F.min("match_date").alias("_since")))
        touched = kept.join(since, list(ENTITY))
        before = touched.where("match_date < _since").groupBy(*ENTITY).agg(
            F.count(F.lit(1)).alias("n"), F.sum("won").cast("bigint").alias("wins"), F.sum("svpt").cast("double").alias("svpt"), F.max("match_date").alias("last_date")
        )
        again = cut_lineage(with_batch(touched.where("match_date >= _since").drop("_since").select(rows.columns).unionByName(fresh), VENUE_BATCH))
        carried = before.select(*ENTITY, F.lit(0).cast("bigint").alias("batch_no"), "n", "wins", "svpt", "last_date")
        steps = again.select(
            *ENTITY, "batch_no", F.lit(1).cast("bigint").alias("n"), F.col("won").cast("bigint").alias("wins"), F.col("svpt").cast("double").alias("svpt"), F.col("match_date").alias("last_date")
        )
        sums = {c: F.col(c) for c in ("n", "wins", "svpt")}
        prior = prior_totals(carried.unionByName(steps), ENTITY, "batch_no", sums=sums, maxes={"last_date": F.col("last_date")})
        snapshots = again.select(*SIDE, "batch_no").join(prior, [*ENTITY, "batch_no"]).drop("batch_no")
        snapshots.select(*SIDE, "n", "wins", "svpt", "last_date").write.mode("overwrite").parquet(f"{self.root}/snapshots/epoch={epoch}")


def current_snapshots(spark: SparkSession, root: str) -> DataFrame:
    """The latest version of every snapshot."""
    all_versions = spark.read.schema(f"{SNAPSHOT_SCHEMA}, epoch int").parquet(f"{root}/snapshots")
    latest = Window.partitionBy(*SIDE).orderBy(F.desc("epoch"))
    return all_versions.withColumn("_v", F.row_number().over(latest)).where("_v = 1").drop("_v", "epoch")


def maintain_state(stream: DataFrame, root: str, checkpoint: str) -> None:
    query = (
        stream.writeStream.foreachBatch(StateFolder(stream.sparkSession, root))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
