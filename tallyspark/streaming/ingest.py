"""New result files to deduplicated matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

BUCKETS = 64


def result_stream(spark: SparkSession, path: str, schema: StructType, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def earlier_epochs(spark: SparkSession, path: str, schema: StructType, epoch: int) -> DataFrame:
    """What epochs before ``epoch`` wrote below ``path``; the repeat of an epoch never sees its own first try."""
    done = [f"{path}/epoch={e}" for e in range(epoch)]
    return spark.read.schema(schema).parquet(*done) if done else spark.createDataFrame([], schema)


def earlier_keys(spark: SparkSession, path: str, schema: StructType, epoch: int) -> DataFrame:
    """Keys that epochs before ``epoch`` wrote, with the bucket each lies in; a filter on it skips the other folders."""
    wide = StructType([*schema, StructField("_bucket", IntegerType())])
    done = [f"{path}/epoch={e}" for e in range(epoch)]
    return spark.read.schema(wide).option("basePath", path).parquet(*done) if done else spark.createDataFrame([], wide)


def first_arrivals(rows: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key was not seen before, however far back their date lies.

    Of several rows of one key that arrive together, the one with the least values in column order stays; nulls are least.
    """
    rest = [c for c in rows.columns if c not in keys]
    least = rows.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_row")) if rest else rows.distinct()
    values = [F.col("_row").getField(c).alias(c) if c in rest else F.col(c) for c in rows.columns]
    return least.select(*values).join(seen.select(*keys), keys, "left_anti")


def key_bucket(key: str) -> Column:
    return F.pmod(F.xxhash64(F.col(key)), F.lit(BUCKETS)).cast("int")


def ingest(spark: SparkSession, source: str, schema: StructType, target: str, checkpoint: str, key: str = "match_id", files_per_batch: int | None = None) -> None:
    """Process everything that has arrived and stop; a later run continues from the checkpoint.

    A match is kept at its first arrival. Repeats are found against the target itself, so there is no time bound
    and files may come in any order. The target is laid out by a hash of the key, and an epoch reads only the keys of
    the buckets that its own rows fall into.
    """

    def fold(rows: DataFrame, epoch: int) -> None:
        rows = rows.withColumn("_bucket", key_bucket(key))
        touched = [r[0] for r in rows.select("_bucket").distinct().collect()]
        kept = earlier_keys(spark, target, StructType([f for f in schema if f.name == key]), epoch).where(F.col("_bucket").isin(touched))
        fresh = first_arrivals(rows, kept, ["_bucket", key])
        fresh.write.mode("overwrite").partitionBy("_bucket").parquet(f"{target}/epoch={epoch}")

    query = (
        result_stream(spark, source, schema, files_per_batch)
        .writeStream.foreachBatch(fold)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def ingested(spark: SparkSession, target: str, schema: StructType) -> DataFrame:
    return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(target)
