"""Session construction, lineage cuts and shared scratch folders."""

from __future__ import annotations

import os
import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
CLEANUP_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
WAREHOUSE_KEY = "spark.sql.warehouse.dir"
ROW_GROUP = 16 << 20


def local_session(app: str = "tallyspark", cores: str | int = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A single-machine session for tests and benchmarks; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("TALLY_DRIVER_MEMORY", "8g"))
        .config("spark.driver.extraJavaOptions", "-Xss16m")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``, else a folder in the warehouse."""
    configured = spark.conf.get(CHECKPOINT_KEY, None)
    if configured:
        return configured.rstrip("/")
    return spark.conf.get(WAREHOUSE_KEY).rstrip("/") + "/_staged"


_roots: dict[str, str] = {}


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder; what is written there goes when the session ends."""
    top = shared_dir(spark)
    session = f"{spark.sparkContext.applicationId}|{top}"
    if session not in _roots:
        root = f"{top}/tallyspark-{uuid.uuid4().hex}"
        target = spark._jvm.org.apache.hadoop.fs.Path(root)
        files = target.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(target)
        files.deleteOnExit(target)
        _roots[session] = root
    return f"{_roots[session]}/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, label: str = "cut") -> DataFrame:
    """Write ``df`` to the shared folder and continue from the files.

    The files survive the loss of any executor, so a long loop restarts from the last cut
    and not from its beginning. Files have small row groups: a reader can share even one file among many tasks.
    Once they are written, the shuffles that made them go; the driver's garbage collector would get to them much later.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    before = spark.conf.get(CLEANUP_KEY, None)
    spark.conf.set(CLEANUP_KEY, "true")
    try:
        df.write.mode("overwrite").option("compression", "zstd").option("parquet.block.size", ROW_GROUP).parquet(path)
    finally:
        spark.conf.unset(CLEANUP_KEY) if before is None else spark.conf.set(CLEANUP_KEY, before)
    if _scopes():
        _scopes()[-1].append(path)
    return _marked(spark.read.schema(df.schema).parquet(path), path)


_local = threading.local()


def _scopes() -> list[list[str]]:
    """The paths staged so far within every open ``only`` of this thread, the innermost last."""
    if not hasattr(_local, "scopes"):
        _local.scopes = []
    return _local.scopes


def _marked(df: DataFrame, path: str | None) -> DataFrame:
    df._staged_at = path
    return df


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def is_staged(df: DataFrame) -> bool:
    """Whether the frame is what ``cut_lineage`` wrote and nothing else, so that it can be read again and again."""
    return bool(df.__dict__.get("_staged_at"))


def staged(df: DataFrame, label: str = "cut") -> DataFrame:
    """``df`` itself where it is staged, else written as by ``cut_lineage``."""
    return df if is_staged(df) else cut_lineage(df, label)


def drop_staged(df: DataFrame) -> None:
    """Delete the files of a frame that ``cut_lineage`` returned, once nothing that is still to run reads them."""
    path = df.__dict__.get("_staged_at")
    if path:
        _delete(df.sparkSession, path)


def only(build: Callable[[], DataFrame | tuple[DataFrame, ...]], label: str = "cut"):
    """What ``build`` returns, one frame or several, written as by ``cut_lineage``; whatever else it staged is deleted.

    So what a long job stages on its way takes disk only as long as the job runs.
    """
    scopes = _scopes()
    scopes.append([])
    try:
        made = build()
        several = isinstance(made, tuple)
        kept = tuple(cut_lineage(df, label) for df in (made if several else (made,)))
    finally:
        staged = scopes.pop()
    paths = [df.__dict__["_staged_at"] for df in kept]
    for path in staged:
        if path not in paths:
            _delete(kept[0].sparkSession, path)
    if scopes:
        scopes[-1].extend(paths)
    return kept if several else kept[0]


def dealt(df: DataFrame) -> DataFrame:
    """``df`` with its next join dealt by key on both sides.

    Spark judges a staged table by the bytes of its compressed files, and a join by the product of its sides, so it takes
    millions of rows for a small table and builds them whole on the driver, to be sent to every task. Tables that grow
    with the matches go through here.
    """
    return _marked(df.hint("merge"), df.__dict__.get("_staged_at"))
