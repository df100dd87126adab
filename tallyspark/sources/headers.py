"""First lines and hashes of files, read without holding the files."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Schemes that Spark and pyarrow name differently.
_SCHEMES = {"s3a": "s3", "s3n": "s3"}
FILES_PER_TASK = 64
CHUNK = 1 << 16
PIECE = 1 << 22


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    """The store of a path as Spark lists it: a scheme and the name as it is, nothing escaped."""
    scheme, found, name = path.partition(":")
    if not found or "/" in scheme:
        return fs.LocalFileSystem(), path
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + name.lstrip("/")
    return fs.FileSystem.from_uri(f"{_SCHEMES.get(scheme, scheme)}:{quote(name, safe='/:@')}")


def reachable(path: str) -> bool:
    """Whether Python can open the path here."""
    try:
        store, name = _opened(path)
        return store.get_file_info(name).is_file
    except (OSError, pa.ArrowException):
        return False


def sha256(path: str, length: int) -> str:
    """Hash of a file of ``length`` bytes, read piece by piece."""
    store, name = _opened(path)
    digest, seen = hashlib.sha256(), 0
    with store.open_input_stream(name, compression=None) as stream:
        while piece := stream.read(PIECE):
            digest.update(piece)
            seen += len(piece)
    if seen != length:
        raise OSError(f"{path}: {seen} bytes read of {length}")
    return digest.hexdigest()


def first_line(path: str) -> str | None:
    """The text before the first line end, null for an empty file; reads on only until that line ends."""
    store, name = _opened(path)
    line = b""
    with store.open_input_stream(name, compression=None) as stream:
        while chunk := stream.read(CHUNK):
            line += chunk
            if b"\n" in chunk:
                break
    return line.split(b"\n", 1)[0].rstrip(b"\r").decode("utf-8", "replace") if line else None


class _Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class _Reader(DataSourceReader):
    def __init__(self, paths: list[str]):
        self.paths = paths

    def partitions(self) -> list[_Files]:
        return [_Files(self.paths[i : i + FILES_PER_TASK]) for i in range(0, len(self.paths), FILES_PER_TASK)] or [_Files([])]

    def read(self, partition: _Files) -> Iterator[tuple[str, str | None]]:
        return ((path, first_line(path)) for path in partition.paths)


class FirstLines(DataSource):
    """``path, head`` of the files listed in the option ``paths``, one per line; a task reads the first bytes of 64 files."""

    @classmethod
    def name(cls) -> str:
        return "tally_first_lines"

    def schema(self) -> str:
        return "path string, head string"

    def reader(self, schema) -> _Reader:
        return _Reader([p for p in self.options.get("paths", "").split("\n") if p])


def _scanned(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The same by Spark's own text reader, which reads the files whole."""
    lines = spark.read.text(paths).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at"), "value", F.monotonically_increasing_id().alias("line"))
    return lines.where("at = 0").groupBy("path").agg(F.min_by("value", "line").alias("head"))


def first_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``path, head`` of every file that is not empty.

    Compressed files, and stores that Python cannot open here (Spark may know more of them), go through Spark's own reader.
    """
    packed = [p for p in paths if p.rsplit(".", 1)[-1].lower() in ("gz", "bz2", "zst", "lz4", "snappy", "deflate", "xz")]
    plain = sorted(set(paths) - set(packed))
    if plain and not reachable(plain[0]):
        packed, plain = paths, []
    spark.dataSource.register(FirstLines)
    found = spark.read.format(FirstLines.name()).option("paths", "\n".join(plain)).load().where("head is not null")
    return found.unionByName(_scanned(spark, packed)) if packed else found
