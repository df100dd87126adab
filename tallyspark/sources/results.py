"""Match results from CSV files in either of two layouts."""

from __future__ import annotations

import csv
import json
from collections import defaultdict
from collections.abc import Iterable

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions.text import (
    SURFACES_THREE,
    best_of_or_default,
    canonical_surface,
    first_float,
    normalize_name,
    parse_date,
)
from tallyspark.sources.headers import first_lines, reachable, sha256

YEARLY_NAME = r"(?i)^(atp|wta)_matches_\d{4}\.csv$"
# Raw count columns per side.
COUNTS = ("svpt", "1stIn", "1stWon", "2ndWon", "bpSaved", "bpFaced", "ace", "df")


def file_listing(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Path, name, size and modification time of every file below ``path``; contents are not read."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", glob)
        .load(path)
        .select("path", "length", "modificationTime")
    )
    return files.withColumn("name", F.element_at(F.split("path", "/"), -1))


def source_manifest(spark: SparkSession, path: str, expected: Iterable[str], smallest: int = 1000) -> DataFrame:
    """Status of every expected file: exists, too_small or missing."""
    wanted = spark.createDataFrame([(e,) for e in expected], "name string")
    found = file_listing(spark, path).groupBy("name").agg(F.max("length").alias("length"))
    status = F.when(F.col("length").isNull(), "missing").when(F.col("length") > smallest, "exists").otherwise("too_small")
    return wanted.join(found, "name", "left").select("name", F.coalesce("length", F.lit(0)).alias("length"), status.alias("status"))


def pool_of_file(path: Column) -> Column:
    """``wta`` when the file name or its folder says so, else ``atp``."""
    tail = F.lower(F.regexp_extract(path, r"([^/]+/[^/]+)$", 1))
    return F.when(tail.contains("wta"), "wta").otherwise("atp")


def _headers(spark: SparkSession, paths: list[str]) -> dict[tuple[str, ...], list[str]]:
    """Files grouped by their header line, found in one job over the first bytes of every file."""
    first = first_lines(spark, paths)
    groups: dict[tuple[str, ...], list[str]] = defaultdict(list)
    for row in first.groupBy("head").agg(F.sort_array(F.collect_list("path")).alias("paths")).orderBy("head").collect():
        names = next(csv.reader([row["head"].lstrip("\ufeff")]), [])
        groups[tuple(names)] += row["paths"]
    return groups


def read_raw(spark: SparkSession, path: str, name_pattern: str | None = None) -> DataFrame:
    """All CSV rows below ``path`` as text columns plus ``_path``, whatever the files' layouts."""
    files = file_listing(spark, path, "*.csv")
    if name_pattern:
        files = files.where(F.col("name").rlike(name_pattern))
    paths = sorted(r[0] for r in files.select("path").collect())
    if not paths:
        raise FileNotFoundError(f"no result files below {path}")
    out = None
    for names, members in _headers(spark, paths).items():
        schema = ", ".join(f"`{n}` string" for n in names)
        rows = spark.read.schema(schema).option("header", True).option("escape", '"').csv(members)
        rows = rows.select("*", F.col("_metadata.file_path").alias("_path"))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


def _text(df: DataFrame, *names: str) -> Column:
    """First nonempty column among the aliases present in the frame."""
    have = [F.when(F.trim(F.col(f"`{n}`")) != "", F.col(f"`{n}`")) for n in names if n in df.columns]
    return F.coalesce(*have) if have else F.lit(None).cast("string")


def _number(df: DataFrame, *names: str) -> Column:
    have = [F.col(f"`{n}`") for n in names if n in df.columns]
    return first_float(*have) if have else F.lit(None).cast("double")


def adapt(raw: DataFrame, pool: Column, surfaces: tuple[str, ...] = SURFACES_THREE) -> DataFrame:
    """Both layouts to one schema; rows without two names or a readable date are left out.

    The two-player layout names its sides and repeats the winner; ranks and points follow the side
    the winner is on.
    """
    named = raw.select(
        "*",
        normalize_name(F.coalesce(_text(raw, "winner_name", "winner", "Winner"), F.lit(""))).alias("_w"),
        normalize_name(F.coalesce(_text(raw, "loser_name", "loser"), F.lit(""))).alias("_l"),
        normalize_name(F.coalesce(_text(raw, "Player_1", "player_1"), F.lit(""))).alias("_p1"),
        normalize_name(F.coalesce(_text(raw, "Player_2", "player_2"), F.lit(""))).alias("_p2"),
        pool.alias("pool"),
    )
    w, p1, p2 = F.col("_w"), F.col("_p1"), F.col("_p2")
    first = (p1 != "") & (w == p1)
    second = ~first & (p2 != "") & (w == p2)
    both = (w != "") & (p1 != "") & (p2 != "")
    loser = F.when(F.col("_l") != "", F.col("_l")).when(both & first, p2).when(both & second, p1).otherwise(F.lit(""))

    def sided(plain: tuple[str, ...], stem: str, winner: bool) -> Column:
        one, two = _number(raw, f"{stem}_1"), _number(raw, f"{stem}_2")
        if not winner:
            one, two = two, one
        return F.coalesce(_number(raw, *plain), F.when(first, one).when(second, two))

    level = F.trim(F.coalesce(_text(raw, "tourney_level"), F.lit("")))
    cols = {
        "pool": F.col("pool"),
        "match_date": parse_date(_text(raw, "tourney_date", "date", "Date")),
        "venue_id": F.trim(F.coalesce(_text(raw, "tourney_id"), F.lit(""))),
        "venue": F.coalesce(_text(raw, "tourney_name", "tournament", "Tournament"), F.lit("")),
        "surface": canonical_surface(_text(raw, "surface", "Surface"), surfaces),
        "level": level,
        "indoor": F.upper(F.trim(F.coalesce(_text(raw, "indoor"), F.lit("")))),
        "round": F.trim(F.coalesce(_text(raw, "round", "Round"), F.lit(""))),
        "best_of": best_of_or_default(_number(raw, "best_of", "Best of"), F.col("pool"), level),
        "winner": w,
        "loser": loser,
        "winner_rank": sided(("winner_rank", "winner_rank_num"), "Rank", True),
        "loser_rank": sided(("loser_rank", "loser_rank_num"), "Rank", False),
        "winner_rank_points": sided(("winner_rank_points", "winner_points"), "Pts", True),
        "loser_rank_points": sided(("loser_rank_points", "loser_points"), "Pts", False),
        "score": F.coalesce(_text(raw, "score", "Score"), F.lit("")),
    }
    for side in ("winner", "loser"):
        cols[f"{side}_age"] = _number(raw, f"{side}_age")
        cols[f"{side}_height"] = _number(raw, f"{side}_ht")
        cols[f"{side}_hand"] = F.upper(F.trim(F.coalesce(_text(raw, f"{side}_hand"), F.lit(""))))
    for s in ("w", "l"):
        cols |= {f"{s}_{c}": _number(raw, f"{s}_{c}") for c in COUNTS}
    out = named.select(*[c.alias(n) for n, c in cols.items()])
    return out.where((F.col("winner") != "") & (F.col("loser") != "") & F.col("match_date").isNotNull())


def read_results(spark: SparkSession, path: str, name_pattern: str | None = None, surfaces: tuple[str, ...] = SURFACES_THREE) -> DataFrame:
    raw = read_raw(spark, path, name_pattern)
    return adapt(raw, pool_of_file(F.col("_path")), surfaces)


# Round codes in playing order.
ROUND_ORDER = {"RR": 1, "R128": 2, "R64": 3, "R32": 4, "R16": 5, "QF": 6, "SF": 7, "F": 8, "BR": 8, "3rd/4th": 8}


def round_order(round_code: Column) -> Column:
    codes = F.create_map(*[F.lit(x) for kv in ROUND_ORDER.items() for x in kv])
    return F.coalesce(F.try_element_at(codes, round_code), F.lit(0))


REQUIRED = (("winner", "winner_name", "Winner"), ("loser", "loser_name", "Player_1"), ("tourney_name", "tournament", "Tournament"), ("surface", "Surface"), ("tourney_date", "date", "Date"))


def column_report(spark: SparkSession, path: str) -> DataFrame:
    """Rows and missing required columns per file; a column counts under any of its spellings."""
    paths = sorted(r[0] for r in file_listing(spark, path, "*.csv").select("path").collect())
    heads = [
        (p, ",".join(sorted(group[0] for group in REQUIRED if not set(group) & set(names))))
        for names, members in _headers(spark, paths).items()
        for p in members
    ]
    listed = spark.createDataFrame(heads, "path string, missing string")
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").text(path)
    counted = lines.groupBy(F.col("_metadata.file_path").alias("path")).agg((F.count_if(F.trim("value") != "") - 1).alias("rows"))
    same = lambda c: F.regexp_replace(c, "^file:/*", "/")
    return listed.join(counted.withColumn("_k", same(F.col("path"))).drop("path"), same(F.col("path")) == F.col("_k"), "left").select(
        F.element_at(F.split("path", "/"), -1).alias("file"), F.coalesce("rows", F.lit(0)).alias("rows"), "missing"
    )


def _combined(place: str, item: Column) -> Column:
    """SHA-256 over the items of a group in the order of ``place``."""
    return F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(place).alias("p"), item.alias("i")))), lambda x: x["i"]), "\n"), 256)


# Fixed value: the most bytes that are held as one value, where Python cannot open the files.
WHOLE = 64 << 20


def _hashed(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    for batch in batches:
        found = [sha256(path, length) for path, length in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], names=["path", "length", "sha"])


def _hashed_in_store(spark: SparkSession, files: DataFrame) -> DataFrame:
    """Files of a store that only Spark opens: small ones are values of a task, large ones pass through the driver in small pieces."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    large = []
    for r in files.where(F.col("length") > WHOLE).select("path", "length").collect():
        where = jvm.org.apache.hadoop.fs.Path(r["path"])
        stream = where.getFileSystem(conf).open(where)
        try:
            large.append((r["path"], r["length"], jvm.org.apache.commons.codec.digest.DigestUtils.sha256Hex(stream)))
        finally:
            stream.close()
    small = files.where(F.col("length") <= WHOLE).select("path", "length", F.sha2("content", 256).alias("sha"))
    return small.unionByName(spark.createDataFrame(large, "path string, length bigint, sha string"))


def fingerprints(spark: SparkSession, path: str, glob: str = "*.csv") -> DataFrame:
    """Number of files, snapshot hash of paths and sizes (16 hex digits), and a hash of paths and contents.

    Files are known by their path below ``path``; each file, of any size, is hashed where it is read, a piece at a time, and
    only its hash moves on. Hashes are combined in path order within 4096 groups given by the path's own hash, then the
    groups are combined in order: no step holds more than its share of the files.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    root = F.length(F.regexp_replace(F.lit(path.rstrip("/")), "^[a-z]+:/*", "/"))
    below = F.substr(F.regexp_replace("path", "^[a-z]+:/*", "/"), root + 2)
    one = files.select("path").first()
    if one is None or reachable(one["path"]):
        read = files.select("path", "length").mapInArrow(_hashed, "path string, length bigint, sha string")
    else:
        read = _hashed_in_store(spark, files)
    hashed = read.select(below.alias("name"), "length", "sha")
    size, sha = F.concat_ws(":", "name", F.col("length").cast("string")), F.concat_ws(":", "name", "sha")
    group = F.substring(F.sha2("name", 256), 1, 3).alias("group")
    part = hashed.groupBy(group).agg(F.count("*").alias("n"), _combined("name", size).alias("sizes"), _combined("name", sha).alias("shas"))
    return part.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("files"), F.substring(_combined("group", F.col("sizes")), 1, 16).alias("snapshot"), _combined("group", F.col("shas")).alias("content")
    )


def row_fingerprint(df: DataFrame) -> DataFrame:
    """Order-independent fingerprint of all rows: count, and sum and XOR of 60-bit row digests.

    A row's digest is the MD5 of its values as text, joined by ``|``, null as ``~``. The sum is a decimal, so it does
    not overflow at any number of rows.
    """
    text = F.concat_ws("|", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("~")) for c in df.columns])
    h = F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")
    return df.select(h.alias("h")).agg(F.count(F.lit(1)).alias("rows"), F.bit_xor("h").alias("xor"), F.sum(F.col("h").cast("decimal(38,0)")).cast("string").alias("total"))


def _canonical(texts: pd.Series) -> pd.Series:
    """JSON texts with sorted keys at every depth and no blanks; null where a text is no JSON."""

    def one(text: str | None) -> str | None:
        try:
            return None if text is None else json.dumps(json.loads(text), sort_keys=True, separators=(",", ":"))
        except (ValueError, RecursionError):
            return None

    return texts.map(one, na_action="ignore")


def canonical_json_hash(df: DataFrame, key: str, value: str) -> DataFrame:
    """SHA-256 of each row's JSON value in one canonical form; null where the text is null or no JSON.

    Keys are sorted at every depth (of repeated ones the last counts), arrays keep their order, strings stay strings and
    other than ASCII is escaped, numbers have their shortest form. Spark's own JSON writer prints numbers and letters in
    another way, so a small Arrow-batched function states the form.
    """
    form = F.pandas_udf(_canonical, "string")
    return df.select(key, F.sha2(form(F.col(value)), 256).alias("sha256"))
