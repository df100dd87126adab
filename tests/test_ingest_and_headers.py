"""First lines of files, and ingest that reads only the buckets an epoch touches."""

import re

from pyspark.sql import functions as F

from tallyspark.sources.headers import CHUNK, first_line, first_lines
from tallyspark.streaming.ingest import BUCKETS, earlier_keys, first_arrivals, ingest, ingested, key_bucket


def test_first_lines(spark, tmp_path):
    texts = {"a b.csv": "x,y\r\n1,2\n", "c.csv": "only", "empty.csv": "", "long.csv": "h" * (CHUNK + 7) + "\nrest\n", "é%20.csv": "﻿ü,v\n" + "1,2\n" * 9}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    paths = [r[0] for r in spark.read.format("binaryFile").load(str(tmp_path)).select("path").collect()]
    heads = {r["head"] for r in first_lines(spark, paths).collect()}
    assert heads == {"x,y", "only", "h" * (CHUNK + 7), "﻿ü,v"}
    import gzip

    with gzip.open(tmp_path / "z.csv.gz", "wt") as f:
        f.write("p,q\n1,2\n")
    both = {r["head"] for r in first_lines(spark, [f"file:{tmp_path}/c.csv", f"file:{tmp_path}/z.csv.gz"]).collect()}
    assert both == {"only", "p,q"}
    assert first_lines(spark, []).count() == 0


def test_first_line_reads_no_further(tmp_path, monkeypatch):
    """A file of 1 GB whose body holds no text is answered from its first bytes."""
    big = tmp_path / "big.csv"
    with big.open("wb") as f:
        f.write(b"winner,loser\n")
        f.truncate(1 << 30)
    from pyarrow import fs

    from tallyspark.sources import headers

    read = []

    class Counted:
        def __init__(self, inner):
            self.inner = inner

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.inner.close()

        def read(self, n):
            read.append(n)
            return self.inner.read(n)

    class Store:
        def open_input_stream(self, name, compression):
            return Counted(fs.LocalFileSystem().open_input_stream(name, compression=compression))

    monkeypatch.setattr(headers, "_opened", lambda path: (Store(), path))
    assert first_line(str(big)) == "winner,loser" and read == [CHUNK]


def test_first_arrivals_have_a_stated_order(spark):
    rows = spark.createDataFrame([(1, "b", 2), (1, "a", 9), (1, "a", 3), (2, None, 1), (2, "a", 1), (3, "x", 0)], "k int, t string, v int")
    seen = spark.createDataFrame([(3,)], "k int")
    for n in (1, 5):
        assert sorted((r["k"], r["t"], r["v"]) for r in first_arrivals(rows.repartition(n), seen, ["k"]).collect()) == [(1, "a", 3), (2, None, 1)]


def test_epoch_reads_its_own_buckets(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    first = spark.range(4000).select("id", (F.col("id") * 2).alias("v"))
    first.coalesce(1).write.parquet(f"{source}/one")
    run = lambda: ingest(spark, f"{source}/*", first.schema, target, str(tmp_path / "check"), key="id")
    run()
    late = spark.createDataFrame([(7, -1), (9001, 5), (9001, 4), (None, 1)], "id long, v long")
    late.coalesce(1).write.parquet(f"{source}/two")
    run()
    got = {r["id"]: r["v"] for r in ingested(spark, target, first.schema).collect()}
    assert len(got) == 4002 and got[7] == 14 and got[9001] == 4 and got[None] == 1
    mine = [r[0] for r in late.select(key_bucket("id")).distinct().collect()]
    kept = earlier_keys(spark, target, first.select("id").schema, 1).where(F.col("_bucket").isin(mine))
    folders = {re.search(r"_bucket=(\d+)", f).group(1) for f in (r[0] for r in kept.select(F.input_file_name()).distinct().collect())}
    assert {int(f) for f in folders} <= set(mine)
    plan = kept._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "_bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert 0 < kept.count() < 4000 * (len(mine) + 1) // BUCKETS * 2
