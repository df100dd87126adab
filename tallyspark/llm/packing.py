"""Length buckets with the least padding, and batches of a token budget inside each bucket. Column functions only.

Lengths are counted over the whole table; their histogram has at most ``longest`` rows, so the best bucket
boundaries are found on the driver by dynamic programming. Positions inside a bucket come from numbering small
chunks and adding the chunk totals, so a bucket with most of the rows is spread over many tasks.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LONGEST, BUCKETS, BUDGET = 2048, 8, 65_536
CHUNK = 20_000
WORD = r"[^ \t\n\r\f\x0B]+"


def best_boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper bounds of at most ``buckets`` buckets over sorted distinct lengths with the least total padding.

    A bucket pads its members to its upper bound. Fewer distinct lengths than buckets give no padding; of equally
    good choices the one with the lower boundaries is taken.
    """
    if not len(lengths):
        return []
    n = len(lengths)
    lengths, counts = np.asarray(lengths, dtype=np.int64), np.asarray(counts, dtype=np.int64)
    rows = np.concatenate([[0], np.cumsum(counts)])
    tokens = np.concatenate([[0], np.cumsum(counts * lengths)])
    cost = tokens * 0 + np.iinfo(np.int64).max // 4
    cost[0] = 0
    choice = []
    for _ in range(min(buckets, n)):
        new, back = np.full(n + 1, np.iinfo(np.int64).max // 4), np.zeros(n + 1, dtype=np.int64)
        new[0] = 0
        for j in range(1, n + 1):
            total = cost[:j] + lengths[j - 1] * (rows[j] - rows[:j]) - (tokens[j] - tokens[:j])
            back[j] = int(total.argmin())
            new[j] = total[back[j]]
        cost = new
        choice.append(back)
    out, j = [], n
    for back in reversed(choice):
        if j == 0:
            break
        out.append(int(lengths[j - 1]))
        j = int(back[j])
    return out[::-1]


def word_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", longest: int = LONGEST) -> DataFrame:
    """(id, piece, start, n_tokens): each text's words in pieces of at most ``longest``; nothing is cut off.

    A null or empty text has one piece of no words.
    """
    n = F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), n.alias("n"))
    last = F.greatest(F.ceil(F.col("n") / longest).cast("int") - 1, F.lit(0))
    rows = rows.withColumn("piece", F.explode(F.sequence(F.lit(0), last)))
    start = F.col("piece") * F.lit(longest)
    return rows.select("id", "piece", start.alias("start"), F.least(F.col("n") - start, F.lit(longest)).cast("int").alias("n_tokens"))


def _first_bound(bounds: list[int], values: list[int]) -> Column:
    out = F.lit(None).cast("int")
    for bound, value in reversed(list(zip(bounds, values))):
        out = F.when(F.col("n_tokens") <= bound, F.lit(value).cast("int")).otherwise(out)
    return F.when(F.col("n_tokens") > 0, out)


def packed_batches(pieces: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """``pieces`` with bucket, padded (the bucket's length), batch and slot.

    A batch is (bucket, batch): at most ``budget`` padded tokens (one piece if a single one is longer). Every batch
    of a bucket but its last is full. Pieces without tokens have null bucket, padded, batch and slot. Repeated
    rows are pieces of their own; order inside a bucket follows a hash of (id, piece); an empty table gives no rows.
    """
    histogram = pieces.where("n_tokens > 0").groupBy("n_tokens").count().orderBy("n_tokens").toPandas()
    lengths, counts = histogram["n_tokens"].to_numpy(dtype=np.int64), histogram["count"].to_numpy(dtype=np.int64)
    bounds = best_boundaries(lengths, counts, buckets)
    sizes = [max(1, budget // b) for b in bounds]
    held = [int(counts[(lengths > low) & (lengths <= high)].sum()) for low, high in zip([0, *bounds], bounds)]
    chunks = [-(-n // CHUNK) for n in held]
    rows = pieces.withColumns({"bucket": _first_bound(bounds, list(range(len(bounds)))), "padded": _first_bound(bounds, bounds), "size": _first_bound(bounds, sizes)})
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("id", "piece"), F.coalesce(_first_bound(bounds, chunks), F.lit(1))).cast("int"))
    full = rows.where("bucket is not null")
    totals = full.groupBy("bucket", "chunk").agg(F.count("*").alias("held"))
    ahead = Window.partitionBy("bucket").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("bucket", "chunk", F.coalesce(F.sum("held").over(ahead), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy("bucket", "chunk").orderBy(F.xxhash64("id", "piece"), "id", "piece")
    placed = full.withColumn("at", F.row_number().over(inside) - 1).join(offsets, ["bucket", "chunk"]).withColumn("at", F.col("at") + F.col("ahead"))
    names = [c for c in pieces.columns]
    placed = placed.select(*names, "bucket", "padded", F.floor(F.col("at") / F.col("size")).alias("batch"), (F.col("at") % F.col("size")).cast("int").alias("slot"))
    rest = rows.where("bucket is null").select(*names, "bucket", "padded", F.lit(None).cast("long").alias("batch"), F.lit(None).cast("int").alias("slot"))
    return placed.union(rest)
