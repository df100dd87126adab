"""Ordered running totals that stay parallel when one key holds most of the rows.

A running total is built in three steps: rows of one (key, position) are merged by a map-side
combined aggregation, positions are cut into chunks and scanned per (key, chunk), and the few
chunk totals of a key are scanned to give each chunk its carry. No task ever sees more than one
chunk of a key, and the result is the exact total.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark import session

CHUNK = 4096


def numbers_first(df: DataFrame, keys: Sequence[str]) -> list[str]:
    """``keys`` with strings last: rows are sorted by the first of them, and pools and surfaces are the same for most rows."""
    types = dict(df.dtypes)
    return sorted(keys, key=lambda k: types[k] == "string")


def prior_totals(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str] | str,
    sums: dict[str, Column] | None = None,
    maxes: dict[str, Column] | None = None,
    chunk: Column | None = None,
    inclusive: bool = False,
    combine: bool = True,
    carried: dict[str, Column] | None = None,
) -> DataFrame:
    """One row per (keys, order) with totals over all rows of the key at smaller positions.

    ``inclusive`` adds the rows at the position itself. Rows sharing a position never see
    each other otherwise. ``chunk`` must be monotone in ``order``. ``combine`` merges rows of a
    position before the shuffle; without it, where a position has few rows, the rows are dealt to
    (keys, chunk) once and merging, scan and chunk totals all work on that one exchange. ``carried`` are sums of the rows
    at the position itself.
    """
    order = [order] if isinstance(order, str) else list(order)
    keys, sums, maxes, carried = list(keys), sums or {}, maxes or {}, carried or {}
    at_own = [F.sum(c).alias(n) for n, c in carried.items()]
    at = chunk if chunk is not None else F.floor(F.col(order[0]) / CHUNK)
    by = numbers_first(df, keys)
    if combine:
        per = df.groupBy(*by, *order).agg(
            *[F.sum(c).alias(n) for n, c in sums.items()],
            *[F.max(c).alias(n) for n, c in maxes.items()],
            *at_own,
        )
        per = per.withColumn("_chunk", at)
    else:
        # dealt as they are: the few columns that all sums are made of are narrower than the sums
        dealt = df.withColumn("_chunk", at).repartition(*by, "_chunk")
        per = dealt.groupBy(*by, "_chunk", *order).agg(
            *[F.sum(c).alias(n) for n, c in sums.items()],
            *[F.max(c).alias(n) for n, c in maxes.items()],
            *at_own,
        )
    key_list, order_list = ", ".join(f"`{k}`" for k in by), ", ".join(f"`{o}`" for o in order)
    by_key = f"PARTITION BY {key_list}" if keys else ""
    by_chunk = f"PARTITION BY {key_list + ', ' if keys else ''}_chunk"
    ends = "CURRENT ROW" if inclusive else "1 PRECEDING"
    scan = f"({by_chunk} ORDER BY {order_list} ROWS BETWEEN UNBOUNDED PRECEDING AND {ends})"
    across = f"({by_key} ORDER BY _chunk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    inner = per.selectExpr(
        *keys,
        *order,
        "_chunk",
        *[f"sum(`{n}`) OVER {scan} AS `{n}`" for n in sums],
        *[f"max(`{n}`) OVER {scan} AS `{n}`" for n in maxes],
        *[f"`{n}`" for n in carried],
    )
    # both branches read the same columns of ``per``, so its shuffle is shared
    folded = [F.expr(f"sum(`{n}`) AS `{n}`") for n in sums] + [F.expr(f"max(`{n}`) AS `{n}`") for n in maxes]
    totals = per.groupBy(*by, "_chunk").agg(*folded)
    carry = totals.selectExpr(
        *keys,
        "_chunk",
        *[f"sum(`{n}`) OVER {across} AS `_c_{n}`" for n in sums],
        *[f"max(`{n}`) OVER {across} AS `_c_{n}`" for n in maxes],
        f"row_number() OVER ({by_key} ORDER BY _chunk) AS _place",
    ).where("_place > 1")
    joined = inner.join(carry, by + ["_chunk"], "left")
    # where no key fills a chunk there is no carry, and Spark takes a join with an empty table for an empty one
    return session.dealt(
        joined.selectExpr(
            *keys,
            *order,
            *[f"coalesce(`{n}`, 0) + coalesce(`_c_{n}`, 0) AS `{n}`" for n in sums],
            *[f"greatest(`{n}`, `_c_{n}`) AS `{n}`" for n in maxes],
            *[f"`{n}`" for n in carried],
        )
    )


def sequence_rows(
    df: DataFrame,
    keys: Sequence[str],
    batch: str,
    tie: str,
    out: str = "seq",
    width: int = 1 << 16,
) -> DataFrame:
    """Dense 1-based position of every row within its key, ordered by (batch, tie).

    Adds ``<out>`` and ``<out>_before`` (rows of the key in earlier batches). A batch that is
    itself huge for one key is cut along ``tie``, an integer that is unique within the key.
    """
    sub = F.floor(F.col(tie) / width)
    marked, by = df.withColumn("_sub", sub), numbers_first(df, keys)
    before = prior_totals(marked, keys, [batch, "_sub"], sums={"_n": F.lit(1)})
    first = Window.partitionBy(*by, batch).orderBy("_sub")
    before = before.withColumn(f"{out}_before", F.min("_n").over(first))
    local = Window.partitionBy(*by, batch, "_sub").orderBy(tie)
    return (
        marked.join(before, [*by, batch, "_sub"])
        .withColumn(out, F.col("_n") + F.row_number().over(local))
        .drop("_n", "_sub")
    )


def trailing_means(
    df: DataFrame, keys: Sequence[str], seq: str, value: str, spans: Sequence[int], chunk: int = CHUNK
) -> DataFrame:
    """Mean of the last N values up to and including each row, for several N.

    Each chunk of a key also receives the last rows of the chunk before it, so the frames at
    its start are complete.
    """
    reach, by = max(spans) - 1, numbers_first(df, keys)
    pos = F.col(seq) - 1
    home = F.floor(pos / chunk)
    spread = F.when(pos % chunk >= chunk - reach, F.array(home, home + 1)).otherwise(F.array(home))
    copied = df.withColumn("_home", home).withColumn("_chunk", F.explode(spread))
    out = copied
    for n in spans:
        frame = Window.partitionBy(*by, "_chunk").orderBy(seq).rowsBetween(-(n - 1), 0)
        out = out.withColumn(f"{value}_{n}", F.avg(value).over(frame))
    return out.where(F.col("_home") == F.col("_chunk")).drop("_home", "_chunk")


def asof_before(
    probes: DataFrame, states: DataFrame, keys: Sequence[str], order: str, payload: Sequence[str]
) -> DataFrame:
    """For every distinct (keys, order) probe, the payload of the last state strictly before it.

    Probe and state rows meet in one ordered scan; there is no range join.
    """
    keys = list(keys)
    body = F.struct(F.col(order).alias("_at"), *[F.col(c) for c in payload])
    left = probes.select(*keys, order).distinct().withColumn("_body", F.lit(None))
    right = states.select(*keys, order, body.alias("_body"))
    both = left.select(*keys, order, F.col("_body").cast(right.schema["_body"].dataType), F.lit(1).alias("_probe"))
    both = both.unionByName(right.withColumn("_probe", F.lit(0)))
    seen = prior_totals(both, keys, order, maxes={"_body": F.col("_body")}, combine=False)
    hits = seen.join(left.select(*keys, order), [*keys, order], "left_semi")
    return hits.select(*keys, order, *[F.col(f"_body.{c}").alias(c) for c in payload])
