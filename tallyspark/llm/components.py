"""Connected components of an edge table by alternating star contraction.

Each round hangs every node on the smallest node next to it (joins and minima only, combined before
the shuffle), until no edge changes. Rounds grow with the logarithm of a component's size; every
round is written to the shared folder, so a lost executor costs one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.session import cut_lineage


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component_id) of every node with an edge; component_id is the smallest node reachable.

    Null ends and loops are ignored; repeated edges count once; no edges give no rows.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    e = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = cut_lineage(e, "edges")
    before = None
    while True:
        both = e.union(e.select(F.col("v"), F.col("u")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: neighbours above u hang on the smallest neighbour of u
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: u and its smaller neighbours hang on the smallest of them
        small_low = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(small_low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(small_low.select("u", F.col("m").alias("v")))
        e = cut_lineage(hung.distinct(), "edges")
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    roots = e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component_id"))
    tops = roots.select(F.col("component_id").alias("node"), "component_id").distinct()
    return roots.union(tops)
