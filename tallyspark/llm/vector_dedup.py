"""Near-duplicate vectors by counting collisions of one-dimensional projections.

Two unit vectors with cosine c are sqrt(2 - 2c) apart, and a projection on a unit direction never moves them
further apart. The first projection, sorted into cells of that width, deals the vectors: links lie in one cell
or two neighbouring ones. Inside a task each vector is the centre of a window in every further projection;
a pair is checked exactly if enough windows hold both. The counts asked for are set from the binomial
distribution so that a pair at the threshold is missed with probability below MISS.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.components import components
from tallyspark.llm.vectors import matrix, usable
from tallyspark.session import cut_lineage

COSINE = 0.98
FIRST, ALL = 16, 64
DEVIATIONS = 2.0
MISS = 1e-7
BLOCK = 2048


def collisions_needed(projections: int) -> int:
    """The largest count that a pair at the threshold reaches with probability 1 - MISS."""
    hit = math.erf(DEVIATIONS / math.sqrt(2))
    below = 0.0
    for count in range(projections + 1):
        below += math.comb(projections, count) * hit**count * (1 - hit) ** (projections - count)
        if below > MISS:
            return count
    return projections


@lru_cache(maxsize=4)
def directions(size: int) -> np.ndarray:
    """Unit directions as columns: the dealing one, then ALL counting ones."""
    d = np.random.default_rng(7919).standard_normal((size, ALL + 1))
    return d / np.sqrt((d**2).sum(axis=0))


def _pairs(a: np.ndarray, b: np.ndarray, pa_: np.ndarray, pb: np.ndarray, width: float, same: bool):
    """Candidate pairs whose query-centred windows collide often enough, as index arrays."""
    few, many = collisions_needed(FIRST), collisions_needed(ALL)
    order = np.argsort(pb[:, 0], kind="stable")
    sorted_first = pb[order, 0]
    reach = math.sqrt(2 - 2 * COSINE) + 1e-9
    for lo in range(0, len(a), 128):
        x = pa_[lo : lo + 128]
        left, right = np.searchsorted(sorted_first, x[:, 0].min() - reach), np.searchsorted(sorted_first, x[:, 0].max() + reach, side="right")
        near = order[left:right]
        if not len(near):
            continue
        y = pb[near]
        count = np.zeros((len(x), len(near)), dtype=np.uint8)
        for j in range(1, FIRST + 1):
            count += np.abs(x[:, j, None] - y[None, :, j]) <= width
        r, c = np.nonzero(count >= few)
        if same:
            keep = lo + r < near[c]
            r, c = r[keep], c[keep]
        for s in range(0, len(r), 1 << 15):
            i, k = r[s : s + (1 << 15)], c[s : s + (1 << 15)]
            total = count[i, k] + (np.abs(x[i, FIRST + 1 :] - y[k, FIRST + 1 :]) <= width).sum(axis=1)
            ok = total >= many
            yield lo + i[ok], near[k[ok]]


def block_links(left: np.ndarray, right: np.ndarray, weight_left: np.ndarray, weight_right: np.ndarray, same: bool):
    """Links of two blocks of vectors: linked weight of every row and the smallest row it is connected to.

    Rows of the right block follow those of the left (with ``same`` both are one block).
    """
    unit = [v / np.sqrt((v**2).sum(axis=1))[:, None] for v in (left, right)]
    dirs = directions(left.shape[1])
    proj = [(u @ dirs).astype(np.float32) for u in unit]
    width = np.float32(DEVIATIONS * math.sqrt((2 - 2 * COSINE) / left.shape[1]) + 1e-6)
    shift = 0 if same else len(left)
    n = len(left) + (0 if same else len(right))
    links, root = np.zeros(n, dtype=np.int64), np.arange(n)

    def top(x: np.ndarray) -> np.ndarray:
        while True:
            up = root[x]
            if (up == x).all():
                return x
            x = root[up]

    for i, j in _pairs(unit[0], unit[1], proj[0], proj[1], width, same):
        true = np.einsum("ij,ij->i", unit[0][i], unit[1][j]) >= COSINE
        i, j = i[true], j[true]
        np.add.at(links, i, weight_right[j])
        j = j + shift
        np.add.at(links, j, weight_left[i])
        while len(i):
            a, b = top(i), top(j)
            apart = a != b
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
    return links, top(np.arange(n))


def _compare(table: pa.Table) -> pa.Table:
    side = table["side"].to_numpy()
    vectors = matrix(table["vector"])
    weight, node = table["copies"].to_numpy(), table["node"].to_numpy()
    first, second = np.flatnonzero(side <= 1), np.flatnonzero(side == 2)
    if side.max() == 0:
        links, root = block_links(vectors[first], vectors[first], weight[first], weight[first], True)
        order = first
    elif len(first) and len(second):
        links, root = block_links(vectors[first], vectors[second], weight[first], weight[second], False)
        order = np.concatenate([first, second])
    else:
        links, root, order = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), first[:0]
    hit = links > 0
    return pa.table({"node": node[order][hit], "root": node[order][root[hit]], "links": links[hit]})


def vector_groups(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """id, n_links, component_id, kept of every vector.

    Vectors of one label (not null) with cosine of at least COSINE are linked; equal vectors are one node with a
    number of copies. component_id is the smallest id reachable. Null, zero and non-finite vectors and those
    without a label link with nothing; vectors of different lengths are never compared. A null id gets a row with
    null component_id. An empty table gives no rows. A crowded cell is dealt to blocks of BLOCK nodes that meet
    two by two in tasks; a task returns one row per linked node, never a row per pair.
    """
    given = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"), F.col(label_col).alias("label"))
    good = given.where(usable("vector") & F.col("label").isNotNull() & F.col("id").isNotNull())
    nodes = good.groupBy("label", "vector").agg(F.min("id").alias("node"), F.count("*").alias("copies"))
    reach = math.sqrt(2 - 2 * COSINE)

    def deal(batches):
        for batch in batches:
            lists = batch.column(1)
            sizes = np.diff(lists.offsets.to_numpy())
            for size in np.unique(sizes):
                part = batch.filter(pa.array(sizes == size))
                v = matrix(part.column(1))
                first = (v / np.sqrt((v**2).sum(axis=1))[:, None]) @ directions(int(size))[:, 0]
                cell = pa.array(np.floor(first / (reach + 1e-9)).astype(np.int64))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.full(part.num_rows, size, dtype=np.int32)), cell], names=["label", "vector", "node", "copies", "dim", "cell"])

    kind = given.schema["label"].dataType.simpleString()
    dealt = cut_lineage(nodes.mapInArrow(deal, f"label {kind}, vector array<double>, node long, copies long, dim int, cell long"), "cells")
    place = ["label", "dim", "cell"]
    parts = dealt.groupBy(*place).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    rows = dealt.join(parts, place).withColumn("block", F.pmod(F.xxhash64("node"), "parts").cast("int"))
    blocks = parts.select(*place, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("block"))
    others = blocks.select("label", "dim", F.col("cell").alias("cell2"), F.col("block").alias("block2"))
    inside = blocks.join(others.withColumn("cell", F.col("cell2")), place).where("block <= block2")
    beside = blocks.join(others.withColumn("cell", F.col("cell2") - 1), place)
    tasks = inside.unionByName(beside).select(*place, "block", "cell2", "block2", F.struct("cell", "block", "cell2", "block2").alias("task"))
    alone = (F.col("cell") == F.col("cell2")) & (F.col("block") == F.col("block2"))
    left = tasks.select(*place, "block", "task", F.when(alone, 0).otherwise(1).alias("side"))
    right = tasks.where(~alone).select("label", "dim", F.col("cell2").alias("cell"), F.col("block2").alias("block"), "task", F.lit(2).alias("side"))
    met = rows.join(left.union(right), [*place, "block"]).select("label", "dim", "task", "side", "vector", "node", "copies")
    found = cut_lineage(met.groupBy("label", "dim", "task").applyInArrow(_compare, "node long, root long, links long"), "links")
    linked = found.groupBy("node").agg(F.sum("links").alias("links"))
    joined = components(found, "node", "root")
    known = nodes.join(linked, "node", "left").join(joined, "node", "left")
    known = known.select("label", "vector", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "node").alias("component"))
    out = given.join(known.join(good.select("id", "label", "vector"), ["label", "vector"]).select("id", "n_links", "component"), "id", "left")
    component = F.coalesce("component", "id")
    return out.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("id") == component).alias("kept"))
