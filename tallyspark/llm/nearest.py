"""Nearest neighbours by largest inner product over randomly rotated one-bit codes.

A vector is turned by a fixed random rotation and only the signs are kept, packed, with two correction
scalars: its length and how well the signs stand for it. A query's rotated coordinates are rounded to four
bits, so an inner product is estimated from counts of common bits. The error bound of the estimate decides
which vectors are compared exactly; every row is indexed and every query meets every block.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.llm.vectors import matrix, usable
from tallyspark.session import cut_lineage

BITS = 256
WORDS = BITS // 64
LEVELS = 4
SIGMAS = 3.0
DATA_BLOCK, QUERY_BLOCK = 4096, 1024


@lru_cache(maxsize=4)
def rotation(size: int) -> np.ndarray:
    """Rows of an orthogonal matrix over max(BITS, size) rounded up to words, cut to ``size`` columns."""
    wide = -(-max(BITS, size) // 64) * 64
    q, r = np.linalg.qr(np.random.default_rng(20240607).standard_normal((wide, wide)))
    return (q * np.sign(np.diag(r)))[:, :size].copy()


def encode(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed signs, lengths, and inner products of each unit vector with its own signs."""
    norm = np.sqrt((vectors**2).sum(axis=1))
    turned = (vectors / norm[:, None]) @ rotation(vectors.shape[1]).T
    codes = np.packbits(turned > 0, axis=1, bitorder="little").view(np.uint64)
    return codes, norm, np.abs(turned).sum(axis=1) / np.sqrt(turned.shape[1])


def estimate(queries: np.ndarray, codes: np.ndarray, norm: np.ndarray, fit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products (queries, codes) and their error bounds."""
    turned = queries @ rotation(queries.shape[1]).T
    bits = turned.shape[1]
    low = turned.min(axis=1)
    step = np.maximum((turned.max(axis=1) - low) / (2**LEVELS - 1), 1e-300)
    whole = np.rint((turned - low[:, None]) / step[:, None]).astype(np.uint8)
    common = np.zeros((len(queries), len(codes)), dtype=np.int32)
    for level in range(LEVELS):
        plane = np.packbits((whole >> level) & 1, axis=1, bitorder="little").view(np.uint64)
        for w in range(plane.shape[1]):
            common += np.bitwise_count(plane[:, w, None] & codes[None, :, w]).astype(np.int32) << level
    ones = np.bitwise_count(codes).sum(axis=1, dtype=np.int64)
    rounded = low * bits + step * whole.sum(axis=1, dtype=np.int64)
    signs = 2 * (low[:, None] * ones[None, :] + step[:, None] * common) - rounded[:, None]
    scale = norm / fit
    guess = signs / np.sqrt(bits) * scale
    size = np.sqrt((queries**2).sum(axis=1))
    spread = np.sqrt(np.maximum(1 - fit**2, 0) / max(bits - 1, 1))
    bound = SIGMAS * np.sqrt((size[:, None] * spread) ** 2 + (step[:, None] ** 2) / 12) * scale + 1e-9
    return guess, bound


def best_in_block(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, code, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, score) of up to k best of the block per query; only promising vectors are compared exactly."""
    out = []
    for lo in range(0, len(queries), 128):
        q, names = queries[lo : lo + 128], query_ids[lo : lo + 128]
        guess, bound = estimate(q, *code)
        other = names[:, None] != ids[None, :]
        guess[~other] = -np.inf
        # the k-th best of the most promising rows, compared exactly, is a floor that no better set can fall below
        first = min(2 * k, len(ids))
        tried = np.argpartition(guess, len(ids) - first, axis=1)[:, len(ids) - first :]
        known = np.einsum("ij,ikj->ik", q, vectors[tried])
        known[~np.take_along_axis(other, tried, axis=1)] = -np.inf
        floor = np.sort(known, axis=1)[:, max(first - k, 0)]
        row, col = np.nonzero(other & (guess + bound >= floor[:, None]))
        score = np.empty(len(row))
        for a in range(0, len(row), 1 << 16):
            r, c = row[a : a + (1 << 16)], col[a : a + (1 << 16)]
            score[a : a + (1 << 16)] = np.einsum("ij,ij->i", q[r], vectors[c])
        order = np.lexsort((ids[col], -score, row))
        row, col, score = row[order], col[order], score[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        top = rank < k
        out.append((names[row[top]], ids[col[top]], score[top]))
    return tuple(np.concatenate(x) for x in zip(*out))


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for size in np.unique(batch.column(2).to_numpy()):
            part = batch.filter(pa.compute.equal(batch.column(2), int(size)))
            codes, norm, fit = encode(matrix(part.column(1)))
            packed = pa.array([c.tobytes() for c in codes], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), packed, pa.array(norm), pa.array(fit)], names=["id", "vector", "dim", "code", "norm", "fit"])


def build_index(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id, vector, dim, code, norm, fit of every usable vector."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector")).where(usable("vector"))
    rows = rows.where("id is not null").select("id", F.col("vector").cast("array<double>").alias("vector"), F.size("vector").alias("dim"))
    return rows.mapInArrow(_index, "id long, vector array<double>, dim int, code binary, norm double, fit double")


def nearest(index: DataFrame, is_query: Column, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products of each query row with the other rows.

    ``is_query`` is a condition on ``id``. Vectors that are null, zero or not finite are not in the index; vectors of
    different lengths are never compared; ties go to the smaller id; fewer candidates give fewer rows; no
    queries or an empty table give none. The queries are dealt to blocks and the rows to blocks, each two
    blocks meet in one task and return at most k rows a query.
    """
    index = cut_lineage(index, "index")
    rows, asked = index.count(), index.where(is_query).count()
    parts, sets = -(-max(rows, 1) // DATA_BLOCK), -(-max(asked, 1) // QUERY_BLOCK)
    block = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    data = index.select("*", block(parts).alias("d"), every(sets).alias("q"), F.lit(False).alias("asks"))
    queries = index.where(is_query).select("*", every(parts).alias("d"), block(sets).alias("q"), F.lit(True).alias("asks"))

    def search(table: pa.Table) -> pa.Table:
        asks = table["asks"].combine_chunks()
        mine, rest = table.filter(asks), table.filter(pa.compute.invert(asks))
        if not mine.num_rows or not rest.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        codes = np.frombuffer(b"".join(rest["code"].to_pylist()), dtype=np.uint64).reshape(rest.num_rows, -1)
        found = best_in_block(mine["id"].to_numpy(), matrix(mine["vector"]), rest["id"].to_numpy(), matrix(rest["vector"]), (codes, rest["norm"].to_numpy(), rest["fit"].to_numpy()), k)
        return pa.table(dict(zip(("query_id", "vec_id", "score"), found)))

    found = data.unionByName(queries).groupBy("dim", "d", "q").applyInArrow(search, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
