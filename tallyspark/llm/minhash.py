"""Near-duplicate texts by one-permutation hashing with optimal densification."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.arrays import as_bytes, chunks, mix, shingle_hashes, signed
from tallyspark.llm.components import components
from tallyspark.session import cut_lineage

BANDS, ROWS = 24, 4
BINS = BANDS * ROWS
PERCENT = 85
SMALL_BUCKET = 32
FAMILY_BLOCK = 512
_EMPTY = np.uint64(2**64 - 1)
_U = np.uint64


def densified(owner: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """(n, BINS) signatures: one hash deals every shingle to one bin, the bin keeps its minimum.

    An empty bin borrows from the bin that its own sequence of hashes first finds filled, so two texts
    borrow alike and the chance that a bin agrees stays the similarity of the sets.
    """
    table = np.full(n * BINS, _EMPTY, dtype=_U)
    h = mix(value, 11)
    np.minimum.at(table, owner * BINS + ((h >> _U(32)) % _U(BINS)).astype(np.int64), mix(h, 12))
    table = table.reshape(n, BINS)
    filled = table != _EMPTY
    row, col = np.nonzero(~filled & filled.any(axis=1)[:, None])
    attempt = 0
    while len(row):
        donor = (mix(col.astype(_U) * _U(1 << 32) + _U(attempt), 13) % _U(BINS)).astype(np.int64)
        hit = filled[row, donor]
        table[row[hit], col[hit]] = table[row[hit], donor[hit]]
        row, col = row[~hit], col[~hit]
        attempt += 1
    return table


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = as_bytes(batch.column(1))
        for lo, hi in chunks(texts):
            n = hi - lo
            owner, value = shingle_hashes(texts[lo:hi])
            size = np.bincount(owner, minlength=n)
            sums = [np.zeros(n, dtype=_U) for _ in range(2)]
            for k, total in enumerate(sums):
                np.add.at(total, owner, mix(value, 21 + k))
            table = densified(owner, value, n).reshape(n, BANDS, ROWS)
            keys = np.tile(np.arange(BANDS, dtype=_U), (n, 1))
            for r in range(ROWS):
                keys = mix(keys + table[:, :, r], 31 + r)
            flat = pa.array(signed(np.ascontiguousarray(keys)).reshape(-1))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * BANDS), flat)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(lo, n), pa.array(size.astype(np.int64)), pa.array(signed(sums[0])), pa.array(signed(sums[1])), lists],
                names=["id", "n", "set_a", "set_b", "bands"],
            )


def _shingles(text: bytes | None) -> set:
    words = (text or b"").lower().split()
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return set(zip(words, words[1:], words[2:], words[3:], words[4:]))


def _confirm(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    last, left = None, set()
    for batch in batches:
        keep = []
        texts_a, texts_b = as_bytes(batch.column(2)), as_bytes(batch.column(3))
        for ta, tb in zip(texts_a, texts_b):
            if ta != last:
                last, left = ta, _shingles(ta)
            right = _shingles(tb)
            same = len(left & right)
            keep.append(100 * same >= percent * (len(left) + len(right) - same))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, set size n, a 128-bit sum that names the shingle set, and the band keys."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(_sketch, "id long, n long, set_a long, set_b long, bands array<long>")


def _verified(pairs: DataFrame, docs: DataFrame, id_col: str, text_col: str, percent: int) -> DataFrame:
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    with_b = pairs.join(texts.withColumnsRenamed({"id": "b", "text": "text_b"}), "b")
    both = with_b.join(texts.withColumnsRenamed({"id": "a", "text": "text_a"}), "a").select("a", "b", "text_a", "text_b")
    return cut_lineage(both.mapInArrow(partial(_confirm, percent=percent), "a long, b long"), "links")


def _alike(n: str, m: str, percent: int):
    """Set sizes that can reach the similarity at all."""
    return F.lit(100) * F.least(n, m) >= F.lit(percent) * F.greatest(n, m)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = as_bytes(batch.column(2))
        for lo, hi in chunks(texts):
            owner, value = shingle_hashes(texts[lo:hi])
            cut = np.searchsorted(owner, np.arange(hi - lo + 1))
            packed = [value[cut[k] : cut[k + 1]].tobytes() for k in range(hi - lo)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(packed, pa.binary())], names=["family", "node", "shingles"])


def _block_links(table: pa.Table, percent: int) -> pa.Table:
    """Compare all sets of one block pair; (node, first node it is connected to in the block)."""
    node = table["node"].to_numpy()
    values = [np.frombuffer(v, dtype=_U) for v in table["shingles"].to_pylist()]
    size = np.array([len(v) for v in values], dtype=np.float64)
    owner = np.repeat(np.arange(len(node)), size.astype(np.int64))
    _, code, seen = np.unique(np.concatenate(values), return_inverse=True, return_counts=True)
    shared = seen[code] > 1
    owner, code = owner[shared], np.unique(code[shared], return_inverse=True)[1]
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    common = np.zeros((len(node), len(node)), dtype=np.float64)
    for lo in range(0, int(code[-1]) + 1 if len(code) else 0, 4096):
        a, b = np.searchsorted(code, [lo, lo + 4096])
        held = np.zeros((len(node), min(4096, int(code[-1]) + 1 - lo)), dtype=np.float32)
        held[owner[a:b], code[a:b] - lo] = 1
        common += held @ held.T
    linked = 100 * common >= percent * (size[:, None] + size[None, :] - common)
    label = np.arange(len(node))
    while True:
        low = np.minimum(label, np.where(linked, label[None, :], len(node)).min(axis=1))
        low = low[low]
        if (low == label).all():
            break
        label = low
    away = label != np.arange(len(node))
    return pa.table({"a": node[away], "b": node[label[away]]})


def _within_families(rows: DataFrame, docs: DataFrame, id_col: str, text_col: str, percent: int) -> DataFrame:
    """Connections among the nodes of the large buckets (key, node), compared block by block inside tasks.

    Large buckets that share nodes form a family. A family is dealt to blocks of about FAMILY_BLOCK nodes and
    every two blocks meet in one task that returns a spanning forest, so no pair is ever a row.
    """
    low = rows.groupBy("key").agg(F.min("node").alias("a"))
    joined = components(rows.join(low, "key").select("a", F.col("node").alias("b")))
    members = cut_lineage(joined.select(F.col("component_id").alias("family"), "node"), "family")
    texts = docs.select(F.col(id_col).cast("long").alias("node"), F.col(text_col).cast("binary").alias("text"))
    sets = members.join(texts, "node").select("family", "node", "text").mapInArrow(_sets, "family long, node long, shingles binary")
    parts = members.groupBy("family").agg(F.ceil(F.count("*") / FAMILY_BLOCK).cast("int").alias("parts"))
    dealt = sets.join(parts, "family").withColumn("own", F.expr("cast(pmod(xxhash64(node), parts) as int)"))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    met = met.select("family", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "shingles")
    compare = lambda table: _block_links(table, percent)
    return cut_lineage(met.groupBy("family", "i", "j").applyInArrow(compare, "a long, b long"), "links")


def minhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row per document: id, n_shingles, component_id, kept.

    Documents with 100 * intersection >= percent * union of their 5-word shingle sets are linked; component_id is
    the smallest id reachable. Documents with equal sets are one node, so a huge group of copies costs one
    signature. Candidates are stars: in a bucket every node meets only the smallest one, and each star edge is
    checked on the full texts. Buckets whose nodes are still in several groups are finished exactly: small ones
    by the few pairs across groups, large ones block by block inside tasks.

    Null or empty texts and texts without words have n_shingles 0 and stay alone. A null id keeps a row with
    null component_id and kept. Ids are unique; other columns are ignored, whatever their names. Very long texts are
    hashed whole. An empty table gives no rows.
    """
    sig = cut_lineage(sketches(docs, id_col, text_col), "sketch")
    usable = sig.where("n > 0 and id is not null")
    nodes = cut_lineage(usable.groupBy("set_a", "set_b", "n", "bands").agg(F.min("id").alias("node")), "nodes")
    rows = nodes.select("node", "n", F.explode("bands").alias("key"))
    shared = rows.groupBy("key").agg(F.min(F.struct("node", "n")).alias("c"), F.count("*").alias("size")).where("size > 1")
    bucketed = cut_lineage(rows.join(shared, "key").select("key", "node", "n", F.col("c.node").alias("a"), F.col("c.n").alias("m"), "size"), "buckets")
    pairs = cut_lineage(bucketed.where("node <> a").where(_alike("n", "m", percent)).select("a", F.col("node").alias("b")).distinct(), "pairs")
    links = _verified(pairs, docs, id_col, text_col, percent)
    labels = cut_lineage(components(links), "labels")

    tagged = bucketed.join(labels, "node", "left").select("key", "node", "n", "size", F.coalesce("component_id", "node").alias("g"))
    mixed = tagged.groupBy("key").agg(F.min("g").alias("g0"), F.max("g").alias("g1")).where("g0 < g1").select("key")
    still = cut_lineage(tagged.join(mixed, "key", "left_semi"), "mixed")
    small = still.where(F.col("size") <= SMALL_BUCKET)
    other = small.select("key", F.col("node").alias("b"), F.col("n").alias("m"), F.col("g").alias("h"))
    cross = small.join(other, "key").where("node < b and g <> h").where(_alike("n", "m", percent)).select(F.col("node").alias("a"), "b").distinct()
    links = links.union(_verified(cross.join(pairs, ["a", "b"], "left_anti"), docs, id_col, text_col, percent))
    large = still.where(F.col("size") > SMALL_BUCKET).select("key", "node")
    if not large.isEmpty():
        links = links.union(_within_families(large, docs, id_col, text_col, percent))
    labels = components(links)

    groups = nodes.join(labels, "node", "left").select("set_a", "set_b", "n", F.coalesce("component_id", "node").alias("g"))
    out = sig.join(groups, ["set_a", "set_b", "n"], "left")
    component = F.coalesce("g", "id")
    return out.select("id", F.col("n").alias("n_shingles"), component.alias("component_id"), (F.col("id") == component).alias("kept"))
