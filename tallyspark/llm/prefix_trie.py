"""The tree of shared conversation beginnings, built as adaptive radix trees over sorted key ranges.

A turn becomes a big-endian id of WIDTH bytes (a digest of role and text), a conversation the string of its ids. Equal
conversations become one key with their counts; the keys are sorted by range, and every block of a range builds its
own radix tree: nodes grow from 4 to 16, 48 and 256 branches and paths without a branch are one node. Only byte depths
that end a turn become nodes of the result.

Blocks are consecutive, so a node lies in several blocks only if it is a prefix of the last key of one and the first
key of the next. A block knows how many turns it shares with either neighbour: the first block that holds a node owns
it, counts of owned children, leaves and tokens add up, and only shared nodes meet in a small aggregate afterwards.
A common first turn, or the root, is therefore built by many tasks.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.session import cut_lineage

WIDTH = 16
GROUP, SPREAD = 100, 6
BLOCK_KEYS, BLOCK_BYTES = 16_384, 16 << 20
SEGMENT = 4096
NO_ENDS = hashlib.sha256(b"").hexdigest()


class Node:
    """A radix node: the bytes of its path, the key that ends here (or -1) and its branches in one of four layouts.

    Up to 16 branches are two short lists sorted by byte; up to 48 a table of 256 places into a list; more are a list
    by byte.
    """

    __slots__ = ("path", "entry", "room", "bytes", "below")

    def __init__(self, path: bytes, entry: int = -1):
        self.path, self.entry, self.room = path, entry, 4
        self.bytes, self.below = bytearray(), []

    def find(self, byte: int) -> Node | None:
        if self.room <= 16:
            k = bisect_left(self.bytes, byte)
            return self.below[k] if k < len(self.bytes) and self.bytes[k] == byte else None
        if self.room == 48:
            return self.below[self.bytes[byte] - 1] if self.bytes[byte] else None
        return self.below[byte]

    def put(self, byte: int, child: Node) -> None:
        """Add or replace the branch of ``byte``."""
        if self.room == 256:
            self.below[byte] = child
            return
        if self.room == 48:
            if self.bytes[byte]:
                self.below[self.bytes[byte] - 1] = child
                return
        else:
            k = bisect_left(self.bytes, byte)
            if k < len(self.bytes) and self.bytes[k] == byte:
                self.below[k] = child
                return
        if len(self.below) == self.room:
            self._grow()
            self.put(byte, child)
        elif self.room == 48:
            self.below.append(child)
            self.bytes[byte] = len(self.below)
        else:
            self.bytes.insert(k, byte)
            self.below.insert(k, child)

    def _grow(self) -> None:
        branches = list(self.branches())
        self.room = {4: 16, 16: 48, 48: 256}[self.room]
        if self.room == 48:
            self.bytes = bytearray(256)
            for k, (byte, _) in enumerate(branches):
                self.bytes[byte] = k + 1
        elif self.room == 256:
            self.bytes, self.below = bytearray(), [None] * 256
            for byte, child in branches:
                self.below[byte] = child

    def branches(self) -> Iterator[tuple[int, Node]]:
        """In byte order."""
        if self.room <= 16:
            yield from zip(self.bytes, self.below)
        elif self.room == 48:
            yield from ((b, self.below[k - 1]) for b, k in enumerate(self.bytes) if k)
        else:
            yield from ((b, child) for b, child in enumerate(self.below) if child is not None)


def _agree(a: bytes, b: bytes) -> int:
    """Leading bytes that two strings share."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if a[:middle] == b[:middle] else (low, middle)
    return low


def radix_tree(keys: list[bytes]) -> Node:
    """The tree of different keys; each key's place in the list is its entry."""
    root = Node(b"")
    for entry, key in enumerate(keys):
        above, node, at = None, root, 0
        while True:
            path = node.path
            if not key.startswith(path, at):
                same = _agree(key[at : at + len(path)], path)
                fork = Node(path[:same])
                node.path = path[same + 1 :]
                fork.put(path[same], node)
                above.put(key[at - 1], fork)
                if at + same == len(key):
                    fork.entry = entry
                else:
                    fork.put(key[at + same], Node(key[at + same + 1 :], entry))
                break
            at += len(path)
            if at == len(key):
                node.entry = entry
                break
            child = node.find(key[at])
            if child is None:
                node.put(key[at], Node(key[at + 1 :], entry))
                break
            above, node, at = node, child, at + 1
    return root


def _preorder(root: Node) -> Iterator[tuple[Node, int, int, int]]:
    """(node, place of the one above, byte depth above it, byte depth of its end), parents first, in byte order."""
    waiting, place = [(root, -1, -1)], 0
    while waiting:
        node, above, start = waiting.pop()
        end = start + 1 + len(node.path)
        yield node, above, start, end
        waiting.extend((child, place, end) for _, child in reversed(list(node.branches())))
        place += 1


def _path_names(key: bytes, depth: int) -> list[bytes]:
    """A name for the first 0 to ``depth`` turns of a key."""
    running, out = hashlib.blake2b(digest_size=16), []
    out.append(running.digest())
    for d in range(depth):
        running.update(key[d * WIDTH : (d + 1) * WIDTH])
        out.append(running.copy().digest())
    return out


FIELDS = ("path", "above", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends")
NODES = "path binary, above binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends string"


def block_nodes(keys: list[bytes], convs: list[int], counts: list[int], chars: list[list[int]], ends: list[str], before: int, after: int) -> list[tuple]:
    """Rows of FIELDS for one block of sorted different keys that shares ``before`` turns with the key ahead of it and
    ``after`` with the one behind it (-1: there is none).

    Shared nodes carry a name in ``path`` and this block's part of the sums; children of shared nodes carry it in ``above``.
    """
    nodes = list(_preorder(radix_tree(keys)))
    size = len(nodes)
    last = len(keys) - 1
    total, conv, low, high, leaves, saved = [0] * size, [None] * size, [last + 1] * size, [-1] * size, [0] * size, [0] * size
    tops: list[list[tuple[int, bool]]] = [[] for _ in range(size)]
    left, right = _path_names(keys[0], max(before, 0)), _path_names(keys[-1], max(after, 0))
    rows: list[list] = []
    for i in range(size - 1, -1, -1):
        node, above, start, end = nodes[i]
        if (e := node.entry) >= 0:
            total[i] += counts[e]
            conv[i] = convs[e] if conv[i] is None else min(conv[i], convs[e])
            low[i], high[i] = min(low[i], e), max(high[i], e)
        for depth in range(end // WIDTH, start // WIDTH, -1):
            ahead, behind = low[i] == 0 and depth <= before, high[i] == last and depth <= after
            kids, tops[i] = tops[i], [(len(rows), not ahead)]
            spoken = chars[low[i]][depth - 1] if depth else 0
            leaves[i] += not kids and not behind
            saved[i] += (total[i] - (not ahead)) * spoken
            name = left[depth] if ahead else right[depth] if behind else None
            for k, _ in kids:
                rows[k][1], rows[k][4] = name, conv[i]
            closed = ends[e] if e >= 0 and depth * WIDTH == end else None
            rows.append([name, None, conv[i], depth, None, total[i], sum(owned for _, owned in kids), leaves[i], saved[i], closed])
        if above >= 0:
            total[above] += total[i]
            conv[above] = conv[i] if conv[above] is None else min(conv[above], conv[i])
            low[above], high[above] = min(low[above], low[i]), max(high[above], high[i])
            leaves[above] += leaves[i]
            saved[above] += saved[i]
            tops[above] += tops[i]
    return rows


def _turns_shared(a: bytes, b: bytes) -> int:
    return _agree(a, b) // WIDTH


def _build(batches: Iterator[pa.RecordBatch], edges: dict[int, tuple[int, int]], block_keys: int) -> Iterator[pa.RecordBatch]:
    """Rows (part, key, conv_id, n, chars, ends) sorted by part and key, into nodes block by block."""
    kinds = [pa.binary(), pa.binary(), *[pa.int64()] * 7, pa.string()]
    block: list[tuple] = []
    before = size = 0

    def finished(after: int) -> Iterator[pa.RecordBatch]:
        rows = block_nodes(*map(list, zip(*block)), before, after)
        for lo in range(0, len(rows), 1 << 16):
            columns = zip(*rows[lo : lo + (1 << 16)])
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds)], names=list(FIELDS))

    part = None
    for batch in batches:
        for own, *row in zip(*(batch.column(k).to_pylist() for k in range(6))):
            if own != part or len(block) == block_keys or size > BLOCK_BYTES:
                shared = edges[own][0] if own != part else _turns_shared(block[-1][0], row[0])
                if block:
                    yield from finished(edges[part][1] if own != part else shared)
                block, before, size, part = [], shared, 0, own
            block.append(tuple(row))
            size += len(row[0])
    if block:
        yield from finished(edges[part][1])


def _sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments (key, segment, conv_id, n, chars, ids) sorted by key and segment, into one row per key."""
    kinds = [pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.string()]
    names = ["key", "conv_id", "n", "chars", "ends"]
    held = None
    out: list[tuple] = []
    for batch in batches:
        for key, _, conv, n, chars, ids in zip(*(batch.column(k).to_pylist() for k in range(6))):
            if held is not None and held[0] == key:
                held[1], held[2] = min(held[1], conv), held[2] + n
                held[4].update(b"," + ids.encode())
                continue
            if held is not None:
                out.append((*held[:4], held[4].hexdigest()))
            held = [key, conv, n, chars, hashlib.sha256(ids.encode())]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out), kinds)], names=names)
            out = []
    if held is not None:
        yield pa.RecordBatch.from_arrays([pa.array([v], kind) for v, kind in zip((*held[:4], held[4].hexdigest()), kinds)], names=names)


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turns that a range shares with the ranges beside it."""
    for batch in batches:
        part, first, last, ahead, behind = (batch.column(k).to_pylist() for k in range(5))
        shared = [[-1 if a is None else _turns_shared(a, f) for a, f in zip(ahead, first)], [-1 if b is None else _turns_shared(x, b) for x, b in zip(last, behind)]]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), *[pa.array(x, pa.int32()) for x in shared]], names=["part", "before", "after"])


def conversation_keys(turns: DataFrame) -> DataFrame:
    """conv_id, ids (hex digests of role and text), chars (code points of the texts): each conversation's turns in order.

    Turns are ordered by turn (null first), role and text; null roles and texts are empty, repeated rows are turns of
    their own, rows without conv_id are left out. A conversation is one row.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    name = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * WIDTH)
    said = F.struct("turn", role.alias("role"), text.alias("text"), name.alias("id"), F.length(text).alias("chars"))
    whole = turns.where("conv_id is not null").groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(said)).alias("said"))
    return whole.select("conv_id", F.col("said.id").alias("ids"), F.col("said.chars").alias("chars"))


def shared_beginnings(convs: DataFrame) -> DataFrame:
    """Every conversation c begins with the first crc32(c) % SPREAD turns of conversation c - c % GROUP in place of its own.

    Fewer turns there, or no such conversation, give fewer; c's own turns after its first ones follow.
    """
    base = F.col("conv_id") - F.col("conv_id") % GROUP
    taken = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % SPREAD).cast("int")
    heads = convs.where(F.col("conv_id") % GROUP == 0).select(F.col("conv_id").alias("base"), F.slice("ids", 1, SPREAD - 1).alias("base_ids"), F.slice("chars", 1, SPREAD - 1).alias("base_chars"))
    both = convs.select("conv_id", "ids", "chars", base.alias("base"), taken.alias("h")).join(heads, "base", "left")

    def joined(own: str, other: str):
        begun = F.coalesce(F.slice(other, F.lit(1), F.col("h")), F.slice(own, 1, 0))
        return F.concat(begun, F.slice(own, F.col("h") + 1, F.greatest(F.size(own) - F.col("h"), F.lit(0)))).alias(own)

    return both.select("conv_id", joined("ids", "base_ids"), joined("chars", "base_chars"))


def prefix_nodes(convs: DataFrame, block_keys: int = BLOCK_KEYS) -> DataFrame:
    """One row per different beginning of the sequences in ``convs`` (conv_id, ids, chars), the empty one included.

    conv_id (the smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256
    (digest of the conv_ids that end here). conv_ids are unique; a conversation without turns is a member of the root
    alone; an empty table gives no rows. Digests of 128 bits stand for turns. A block has at most ``block_keys`` keys.
    """
    rows = convs.select("conv_id", F.unhex(F.array_join("ids", "")).alias("key"), "chars", F.expr(f"conv_id div {SEGMENT}").alias("segment"))
    ids = F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",")
    segments = rows.groupBy("key", "segment").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n"), F.first("chars").alias("chars"), ids.alias("ids"))
    ranged = segments.repartitionByRange("key").sortWithinPartitions("key", "segment").select("key", "segment", "conv_id", "n", "chars", "ids")
    sequences = ranged.mapInArrow(_sequences, "key binary, conv_id long, n long, chars array<int>, ends string")
    sequences = cut_lineage(sequences.withColumn("part", F.spark_partition_id()), "sequences")

    beside = Window.orderBy("part")  # one row per range
    ranges = sequences.groupBy("part").agg(F.min("key").alias("first"), F.max("key").alias("last"))
    ranges = ranges.select("part", "first", "last", F.lag("last").over(beside).alias("ahead"), F.lead("first").over(beside).alias("behind"))
    edges = {r.part: (r.before, r.after) for r in ranges.mapInArrow(_edges, "part int, before int, after int").collect()}

    dealt = sequences.repartition(max(len(edges), 1), "part").sortWithinPartitions("part", "key").select("part", "key", "conv_id", "n", "chars", "ends")
    nodes = cut_lineage(dealt.mapInArrow(partial(_build, edges=edges, block_keys=block_keys), NODES), "nodes")
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    shared = nodes.where("path is not null").groupBy("path").agg(F.first("above").alias("above"), F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), *sums, F.max("ends").alias("ends"))
    shared = cut_lineage(shared, "shared")
    counted = ["n_convs", "n_children", "n_leaves", "saved_tokens"]
    inner = nodes.where("path is null and above is null").select("conv_id", "depth", "parent_conv_id", *counted, "ends")
    outer = nodes.where("path is null and above is not null").select("above", "conv_id", "depth", *counted, "ends").unionByName(shared.select("above", "conv_id", "depth", *counted, "ends"))
    parents = shared.select(F.col("path").alias("above"), F.col("conv_id").alias("parent_conv_id"))
    outer = outer.join(parents, "above", "left").select("conv_id", "depth", "parent_conv_id", *counted, "ends")
    return inner.unionByName(outer).withColumn("ends", F.coalesce("ends", F.lit(NO_ENDS))).withColumnRenamed("ends", "ends_sha256")


def conversation_trie(turns: DataFrame) -> DataFrame:
    """``prefix_nodes`` of the rebuilt conversations of a table of turns (conv_id, turn, role, text).

    Null conv_ids are no conversation; see ``conversation_keys`` for the order of turns, nulls and repeated rows and
    ``shared_beginnings`` for the rebuilding. Other columns are ignored, whatever their names.
    """
    return prefix_nodes(cut_lineage(shared_beginnings(conversation_keys(turns.select("conv_id", "turn", "role", "text"))), "rebuilt"))
