"""The tree of shared conversation beginnings against a plain dictionary of prefixes, in blocks of every size."""

import hashlib
import random
import zlib

import pytest

from tallyspark.llm.prefix_trie import WIDTH, Node, block_nodes, conversation_keys, conversation_trie, prefix_nodes, radix_tree, shared_beginnings


def order(row):
    return (row[1] is not None, row[1] or 0, row[2] or "", row[3] or "")


def rebuilt(rows):
    own = {}
    for r in sorted((r for r in rows if r[0] is not None), key=order):
        own.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - c % 100, [])[:h] + turns[h:]
    return out


def expected(convs):
    """(conv_id, depth, parent, n, children, leaves, saved, ends) of every prefix."""
    held = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            held.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for path, members in held.items():
        under = [p for p in held if p[: len(path)] == path]
        kids = [p for p in under if len(p) == len(path) + 1]
        leaves = sum(not any(len(q) > len(p) and q[: len(p)] == p for q in under) for p in under)
        saved = sum((len(held[p]) - 1) * len(p[-1][1]) for p in under if p)
        ends = ",".join(str(c) for c in sorted(c for c in members if tuple(convs[c]) == path))
        parent = min(held[path[:-1]]) if path else None
        out.append((min(members), len(path), parent, len(members), len(kids), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def read(df):
    columns = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def conversations(seed, n=260):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(700), n):
        for t in range(rng.choice([0, 1, 1, 2, 3, 5, 8])):
            rows.append((c, t, rng.choice(["user", "user", "assistant", None]), rng.choice(["a", "bb", "b" * 9, None, "é🙂"]), 3, "path"))
    rows += [(1000 + k, t, "user", "the same", 1, "p") for k in range(60) for t in range(4)]
    rows += [(2000, t, "user", f"turn {t}", 1, "p") for t in range(400)] + [(2001, t, "user", f"turn {t}", 1, "p") for t in range(400)]
    rows += [(5, None, "system", "late null", 1, "p"), (5, None, "system", "null", 1, "p"), (None, 1, "user", "no conversation", 1, "p"), rows[0], rows[0]]
    return rows


SCHEMA = "conv_id long, turn long, role string, text string, depth int, path string"


@pytest.mark.parametrize(("seed", "block", "parts"), [(1, 16_384, "4"), (2, 1, "1"), (3, 7, "3"), (4, 40, "30")])
def test_brute_force(spark, seed, block, parts):
    rows = conversations(seed)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        table = spark.createDataFrame(rows, SCHEMA)
        got = read(prefix_nodes(shared_beginnings(conversation_keys(table)), block))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == expected(rebuilt(rows))


def test_turnless_and_empty(spark):
    c = next(k for k in range(101, 200) if zlib.crc32(str(k).encode()) % 6 >= 2)
    rows = [(c, 0, "user", "dropped", 0, ""), (301, None, None, None, 0, "")]
    got = read(conversation_trie(spark.createDataFrame(rows, SCHEMA)))
    assert got == expected(rebuilt(rows)) and rebuilt(rows)[c] == []
    assert conversation_trie(spark.createDataFrame([], SCHEMA)).collect() == []


def test_node_layouts_grow_and_keep_order():
    rng = random.Random(6)
    bytes_ = rng.sample(range(256), 256)
    node, sizes = Node(b""), []
    for n, b in enumerate(bytes_, 1):
        node.put(b, Node(bytes([b])))
        sizes.append(node.room)
        if n in (4, 5, 16, 17, 48, 49, 256):
            assert [x for x, _ in node.branches()] == sorted(bytes_[:n])
            assert all(node.find(x).path == bytes([x]) for x in bytes_[:n]) and all(node.find(x) is None for x in bytes_[n:])
    assert [sizes[k - 1] for k in (4, 5, 16, 17, 48, 49, 256)] == [4, 16, 16, 48, 48, 256, 256]
    other = Node(b"new")
    for b in bytes_[:3] + bytes_[40:43]:
        node.put(b, other)
        assert node.find(b) is other


def test_paths_are_compressed():
    one = b"x" * WIDTH * 50
    root = radix_tree([one, one + b"y" * WIDTH])
    assert [(len(n.path), n.entry) for n in (root, root.below[0], root.below[0].below[0])] == [(0, -1), (WIDTH * 50 - 1, 0), (WIDTH - 1, 1)]
    rows = block_nodes([one, one + b"y" * WIDTH], [4, 2], [1, 3], [[1] * 50, [1] * 51], ["e", "f"], -1, -1)
    assert len(rows) == 52 and {r[3] for r in rows} == set(range(52))


def test_common_conversation_in_segments(spark):
    ids = [*range(0, 30_000, 3), 10**12]
    convs = spark.createDataFrame([(i,) for i in ids], "conv_id long").selectExpr("conv_id", "array(sha2('x', 256), sha2('y', 256)) ids", "array(3, 4) chars")
    convs = convs.selectExpr("conv_id", "transform(ids, x -> substring(x, 1, 32)) ids", "chars")
    want = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    got = read(prefix_nodes(convs))
    assert got[-1] == (0, 2, 0, len(ids), 0, 1, 4 * (len(ids) - 1), want) and len(got) == 3
