"""Order-sensitive fingerprints against a plain statement of the rule, and the neighbour in id order."""

import hashlib
import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from tallyspark.llm.fingerprints import K, PLACE_BITS, RINGS, SLOTS, edit_likeness, fingerprint_text, fingerprints, likeness, order_minhash, with_next

SIGN = 1 << 63


def chained(values):
    seed = 42
    for v in values:
        raw = v.encode() if isinstance(v, str) else v[0].to_bytes(v[1], "little", signed=True)
        seed = xxhash.xxh64_intdigest(raw, seed)
    return seed - 2 * SIGN if seed >= SIGN else seed


def numbers(text):
    words = re.findall(r"[^ \t\n\r\f\x0B]{1,16}", text or "")
    if not words:
        return []
    grams = [chained(words)] if len(words) < K else [chained(words[i : i + K]) for i in range(len(words) - K + 1)]
    seen, units = {}, []
    for place, g in enumerate(grams):
        kind = g >> PLACE_BITS
        units.append((chained([(kind, 8), (seen.get(kind, 0), 4)]) >> PLACE_BITS, place))
        seen[kind] = seen.get(kind, 0) + 1
    out = []
    for ring in range(RINGS):
        order = sorted((u if ring == 0 else chained([(u, 8), (ring, 4)]) >> PLACE_BITS, p) for u, p in units)
        for slot in range(SLOTS):
            start = -(SIGN >> PLACE_BITS) + slot * (2 * SIGN >> PLACE_BITS) // SLOTS
            first = next((k for k, (u, _) in enumerate(order) if u >= start), 0)
            a, b = sorted((order[first][1], order[(first + 1) % len(order)][1]))
            out.append(chained([(grams[a], 8), (grams[b], 8)]) & 0xFFFFFFFF)
    return out


def texts():
    rng = random.Random(4)
    prose = lambda n: " ".join(rng.choice(["río", "tree", "🙂", "stone", "water", "日本語"]) + str(rng.randrange(30)) for _ in range(n))
    given = [None, "", " \n\t ", "one", "two words", "three word text", "a a a a a a a a", "  edges \n", "x" * 100, "x" * 16 + " " + "y" * 17, "  no break"]
    return given + [prose(rng.randrange(1, 200)) for _ in range(60)] + ["same again " * 3000, prose(20_000)]


def test_brute_force(spark):
    given = texts()
    table = spark.createDataFrame([(i, t) for i, t in enumerate(given)], "doc_id long, text string")
    got = {r.doc_id: r.n for r in table.select("doc_id", order_minhash(F.col("text")).alias("n")).collect()}
    for i, t in enumerate(given):
        assert got[i] == numbers(t), (i, (t or "")[:40])


def test_fingerprints_of_odd_rows(spark):
    rows = [(1, "the same words here", 9), (None, "the same words here", 9), (1, "the same words here", 9), (2, None, None), (3, " ", 1)]
    got = [(r.id, r.fingerprint) for r in fingerprints(spark.createDataFrame(rows, "doc_id long, text string, fingerprint int")).collect()]
    whole = "".join(f"{x:08x}" for x in numbers("the same words here"))
    assert sorted(got, key=str) == sorted([(1, whole), (1, whole), (None, whole), (2, ""), (3, "")], key=str)
    assert fingerprints(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_likeness_follows_order_and_edits(spark):
    rng = random.Random(8)
    words = [f"w{rng.randrange(400)}" for _ in range(600)]
    edits = [*words]
    edits[300:303] = ["new", "words"]
    swapped = words[300:] + words[:300]
    other = [f"v{rng.randrange(400)}" for _ in range(600)]
    pairs = [(" ".join(words), " ".join(x)) for x in (words, edits, words[:300] + other[:300], swapped, other)] + [("", ""), ("", "a"), (None, "")]
    table = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    near = [r.x for r in table.select("i", likeness(order_minhash(F.col("a")), order_minhash(F.col("b"))).alias("x")).orderBy("i").collect()]
    assert near[0] == 1 and near[4] == 0 and near[5:] == [1, 0, 1]
    assert near[1] > 0.85 and 0.02 < near[2] < 0.4
    assert 0.3 < near[3] < 0.75  # nearly the same k-mers, half of the pairs in another order


def plain_next(rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, xxhash_text(r[1] or ""), r[1] or ""))
    return [(a[0], a[1] or "", b[1] or "") for a, b in zip(order, order[1:] + order[:1])]


def xxhash_text(t):
    return chained([t])


@pytest.mark.parametrize("parts", ["1", "5", "40"])
def test_next_document(spark, parts):
    rng = random.Random(int(parts))
    rows = [(rng.randrange(-40, 400), f"text {rng.randrange(50)}", 1, "k") for _ in range(300)]
    rows += [(None, f"null {k}", 1, "k") for k in range(30)] + [(None, None, 1, "k")] * 3 + [(7, "copy", 1, "k")] * 5
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = with_next(spark.createDataFrame(rows, "doc_id long, text string, part int, key string").repartition(7)).collect()
        alone = edit_likeness(spark.createDataFrame([(4, "abcdefg hi")], "doc_id long, text string")).first()
        none = with_next(spark.createDataFrame([], "doc_id long, text string")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    key = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    assert sorted(((r.id, r.text, r.next_text) for r in got), key=key) == sorted(plain_next(rows), key=key)
    assert all(r.numbers == numbers(r.text) and r.next_numbers == numbers(r.next_text) for r in got[:40])
    assert alone.edited == "abcdeabcde" and alone.next_numbers == alone.numbers and none == []


def test_query(spark):
    import __spark_entry__ as entry

    sf = "/root/testdata/sf0.001"
    docs = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    got = {r.doc_id: r for r in entry.queries()["op12_order_minhash"](spark, sf).collect()}
    hexed = lambda ns: "".join(f"{x:08x}" for x in ns)
    share = lambda a, b: 1.0 if a == b else sum(x == y for x, y in zip(a, b)) / (RINGS * SLOTS)
    assert len(got) == len(docs)
    for (i, t), (_, after) in zip(docs, docs[1:] + docs[:1]):
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        own, changed = numbers(t), numbers(edited)
        row = got[i]
        assert (row.n_chars, row.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (row.fingerprint, row.edited_fingerprint) == (hexed(own), hexed(changed))
        assert (row.near_edited, row.near_next) == (share(own, changed), share(own, numbers(after)))


def test_fingerprint_text(spark):
    row = spark.range(1).select(fingerprint_text(F.array(F.lit(1).cast("long"), F.lit(0xFFFFFFFF), F.lit(0xABC).cast("long"))).alias("x")).first()
    assert row.x == "00000001ffffffff00000abc"
