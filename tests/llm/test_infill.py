"""Fill-in-the-middle texts against a plain statement of the rule, and odd rows."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tallyspark.llm.infill import LEAST, MOST, ChunkMemory, Parts, content_cuts, fill_in_middle, restored


def expected(doc_id, text, seed=7, infill=100, spm=50):
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[k : k + 8], 16) for k in range(0, 32, 8)]
    n = len(lines)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= infill:
        return n, "plain", None, None, text
    p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    if h[3] % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def odd_texts():
    rng = random.Random(5)
    line = lambda: " ".join(rng.choice(["río", "mañana", "🙂", "plain", "words", "日本"]) for _ in range(rng.randrange(12)))
    shared = "\n".join(line() for _ in range(120))
    texts = [None, "", "\n", "\n\n\n", "no line end", "one\n", "a\r\nb\r\n", "<P>", "x <S> y\nz", "<M", "<P\n>", "tail <", shared, shared + "\n", "start " + shared, shared + line()]
    texts += ["\n".join(line() for _ in range(rng.randrange(40))) for _ in range(60)]
    texts += ["x" * 300_000, ("y" * 90 + "\n") * 9000, ("long line " * 4000 + "\n") * 3, "a" * (MOST - 2) + "<P>" + "b" * 50, "a" * (MOST - 1) + "<M>", "a" * MOST + "<S>\n"]
    return texts


@pytest.mark.parametrize(("infill", "spm"), [(100, 50), (40, 0)])
def test_brute_force(spark, infill, spm):
    rows = [*enumerate(odd_texts()), (None, "null id\nsecond\n"), (3, "\n\n\n"), (-9, "negative\nid")]
    table = spark.createDataFrame([(i, t, "psm", -1, "o") for i, t in rows], "doc_id long, text string, form string, n int, output string")
    made = fill_in_middle(table, infill_percent=infill, spm_percent=spm)
    got = made.withColumn("back", restored(F.col("output"), F.col("form"))).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    want = sorted(((i, *map(str, expected(i, t, 7, infill, spm)), t or "") for i, t in rows), key=key)
    assert sorted(((r.id, *map(str, (r.n, r.form, r.prefix_chars, r.middle_chars, r.output)), r.back) for r in got), key=key) == want


def test_empty_table(spark):
    assert fill_in_middle(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_chunks_follow_content():
    rng = random.Random(2)
    body = bytes(rng.randrange(32, 127) for _ in range(60_000))
    one, other = content_cuts([b"head " + body, rng.randbytes(4000) + body])
    assert all(LEAST <= b - a <= MOST for a, b in zip([0, *one], one[:-1]))
    assert one[-1] == len(body) + 5 and other[-1] == len(body) + 4000
    assert len({x - 5 for x in one} & {x - 4000 for x in other}) > 0.8 * len(one)
    assert content_cuts([b"", b"a"]) == [[], [1]]


def test_memory_is_bounded_and_compares_contents():
    memory = ChunkMemory(10_000)
    texts = [bytes([65 + k % 26]) * 999 + b"\n" + str(k).encode() for k in range(200)]
    for text in texts * 2:
        cuts = content_cuts([text])[0]
        parts = Parts(text, cuts, memory)
        assert parts.n == 2 and parts.place(1) == (1000, 1000) and parts.place(2) == (len(text), len(text))
        assert memory.size <= 10_000 and sum(map(len, memory.old)) <= 10_000
    memory = ChunkMemory()
    for _ in range(3):
        Parts(texts[0], content_cuts([texts[0]])[0], memory)
    assert memory.hits == 2 * memory.misses
