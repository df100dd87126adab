"""The text operators against brute force, and their behaviour on odd rows."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

import tallyspark.llm.minhash as minhash
import tallyspark.llm.suffix as suffix
from tallyspark.llm.components import components
from tallyspark.llm.queries import vocabulary_path

ODD = "doc_id long, text string, id long, node long, key string, n int, bytes string, g int"


def odd_rows(texts):
    return [(i, t, 7, 8, "k", 9, "b", 1) for i, t in enumerate(texts)]


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) > 4 else ({tuple(words)} if words else set())


def groups(ids, linked):
    root = {i: i for i in ids}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = sorted((top(a), top(b)))
        root[b] = a
    return {i: top(i) for i in ids}


def family(rng, size, edits, words=120):
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    out = []
    for _ in range(size):
        copy = list(base)
        for _ in range(rng.randint(0, edits)):
            copy[rng.randrange(words)] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(copy))
    return out


@pytest.mark.parametrize("small", [2, 32])
def test_minhash_groups(spark, monkeypatch, small):
    monkeypatch.setattr(minhash, "SMALL_BUCKET", small)
    monkeypatch.setattr(minhash, "FAMILY_BLOCK", 8)
    rng = random.Random(small)
    texts = family(rng, 40, 6) + family(rng, 12, 3) + [None, "", " \t\n", "one two", "ONE two", "a b c d e", "a b c d e f"]
    texts += [texts[3], texts[3].upper()]
    got = {r.id: r for r in minhash.minhash_groups(spark.createDataFrame(odd_rows(texts), ODD)).collect()}
    sets = [shingles(t) for t in texts]
    linked = [(i, j) for i in range(len(texts)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
    want = groups(range(len(texts)), linked)
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(r.n_shingles == len(sets[i]) and r.kept == (want[i] == i) for i, r in got.items())


@pytest.mark.parametrize("small", [2, 32])
def test_minhash_threshold(spark, monkeypatch, small):
    monkeypatch.setattr(minhash, "SMALL_BUCKET", small)
    monkeypatch.setattr(minhash, "FAMILY_BLOCK", 8)
    texts = family(random.Random(small), 40, 9) + [" ".join(f"v{i}" for i in range(58)), " ".join(f"v{i}" for i in range(48))]
    sets = [shingles(t) for t in texts]
    docs = spark.createDataFrame(odd_rows(texts), ODD).cache()
    found = []
    for percent in (80, 85):
        linked = [(i, j) for i in range(len(texts)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
        found.append({r.id: r.component_id for r in minhash.minhash_groups(docs, percent=percent).collect()})
        assert found[-1] == groups(range(len(texts)), linked)
    assert found[0] != found[1]


def test_minhash_empty_table(spark):
    assert minhash.minhash_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_densified_bins_agree_like_the_sets():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 12).astype(np.uint64)
    b = np.append(a[:10], rng.integers(0, 2**63, 2).astype(np.uint64))
    tables = minhash.densified(np.repeat([0, 1], 12), np.concatenate([a, b]), 2)
    assert (tables != 2**64 - 1).all()
    assert 0.4 < (tables[0] == tables[1]).mean() < 0.98


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)] + [(None, 3), (5, 5)]
    got = {r.node: r.component_id for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    real = [(a, b) for a, b in edges if a is not None and a != b]
    want = groups({x for e in real for x in e}, real)
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_suffix_order():
    rng = random.Random(2)
    parts = [bytes(rng.choice(b"ab\x00\xff") for _ in range(rng.randint(1, 40))) for _ in range(40)] + [b"a" * 30, b"ab" * 20]
    order = suffix.suffix_order(parts)
    data, ends = b"".join(parts), np.repeat(np.cumsum([len(p) for p in parts]), [len(p) for p in parts])
    keys = [data[i : ends[i]] for i in order]
    assert keys == sorted(keys) and sorted(order.tolist()) == list(range(len(data)))
    wanted = np.array([rng.randint(1, len(p)) for p in parts])
    starts = np.cumsum([0, *(len(p) for p in parts)])
    first = lambda o: [data[i : ends[i]] for i in o if i < starts[np.searchsorted(starts, i, "right") - 1] + wanted[np.searchsorted(starts, i, "right") - 1]]
    some = suffix.suffix_order(parts, wanted=wanted)
    assert first(some) == first(order) and len(some) < len(order)


def removed(texts, length=400, first=False):
    data = [(t or "").encode() for t in texts]
    windows = [[hashlib.md5(t[i : i + length]).digest() for i in range(len(t) - length + 1)] for t in data]
    seen = Counter(h for t in windows for h in t)
    out, met = [], set()
    for t, own in zip(data, windows):
        mask = np.zeros(len(t), dtype=bool)
        for i, h in enumerate(own):
            if seen[h] > 1 and (h in met or not first):
                mask[i : i + length] = True
            met.add(h)
        spans = int(mask[0]) + int((np.diff(mask.astype(int)) == 1).sum()) if len(t) else 0
        out.append((len(t), int(mask.sum()), spans, bytes(np.frombuffer(t, np.uint8)[~mask])))
    return out


def passages(seed):
    rng = random.Random(seed)
    prose = lambda n: "".join(rng.choice("abcdé \n") for _ in range(n))
    passage, line, copy = prose(900), prose(150), prose(700)
    texts = [prose(300) + passage + prose(rng.randint(0, 500)) for _ in range(9)] + [(prose(100) + line) * 1 + prose(500) for _ in range(6)]
    texts += [copy] * 4 + [None, "", "short", "a" * 1500, "ab" * 700, prose(600) + copy[:405], passage[:399], passage[100:500]]
    return texts + [texts[0][:700] + "!" + texts[0][700:], prose(50) + "xyz " * 300]


@pytest.mark.parametrize("group", [2, 512])
def test_repeated_passages(spark, monkeypatch, group):
    monkeypatch.setattr(suffix, "GROUP", group)
    texts = passages(group)
    got = {r.id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix.without_repeats(spark.createDataFrame(odd_rows(texts), ODD)).collect()}
    assert [got[i] for i in range(len(texts))] == removed(texts)


def more_passages(seed):
    rng = random.Random(seed)
    prose = lambda n: "".join(rng.choice("efghß.,") for _ in range(n))
    near = [prose(rng.choice([230, 260, 330, 390])) for _ in range(5)]
    return passages(seed) + [prose(rng.randint(0, 200)) + rng.choice(near) + prose(rng.randint(0, 300)) + rng.choice(near) for _ in range(25)] + near + ["same words " * k for k in (30, 31, 90)]


@pytest.mark.parametrize("group", [2, 512])
def test_two_lengths_from_one_sort(spark, monkeypatch, group):
    monkeypatch.setattr(suffix, "GROUP", group)
    texts = more_passages(group)
    out = suffix.without_repeats(spark.createDataFrame(odd_rows(texts), ODD), windows=suffix.Windows(length=250, longer=400))
    rows = {r.id: r for r in out.collect()}
    short = [(rows[i].n_bytes, rows[i].n_removed, rows[i].n_spans, bytes(rows[i].kept)) for i in range(len(texts))]
    long = [(rows[i].n_bytes, rows[i].longer_removed, rows[i].longer_spans, bytes(rows[i].longer_kept)) for i in range(len(texts))]
    assert short == removed(texts, 250)
    assert long == removed(texts, 400)


@pytest.mark.parametrize("group", [2, 512])
def test_first_copy_stays(spark, monkeypatch, group):
    monkeypatch.setattr(suffix, "GROUP", group)
    texts = more_passages(group + 1)
    out = suffix.without_repeats(spark.createDataFrame(odd_rows(texts), ODD), windows=suffix.Windows(length=250, first=True))
    got = {r.id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in out.collect()}
    assert [got[i] for i in range(len(texts))] == removed(texts, 250, first=True)


def test_equal_streams_of_spans_meet_once(spark):
    rng = random.Random(4)
    prose = lambda n: "".join(rng.choice("abcdefgh ,") for _ in range(n))
    passage = prose(9000)
    texts = [prose(rng.randint(0, 300)) + passage + prose(rng.randint(0, 300)) for _ in range(30)]
    w = suffix.Windows(length=250, first=True)
    docs = spark.createDataFrame(odd_rows(texts), ODD)
    # spans are 110 bytes on the average: a row for each would be some eighty for every text
    assert suffix.repeated_windows(docs, w).count() < 25 * len(texts)
    got = {r.id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix.without_repeats(docs, windows=w).collect()}
    assert [got[i] for i in range(len(texts))] == removed(texts, 250, first=True)


def test_streams_end_by_their_text():
    part, ends = np.array([0] * 6 + [1] * 5), np.array([0, 0, 1, 0, 0, 0, 0, 1, 0, 0, 0], dtype=bool)
    opens, number = suffix._streams(part, np.array([0, 1, 2, 3, 5, 6, 7, 8, 9, 10, 11]), ends)
    assert opens.tolist() == [0, 3, 4, 6, 8] and number.tolist() == [0, 1, 2, 0, 0, 1, 0, 1, 0, 1, 2]
    opens, number = suffix._streams(np.zeros(150, int), np.arange(150), np.zeros(150, bool))
    assert opens.tolist() == [0, 64, 128] and number.max() == 63


def test_windows_are_checked():
    for wrong in ({"length": 20}, {"length": 400, "longer": 250}, {"longer": 500, "first": True}):
        with pytest.raises(ValueError):
            suffix.Windows(**wrong)


def test_repeated_passages_in_pieces(spark, monkeypatch):
    rng = random.Random(9)
    long = "".join(rng.choice("abcdefgh ") for _ in range(9000))
    texts = [long, "x" + long[2000:2600] + "y", long[100:4000]]
    items = suffix._items([t.encode() for t in texts])
    monkeypatch.setattr(suffix, "PIECE", 1000)
    pieces = suffix._items([t.encode() for t in texts])
    windows = lambda rows: sorted((i, at + k) for i, at, t in rows for k in range(len(t) - suffix.LENGTH + 1))
    assert windows(items) == windows(pieces) and len(pieces) > len(items)


def test_repeated_passages_empty_table(spark):
    assert suffix.without_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_bpe_matches_the_library(spark):
    from tokenizers import Tokenizer

    from tallyspark.llm.bpe import bpe_decode, bpe_encode

    rng = random.Random(5)
    letters = "abcdefgh ijklmnop'stmdrevl \n\t\x85　\x1c éèßΣσςİIıŁ12345٣½²日本語🙂👍🏽́<|>endoftext</w>,.!?-_AEIOU"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    texts += [None, "", "<|endoftext|>a<|startoftext|> B", "ΑΣ ΣΑΣ", "x" * 500, "ab" * 300, texts[0], "The " * 5000]
    path = vocabulary_path("word_bpe_49k.json")
    rows = bpe_decode(bpe_encode(spark.createDataFrame(odd_rows(texts), ODD), path), path).collect()
    library = Tokenizer.from_file(path)
    for r in rows:
        ids = library.encode(texts[r.id] or "", add_special_tokens=False).ids
        assert (r.ids, r.decoded) == (ids, library.decode(ids, skip_special_tokens=False))
    assert len(rows) == len(texts)


def test_token_files(spark):
    from tallyspark.llm.token_files import SEPARATOR, _encoding, document_token_counts, flat_token_blocks, named_counts
    from tallyspark.session import cut_lineage

    rng = random.Random(6)
    texts = [" ".join(f"w{rng.randrange(999)}" for _ in range(rng.randrange(60))) for _ in range(80)] + [None, "", "", "z " * 900, "<|endoftext|>"]
    path = vocabulary_path("byte_bpe_50k.tiktoken")
    encoding = _encoding(path)
    for size in (1, 7, 64, 65_536):
        blocks = cut_lineage(flat_token_blocks(spark.createDataFrame(odd_rows(texts), ODD).repartition(3), path, block_tokens=size))
        got = {r.id: r.n_tokens for r in named_counts(blocks, block_tokens=size).collect()}
        assert got == {i: len(encoding.encode_ordinary(t or "")) for i, t in enumerate(texts)}
    ids = [5, SEPARATOR, SEPARATOR, 6, 7, 8, SEPARATOR, 9]
    parts = [(1, k, np.array(ids[2 * k : 2 * k + 2], dtype="<u2").tobytes()) for k in range(4)] + [(2, 0, b""), (2, 1, None)]
    rows = document_token_counts(spark.createDataFrame([(f, b, bytearray(t) if t is not None else None) for f, b, t in parts], "file long, block long, tokens binary")).collect()
    assert sorted((r.ordinal, r.start, r.n_tokens, r.closed) for r in rows) == [(0, 0, 1, True), (1, 2, 0, True), (2, 3, 3, True), (3, 7, 1, False)]


def test_flat_binary_files(spark, tmp_path):
    from tallyspark.llm.token_files import SEPARATOR, document_token_counts, read_token_files

    ids = [1, 2, 3, SEPARATOR, 4, SEPARATOR, 5]
    (tmp_path / "a.bin").write_bytes(np.array(ids, dtype="<u2").tobytes())
    rows = document_token_counts(read_token_files(spark, str(tmp_path), block_tokens=3)).collect()
    assert sorted((r.ordinal, r.n_tokens, r.closed) for r in rows) == [(0, 3, True), (1, 1, True), (2, 1, False)]


def test_pieces_of_a_cell_match_every_window():
    rng = np.random.default_rng(4)
    for _ in range(100):
        n, width = int(rng.integers(1, 30)), int(rng.choice(suffix.WIDTHS))
        rel = rng.integers(0, 400, n)
        count = np.array([int(rng.integers(1, r + 2)) for r in rel])
        want = [(i, d // width) for i in range(n) for d in range(rel[i], rel[i] - count[i], -1)]
        row, off, size = suffix._by_cell(rel, count, width)
        assert [(r, (rel[r] - o - k) // width) for r, o, s in zip(row.tolist(), off.tolist(), size.tolist()) for k in range(s)] == want
        assert len(row) == len(set(want))


def test_landmarks_match_every_window(monkeypatch):
    monkeypatch.setattr(suffix, "PIECE", 90)
    w = suffix.Windows(20, gram=8)
    rng = random.Random(6)
    texts = ["".join(rng.choices("ab", k=k)).encode() for k in (20, 21, 45, 120, 300, 19, 88)]
    items = suffix._items(texts, w)
    _, _, gram, ends, starts, part, best = suffix._landmarks([x[2] for x in items], w)
    windows = [(number, at + k) for number, at, piece in items for k in range(len(piece) - 19) if len(piece) < 109 or k < 90]
    assert [(items[p][0], items[p][1] + s - (ends[p] - len(items[p][2]))) for s, p in zip(starts, part)] == windows
    assert windows == [(i, k) for i, t in enumerate(texts) for k in range(len(t) - 19)]
    for s, b in zip(starts.tolist(), best.tolist()):
        assert b == min(range(s, s + 13), key=lambda x: (int(gram[x]) >> 23, x))


def test_whole_characters_in_broken_text():
    rng = np.random.default_rng(3)
    for _ in range(500):
        data = rng.choice(np.array([0x41, 0x80, 0xBF, 0xC3, 0xE2, 0xF0], dtype=np.uint8), int(rng.integers(1, 20)))
        starts = np.unique(np.append(rng.integers(0, len(data) + 1, 2), 0))
        gone = rng.random(len(data)) < 0.2
        want, at = gone.copy(), 0
        while at < len(data):
            stop = at + 1
            size = 1 + sum(data[at] >= x for x in (0xC0, 0xE0, 0xF0))
            while stop < min(at + size, len(data)) and data[stop] >> 6 == 2 and stop not in starts:
                stop += 1
            want[at:stop] |= gone[at:stop].any()
            at = stop
        assert np.array_equal(suffix._whole_characters(data, starts, gone), want)
