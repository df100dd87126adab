"""The pipeline's stages on a small table, each held to what it must leave behind."""

import random

import pytest
from test_texts import groups, removed, shingles

import corpus_pipeline as pipeline
from tallyspark.llm.quality import quality_scores

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def results(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for _, stage in pipeline.STAGES:
        out.append(stage(spark, out[-1], SF).cache())
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


def test_columns(results):
    assert [n for n, _ in pipeline.STAGES] == ["quality", "near_duplicates", "repeated_passages", "personal_data", "packing"]
    assert all(r.columns == results[0].columns for r in results[1:-1])


def test_quality_stage(results):
    kept = {r.id for r in quality_scores(results[0]).where("kept").collect()}
    assert texts(results[1]) == {i: t for i, t in texts(results[0]).items() if i in kept}


def test_near_duplicate_stage(results):
    before = texts(results[1])
    sets = {i: shingles(t) for i, t in before.items()}
    linked = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert set(texts(results[2])) == set(groups(sets, linked).values())


def test_repeated_passage_stage(results):
    before = texts(results[2])
    want = {i: kept.decode("utf-8", "ignore") for i, (_, gone, _, kept) in zip(before, removed(before.values(), 250, first=True)) if kept or not gone}
    assert texts(results[3]) == want


def test_personal_data_stage(results):
    before, after = texts(results[3]), texts(results[4])
    assert before.keys() == after.keys()
    assert all(after[i] == t for i, t in before.items() if not any(c in "0123456789@" for c in t))
    assert not any("@mail" in t and ".example.com" in t for t in after.values())


def test_packing_stage(results):
    words = {}
    for r in results[5].collect():
        words[r.doc_id] = words.get(r.doc_id, 0) + r.n_tokens
    assert words == {i: len(t.encode().split()) for i, t in texts(results[4]).items()}


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(f"{rng.choice(['river', 'table', 'green', 'walks', 'slow'])}{rng.randrange(10**5)}" for _ in range(n)) + "."


def odd_ids(spark):
    long, short, near = prose(1, 90), prose(2, 12), prose(3, 90)
    rows = [(7, long), (7, long), (8, short), (8, short), (None, near), (None, near + " end"), (None, prose(4, 90)), (None, prose(5, 12)), (9, prose(6, 90)), (9, prose(7, 90)), (10, ""), (10, ""), (None, None), (None, None)]
    table = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return table, rows


def test_repeated_rows_and_null_ids(spark):
    docs, rows = odd_ids(spark)
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    read = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=key)
    kept = pipeline.quality(spark, docs, SF)
    assert kept.schema == docs.schema and read(kept) == sorted(rows, key=key)
    one = pipeline.near_duplicates(spark, kept, SF).cache()
    want = sorted([*dict.fromkeys(r for r in rows[:12] if r != rows[5]), *rows[12:]], key=key)
    got = read(one)
    assert [r for r in got if not (r[1] or "").startswith(rows[4][1])] == [r for r in want if r != rows[4]]
    assert sum((r[1] or "").startswith(rows[4][1]) for r in got) == 1
    assert read(pipeline.repeated_passages(spark, one, SF)) == got


def test_passages_of_null_and_repeated_ids(spark):
    shared = prose(8, 60)
    rows = [(None, "a " + shared), (None, shared + " b"), (5, "c " + shared), (5, "untouched " + prose(9, 60))]
    docs = spark.createDataFrame([(i, t, len(t)) for i, t in rows], "doc_id long, text string, n_chars long").coalesce(1)
    out = pipeline.repeated_passages(spark, docs, SF).collect()
    assert sorted(r.text for r in out) == sorted(kept.decode() for *_, kept in removed((t for _, t in rows), 250, first=True))
    assert sum(shared in r.text for r in out) == 1 and len(out) == 4
    assert all(r.n_chars == len(r.text) for r in out)


def test_passages_of_fifty_words(spark):
    rng = random.Random(12)
    words = lambda n: " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 8))) for _ in range(n))
    passages = [words(rng.randint(51, 59)) for _ in range(30)]
    texts = [f"{words(60)} {p} {words(40)}" for p in passages for _ in range(4)] + [words(80) for _ in range(20)]
    out = {r.doc_id: r.text for r in pipeline.repeated_passages(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), SF).collect()}
    for k, p in enumerate(passages):
        assert sum(p in out[4 * k + j] for j in range(4)) == 1
    assert all(out[i] == t for i, t in enumerate(texts) if i >= 120)
    assert all(len(out[i]) > 400 for i in range(120))


STAGES = dict(pipeline.STAGES)
CLASHING = "doc_id long, text string, row_key string, private int, rest string, id long, component_id long, `a.b` int, n_chars long, row int"


def clashing(spark, rows):
    return spark.createDataFrame([(i, t, f"k{k}", 7, "rest", 8, 9, 10, -1, 11) for k, (i, t) in enumerate(rows)], CLASHING)


def test_clashing_columns(spark):
    copied = prose(21, 60)
    rows = [(1, prose(20, 60)), (2, copied + " mail a@b.example.com"), (3, prose(22, 30) + copied), (3, None), (None, "")]
    docs = clashing(spark, rows)
    for name, stage in list(STAGES.items())[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == clashing(spark, []).columns
        assert all(r.row_key == f"k{('k0 k1 k2 k3 k4'.split()).index(r.row_key)}" and (r.private, r.rest, r.id, r["a.b"]) == (7, "rest", 8, 10) for r in docs.collect()), name
    left = {r.row_key: r.text for r in docs.collect()}
    assert left["k0"] == rows[0][1] and left["k1"].startswith(copied) and "a@b" not in left["k1"] and left["k2"] == rows[2][1].removesuffix(copied)
    assert left["k3"] is None and left["k4"] == ""
    assert STAGES["packing"](spark, docs, SF).count() == 5


def test_empty_table_and_long_text(spark):
    none = clashing(spark, [])
    for name, stage in STAGES.items():
        assert stage(spark, none, SF).count() == 0, name
    long = prose(30, 400_000)
    docs = spark.createDataFrame([(1, long), (2, "short " + prose(31, 60)), (3, prose(32, 20) + long[1_000_000:1_000_900])], "doc_id long, text string")
    for name, stage in list(STAGES.items())[:-1]:
        docs = stage(spark, docs, SF).cache()
    left = texts(docs)
    assert left[1] == long and len(long) > 4_000_000 and left[3] == prose(32, 20)
    assert sum(r.n_tokens for r in STAGES["packing"](spark, docs, SF).collect()) == 400_000 + 61 + 20


def test_secret_without_digits(spark):
    docs = spark.createDataFrame([(1, 'token: "abcdefghijklmnopqrst" in words')], "doc_id long, text string")
    assert "abcdefghijklmnopqrst" not in pipeline.personal_data(spark, docs, SF).first().text


def test_replacement_characters_stay(spark):
    shared = prose(10, 60)
    texts = ["first " + shared, "own \ufffd words é" + shared + "ê\ufffd", "other 🙂" + shared + "🙃 words", "x" * 20 + "é" + shared + "é" + "y" * 20, "z" + "é" + shared + "é", "p😂" + shared + "🙂q", "r😃" + shared]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r.text for r in pipeline.repeated_passages(spark, docs, SF).collect()}
    want = {i: kept.decode("utf-8", "ignore") for i, (*_, kept) in enumerate(removed(texts, 250, first=True))}
    assert want.pop(5) == "p😂q" and got.pop(5) == "pq"  # two halves left over are no character
    assert got == want and want[0] == texts[0] and want[1].startswith("own \ufffd words ") and want[1].endswith("\ufffd")
    assert any(kept.decode("utf-8", "ignore").encode() != kept for *_, kept in removed(texts, 250, first=True))
