import random
from collections import defaultdict

from pyspark.sql import functions as F

from tallyspark.operators.order import numbered
from tallyspark.operators.prefix import asof_before, prior_totals, sequence_rows, trailing_means
from tallyspark.session import cut_lineage, dealt


def history(n=400, seed=5):
    """One key holds a third of all rows; batches repeat."""
    rng = random.Random(seed)
    return [(0 if rng.random() < 0.34 else rng.randrange(1, 12), rng.randrange(30), i, rng.randrange(2)) for i in range(n)]


def test_prior_totals_excludes_own_batch_with_tiny_chunks(spark):
    rows = history()
    df = spark.createDataFrame(rows, "k int, batch int, id int, won int")
    out = prior_totals(
        df, ["k"], "batch", sums={"wins": F.col("won")}, maxes={"last": F.col("batch")}, chunk=F.floor(F.col("batch") / 3)
    ).collect()
    assert len(out) == len({(k, b) for k, b, _, _ in rows})
    for r in out:
        earlier = [(b, w) for k, b, _, w in rows if k == r["k"] and b < r["batch"]]
        assert r["wins"] == sum(w for _, w in earlier)
        assert r["last"] == (max(b for b, _ in earlier) if earlier else None)


def test_inclusive_totals(spark):
    rows = history(120)
    df = spark.createDataFrame(rows, "k int, batch int, id int, won int")
    out = prior_totals(df, ["k"], "batch", sums={"n": F.lit(1)}, chunk=F.floor(F.col("batch") / 4), inclusive=True)
    for r in out.collect():
        assert r["n"] == sum(1 for k, b, _, _ in rows if k == r["k"] and b <= r["batch"])


def test_sequence_and_trailing_means_across_chunks(spark):
    rows = history()
    df = spark.createDataFrame(rows, "k int, batch int, id int, won int")
    seq = sequence_rows(df, ["k"], "batch", "id", width=7)
    out = trailing_means(seq, ["k"], "seq", "won", (3, 5), chunk=6).collect()
    assert len(out) == len(rows)
    by = defaultdict(list)
    for k, b, i, w in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        by[k].append((b, i, w))
    for r in out:
        mine = by[r["k"]]
        pos = [i for _, i, _ in mine].index(r["id"])
        assert r["seq"] == pos + 1
        assert r["seq_before"] == sum(1 for b, _, _ in mine if b < r["batch"])
        for n in (3, 5):
            last = [w for _, _, w in mine[max(0, pos + 1 - n) : pos + 1]]
            assert abs(r[f"won_{n}"] - sum(last) / len(last)) < 1e-12


def test_asof_is_strictly_before(spark):
    states = spark.createDataFrame([(1, 2, "a"), (1, 5, "b"), (2, 1, "c")], "k int, at int, v string")
    probes = spark.createDataFrame([(1, 2), (1, 3), (1, 5), (1, 9), (3, 1)], "k int, at int")
    got = {(r["k"], r["at"]): r["v"] for r in asof_before(probes, states, ["k"], "at", ["v"]).collect()}
    assert got == {(1, 2): None, (1, 3): "a", (1, 5): "a", (1, 9): "b", (3, 1): None}


def test_global_numbering(spark):
    rows = [(i * 37 % 101, i) for i in range(300)]
    df = spark.createDataFrame(rows, "a int, b int").repartition(5)
    got = [(r["a"], r["b"]) for r in sorted(numbered(df, ["a", "b"], "pos").collect(), key=lambda r: r["pos"])]
    assert got == sorted(rows)


def test_no_state_is_built_whole_on_the_driver(spark):
    rows = spark.range(4000).selectExpr("id % 500 AS k", "id DIV 500 AS pos", "1.0D AS v")
    totals = prior_totals(rows, ["k"], "pos", sums={"t": F.col("v")})
    sides = dealt(cut_lineage(rows)).join(rows.groupBy("k").agg(F.sum("v").alias("s")), "k")
    for out in (rows.join(totals, ["k", "pos"]), sides):
        assert len(out.collect()) == 4000
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in next(line for line in plan.splitlines() if "Join" in line), plan


def test_rows_are_sorted_by_numbers_before_strings(spark):
    from tallyspark.operators.prefix import numbers_first

    df = spark.createDataFrame([("north", 1, "hard", 3)], "pool string, entity long, surface string, batch_no long")
    assert numbers_first(df, ("pool", "entity", "surface")) == ["entity", "pool", "surface"]
    out = prior_totals(df, ("pool", "entity"), "batch_no", sums={"n": F.lit(1)})
    assert out.columns == ["pool", "entity", "batch_no", "n"]
    assert "[entity" in out._jdf.queryExecution().sparkPlan().toString().split("Window")[1]


def test_two_sides_are_dealt_before_they_are_merged(spark):
    from tallyspark.operators.batches import paired

    sides = spark.range(8).selectExpr("id div 2 AS match_id", "id % 2 = 0 AS one", "id AS v", "cast(id AS string) AS s")
    wide = paired(sides, ["match_id"], ["v", "s"], F.col("one"))
    assert "RepartitionByExpression" in wide._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(tuple(r) for r in wide.collect()) == [(i, 2 * i, 2 * i + 1, str(2 * i), str(2 * i + 1)) for i in range(4)]
