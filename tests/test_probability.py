from functools import lru_cache

import numpy as np
from pyspark.sql import functions as F

from tallyspark.functions import prob
from tallyspark.operators import resample

GRID = [0.05 * i for i in range(1, 20)]


def set_recursion(h1, h2):
    h1, h2 = (max(0.01, min(0.99, h)) for h in (h1, h2))

    @lru_cache(None)
    def go(a, b):
        if a >= 6 and a - b >= 2:
            return 1.0
        if b >= 6 and b - a >= 2:
            return 0.0
        if a == b == 6:
            return 0.5 + 0.45 * (h1 - h2)
        p = h1 if (a + b) % 2 == 0 else 1 - h2
        return p * go(a + 1, b) + (1 - p) * go(a, b + 1)

    return go(0, 0)


def tiebreak_recursion(pa, pb):
    tail = pa * (1 - pb) / (pa * (1 - pb) + (1 - pa) * pb)

    @lru_cache(None)
    def go(a, b):
        if a >= 7 and a - b >= 2:
            return 1.0
        if b >= 7 and b - a >= 2:
            return 0.0
        if a == b == 6:
            return tail
        p = pa if (a + b) % 4 in (0, 3) else 1 - pb
        return p * go(a + 1, b) + (1 - p) * go(a, b + 1)

    return go(0, 0)


def test_set_and_tiebreak_match_recursion(spark):
    df = spark.createDataFrame([(a, b) for a in GRID for b in GRID], "a double, b double")
    out = prob.with_tiebreak(prob.with_set_from_holds(df, "a", "b", "s"), "a", "b", "t").collect()
    for r in out:
        assert abs(r["s"] - set_recursion(r["a"], r["b"])) < 1e-12
        assert abs(r["t"] - tiebreak_recursion(r["a"], r["b"])) < 1e-12


def test_symmetry_and_direction(spark):
    df = spark.createDataFrame([(0.66, 0.61), (0.64, 0.58), (0.6, 0.6)], "a double, b double")
    one = prob.with_exact_set(df, "a", "b", "p")
    both = prob.with_exact_set(one, "b", "a", "q").collect()
    for r in both:
        assert abs(r["p"] + r["q"] - 1) < 1e-12
    assert both[0]["p"] > 0.5 and abs(both[2]["p"] - 0.5) < 1e-12


def test_array_twin_equals_expression(spark):
    pairs = [(a, b) for a in (0.5, 0.6, 0.71) for b in (0.52, 0.66)]
    df = spark.createDataFrame([(a, b, n) for a, b in pairs for n in (3, 5)], "a double, b double, n int")
    rows = prob.with_exact_set(df, "a", "b", "s").withColumn("m", prob.match_from_set(F.col("s"), F.col("n"))).collect()
    for r in rows:
        twin = resample._match_chances(np.array([r["a"]]), np.array([r["b"]]), np.array([r["n"]]))[0]
        assert abs(twin - r["m"]) < 1e-12


def test_posterior_does_not_depend_on_partitioning(spark):
    df = spark.createDataFrame([(i, 65.0, 35.0, 61.0, 39.0, 3) for i in range(20)], "k int, alpha_1 double, beta_1 double, alpha_2 double, beta_2 double, best_of int")
    runs = [sorted(map(tuple, resample.posterior_match(df.repartition(n), ["k"], 200).collect())) for n in (1, 7)]
    assert runs[0] == runs[1]
    for _, mean, _, low, high in runs[0]:
        assert low < mean < high and 0.5 < mean < 0.9


def test_bootstrap_is_reproducible(spark):
    rows = [(f"b{i % 12}", 0.3 + 0.05 * (i % 9), 0.4 + 0.04 * (i % 9), i % 2) for i in range(240)]
    df = spark.createDataFrame(rows, "block string, p double, q double, label int")
    run = lambda n: {
        r["metric"]: (round(r["mean"], 9), round(r["low"], 9), round(r["high"], 9))
        for r in resample.bootstrap_delta(resample.block_sums(df.repartition(n), ["block"], "p", "q"), ["block"], 100).collect()
    }
    a, b = run(1), run(6)
    assert a == b and a["brier"][1] <= a["brier"][0] <= a["brier"][2]


def test_posterior_is_spread_whatever_the_rows_bytes(spark):
    df = spark.range(400).selectExpr("id AS k", "65D AS alpha_1", "35D AS beta_1", "61D AS alpha_2", "39D AS beta_2", "3 AS best_of").coalesce(1)
    out = resample.posterior_match(df, ["k"], 20)
    assert out.select(F.spark_partition_id().alias("p")).distinct().count() > spark.sparkContext.defaultParallelism


def test_balanced_lattice_equals_the_paths():
    rng = np.random.default_rng(4)
    for tables in (prob.set_monomials, prob.tiebreak_monomials):
        a, b, tail = rng.uniform(0.02, 0.98, (3, 50))
        paths = lambda terms, p, q: sum(n * p**i * (1 - p) ** j * q**k * (1 - q) ** m for (i, j, k, m), n in terms.items())
        won, tied = tables()
        expected = paths(won, a, b) - paths(won, b, a) + paths(tied, a, b) * tail
        first, level = resample._balanced(tables)
        x, y = resample._shares(a), resample._shares(b)
        assert np.abs((x * (first @ y + level[:, None] * y * tail)).sum(axis=0) - expected).max() < 1e-13
