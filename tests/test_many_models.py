"""Models fitted side by side against one plain fit each, folds and the ladder against brute force."""

import numpy as np
import pyarrow.parquet as parquet
import pytest
from pyspark.sql import functions as F

from tallyspark.operators import learn
from tallyspark.operators.newton import Fit, Linear, calibrate_all, fit_all
from tallyspark.operators.resample import digest_number
from tallyspark.session import cut_lineage

NAMES = ["a", "b", "c", "flat"]


def table(n=900, seed=5):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3)) * [1.0, 30.0, 0.01] + [0.0, 5.0, 1.0]
    t = 0.9 * x[:, 0] - 0.02 * x[:, 1] + rng.normal(size=n) * 0.3
    y = (rng.random(n) < 1 / (1 + np.exp(-t))).astype(int)
    return [(i, 2000 + i % 6, f"v{i % 17}", *map(float, x[i]), 2.0, int(y[i])) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "k int, yr int, venue string, a double, b double, c double, flat double, label int")


def plain_fit(x, y, l2):
    center, scale = x.mean(axis=0), x.std(axis=0)
    scale = np.where(scale < 1e-6, 1.0, scale)
    z = np.column_stack([np.ones(len(x)), (x - center) / scale])
    ridge = np.diag([0.0] + [l2] * x.shape[1])
    beta = np.zeros(z.shape[1])
    for _ in range(80):
        p = 1 / (1 + np.exp(-z @ beta))
        beta -= np.linalg.solve((z.T * (p * (1 - p))) @ z / len(y) + ridge + 1e-12 * np.eye(len(beta)), z.T @ (p - y) / len(y) + ridge @ beta)
    return lambda v: beta[0] + ((v - center) / scale) @ beta[1:]


def plain_line(z, y, pull=0.002):
    a, b = 1.0, 0.0
    for _ in range(80):
        p = 1 / (1 + np.exp(-(a * z + b)))
        w = p * (1 - p)
        g = np.array([((p - y) * z).mean() + pull * (a - 1), (p - y).mean()])
        h = np.array([[(w * z * z).mean() + pull, (w * z).mean()], [(w * z).mean(), w.mean() + 1e-12]])
        a, b = np.array([a, b]) - np.linalg.solve(h, g)
    return a, b


def plain_folds(rows, features, l2, folds):
    x = np.array([[r[3 + NAMES.index(f)] for f in features] for r in rows])
    year, y = np.array([r[1] for r in rows]), np.array([r[-1] for r in rows])
    out = {}
    for fold in folds:
        score = plain_fit(x[year < fold - 1], y[year < fold - 1], l2)
        a, b = plain_line(score(x[year == fold - 1]), y[year == fold - 1])
        for i in np.flatnonzero(year == fold):
            out[rows[i][0]] = 1 / (1 + np.exp(-(a * score(x[i]) + b)))
    return out


def test_folds_penalties_and_subsets_in_one_call(spark):
    rows = table()
    variants = {"all": learn.Variant(tuple(NAMES), 0.004), "strict": learn.Variant(tuple(NAMES), 0.5), "one": learn.Variant(("c",)), "two": learn.Variant(("c", "a"))}
    got = learn.variant_predictions(frame(spark, rows).repartition(7), variants, [2003, 2004, 2005]).collect()
    assert len(got) == len(variants) * sum(r[1] >= 2003 for r in rows)
    for name, v in variants.items():
        want = plain_folds(rows, v.features, v.l2, [2003, 2004, 2005])
        mine = {r["k"]: r["probability"] for r in got if r["variant"] == name}
        assert mine.keys() == want.keys()
        assert max(abs(mine[k] - p) for k, p in want.items()) < 1e-5


def test_number_of_jobs_does_not_grow_with_models(spark):
    rows = frame(spark, table(400)).coalesce(2).cache()
    tracker = spark.sparkContext.statusTracker()

    def jobs(folds, variants):
        spark.sparkContext.setJobGroup(f"{folds}{variants}", "")
        learn.variant_predictions(rows, {str(i): learn.Variant(tuple(NAMES[: 1 + i % 4]), 0.01 * (i + 1)) for i in range(variants)}, folds).count()
        return len(tracker.getJobIdsForGroup(f"{folds}{variants}"))

    one, many = jobs([2005], 1), jobs([2003, 2004, 2005], 4)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert many <= 2 * one


def test_far_logits_and_empty_samples(spark):
    rows = frame(spark, table(300)).withColumn("a", F.col("a") * 400.0).coalesce(2)
    both = fit_all(rows, {"none": F.lit(False), "null": F.lit(None).cast("boolean"), "all": F.lit(True)}, [Fit("none", ("a",)), Fit("all", ("a", "b")), Fit("null", ("b",))])
    assert both[0].coefficients == (0.0,) and both[0].intercept == 0.0 and both[2].coefficients == (0.0,)
    alone = learn.fit_logistic(rows, ["a", "b"])
    assert np.allclose(both[1].coefficients, alone.coefficients) and all(np.isfinite(alone.coefficients))
    # the classes of one model are split without error, another has no rows
    z = rows.select(F.lit(0).alias("model"), (F.col("label") * 2.0 - 1.0).alias("raw"), "label").unionByName(rows.select(F.lit(2).alias("model"), F.col("a").alias("raw"), "label"))
    lines = calibrate_all(z, 3)
    assert lines[0].slope > 2 and lines[1] == learn.Calibration() and np.isfinite(lines[2].slope)


def test_no_folds(spark):
    rows = frame(spark, table(60))
    assert learn.variant_predictions(rows, {"x": learn.Variant(("a",))}, []).count() == 0
    out = learn.ladder(rows, [("M0", ("a",)), ("M1", ())], [], ["k"], ["venue"]).collect()
    assert [r["status"] for r in out] == ["not_enough_fold_rows"] * 2 and {r["decision"] for r in out} == {"DELETE"}


def test_ladder_against_brute_force(spark):
    rows, folds = table(), [2004, 2005]
    df = frame(spark, rows).coalesce(2)
    rungs = [("empty", ()), ("M0", ("c",)), ("M1", ("a",)), ("M2", ()), ("M3", ("b", "a"))]
    got = learn.ladder(df, rungs, folds, ["k"], ["venue"], iterations=40).collect()
    label, venue = {r[0]: r[-1] for r in rows}, {r[0]: r[2] for r in rows}
    loss = lambda p: {k: -np.log(v if label[k] else 1 - v) for k, v in p.items()}
    sets = [("c",), ("c", "a"), ("c", "a"), ("c", "a", "b")]
    losses = [loss(plain_folds(rows, s, 0.004, folds)) for s in sets]
    names = sorted(set(venue.values()))
    placed = spark.createDataFrame([(v,) for v in names], "venue string").select("venue", digest_number(F.col("venue"), digits=3).alias("b")).collect()
    order = [r["venue"] for r in sorted(placed, key=lambda r: (r["b"], r["venue"]))]
    drawn = spark.range(40).select(F.col("id").cast("int").alias("it"), F.explode(F.sequence(F.lit(0), F.lit(len(order) - 1))).alias("i"))
    picks = {}
    for r in drawn.select("it", (digest_number(F.lit(11), F.col("it"), F.col("i")) % len(order)).alias("at")).collect():
        picks.setdefault(r["it"], []).append(order[r["at"]])
    sums = [{v: (sum(x for k, x in l.items() if venue[k] == v), sum(venue[k] == v for k in l)) for v in names} for l in losses]
    mean = lambda s, p: sum(s[v][0] for v in p) / sum(s[v][1] for v in p)
    assert [(r["status"], r["decision"]) for r in got[:2]] == [("not_evaluated_no_supported_features", "DELETE"), ("evaluated", "KEEP_BASELINE")]
    for i, row in enumerate(got[1:]):
        pooled = np.mean(list(losses[i].values()))
        assert abs(row["log_loss"] - pooled) < 1e-5 and row["features"] == len(sets[i])
        if i:
            deltas = [mean(sums[i], p) - mean(sums[i - 1], p) for p in picks.values()]
            assert abs(row["mean_delta"] - np.mean(deltas)) < 1e-5
            assert abs(row["low"] - np.quantile(deltas, 0.025)) < 1e-5 and abs(row["high"] - np.quantile(deltas, 0.975)) < 1e-5
            assert row["decision"] == ("KEEP" if pooled < np.mean(list(losses[i - 1].values())) - 1e-12 and np.mean(deltas) < 0 else "DELETE")
    with pytest.raises(Exception, match="not unique"):
        learn.ladder(df.unionByName(df.limit(1)).withColumn("yr", F.lit(2005)).unionByName(df), rungs, folds, ["k"], ["venue"], iterations=4)


def test_a_year_is_scored_by_many_tasks(spark):
    rows = frame(spark, table(400)).repartition(6)
    models = [("v", 2003, Linear(("a",), (1.0,), 0.0, (0.0,), (1.0,)))]
    scored = learn._scored_by_year(rows, models, [2003], "yr")
    assert "BroadcastHashJoin" in scored._jdf.queryExecution().sparkPlan().toString()
    assert scored.select(F.spark_partition_id().alias("p")).distinct().count() == 6


def test_one_staged_file_has_many_row_groups(spark):
    staged = cut_lineage(spark.range(0, 6_000_000, 1, 1).select("id", F.rand(3).alias("x")))
    groups = [parquet.ParquetFile(f.removeprefix("file:")).num_row_groups for f in staged.inputFiles()]
    assert len(groups) == 1 and groups[0] > 2
