"""What is staged on the way, and the shuffles behind it, take disk only as long as they are read."""

import os
import time
from urllib.parse import urlparse

import pytest
from pyspark.sql import functions as F

from test_ratings import frames, history
from tallyspark import session
from tallyspark.operators import features as ft
from tallyspark.operators import ratings as rt
from tallyspark.operators import state as st
from tallyspark.operators.newton import Fit, fit_all
from tallyspark.operators.prefix import prior_totals


def staged_folders(spark):
    root = urlparse(os.path.dirname(session.scratch_path(spark, "x"))).path
    return set(os.listdir(root))


def shuffle_files(spark):
    tops = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {f for top in tops for d, _, names in os.walk(top) for f in names if f.startswith("shuffle_")}


def test_shuffles_go_with_the_write(spark):
    before = shuffle_files(spark)
    out = session.cut_lineage(spark.range(20_000).groupBy((F.col("id") % 999).alias("k")).agg(F.sum("id").alias("s")))
    end = time.time() + 20
    while (left := shuffle_files(spark) - before) and time.time() < end:
        time.sleep(0.2)
    assert not left
    assert spark.conf.get(session.CLEANUP_KEY) in (None, "false") and out.count() == 999


def test_only_what_is_returned_stays(spark):
    before = staged_folders(spark)

    def build():
        one = session.cut_lineage(spark.range(10))
        two = session.only(lambda: session.cut_lineage(one).withColumn("x", F.col("id") * 2))
        return one.join(two, "id"), two.select("x")

    both, xs = session.only(build)
    assert len(staged_folders(spark) - before) == 2
    assert both.count() == 10 and sorted(r.x for r in xs.collect()) == list(range(0, 20, 2))
    session.drop_staged(both)
    session.drop_staged(session.dealt(xs))
    assert staged_folders(spark) == before


def test_a_failed_build_leaves_no_scope_open(spark):
    with pytest.raises(ZeroDivisionError):
        session.only(lambda: 1 // 0)
    assert session._scopes() == []


def test_solved_ratings_leave_one_table(spark):
    _, p = frames(spark, history(300))
    before = staged_folders(spark)
    solved = rt.solve_ratings(p, rt.DEVIATION, sweeps_per_cut=2)
    assert len(staged_folders(spark) - before) == 1 and solved.count() == 300


def test_fits_leave_nothing(spark):
    rows = spark.range(400).select((F.col("id") % 7).cast("double").alias("x"), (F.col("id") % 3 == 0).cast("int").alias("label"))
    before = staged_folders(spark)
    plain = fit_all(rows, {"all": F.lit(True)}, [Fit("all", ("x",))])
    kept = session.cut_lineage(rows)
    assert fit_all(kept, {"all": F.lit(True)}, [Fit("all", ("x",))])[0].coefficients == pytest.approx(plain[0].coefficients)
    assert len(staged_folders(spark) - before) == 1 and kept.count() == 400


def test_running_totals_deal_their_inputs(spark):
    """Ten sums of two columns: what is dealt are the two columns."""
    df = spark.range(100).select((F.col("id") % 5).alias("k"), F.floor(F.col("id") / 5).alias("at"), F.col("id").alias("a"), (F.col("id") % 3).alias("b"))
    sums = {f"s{i}": F.col("a") * i + F.col("b") for i in range(10)}
    out = prior_totals(df, ["k"], "at", sums=sums, combine=False)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    dealt = [line for line in plan.split("\n") if "RepartitionByExpression" in line]
    below = plan.split("\n")[plan.split("\n").index(dealt[0]) + 1]
    assert below.count("#") <= 16 and "s9" not in below
    got = {(r.k, r.at): [r[f"s{i}"] for i in range(10)] for r in out.collect()}
    assert got[(2, 3)] == [sum(a * i + a % 3 for a in (2, 7, 12)) for i in range(10)] and len(got) == 100


def test_ratings_summed_in_the_state_scan(spark):
    """The scans that sum the changes give the frozen ratings of ``rating_snapshots``."""
    _, p = frames(spark, history(60))
    solved = rt.solve_ratings(p, rt.PLAIN)
    want = {(r.match_id, r.entity): (r.overall, r.on_surface, r.surface_n) for r in rt.rating_snapshots(solved, rt.PLAIN).collect()}
    q = ft._with_changes(p, solved, rt.PLAIN)
    rows = q.select("match_id", *st.ENTITY_SURFACE, "batch_no").join(st.state_table(q, st.ENTITY, [rt.overall_measures()]), [*st.ENTITY, "batch_no"])
    rows = rows.join(st.state_table(q, st.ENTITY_SURFACE, [rt.surface_measures()]), [*st.ENTITY_SURFACE, "batch_no"])
    got = {(r.match_id, r.entity): (r.overall, r.on_surface, r.surface_n) for r in rows.collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_predictions_are_made_once(spark):
    """The metrics read staged predictions: no plan of theirs scores the rows again, and the rest goes."""
    from tallyspark.operators import learn

    rows = spark.range(900).select((F.col("id") % 11).cast("double").alias("x"), (F.col("id") % 5 < 2).cast("int").alias("label"), (F.col("id") % 3).cast("int").alias("yr"), F.lit("a").alias("other"))
    before = staged_folders(spark)
    grid = learn.parameter_grid(rows, {"a": learn.Variant(("x",)), "b": learn.Variant(("x",), 0.1)}, [2])
    walked = learn.walk_forward(rows, ["x"], [2])
    assert len(staged_folders(spark) - before) == 2
    for out in (grid, walked):
        assert "_weights" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert grid.count() == 2 and {r.fold: r.n for r in walked.collect()} == {0: 300, 2: 300}
    before = staged_folders(spark)
    assert learn.ablation(session.cut_lineage(rows), ["x"], {}, [2]).count() == 1
    assert len(staged_folders(spark) - before) == 2


def test_auc_leaves_out_what_has_no_probability(spark):
    from tallyspark.operators import metrics as mx

    rows = [("g", 0.2, 0), ("g", 0.4, 1), ("g", 0.4, 0), ("g", 0.9, 1), ("g", None, 1), ("g", None, 0), (None, 0.3, 1)]
    df = spark.createDataFrame(rows, "grp string, p double, label int").select("grp", F.col("p"), F.col("label").alias("pos"), (1 - F.col("label")).alias("neg"))
    assert [(r.grp, r.auc) for r in mx.auc(df, ["grp"]).collect()] == [("g", 0.875)]


def test_carried_sums_are_those_of_the_position(spark):
    df = spark.range(40).select((F.col("id") % 2).alias("k"), F.floor(F.col("id") / 4).alias("at"), F.col("id"))
    for combine in (True, False):
        out = prior_totals(df, ["k"], "at", sums={"n": F.lit(1)}, combine=combine, chunk=F.floor(F.col("at") / 3), carried={"own": F.col("id")})
        assert {(r.k, r.at): (r.n, r.own) for r in out.collect()} == {(k, a): (2 * a, 8 * a + 2 * k + 2) for k in (0, 1) for a in range(10)}
