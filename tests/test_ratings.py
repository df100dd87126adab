import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import ratings as rt
from tallyspark.operators.batches import ROUND_BATCH, with_batch
from tallyspark.sources.fixtures import with_participations

SURFACES = ("hard", "clay", "grass", "carpet")
COLS = "match_id long, pool string, match_date date, venue string, round_order int, surface string, best_of int, winner int, loser int, w_ev int, l_ev int, score string"


def history(n, seed=3, hot=0.34):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        a = 0 if rng.random() < hot else rng.randrange(1, 9)
        b = rng.choice([x for x in range(9) if x != a])
        if rng.random() < 0.5:
            a, b = b, a
        day = dt.date(2024, 1, 1) + dt.timedelta(days=i * 40 // n)
        out.append((i, "north", day, f"V{i % 2}", rng.randrange(1, 4), rng.choice(SURFACES), rng.choice((3, 5)), a, b, 2 * i, 2 * i + 1, "6-4 6-4"))
    return out


def frames(spark, rows):
    m = with_batch(spark.createDataFrame(rows, COLS), ROUND_BATCH)
    return m, with_participations(m)


def sequential(rows, spec):
    """Plain one-by-one fold in (batch, id) order."""
    key = lambda r: (r[2], r[3], r[4])
    state, out = {}, {}
    for r in sorted(rows, key=lambda r: (key(r), r[0])):
        i, _, day, _, _, s, best, w, l = r[:9]
        sides = []
        for e in (w, l):
            sides.append(state.setdefault(e, {"o": 1500.0, "n": 0, "rd": 350.0, "last": None, **{x: 1500.0 for x in SURFACES}, **{f"n{x}": 0 for x in SURFACES}}))

        def blended(p):
            surface = p[s]
            if spec.surface_shrink:
                x = p[f"n{s}"] / (p[f"n{s}"] + spec.surface_shrink)
                surface = x * surface + (1 - x) * p["o"]
            return spec.surface_weight * surface + spec.overall_weight * p["o"] - spec.uncertainty_weight * max(28.0, 85.0 * 0.992 ** p["n"])

        exp = 1 / (1 + 10 ** ((blended(sides[1]) - blended(sides[0])) / 400))
        k = spec.k_base + spec.k_gain / (1 + min(p["n"] for p in sides) / spec.experience)
        if spec.deviation:
            idle = max(21.0 if p["last"] is None else min(90.0, float((day - p["last"]).days)) for p in sides)
            k *= (0.65 + sum(p["rd"] for p in sides) / 700) * (1 + min(idle, 180) / 600)
        k *= spec.long_match if best == 5 else 1.0
        delta = k * (1 - exp)
        out[i] = (delta, sides[0]["o"], sides[1]["o"])
        for p, sign in zip(sides, (1, -1), strict=True):
            p["o"] += sign * spec.overall_step * delta
            p[s] += sign * spec.surface_step * delta
            p["rd"] = max(35.0, min(350.0, p["rd"] * 0.965 + 350.0 / (p["n"] + 8) ** 0.5 * 0.035))
            p["n"] += 1
            p[f"n{s}"] += 1
            p["last"] = day
    return out, state


@pytest.mark.parametrize("spec", [rt.PLAIN, rt.DEVIATION], ids=["plain", "deviation"])
@pytest.mark.parametrize("chunk", [4096, 8])
def test_solver_equals_sequential_fold(spark, monkeypatch, spec, chunk):
    monkeypatch.setattr(rt, "CHUNK", chunk)
    rows = history(150)
    _, p = frames(spark, rows)
    solved = rt.solve_ratings(p, spec)
    want, state = sequential(rows, spec)
    got = {r["match_id"]: r for r in solved.collect()}
    assert set(got) == set(want)
    for i, (delta, ow, ol) in want.items():
        assert abs(got[i]["delta"] - delta) < 1e-7
        assert abs(got[i]["overall_w"] - ow) < 1e-6 and abs(got[i]["overall_l"] - ol) < 1e-6
    final = {r["entity"]: r for r in rt.final_ratings(solved, spec).collect()}
    assert abs(sum(r["overall"] for r in final.values()) - 1500 * len(final)) < 1e-6
    for e, s in state.items():
        assert abs(final[e]["overall"] - s["o"]) < 1e-6 and final[e]["matches"] == s["n"]


def test_future_rows_and_row_order_change_nothing(spark):
    rows = history(60)
    later = history(90)[60:]
    later = [(r[0], r[1], dt.date(2025, 1, 1), *r[3:]) for r in later]
    snap = lambda rs: {
        (r["match_id"], r["entity"]): round(r["blended"], 8)
        for r in rt.rating_snapshots(rt.solve_ratings(frames(spark, rs)[1], rt.DEVIATION), rt.DEVIATION).collect()
    }
    base = snap(rows)
    shuffled = rows[:]
    random.Random(1).shuffle(shuffled)
    assert snap(shuffled) == base
    more = snap(rows + later)
    assert all(more[k] == v for k, v in base.items())


def test_same_batch_matches_share_a_snapshot(spark):
    day = dt.date(2024, 1, 1)
    row = lambda i, d, rnd, w, l: (i, "north", d, "V", rnd, "hard", 3, w, l, 2 * i, 2 * i + 1, "6-4")
    rows = [row(0, day, 1, 1, 2), row(1, day, 1, 1, 3), row(2, day, 2, 1, 4)]
    solved = rt.solve_ratings(frames(spark, rows)[1], rt.PLAIN)
    got = {(r["match_id"], r["entity"]): r["overall"] for r in rt.rating_snapshots(solved, rt.PLAIN).collect()}
    assert got[0, 1] == got[1, 1] == 1500.0
    assert got[2, 1] > 1500.0


def test_winner_gains(spark):
    _, p = frames(spark, history(5))
    solved = rt.solve_ratings(p, rt.SERVICE)
    assert solved.where(F.col("delta") <= 0).count() == 0


def test_settled_matches_leave_the_sweeps(spark):
    rows = history(400, seed=11)
    _, p = frames(spark, rows)
    log = []
    solved = rt.solve_ratings(p, rt.DEVIATION, sweeps_per_cut=2, log=log)
    want, _ = sequential(rows, rt.DEVIATION)
    got = {r["match_id"]: r for r in solved.collect()}
    assert got.keys() == want.keys() and all(abs(got[i]["delta"] - d) < 1e-7 and abs(got[i]["overall_w"] - w) < 1e-6 for i, (d, w, _) in want.items())
    assert log[0] == 400 and log[-1] < 270 and log == sorted(log, reverse=True)


@pytest.mark.parametrize("chunk", [4096, 8])
def test_sweeps_pass_narrow_rows_and_gather_nothing(spark, monkeypatch, chunk):
    monkeypatch.setattr(rt, "CHUNK", chunk)
    rows = history(60, seed=5)
    edges, split = rt.fold_edges(frames(spark, rows)[1], rt.PLAIN)
    assert split == (chunk == 8)
    swept = rt._sweeps(edges, rt.PLAIN, split, 2)
    assert "collect_list" not in swept._jdf.queryExecution().toString()
    assert set(swept.columns) == {*rt.MATCH, *rt.SIDE, *rt.RATED, "k", "delta", "old"}
    got = swept.collect()
    assert len(got) == 120 and all(len({r[c] for r in got if r["match_id"] == 7}) == 1 for c in ("delta", "expected", "overall_w"))
    # two sweeps settle the first two matches of the history
    want, _ = sequential(rows, rt.PLAIN)
    for i in sorted(want, key=lambda i: (rows[i][2:5], i))[:2]:
        assert all(abs(r["delta"] - want[i][0]) < 1e-9 for r in got if r["match_id"] == i)


def test_expectation_beside_the_snapshots(spark):
    snap = rt.rating_snapshots(rt.solve_ratings(frames(spark, history(40))[1], rt.PLAIN), rt.PLAIN)
    want = {r["match_id"]: r["pre_p"] for r in rt.pre_match_expectation(snap).collect()}
    got = rt.with_expectation(snap).collect()
    assert len(got) == 80 and all(abs(r["pre_p"] - want[r["match_id"]]) < 1e-12 for r in got)


def test_wide_side_rows_are_dealt_once(spark):
    from tallyspark.operators import features as ft
    from tallyspark.operators import state as st
    from tallyspark.operators.batches import VENUE_BATCH
    from tallyspark.sources.fixtures import parts

    rows = history(40)
    m = with_batch(spark.createDataFrame(rows, COLS), VENUE_BATCH).withColumnRenamed("batch_no", "venue_no")
    m = with_batch(m, ROUND_BATCH).withColumn("p1", F.col("winner"))
    p = st.derived_counts(parts(spark, "", m))
    # ratings come solved, so that the plan below is that of the side rows alone
    state = ft.side_state(p, F.lit(0.635), solved=rt.solve_ratings(p, rt.DEVIATION))
    plan = state._sc._jvm.PythonSQLUtils.explainString(state._jdf.queryExecution(), "formatted")
    dealt = [b for b in plan.split("\n\n") if ") Exchange" in b and "latent_serve#" in b]
    assert len(dealt) == 1 and "_row" in dealt[0]
    got = state.collect()
    assert len(got) == 80 and len({(r["match_id"], r["entity"]) for r in got}) == 80 and "_row" not in state.columns
    assert all(r["residual_form_short"] == 0 for r in got if r["n_before"] == 0)


def test_latest_form_deals_twenty_results_at_most(spark):
    from tallyspark.operators import state as st
    from tallyspark.sources.fixtures import parts

    rows = history(120)
    m = with_batch(spark.createDataFrame(rows, COLS), ROUND_BATCH)
    p = st.derived_counts(parts(spark, "", m))
    state = st.latest_state(p)
    assert "WindowGroupLimit" in state._sc._jvm.PythonSQLUtils.explainString(state._jdf.queryExecution(), "formatted")
    won = {}
    for r in sorted(p.select("entity", "batch_no", "match_id", "won").collect(), key=lambda r: (r.batch_no, r.match_id)):
        won.setdefault(r.entity, []).append(r.won)
    got = {r.entity: r for r in state.collect()}
    assert got.keys() == won.keys() and max(map(len, won.values())) > 20
    for e, results in won.items():
        assert all(abs(got[e][f"form_{n}"] - sum(results[-n:]) / len(results[-n:])) < 1e-12 for n in (5, 10, 20))
