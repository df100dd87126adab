"""Ratings after any cut of the results into batches equal the match-by-match fold over all of them."""

import datetime as dt
import random

from test_ratings import SURFACES, history, sequential

from tallyspark.operators import ratings as rt
from tallyspark.streaming.ratings import RESULT, RatingFolder, current_matches, current_ratings


def results(n, seed, months=6):
    out = []
    for i, r in enumerate(history(n, seed=seed)):
        day = dt.date(2024, 1, 1) + dt.timedelta(days=i * 30 * months // n)
        out.append((r[0], r[1], day, *r[3:]))
    return out


def taken_in(spark, root, batches, spec, log=None):
    folder = RatingFolder(spark, root, spec, log=log)
    for epoch, rows in enumerate(batches):
        folder(spark.createDataFrame([r[:9] for r in rows], RESULT), epoch)
    return len(batches)


def check(spark, root, epochs, rows, spec):
    want, state = sequential(rows, spec)
    got = {r.match_id: r for r in current_matches(spark, root, epochs).collect()}
    assert got.keys() == want.keys()
    for i, (delta, winner, loser) in want.items():
        assert abs(got[i].delta - delta) < 1e-7 and abs(got[i].overall_w - winner) < 1e-6 and abs(got[i].overall_l - loser) < 1e-6
    rated = {r.entity: r for r in current_ratings(spark, root, epochs).collect()}
    assert rated.keys() == state.keys()
    for e, s in state.items():
        assert (rated[e].matches, rated[e].last_date) == (s["n"], s["last"]) and abs(rated[e].overall - s["o"]) < 1e-6
        assert all(abs(rated[e][x] - s[x]) < 1e-6 and rated[e][f"n_{x}"] == s[f"n{x}"] for x in SURFACES)


def test_any_cut_gives_the_batch_result(spark, tmp_path):
    spec = rt.DEVIATION
    rows = results(160, 5)
    rng = random.Random(7)
    order = rows[:]
    rng.shuffle(order)
    batches = [order[:70], order[60:110], order[110:]]  # ten results come twice
    check(spark, str(tmp_path), taken_in(spark, str(tmp_path), batches, spec), rows, spec)


def test_a_late_result_leaves_earlier_periods_alone(spark, tmp_path):
    rows = results(180, 9)
    late = [r for r in rows if r[2].month == 5][:2]
    repeated = [r for r in rows if r[2].month == 1][:5]
    log = []
    first = [r for r in rows if r not in late]
    epochs = taken_in(spark, str(tmp_path), [first, late + repeated, repeated], rt.DEVIATION, log)
    check(spark, str(tmp_path), epochs, rows, rt.DEVIATION)
    since_may = sum(r[2].month >= 5 for r in rows)
    assert log == [(178, 178), (2, since_may), (0, 0)] and since_may < 70


def test_a_repeated_epoch_and_two_versions(spark, tmp_path):
    rows = results(60, 2, months=2)
    root = str(tmp_path)
    folder = RatingFolder(spark, root)
    frame = lambda rs: spark.createDataFrame([r[:9] for r in rs], RESULT)
    other = (*rows[3][:8], rows[3][8] + 50)
    folder(frame([*rows[:40], other]), 0)
    folder(frame(rows[40:]), 1)
    folder(frame(rows[40:]), 1)
    folder(frame([]), 2)
    check(spark, root, 3, rows, rt.DEVIATION)
