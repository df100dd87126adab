"""Known small answers for metrics, plans, names, sources and splits."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import learn, metrics, opponents, pose, resolve, splits, training
from tallyspark.sources import results


def test_metrics_with_ties(spark):
    df = spark.createDataFrame([(0, 0.5), (1, 0.5), (0, 0.1), (1, 0.9)], "label int, p double")
    r = metrics.bundle(df, [], "p").first()
    assert (r["accuracy"], r["auc"]) == (0.75, 0.875) and abs(r["brier"] - 0.13) < 1e-9


@pytest.mark.parametrize("days,weeks,sessions", [(4, 0, 1), (4, 1, 4), (4, 2, 8), (4, 4, 16), (4, 8, 32), (5, 6, 30), (3, 8, 24)])
def test_plan_counts(spark, days, weeks, sessions):
    df = spark.createDataFrame([(1, "Serve", "Beginner", days, 60, weeks, None)], "request_id int, goal string, level string, days int, duration int, weeks int, tags array<string>")
    plan = training.expand_plan(df)
    assert plan.count() == 6 * sessions
    per = plan.groupBy("week", "day").agg(F.sum("minutes").alias("m")).select("m").distinct().collect()
    assert [r["m"] for r in per] == [60]


def brute_resolve(q, names):
    key = lambda s: "".join(c for c in s.lower() if "a" <= c <= "z")

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    k = key(q)
    if len(k) < 2:
        return None
    words = [w.strip(" ,.") for w in q.split() if w.strip(" ,.")]
    forms = [f"{words[-1]} {words[0][0]}.", f"{words[-1]}, {words[0][0]}."] if len(words) > 1 else []
    for test in (lambda n: key(n) == k, lambda n: key(n) in [key(f) for f in forms], lambda n: key(n).startswith(k) or k.startswith(key(n)), lambda n: k in key(n)):
        hit = [n for n in names if test(n)]
        if hit:
            return hit[0]
    near = sorted((edits(k, key(n)), i) for i, n in enumerate(names) if edits(k, key(n)) <= 2)
    return names[near[0][1]] if near else None


def test_names_resolve_like_brute_force(spark):
    rng = random.Random(4)
    names = sorted({"".join(rng.choice("abcde") for _ in range(rng.randrange(3, 7))) + " " + "".join(rng.choice("abc") for _ in range(3)) for _ in range(40)} | {"Smith J.", "Ng A."})
    queries = set(names[:5]) | {"John Smith", "Al Ng", "x"}
    for n in names:
        i = rng.randrange(len(n))
        queries |= {n[:i] + n[i + 1 :], n[:3], n[2:], n[:i] + "z" + n[i:], n + "qq", n[::-1]}
    directory = spark.createDataFrame([(n, float(i + 1)) for i, n in enumerate(names)], "name string, ranking double")
    got = {r["query"]: r["name"] for r in resolve.resolve_names(spark.createDataFrame([(q,) for q in queries], "query string"), directory).collect()}
    assert got == {q: brute_resolve(q, names) for q in queries}


def test_two_layouts_bom_and_bad_rows(spark, tmp_path):
    (tmp_path / "atp_matches_2024.csv").write_text(
        "﻿tourney_date,tourney_name,surface,winner_name,loser_name,best_of,winner_rank,loser_rank,w_ace,w_svpt,tourney_level\n"
        "20240102,Open,Hard,Player_A, Player  B ,,10,x,5,60,G\n20240102,Open,Hard,,Player B,3,1,2,3,4,G\nsoon,Open,Hard,A1,B1,3,1,2,3,4,G\n",
        encoding="utf-8",
    )
    (tmp_path / "wta").mkdir()
    (tmp_path / "wta" / "results.csv").write_text(
        "Tournament,Date,Court,Surface,Round,Best of,Player_1,Player_2,Winner,Rank_1,Rank_2,Pts_1,Pts_2,Odd_1,Odd_2,Score\n"
        "Cup,2024-03-04,Indoor,Greenset,F,3,Ann X,Bea Y,Bea Y,7,9,700,900,1.5,2.5,6-4 6-4\n"
    )
    rows = {r["winner"]: r for r in results.read_results(spark, str(tmp_path)).collect()}
    assert set(rows) == {"Player A", "Bea Y"}
    a, b = rows["Player A"], rows["Bea Y"]
    assert (a["pool"], a["loser"], a["best_of"], a["winner_rank"], a["loser_rank"], a["w_svpt"]) == ("atp", "Player B", 5, 10.0, None, 60.0)
    assert (b["pool"], b["loser"], b["winner_rank"], b["loser_rank"], b["winner_rank_points"], b["surface"]) == ("wta", "Ann X", 9.0, 7.0, 900.0, "hard")
    only = results.read_raw(spark, str(tmp_path), results.YEARLY_NAME).select("_path").distinct().count()
    assert only == 1
    report = {r["file"]: (r["rows"], r["missing"]) for r in results.column_report(spark, str(tmp_path)).collect()}
    assert report == {"atp_matches_2024.csv": (3, ""), "results.csv": (1, "")}


def test_fixed_years_split(spark):
    df = spark.createDataFrame([(y, i) for i, y in enumerate((2022, 2023, 2024, 2025, 2025))], "year int, match_id int")
    roles = splits.split_roles(df.withColumn("batch_no", F.col("match_id")), "year").groupBy("role").count().collect()
    assert {r["role"]: r["count"] for r in roles} == {"train": 2, "calibration": 1, "test": 2}


def test_common_opponent_is_time_safe(spark):
    day = lambda n: dt.date(2024, 1, n)
    games = [(1, day(1), "A", "X"), (2, day(2), "X", "B"), (3, day(3), "A", "B")]
    m = spark.createDataFrame([(i, "p", d, i, "hard", w, l) for i, d, w, l in games], "match_id long, pool string, match_date date, batch_no long, surface string, p1 string, p2 string")
    edges = [(i, "p", d, i, "hard", e, o, r, 0.1 * r, None) for i, d, w, l in games for e, o, r in ((w, l, 0.5), (l, w, -0.5))]
    e = spark.createDataFrame(edges, "match_id long, pool string, match_date date, batch_no long, surface string, entity string, opponent string, residual double, serve_residual double, return_residual double")
    got = opponents.common_opponents(m, e).collect()
    assert [r["match_id"] for r in got] == [3] and got[0]["shared"] == 1
    assert got[0]["common_result"] > 0 and got[0]["common_return"] == 0


def test_degenerate_angle_is_zero(spark):
    pt = lambda x, y: F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"))
    r = spark.range(1).select(
        pose.joint_angle(pt(0.0, 0.0), pt(0.0, 0.0), pt(1.0, 0.0)).alias("z"),
        pose.joint_angle(pt(1.0, 0.0), pt(0.0, 0.0), pt(0.0, 1.0)).alias("right"),
        pose.tilt(pt(0.0, 0.0), pt(0.0, 1.0)).alias("up"),
    ).first()
    assert (r["z"], round(r["right"], 6), r["up"]) == (0.0, 90.0, 90.0)


def test_paired_predictions_reject_repeated_keys(spark):
    one = spark.createDataFrame([(1, 0.5), (1, 0.6)], "k int, probability double")
    two = spark.createDataFrame([(1, 0.4)], "k int, probability double")
    with pytest.raises(Exception, match="not unique"):
        learn.paired_predictions(one, two, ["k"]).collect()


def test_calibration_recovers_slope(spark):
    rng = random.Random(2)
    rows = []
    for _ in range(4000):
        z = rng.uniform(-3, 3)
        rows.append((z, int(rng.random() < 1 / (1 + 2.718281828 ** -(0.6 * z + 0.3)))))
    cal = learn.fit_calibration(spark.createDataFrame(rows, "z double, label int"), F.col("z"))
    assert abs(cal.slope - 0.6) < 0.08 and abs(cal.intercept - 0.3) < 0.12


def test_fingerprints_know_files_by_path(spark, tmp_path):
    from tallyspark.sources.results import fingerprints

    for folder, text in (("a", "x"), ("b", "yy")):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "m.csv").write_text(text)
    first = fingerprints(spark, str(tmp_path)).first()
    (tmp_path / "b" / "m.csv").write_text("zz")
    second = fingerprints(spark, str(tmp_path)).first()
    assert first["files"] == second["files"] == 2
    assert first["snapshot"] == second["snapshot"] and first["content"] != second["content"]


def test_row_fingerprint_total_does_not_overflow(spark):
    from tallyspark.sources.results import row_fingerprint

    row = row_fingerprint(spark.range(100)).first()
    assert int(row["total"]) > 2**63 and row["rows"] == 100


def test_ingest_keeps_far_back_results(spark, tmp_path):
    from tallyspark.streaming.ingest import ingest, ingested

    rows = [(1, "2024-06-01"), (2, "2024-07-01"), (3, "2020-01-01"), (1, "2024-06-01")]
    for i, row in enumerate(rows):
        spark.createDataFrame([row], "match_id long, match_date string").coalesce(1).write.parquet(str(tmp_path / "in" / f"f{i}"))
    schema = spark.read.parquet(str(tmp_path / "in" / "f0")).schema
    ingest(spark, str(tmp_path / "in" / "*"), schema, str(tmp_path / "all"), str(tmp_path / "check"), files_per_batch=1)
    assert sorted(r.match_id for r in ingested(spark, str(tmp_path / "all"), schema).collect()) == [1, 2, 3]


def test_state_of_one_day_in_two_files(spark, tmp_path):
    import datetime as dt

    from tallyspark.streaming.incremental import current_snapshots, maintain_state
    from tallyspark.streaming.ingest import result_stream

    schema = "match_id long, pool string, entity long, match_date date, venue string, won int, svpt long"
    day = dt.date(2024, 1, 2)
    late = dt.date(2023, 1, 1)
    files = [[(1, "n", 7, day, "A", 1, 5)], [(2, "n", 7, day, "B", 0, 6), (3, "s", 9, late, "A", 1, 1)], [(4, "n", 7, late, "A", 1, 9), (1, "n", 7, day, "A", 1, 5)]]
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"f{i}"))
    stream = result_stream(spark, str(tmp_path / "in" / "*"), spark.createDataFrame([], schema).schema, 1)
    maintain_state(stream, str(tmp_path / "state"), str(tmp_path / "check"))
    got = {(r.match_id, r.entity): (r.n, r.wins, r.svpt) for r in current_snapshots(spark, str(tmp_path / "state")).collect()}
    assert got == {(4, 7): (0, 0, 0.0), (1, 7): (1, 1, 9.0), (2, 7): (2, 2, 14.0), (3, 9): (0, 0, 0.0)}
