"""Queries over files, artifacts, contracts, requests and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.operators import quality
from tallyspark.operators.state import ENTITY
from tallyspark.plans.history import PRIOR
from tallyspark.plans.rating import SOLVED_COLS
from tallyspark.plans.registry import query, r6, view
from tallyspark.plans.rows import rnd
from tallyspark.session import scratch_path
from tallyspark.sources import artifacts, contracts, results
from tallyspark.sources.fixtures import matches, parts, scored, table
from tallyspark.streaming.incremental import current_snapshots, maintain_state
from tallyspark.streaming.ingest import ingest, ingested, result_stream
from tallyspark.streaming.ratings import RESULT, current_matches, maintain_ratings


def write_two_layouts(spark, d) -> str:
    """The fixture's matches as CSV: winner/loser files for one pool, two-player files for the other."""
    path = scratch_path(spark, "csv")
    p = parts(spark, d)
    side = lambda w: p.where(f"won = {w}").select("match_id", F.col("ranking").alias(f"r{w}"), F.col("svpt").alias(f"s{w}"))
    m = matches(spark, d).join(side(1), "match_id").join(side(0), "match_id")
    name = lambda c: F.concat(F.lit(" Player_"), F.col(c).cast("string"), F.lit("  X "))
    surface = F.initcap("surface")
    one = m.where("pool = 'north'").select(
        F.date_format("match_date", "yyyyMMdd").alias("tourney_date"),
        F.concat(F.col("venue"), F.lit(', "the" cup')).alias("tourney_name"),
        surface.alias("surface"),
        F.col("match_id").cast("string").alias("tourney_id"),
        name("winner").alias("winner_name"),
        F.when(F.col("match_id") % 10 == 0, "").otherwise(name("loser")).alias("loser_name"),
        F.col("best_of").cast("string").alias("best_of"),
        F.col("r1").cast("string").alias("winner_rank"),
        F.col("r0").cast("string").alias("loser_rank"),
        F.when(F.col("match_id") % 4 == 0, "bad").otherwise(F.col("s1").cast("string")).alias("w_svpt"),
        F.col("score").alias("score"),
    )
    swap = F.col("match_id") % 3 == 0
    pick = lambda a, b: F.when(swap, b).otherwise(a)
    two = m.where("pool = 'south'").select(
        F.concat(F.col("venue"), F.lit(', "the" cup')).alias("Tournament"),
        F.when(F.col("match_id") % 15 == 0, "soon").otherwise(F.date_format("match_date", "yyyy-MM-dd")).alias("Date"),
        surface.alias("Surface"),
        F.col("best_of").cast("string").alias("Best of"),
        pick(name("winner"), name("loser")).alias("Player_1"),
        pick(name("loser"), name("winner")).alias("Player_2"),
        name("winner").alias("Winner"),
        pick(F.col("r1"), F.col("r0")).cast("string").alias("Rank_1"),
        pick(F.col("r0"), F.col("r1")).cast("string").alias("Rank_2"),
        F.col("score").alias("Score"),
    )
    for df, sub in ((one, "atp"), (two, "wta")):
        df.write.option("header", True).option("escape", '"').csv(f"{path}/{sub}")
    return path


view(
    "ranks",
    """SELECT match_id, max(CASE WHEN won = 1 THEN ranking END) AS wr, max(CASE WHEN won = 0 THEN ranking END) AS lr,
       max(CASE WHEN won = 1 THEN svpt END) AS ws FROM parts GROUP BY match_id""",
)
_READ = """SELECT CASE pool WHEN 'north' THEN 'atp' ELSE 'wta' END AS pool, CAST(match_date AS VARCHAR) AS day, venue || ', "the" cup' AS venue,
  CASE surface WHEN 'carpet' THEN 'hard' ELSE surface END AS surface, best_of, 'Player ' || winner || ' X' AS winner, 'Player ' || loser || ' X' AS loser,
  wr AS winner_rank, lr AS loser_rank, CASE WHEN pool = 'north' AND match_id % 4 <> 0 THEN CAST(ws AS DOUBLE) END AS w_svpt, score
  FROM matches JOIN ranks USING (match_id) WHERE {}"""


def _read_cols(df):
    cols = ["pool", F.col("match_date").cast("string").alias("day"), "venue", "surface", "best_of", "winner", "loser"]
    return df.select(*cols, "winner_rank", "loser_rank", "w_svpt", "score")


@query("s1_read_results", _READ.format("(pool = 'north' AND match_id % 10 <> 0) OR (pool = 'south' AND match_id % 15 <> 0)"))
def _(spark, d):
    return _read_cols(results.read_results(spark, write_two_layouts(spark, d)))


@query("s2_pool_from_file", "SELECT CASE pool WHEN 'north' THEN 'atp' ELSE 'wta' END AS pool, CAST(count(*) AS BIGINT) AS n FROM matches GROUP BY ALL")
def _(spark, d):
    raw = results.read_raw(spark, write_two_layouts(spark, d))
    return raw.groupBy(results.pool_of_file(F.col("_path")).alias("pool")).agg(F.count(F.lit(1)).alias("n"))


@query("s3_file_name_filter", "SELECT CASE pool WHEN 'north' THEN 'atp' ELSE 'wta' END AS pool, CAST(count(*) AS BIGINT) AS n FROM matches GROUP BY ALL")
def _(spark, d):
    raw = results.read_raw(spark, write_two_layouts(spark, d), r"(?i)^part-.*\.csv$")
    return raw.groupBy(results.pool_of_file(F.col("_path")).alias("pool")).agg(F.count(F.lit(1)).alias("n"))


@query("s4_two_player_layout", _READ.format("pool = 'south' AND match_id % 15 <> 0"))
def _(spark, d):
    return _read_cols(results.read_results(spark, f"{write_two_layouts(spark, d)}/wta"))


@query("s10_source_manifest", "SELECT 'events.parquet' AS name, 'exists' AS status UNION ALL SELECT 'lineitem.parquet', 'exists' UNION ALL SELECT 'orders.parquet', 'exists' UNION ALL SELECT 'absent.parquet', 'missing'")
def _(spark, d):
    expected = [f"{n}.parquet" for n in ("events", "lineitem", "orders", "absent")]
    return results.source_manifest(spark, d, expected).select("name", "status")


@query("q1_column_report", "SELECT '' AS missing, CAST(count(*) AS BIGINT) AS rows FROM matches")
def _(spark, d):
    r = results.column_report(spark, write_two_layouts(spark, d))
    return r.groupBy("missing").agg(F.sum("rows").alias("rows"))


@query("q6_fingerprints")
def _(spark, d):
    return results.fingerprints(spark, d, "*.parquet")


_ROW_DIGEST = "CAST('0x' || md5(concat_ws('|', coalesce(CAST({} AS VARCHAR), '~'), coalesce({}, '~'), CAST(epoch_us({}) AS VARCHAR)))[1:15] AS BIGINT)"


@query("q6_row_fingerprint", f"""SELECT CAST(count(*) AS BIGINT) AS rows, bit_xor(h) AS xor, CAST(sum(CAST(h AS HUGEINT)) AS VARCHAR) AS total
    FROM (SELECT {_ROW_DIGEST.format('event_id', 'event_type', 'ts')} AS h FROM events)""")
def _(spark, d):
    return results.row_fingerprint(table(spark, d, "events").select("event_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp"))))


@query(
    "q6_canonical_json",
    r"""SELECT p_partkey, sha256('{"a":{"x":true,"y":[' || p_size || ',"\u00e9",null,{"n":"' || p_size || '"}]},"b":"' || p_brand || '\"\\","key":' || p_partkey
        || CASE p_partkey % 3 WHEN 0 THEN ',"z":1.5}' WHEN 1 THEN ',"z":"1.5"}' ELSE '}' END) AS sha256 FROM part""",
)
def _(spark, d):
    z = F.when(F.col("p_partkey") % 3 == 0, '"z": 1.50, ').when(F.col("p_partkey") % 3 == 1, '"z":"1.5",').otherwise("")
    inner = F.concat(F.lit('{"y": ['), "p_size", F.lit(', "é" , null, {"n": "'), "p_size", F.lit('"}], "x":true}'))
    text = F.concat(F.lit("{ "), z, F.lit('"key": '), "p_partkey", F.lit(', "b":"'), "p_brand", F.lit(r'\"\\", "a": '), inner, F.lit(" }"))
    return results.canonical_json_hash(table(spark, d, "part").select("p_partkey", text.alias("v")), "p_partkey", "v")


# ---- artifacts -------------------------------------------------------------------------


def artifact_frames(spark, d):
    """One artifact per pool: coefficients from the scored rows, players from the participations."""
    names = ["p", "l_tax"]
    fit = scored(spark, d).groupBy("grp").agg(*[F.avg(n).alias(f"m_{n}") for n in names], *[F.stddev_pop(n).alias(f"s_{n}") for n in names], F.count(F.lit(1)).alias("n"))
    tour = F.when(F.col("grp") == "F", "atp").otherwise("wta")
    arr = lambda k: F.array(*[F.col(f"{k}_{n}") for n in names])
    heads = fit.select(
        F.concat(F.lit("v-"), F.col("grp")).alias("model_version"),
        F.lit("2025-01-01T00:00:00").alias("generated_at"),
        tour.alias("tour"),
        F.lit("2023-12-31").alias("training_cutoff"),
        F.lit("round-batches").alias("temporal_policy_version"),
        F.col("n").alias("matches_processed"),
        F.when(F.col("grp") == "F", "unverified").alias("evaluation_status"),
        F.create_map(F.lit("accuracy"), F.col("m_p")).alias("metrics"),
        F.struct(
            F.lit("logistic").alias("type"),
            F.array(*[F.lit(n) for n in names]).alias("feature_names"),
            arr("m").alias("coefficients"),
            F.lit(0.25).alias("intercept"),
            arr("m").alias("center"),
            arr("s").alias("scale"),
            F.struct(F.lit("platt").alias("method"), F.lit(0.9).alias("slope"), F.lit(0.0).alias("intercept")).alias("calibration"),
        ).alias("model"),
    )
    pool = F.when(F.col("pool") == "north", "v-F").otherwise("v-O")
    players = parts(spark, d).groupBy("pool", "entity").agg(F.count(F.lit(1)).alias("matches")).select(
        pool.alias("model_version"),
        "pool",
        F.concat_ws("::", F.when(F.col("pool") == "north", "atp").otherwise("wta"), F.col("entity").cast("string")).alias("key"),
        F.when((F.col("pool") == "south") & (F.col("entity") % 50 == 0), "atp").when(F.col("pool") == "north", "atp").otherwise("wta").alias("tour"),
        "matches",
    )
    return heads, players


@query(
    "s7_write_artifact",
    f"""WITH f AS (SELECT grp, avg(p) AS mp, avg(l_tax) AS mt, stddev_pop(p) AS sp, stddev_pop(l_tax) AS st FROM scored GROUP BY grp)
        SELECT 'v-' || grp AS model_version, 0 AS position, 'p' AS feature, {r6('mp')} AS coefficient, {r6('sp')} AS scale FROM f
        UNION ALL SELECT 'v-' || grp, 1, 'l_tax', {r6('mt')}, {r6('st')} FROM f""",
)
def _(spark, d):
    heads, _ = artifact_frames(spark, d)
    path = scratch_path(spark, "artifact")
    artifacts.write_artifact_heads(heads, path)
    c = artifacts.coefficient_table(artifacts.read_artifact_heads(spark, path))
    return c.select("model_version", "position", "feature", rnd("coefficient").alias("coefficient"), rnd("scale").alias("scale"))


@query(
    "s8_read_artifact",
    """SELECT CASE pool WHEN 'north' THEN 'v-F' ELSE 'v-O' END AS model_version, CASE pool WHEN 'north' THEN 'atp' ELSE 'wta' END || '::' || entity AS key,
       CAST(count(*) AS BIGINT) AS matches FROM sides GROUP BY ALL""",
)
def _(spark, d):
    heads, players = artifact_frames(spark, d)
    # documents of at most a few hundred players each: the player map of a pool is never one value
    part = F.pmod(F.xxhash64("key"), F.lit(64)).alias("part")
    state = F.struct(F.col("tour"), F.col("matches"))
    maps = players.groupBy("model_version", part).agg(F.map_from_entries(F.collect_list(F.struct("key", state))).alias("players"))
    path = scratch_path(spark, "artifacts")
    documents = heads.join(maps, "model_version").withColumn("document", F.concat_ws("-", "model_version", "part")).drop("part")
    documents.repartition("document").write.mode("overwrite").partitionBy("document").json(path)
    read = artifacts.read_artifacts(spark, path)
    return artifacts.player_table(read).select("model_version", "key", "matches")


@query(
    "q2_artifact_validation",
    """SELECT 'v-' || g AS model_version, 0 AS missing_metadata, 0 AS unknown_pool, 0 AS no_players, CASE g WHEN 'O' THEN 1 ELSE 0 END AS wrong_pool_players, 0 AS no_parameters,
       0 AS unequal_lengths, 0 AS repeated_names, 0 AS not_finite, 0 AS bad_calibration FROM (SELECT DISTINCT l_linestatus AS g FROM lineitem)""",
)
def _(spark, d):
    return quality.artifact_violations(*artifact_frames(spark, d))


@query(
    "a18_artifact_catalogue",
    """SELECT CASE l_linestatus WHEN 'F' THEN 'atp' ELSE 'wta' END AS tour, 'v-' || l_linestatus AS model_version, CAST(count(*) AS BIGINT) AS matches_processed,
       CAST((SELECT count(DISTINCT entity) FROM sides WHERE pool = CASE l_linestatus WHEN 'F' THEN 'north' ELSE 'south' END) AS BIGINT) AS players,
       CASE l_linestatus WHEN 'F' THEN 'unverified' END AS evaluation_status FROM lineitem GROUP BY l_linestatus""",
)
def _(spark, d):
    return quality.artifact_catalogue(*artifact_frames(spark, d))


@query(
    "a15_report_totals",
    """SELECT 'ok' AS status, CAST(count(*) AS BIGINT) AS matches, CAST((SELECT count(*) FROM (SELECT DISTINCT pool, entity FROM sides)) AS BIGINT) AS players,
       CAST(count(DISTINCT pool) AS BIGINT) AS reports FROM matches""",
)
def _(spark, d):
    path = scratch_path(spark, "reports")
    n = matches(spark, d).groupBy(F.col("pool").alias("tour")).agg(F.count(F.lit(1)).alias("matches"))
    who = parts(spark, d).groupBy(F.col("pool").alias("tour")).agg(F.count_distinct("entity").alias("players"))
    n.join(who, "tour").withColumn("status", F.lit("ok")).write.json(path)
    r = spark.read.schema("tour string, matches bigint, players bigint, status string").json(path)
    status = F.when(F.count_if(F.col("status") != "ok") == 0, "ok").otherwise("partial")
    return r.agg(status.alias("status"), F.sum("matches").alias("matches"), F.sum("players").alias("players"), F.count(F.lit(1)).alias("reports"))


@query(
    "q3_missing_features",
    """SELECT DISTINCT p_name AS feature FROM part WHERE p_partkey % 3 = 0 EXCEPT SELECT DISTINCT p_name FROM part WHERE p_partkey % 97 = 1""",
)
def _(spark, d):
    names = table(spark, d, "part").select(F.col("p_name").alias("feature"), "p_partkey")
    need, have = names.where("p_partkey % 3 = 0"), names.where("p_partkey % 97 = 1")
    return quality.missing_features(need.select("feature").distinct(), have.select("feature").distinct())


@query(
    "q4_table_contracts",
    """WITH pl AS (SELECT DISTINCT pool AS tour, entity AS id FROM sides WHERE entity % 20 <> 3), m AS (SELECT match_id // 2 AS id, CASE WHEN match_id % 9 = 0 THEN 'mixed' ELSE 'atp' END AS tour,
         CASE WHEN match_id % 8 = 0 THEN 1 ELSE best_of END AS best_of, winner AS winner_id, loser AS loser_id FROM matches)
       SELECT 'matches' AS table_name, 'types' AS rule, CAST(1 AS BIGINT) AS violations UNION ALL
       SELECT 'matches' AS table_name, 'enum:tour' AS rule, CAST(count(*) FILTER (tour NOT IN ('atp', 'wta')) AS BIGINT) AS violations FROM m UNION ALL
       SELECT 'matches', 'enum:best_of', count(*) FILTER (best_of NOT IN (3, 5)) FROM m UNION ALL
       SELECT 'matches', 'unique:id', count(*) FROM (SELECT id FROM m GROUP BY id HAVING count(*) > 1) UNION ALL
       SELECT 'matches', 'reference:winner_id', count(*) FROM m WHERE winner_id NOT IN (SELECT id FROM pl) UNION ALL
       SELECT 'matches', 'reference:loser_id', count(*) FROM m WHERE loser_id NOT IN (SELECT id FROM pl)""",
)
def _(spark, d):
    from tallyspark.sources.fixtures import div

    k = F.col("match_id")
    players = parts(spark, d).where("entity % 20 <> 3").select(F.col("entity").alias("id")).distinct()
    m = matches(spark, d).select(
        div(k, 2).alias("id"),
        F.when(k % 9 == 0, "mixed").otherwise("atp").alias("tour"),
        F.when(k % 8 == 0, 1).otherwise(F.col("best_of")).alias("best_of"),
        F.col("winner").alias("winner_id"),
        F.col("loser").alias("loser_id"),
    )
    return contracts.check_table("matches", {"matches": m, "players": players})


@query(
    "q4_event_contracts",
    """WITH pl AS (SELECT DISTINCT user_id AS id FROM events WHERE user_id % 11 <> 5), m AS (SELECT DISTINCT event_id // 20 AS id FROM events WHERE event_id % 20 = 3),
       pe AS (SELECT event_id AS id, event_id // 20 AS match_id, CASE WHEN event_id % 97 = 0 THEN 1 ELSE event_id % 20 + 1 END AS pn, user_id AS server_id, user_id + 1 AS winner_id,
         CASE WHEN event_id % 41 = 0 THEN 1 ELSE (event_id % 20) // 10 + 1 END AS sn, event_id % 10 // 5 AS gn, event_id % 3 AS serve, CASE event_type WHEN 'view' THEN 'lob' ELSE 't' END AS dir FROM events),
       mv AS (SELECT DISTINCT user_id % 7 AS id FROM events WHERE user_id % 7 <> 2),
       pr AS (SELECT event_id // 2 AS id, user_id % 7 AS v, event_id // 20 AS match_id, user_id AS p1, user_id + 3 AS p2 FROM events)
       SELECT 'point_events' AS table_name, 'types' AS rule, CAST(0 AS BIGINT) AS violations UNION ALL
       SELECT 'point_events', 'enum:serve_number', count(*) FILTER (serve NOT IN (1, 2)) FROM pe UNION ALL
       SELECT 'point_events', 'enum:serve_direction', count(*) FILTER (dir = 'lob') FROM pe UNION ALL
       SELECT 'point_events', 'unique:id', count(*) FROM (SELECT id FROM pe GROUP BY id HAVING count(*) > 1) UNION ALL
       SELECT 'point_events', 'unique:match_id,point_number', count(*) FROM (SELECT match_id, pn FROM pe GROUP BY ALL HAVING count(*) > 1) UNION ALL
       SELECT 'point_events', 'reference:match_id', count(*) FROM pe WHERE match_id NOT IN (SELECT id FROM m) UNION ALL
       SELECT 'point_events', 'reference:server_id', count(*) FROM pe WHERE server_id NOT IN (SELECT id FROM pl) UNION ALL
       SELECT 'point_events', 'reference:winner_id', count(*) FROM pe WHERE winner_id NOT IN (SELECT id FROM pl) UNION ALL
       SELECT 'point_events', 'order:point_number', count(*) FROM (SELECT sn * 10 + gn AS cur, lag(sn * 10 + gn) OVER (PARTITION BY match_id ORDER BY pn, id) AS was FROM pe) WHERE cur < was UNION ALL
       SELECT 'model_predictions', 'types', 2 UNION ALL
       SELECT 'model_predictions', 'unique:id', count(*) FROM (SELECT id FROM pr GROUP BY id HAVING count(*) > 1) UNION ALL
       SELECT 'model_predictions', 'reference:model_version_id', count(*) FROM pr WHERE v NOT IN (SELECT id FROM mv) UNION ALL
       SELECT 'model_predictions', 'reference:match_id', count(*) FROM pr WHERE match_id NOT IN (SELECT id FROM m) UNION ALL
       SELECT 'model_predictions', 'reference:player1_id', count(*) FROM pr WHERE p1 NOT IN (SELECT id FROM pl) UNION ALL
       SELECT 'model_predictions', 'reference:player2_id', count(*) FROM pr WHERE p2 NOT IN (SELECT id FROM pl)""",
)
def _(spark, d):
    from tallyspark.sources.fixtures import div

    e, k, u = table(spark, d, "events"), F.col("event_id"), F.col("user_id")
    short = lambda c: c.cast("smallint")
    players = e.where("user_id % 11 <> 5").select(u.cast("bigint").alias("id")).distinct()
    played = e.where("event_id % 20 = 3").select(div(k, 20).cast("bigint").alias("id")).distinct()
    versions = e.where("user_id % 7 <> 2").select((u % 7).cast("bigint").alias("id")).distinct()
    # the id breaks ties of a repeated point number, as in the SQL
    points = e.select(
        k.alias("id"), div(k, 20).cast("bigint").alias("match_id"), F.when(k % 97 == 0, 1).otherwise(k % 20 + 1).cast("int").alias("point_number"),
        u.cast("bigint").alias("server_id"), (u + 1).cast("bigint").alias("winner_id"),
        short(F.when(k % 41 == 0, 1).otherwise(div(k % 20, 10) + 1)).alias("set_number"), short(div(k % 10, 5)).alias("game_number"),
        short(k % 3).alias("serve_number"), F.when(F.col("event_type") == "view", "lob").otherwise("t").alias("serve_direction"),
    )
    predictions = e.select(
        div(k, 2).cast("int").alias("id"), (u % 7).cast("int").alias("model_version_id"), div(k, 20).cast("bigint").alias("match_id"),
        u.cast("bigint").alias("player1_id"), (u + 3).cast("bigint").alias("player2_id"),
    )
    frames = {"point_events": points, "players": players, "matches": played, "model_versions": versions, "model_predictions": predictions}
    return contracts.check_table("point_events", frames).unionByName(contracts.check_table("model_predictions", frames))


@query(
    "q5_request_validation",
    """WITH r AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 9 = 0 THEN 'itf' ELSE 'atp' END AS pool, CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 3 WHEN 2 THEN 5 ELSE 4 END AS best_of,
         CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'hard' WHEN 2 THEN 'clay' WHEN 3 THEN 'ice' ELSE 'grass' END AS surface,
         CASE WHEN c_custkey % 13 = 0 THEN 'x' ELSE lower(c_name) END AS p1, CASE WHEN c_custkey % 11 = 0 THEN (CASE WHEN c_custkey % 13 = 0 THEN 'x' ELSE lower(c_name) END) ELSE 'other one' END AS p2 FROM customer)
       SELECT id, concat_ws(',', CASE WHEN pool = 'itf' THEN 'pool' END, CASE WHEN best_of = 4 THEN 'best_of' END, CASE WHEN surface = 'ice' THEN 'surface' END,
         CASE WHEN p1 = 'x' OR p2 = 'x' THEN 'name_length' END, CASE WHEN p1 = p2 THEN 'same_player' END) AS broken,
         CASE WHEN pool = 'atp' AND coalesce(best_of, 3) <> 4 AND coalesce(surface, '') <> 'ice' AND p1 <> 'x' AND p2 <> 'x' AND p1 <> p2 THEN 1 ELSE 0 END AS valid FROM r""",
)
def _(spark, d):
    k = F.col("c_custkey")
    pick = lambda n, values: F.get(F.array(*[F.lit(v) for v in values]), (k % n).cast("int"))
    one = F.when(k % 13 == 0, " x ").otherwise(F.col("c_name"))
    r = table(spark, d, "customer").select(
        k.alias("id"),
        F.when(k % 9 == 0, "ITF").otherwise(" ATP").alias("pool"),
        pick(4, [None, 3, 5, 4]).alias("best_of"),
        pick(5, [None, "Hard Court", " clay", "ice", "GRASS"]).alias("surface"),
        one.alias("player1"),
        F.when(k % 11 == 0, F.upper(one)).otherwise("Other One").alias("player2"),
    )
    return quality.check_requests(r).select("id", F.array_join("broken", ",").alias("broken"), "valid")


@query(
    "q7_evidence_gate",
    f"""WITH a AS (SELECT yr, 'v' || yr AS v, avg(p) AS m FROM scored GROUP BY yr), g AS (SELECT *, CASE WHEN yr IN (1996, 1997, 1998) AND yr <> 1998 THEN 'independently_reproduced'
        WHEN yr = 1999 THEN 'unverified' ELSE 'artifact_reported' END AS evidence FROM a)
        SELECT v AS model_version, evidence, {', '.join(f"CASE WHEN evidence <> 'unverified' THEN {r6('m')} END AS {n}" for n in quality.METRIC_NAMES)} FROM g""",
)
def _(spark, d):
    y = F.col("yr")
    base = scored(spark, d).groupBy("yr").agg(rnd(F.avg("p")).alias("m"))
    v = F.concat(F.lit("v"), y.cast("string"))
    metrics = [F.col("m").alias(n) for n in quality.METRIC_NAMES]
    a = base.select(
        v.alias("model_version"),
        F.lit("abc").alias("model_sha"),
        F.lit("round").alias("policy"),
        F.when(y.isin(1996, 1997, 1998), "independently_reproduced").when(y == 1999, "unverified").otherwise("reported").alias("status_flag"),
        F.lit(False).alias("retired"),
        *metrics,
    )
    r = base.where(y < 2000).select(
        v.alias("r_model_version"),
        F.when(y == 1998, "zzz").otherwise("abc").alias("r_model_sha"),
        F.lit("round").alias("r_policy"),
        F.lit("reproduced").alias("r_status"),
        F.lit(10).alias("r_rows"),
        *[F.lit(True).alias(c) for c in ("r_regenerated", "r_parameters_match", "r_independent_formulas")],
        F.lit(None).cast("boolean").alias("r_cached_match"),
        *[F.col("m").alias(f"r_{n}") for n in quality.METRIC_NAMES],
    )
    return quality.evidence_gate(a, r)


# ---- streams ---------------------------------------------------------------------------


@query("t1_incremental_ingest", "SELECT match_id, pool, CAST(match_date AS VARCHAR) AS day, winner, loser FROM matches")
def _(spark, d):
    root = scratch_path(spark, "stream")
    m = matches(spark, d).select("match_id", "pool", "match_date", "winner", "loser")
    # the latest days come first, days overlap and one day is split over files
    for keep in (F.day("match_date") > 18, F.day("match_date") <= 12, F.day("match_date").between(8, 20)):
        m.where(keep).repartition(3).write.mode("append").parquet(f"{root}/in")
    ingest(spark, f"{root}/in", m.schema, f"{root}/out", f"{root}/check", files_per_batch=4)
    out = ingested(spark, f"{root}/out", m.schema)
    return out.select("match_id", "pool", F.col("match_date").cast("string").alias("day"), "winner", "loser")


@query(
    "t2_incremental_state",
    f"""SELECT match_id, pool, entity, CAST(count(*) OVER {PRIOR} AS BIGINT) AS n, CAST(coalesce(sum(won) OVER {PRIOR}, 0) AS BIGINT) AS wins,
        CAST(coalesce(sum(svpt) OVER {PRIOR}, 0) AS DOUBLE) AS svpt, CAST(max(match_date) OVER {PRIOR} AS VARCHAR) AS last_date FROM vparts""",
)
def _(spark, d):
    root = scratch_path(spark, "state")
    p = parts(spark, d).select("match_id", *ENTITY, "match_date", "venue", "won", "svpt")
    day = F.day("match_date")
    for keep in (day.between(11, 20), day <= 12, day > 20):
        p.where(keep).repartition(2).write.mode("append").parquet(f"{root}/in")
    maintain_state(result_stream(spark, f"{root}/in", p.schema, 2), root, f"{root}/check")
    s = current_snapshots(spark, root)
    return s.select("match_id", *ENTITY, "n", "wins", "svpt", F.col("last_date").cast("string").alias("last_date"))


@query("t2_incremental_ratings", f"SELECT match_id, {', '.join(f'{r6(s)} AS {n}' for n, s in SOLVED_COLS.items())} FROM solved_deviation")
def _(spark, d):
    root = scratch_path(spark, "ratings")
    m = matches(spark, d).selectExpr(*[f"cast({c.split()[0]} as {c.split()[1]}) as {c.split()[0]}" for c in RESULT.split(", ")])
    day = F.day("match_date")
    # the middle of every month comes first, then its end, then its beginning with some results again
    for keep in (day.between(11, 20), day > 20, day <= 12):
        m.where(keep).repartition(1).write.mode("append").parquet(f"{root}/in")
    epochs = maintain_ratings(result_stream(spark, f"{root}/in", m.schema, 1), root, f"{root}/check")
    return current_matches(spark, root, epochs).select("match_id", *[rnd(n).alias(n) for n in SOLVED_COLS])
