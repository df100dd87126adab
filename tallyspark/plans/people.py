"""Queries that find, list and export entities."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.functions.text import entity_key
from tallyspark.operators import ratings as rt
from tallyspark.operators import resolve
from tallyspark.operators import state as st
from tallyspark.plans.feature import basic_rows  # noqa: F401
from tallyspark.plans.history import venue_parts
from tallyspark.plans.registry import query, r6, view
from tallyspark.plans.rows import rnd
from tallyspark.sources.fixtures import parts, table

view(
    "directory",
    """SELECT p_name AS name, p_brand AS pool, lower(p_brand) || '::' || lower(p_name) AS key,
       CASE WHEN min(p_partkey) % 5 = 0 THEN NULL ELSE CAST(min(p_size) AS DOUBLE) END AS ranking,
       CAST(count(*) AS BIGINT) AS matches FROM part GROUP BY p_name, p_brand""",
)


def directory(spark, d):
    k = F.min("p_partkey")
    return (
        table(spark, d, "part")
        .groupBy(F.col("p_name").alias("name"), F.col("p_brand").alias("pool"))
        .agg(F.when(k % 5 != 0, F.min("p_size")).cast("double").alias("ranking"), F.count(F.lit(1)).alias("matches"))
        .withColumn("key", entity_key(F.col("name"), F.col("pool")))
    )


view(
    "asked",
    """SELECT DISTINCT CASE p_partkey % 9 WHEN 0 THEN upper(p_name) WHEN 1 THEN substr(p_name, 1, 5)
       WHEN 2 THEN substr(p_name, 1, 2) || substr(p_name, 4) WHEN 3 THEN string_split(p_name, ' ')[2] || ' ' || string_split(p_name, ' ')[1]
       WHEN 4 THEN substr(p_name, 4) WHEN 5 THEN p_name || ' jr' WHEN 6 THEN 'x' || substr(p_name, 2) || 'q'
       WHEN 7 THEN substr(p_name, 1, 1) ELSE 'zzzz ' || CAST(p_partkey % 3 AS VARCHAR) END AS query FROM part""",
)


def asked(spark, d):
    n, k = F.col("p_name"), F.col("p_partkey") % 9
    words = F.split(n, " ")
    q = (
        F.when(k == 0, F.upper(n))
        .when(k == 1, F.substring(n, 1, 5))
        .when(k == 2, F.concat(F.substring(n, 1, 2), F.substr(n, F.lit(4))))
        .when(k == 3, F.concat(F.get(words, 1), F.lit(" "), F.get(words, 0)))
        .when(k == 4, F.substr(n, F.lit(4)))
        .when(k == 5, F.concat(n, F.lit(" jr")))
        .when(k == 6, F.concat(F.lit("x"), F.substr(n, F.lit(2)), F.lit("q")))
        .when(k == 7, F.substring(n, 1, 1))
        .otherwise(F.concat(F.lit("zzzz "), (F.col("p_partkey") % 3).cast("string")))
    )
    return table(spark, d, "part").select(q.alias("query")).distinct()


LETTERS = "regexp_replace(lower({}), '[^a-z]', '', 'g')"


@query(
    "j10_resolve_names",
    f"""WITH q AS (SELECT query, {LETTERS.format('query')} AS key, string_split(query, ' ') AS w FROM asked),
      f AS (SELECT *, CASE WHEN len(w) >= 2 THEN {LETTERS.format("w[-1] || w[1][1]")} END AS form FROM q),
      n AS (SELECT name, min(ranking) AS ranking, {LETTERS.format('name')} AS nk FROM directory GROUP BY name),
      c AS (SELECT query, name, coalesce(ranking, 99999) AS rk, CASE WHEN length(key) < 2 THEN 0 WHEN nk = key THEN 1 WHEN nk = form THEN 2
          WHEN starts_with(nk, key) OR starts_with(key, nk) THEN 3 WHEN contains(nk, key) THEN 4
          WHEN levenshtein(key, nk) <= 2 THEN 5 ELSE 0 END AS tier, levenshtein(key, nk) AS dist FROM f, n),
      best AS (SELECT query, name, CAST(tier AS INTEGER) AS tier, row_number() OVER (PARTITION BY query ORDER BY tier,
          CASE WHEN tier = 5 THEN dist ELSE 0 END, rk, name) AS k FROM c WHERE tier > 0)
      SELECT q.query, name, coalesce(tier, 0) AS tier FROM q LEFT JOIN (SELECT * FROM best WHERE k = 1) b ON b.query = q.query""",
)
def _(spark, d):
    return resolve.resolve_names(asked(spark, d), directory(spark, d))


@query(
    "j11_ranked_search",
    """SELECT key, name, pool, CAST(CASE WHEN lower(name) = 'red' THEN 0 WHEN starts_with(lower(name), 'red') THEN 1 ELSE 2 END AS INTEGER)
       AS score FROM directory WHERE contains(lower(name), 'red') ORDER BY score, lower(name), coalesce(nullif(ranking, 0), 99999), name, pool, key
       LIMIT 30 OFFSET 10""",
)
def _(spark, d):
    return resolve.search(directory(spark, d), "Red ", 30, 10).select("key", "name", "pool", "score")


@query(
    "k5_page",
    "SELECT key FROM directory ORDER BY key LIMIT 25 OFFSET 50",
)
def _(spark, d):
    return directory(spark, d).orderBy("key").offset(50).limit(25).select("key")


@query(
    "k4_roster_order",
    "SELECT key, ranking FROM directory ORDER BY coalesce(nullif(ranking, 0), 99999), name, key LIMIT 40",
)
def _(spark, d):
    return resolve.roster(directory(spark, d)).select("key", "ranking")


view(
    "tours",
    "SELECT p_name AS name, CASE WHEN p_partkey % 37 = 0 THEN 'south' WHEN length(p_name) % 3 = 0 THEN 'south' ELSE 'north' END AS pool FROM part",
)


@query(
    "j12_pool_check",
    """WITH t AS (SELECT DISTINCT lower(trim(name)) AS who, pool FROM tours),
      pr AS (SELECT a.p_partkey AS id, a.p_name AS n1, CASE WHEN a.p_partkey % 11 = 0 THEN 'nobody' ELSE b.p_name END AS n2,
        CASE WHEN a.p_partkey % 2 = 0 THEN 'north' ELSE 'south' END AS pool FROM part a JOIN part b ON b.p_partkey = a.p_partkey // 2)
      SELECT id, CASE WHEN lower(n1) = lower(n2) THEN 'same_name'
        WHEN (EXISTS (SELECT 1 FROM t WHERE who = lower(n1)) AND NOT EXISTS (SELECT 1 FROM t WHERE who = lower(n1) AND t.pool = pr.pool))
          OR (EXISTS (SELECT 1 FROM t WHERE who = lower(n2)) AND NOT EXISTS (SELECT 1 FROM t WHERE who = lower(n2) AND t.pool = pr.pool))
        THEN 'wrong_pool' ELSE 'ok' END AS verdict FROM pr""",
)
def _(spark, d):
    from tallyspark.sources.fixtures import div

    p = table(spark, d, "part")
    name, k = F.col("p_name"), F.col("p_partkey")
    south = (k % 37 == 0) | (F.length(name) % 3 == 0)
    listing = p.select(name.alias("name"), F.when(south, "south").otherwise("north").alias("pool"))
    other = p.select(k.alias("_half"), name.alias("_n2"))
    pairs = p.withColumn("_half", div(k, 2)).join(other, "_half").select(
        k.alias("id"),
        name.alias("name_1"),
        F.when(k % 11 == 0, "nobody").otherwise(F.col("_n2")).alias("name_2"),
        F.when(k % 2 == 0, "north").otherwise("south").alias("pool"),
    )
    return resolve.check_pairs(pairs, listing).select("id", "verdict")


# ---- latest state of every entity ------------------------------------------------------

view(
    "career",
    """SELECT pool, entity, count(*) AS matches, max(match_date) AS last_date, """
    + ", ".join(
        f"CASE WHEN sum({t}) > 0 THEN ({p} * {k} + sum({s})) / ({k} + sum({t})) ELSE {p} END AS {n}"
        for n, (s, t, p, k) in {
            "serve_point_won": ("service_won", "svpt", 0.635, 120),
            "return_point_won": ("CASE WHEN return_won >= 0 THEN return_won END", "o_svpt", 0.365, 120),
            "bp_save": ("bp_saved", "bp_faced", 0.58, 40),
            "ace_rate": ("aces", "svpt", 0.055, 120),
        }.items()
    )
    + """, arg_max(ranking, batch_no * 10000000 + match_id) FILTER (ranking <> 0) AS ranking FROM vparts GROUP BY ALL""",
)
view(
    "last_ratings",
    "SELECT pool, entity, 1500 + sum(0.42 * sg) AS overall, "
    + ", ".join(f"1500 + coalesce(sum(0.72 * sg) FILTER (surface = '{s}'), 0) AS {s}" for s in rt.SURFACES)
    + """ FROM (SELECT p.pool, p.entity, p.surface, CASE won WHEN 1 THEN delta ELSE -delta END AS sg FROM vparts p
          JOIN solved_plain USING (match_id)) GROUP BY pool, entity""",
)
view(
    "last_form",
    """SELECT pool, entity, avg(won) AS form_5 FROM (SELECT pool, entity, won, row_number() OVER (PARTITION BY pool, entity
       ORDER BY batch_no DESC, match_id DESC) AS k FROM vparts) WHERE k <= 5 GROUP BY pool, entity""",
)


def latest_states(spark, d):
    """Ratings, smoothed rates, form and counts of every entity after its last match."""
    p = venue_parts(spark, d)
    solved = rt.solve_ratings(p, rt.PLAIN)
    return st.latest_state(p).join(rt.final_ratings(solved, rt.PLAIN).drop("matches"), list(st.ENTITY))


L20_COLS = {
    "overall": "overall",
    **{s: s for s in ("hard", "clay", "grass")},
    "form_5": "form_5",
    "serve_point_won": "serve_point_won",
    "return_point_won": "return_point_won",
    "bp_save": "bp_save",
    "ace_rate": "ace_rate",
}


@query(
    "l20_latest_state",
    f"""SELECT c.pool, c.entity, CAST(c.matches AS BIGINT) AS matches, CAST(last_date AS VARCHAR) AS last_date, ranking,
        {', '.join(f'{r6(e)} AS {n}' for n, e in L20_COLS.items())} FROM career c JOIN last_ratings r ON r.pool = c.pool AND r.entity = c.entity
        JOIN last_form f ON f.pool = c.pool AND f.entity = c.entity""",
)
def _(spark, d):
    s = latest_states(spark, d)
    return s.select(
        *st.ENTITY, "matches", F.col("last_date").cast("string").alias("last_date"), "ranking", *[rnd(n).alias(n) for n in L20_COLS]
    )


def one(e):
    return f"round(({e}) + 1e-9, 1) + 0.0"


@query(
    "s9_directory_export",
    f"""SELECT c.pool || ':' || c.entity AS id, upper(c.pool) AS tour, CAST(c.matches AS BIGINT) AS matches, ranking, {one('overall')} AS overall_elo,
        {one('hard')} AS hard_elo, {one('clay')} AS clay_elo, {one('grass')} AS grass_elo, {one('100 * serve_point_won')} AS serve_point_won,
        {one('100 * return_point_won')} AS return_point_won, {one('100 * form_5')} AS form_5, CAST(row_number() OVER
        (ORDER BY c.pool, ranking IS NULL, coalesce(nullif(ranking, 0), 99999), CAST(c.entity AS VARCHAR)) AS BIGINT) AS position
        FROM career c JOIN last_ratings r ON r.pool = c.pool AND r.entity = c.entity JOIN last_form f ON f.pool = c.pool AND f.entity = c.entity""",
)
def _(spark, d):
    from tallyspark.session import scratch_path
    from tallyspark.sources.artifacts import export_directory, read_directory

    s = latest_states(spark, d).withColumn("name", F.col("entity").cast("string"))
    s = s.withColumn("key", F.concat_ws("::", "pool", "name"))
    path = scratch_path(spark, "directory")
    export_directory(s, path)
    return read_directory(spark, path).select(
        *["id", "tour", "matches", "ranking", "overall_elo", "hard_elo", "clay_elo", "grass_elo"],
        *["serve_point_won", "return_point_won", "form_5", "position"],
    )


@query(
    "s11_rating_map",
    f"""SELECT c.pool, CAST(c.entity AS VARCHAR) AS name, CAST(c.matches AS BIGINT) AS matches, {one('overall')} AS global, {one('hard')} AS hard, {one('clay')} AS clay,
        {one('grass')} AS grass, CAST(greatest(4, round(greatest(28.0, 85.0 * pow(0.992, c.matches)) / 12)) AS BIGINT) AS fatigue
        FROM career c JOIN last_ratings r ON r.pool = c.pool AND r.entity = c.entity WHERE c.matches >= 5""",
)
def _(spark, d):
    s = latest_states(spark, d).where("matches >= 5")
    tenth = lambda c: F.round(F.col(c) + 1e-9, 1)
    tired = F.greatest(F.lit(4), F.round(st.rating_uncertainty(F.col("matches")) / 12)).cast("bigint")
    body = F.create_map(
        F.col("entity").cast("string"),
        F.struct("matches", tenth("overall").alias("global"), *[tenth(c).alias(c) for c in ("hard", "clay", "grass")], tired.alias("fatigue")),
    )
    mapped = s.select("pool", body.alias("m"))
    return mapped.select("pool", F.explode("m").alias("name", "v")).select("pool", "name", "v.*")


@query(
    "j14_lookup_by_id",
    """WITH ids AS (SELECT DISTINCT CASE WHEN user_id % 2 = 0 THEN 'north' ELSE 'south' END AS pool, user_id FROM events)
       SELECT r.pool || ':' || r.entity AS id, r.pool || ':' || r.entity AS own_id, CAST(c.matches AS BIGINT) AS matches,
       round(overall + 1e-9, 2) AS overall, round(hard + 1e-9, 2) AS hard, round(clay + 1e-9, 2) AS clay, round(grass + 1e-9, 2) AS grass
       FROM last_ratings r JOIN ids ON ids.pool = r.pool AND ids.user_id = r.entity JOIN career c ON c.pool = r.pool AND c.entity = r.entity""",
)
def _(spark, d):
    s = latest_states(spark, d).withColumn("key", F.concat_ws("::", "pool", F.col("entity").cast("string")))
    who = F.when(F.col("user_id") % 2 == 0, "north").otherwise("south")
    ids = table(spark, d, "events").select(F.concat_ws(":", who, F.col("user_id").cast("string")).alias("id")).distinct()
    return resolve.lookup_by_id(ids, s)
