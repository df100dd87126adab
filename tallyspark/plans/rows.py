"""Row-level queries: sources, normalization, projections, filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.functions import scores, text
from tallyspark.operators.batches import oriented
from tallyspark.operators.state import derived_counts
from tallyspark.plans.registry import query, r6
from tallyspark.sources.fixtures import matches, parts, scored, table


def rnd(c):
    """Six decimals; the tiny shift makes every engine break ties the same way."""
    return F.round((F.col(c) if isinstance(c, str) else c) + 1e-9, 6)


@query(
    "p1_normalize_name",
    """SELECT p_partkey, trim(regexp_replace(replace(raw, '_', ' '), '\\s+', ' ', 'g')) AS name FROM
       (SELECT p_partkey, '  ' || replace(p_name, ' ', '__ ') || chr(9) || '_' AS raw FROM part)""",
)
def _(spark, d):
    raw = F.concat(F.lit("  "), F.replace("p_name", F.lit(" "), F.lit("__ ")), F.lit("\t_"))
    return table(spark, d, "part").select("p_partkey", text.normalize_name(raw).alias("name"))


@query(
    "p2_entity_key",
    """SELECT p_partkey, lower(p_brand) || '::' || lower(p_name) AS key,
              lower(p_brand) || ':' || replace(lower(p_name), ' ', '-') AS slug FROM part""",
)
def _(spark, d):
    p = table(spark, d, "part")
    return p.select(
        "p_partkey",
        text.entity_key(F.replace("p_name", F.lit(" "), F.lit("_ ")), F.col("p_brand")).alias("key"),
        text.slug_id(F.col("p_name"), F.lower("p_brand")).alias("slug"),
    )


@query(
    "p3_parse_date",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day
       FROM orders""",
)
def _(spark, d):
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    raw = (
        F.when(k % 7 == 0, F.when(k % 2 == 0, "n/a").otherwise("20241"))
        .when(k % 3 == 0, F.date_format("o_orderdate", "yyyyMMdd"))
        .when(k % 3 == 1, F.date_format("o_orderdate", " yyyy-MM-dd "))
        .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"))
    )
    return o.select("o_orderkey", F.date_format(text.parse_date(raw), "yyyy-MM-dd").alias("day"))


@query(
    "p4_first_float",
    f"""SELECT l_orderkey, l_linenumber, l_partkey,
        {r6("CASE WHEN l_partkey % 3 = 0 THEN l_quantity WHEN l_partkey % 5 = 0 THEN NULL ELSE l_tax END")} AS v
        FROM lineitem""",
)
def _(spark, d):
    k = F.col("l_partkey")
    a = F.when(k % 3 == 0, F.col("l_quantity").cast("string")).otherwise("x1")
    b = F.when(k % 5 == 0, "").otherwise(F.concat(F.lit(" "), F.col("l_tax").cast("string")))
    v = text.first_float(a, F.lit(None).cast("string"), b)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", rnd(v).alias("v"))


@query(
    "p5_surface",
    """SELECT event_id, CASE event_type WHEN 'view' THEN 'clay' WHEN 'purchase' THEN 'grass' ELSE 'hard' END AS three,
       CASE event_type WHEN 'view' THEN 'clay' WHEN 'purchase' THEN 'grass' WHEN 'signup' THEN 'carpet'
       ELSE 'hard' END AS four FROM events""",
)
def _(spark, d):
    raw = (
        F.when(F.col("event_type") == "view", " Clay")
        .when(F.col("event_type") == "purchase", "GRASS ")
        .when(F.col("event_type") == "signup", "Carpet")
        .when(F.col("event_type") == "click", "Greenset")
    )
    return table(spark, d, "events").select(
        "event_id",
        text.canonical_surface(raw).alias("three"),
        text.canonical_surface(raw, text.SURFACES_FOUR).alias("four"),
    )


@query(
    "p6_best_of",
    """SELECT o_orderkey, CAST(CASE WHEN n IN (3, 5) THEN n ELSE 3 END AS INTEGER) AS best_of FROM (
       SELECT o_orderkey, CASE WHEN o_orderkey % 8 <> 0 THEN o_orderkey % 8
              WHEN o_orderkey % 16 = 0 AND o_orderstatus = 'F' THEN 5 ELSE 3 END AS n FROM orders)""",
)
def _(spark, d):
    k = F.col("o_orderkey")
    level = F.when(F.col("o_orderstatus") == "F", "G").otherwise("M")
    pool = F.when(k % 16 == 0, "atp").otherwise("wta")
    return table(spark, d, "orders").select(
        "o_orderkey", text.best_of_or_default(k % 8, pool, level).alias("best_of")
    )


@query(
    "p7_derived_counts",
    """SELECT match_id, entity, svpt_second, first_won + second_won AS service_won, o_svpt AS return_points,
       o_svpt - (o_first_won + o_second_won) AS return_won, o_bp_faced - o_bp_saved AS bp_converted,
       o_bp_faced AS bp_opps FROM parts""",
)
def _(spark, d):
    return derived_counts(parts(spark, d)).select(
        "match_id", "entity", "svpt_second", "service_won", "return_points", "return_won", "bp_converted", "bp_opps"
    )


@query(
    "p8_clipped_ratio",
    f"""SELECT match_id, entity,
        {r6("CASE WHEN bp_faced > 0 THEN greatest(0.0, least(1.0, bp_saved / CAST(bp_faced AS DOUBLE))) END")} AS bp_save,
        {r6("CASE WHEN aces - 2 > 0 THEN greatest(0.0, least(1.0, (dfs - 1) / CAST(aces - 2 AS DOUBLE))) END")} AS odd
        FROM parts""",
)
def _(spark, d):
    return parts(spark, d).select(
        "match_id",
        "entity",
        rnd(text.clipped_ratio(F.col("bp_saved"), F.col("bp_faced"))).alias("bp_save"),
        rnd(text.clipped_ratio(F.col("dfs") - 1, F.col("aces") - 2)).alias("odd"),
    )


FLIP_SQL = """list_reduce(list_transform(string_split(strftime(match_date, '%Y-%m-%d') || '|' || {pool} venue || '|'
       || CAST(winner AS VARCHAR) || '|' || CAST(loser AS VARCHAR), ''), lambda x: CAST(unicode(x) AS BIGINT)),
       lambda a, c: (a * 131 + c) % 1000003, CAST(0 AS BIGINT)) % 2"""
FLIP_POOL = FLIP_SQL.format(pool="pool || '|' ||")
FLIP_PLAIN = FLIP_SQL.format(pool="")


def flip_of(pool: bool = False):
    args = [F.col(c) for c in ("match_date", "venue", "winner", "loser")]
    return text.side_flip(*args, pool=F.col("pool") if pool else None)


@query(
    "p9_stable_flip",
    f"""SELECT match_id, CASE WHEN {FLIP_POOL} = 0 THEN 1 ELSE 0 END AS with_pool,
        CASE WHEN {FLIP_PLAIN} = 0 THEN 1 ELSE 0 END AS plain FROM matches""",
)
def _(spark, d):
    return matches(spark, d).select(
        "match_id", flip_of(True).cast("int").alias("with_pool"), flip_of().cast("int").alias("plain")
    )


@query(
    "p10_orient",
    f"""SELECT match_id, CASE WHEN f = 0 THEN loser ELSE winner END AS p1,
        CASE WHEN f = 0 THEN winner ELSE loser END AS p2, CASE WHEN f = 0 THEN 0 ELSE 1 END AS label
        FROM (SELECT *, {FLIP_PLAIN} AS f FROM matches)""",
)
def _(spark, d):
    return oriented(matches(spark, d), flip_of()).select("match_id", "p1", "p2", "label")


SETS_SQL = "list_filter(string_split_regex(trim(score), '\\s+'), lambda t: regexp_matches(t, '^\\d+-\\d+'))"
SCORE_CTE = f"""toks AS (SELECT match_id,
   list_transform({SETS_SQL}, lambda t: CAST(regexp_extract(t, '^(\\d+)-(\\d+)', 1) AS INTEGER)) AS ga,
   list_transform({SETS_SQL}, lambda t: CAST(regexp_extract(t, '^(\\d+)-(\\d+)', 2) AS INTEGER)) AS gb FROM matches),
 sets AS (SELECT match_id, unnest(ga) AS a, unnest(gb) AS b FROM toks),
 summary AS (SELECT match_id, CAST(count(*) FILTER (a > b) AS INTEGER) AS w_sets,
   CAST(count(*) FILTER (b > a) AS INTEGER) AS l_sets, CAST(sum(a) AS INTEGER) AS w_games,
   CAST(sum(b) AS INTEGER) AS l_games,
   CAST(count(*) FILTER (abs(a - b) <= 1 AND greatest(a, b) >= 6) AS INTEGER) AS tiebreaks
   FROM sets GROUP BY match_id)"""


def with_score(m):
    s = m.withColumn("_sets", scores.score_sets(F.col("score")))
    return s.withColumns(scores.score_columns(F.col("_sets"))).drop("_sets")


@query("p11_score_summary", f"WITH {SCORE_CTE} SELECT * FROM summary")
def _(spark, d):
    return with_score(matches(spark, d)).select("match_id", "w_sets", "l_sets", "w_games", "l_games", "tiebreaks")


@query(
    "p12_margins",
    f"""WITH {SCORE_CTE} SELECT match_id,
        {r6("(w_games - l_games) / CAST(greatest(1, w_games + l_games) AS DOUBLE)")} AS game_margin,
        {r6("(w_sets - l_sets) / CAST(greatest(1, w_sets + l_sets) AS DOUBLE)")} AS set_margin FROM summary""",
)
def _(spark, d):
    mg = scores.margins()
    return with_score(matches(spark, d)).select("match_id", *[rnd(c).alias(n) for n, c in mg.items()])


@query(
    "p13_event_surface",
    """WITH named AS (SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'wimbledon' WHEN 'MACHINERY' THEN
         'roland garros' WHEN 'FURNITURE' THEN 'us open' WHEN 'HOUSEHOLD' THEN 'hard court' ELSE 'city open' END AS ev,
         CASE WHEN c_custkey % 5 = 0 THEN 'clay' END AS explicit FROM customer),
       known(ev, s) AS (VALUES ('hard court','hard'),('clay court','clay'),('grass court','grass'),
         ('australian open','hard'),('roland garros','clay'),('french open','clay'),('wimbledon','grass'),
         ('us open','hard'))
       SELECT c_custkey, coalesce(explicit, s) AS surface,
         CASE WHEN coalesce(explicit, s) IS NULL THEN 1 ELSE 0 END AS rejected
       FROM named LEFT JOIN known USING (ev)""",
)
def _(spark, d):
    c = table(spark, d, "customer")
    seg = F.col("c_mktsegment")
    ev = (
        F.when(seg == "BUILDING", " Wimbledon")
        .when(seg == "MACHINERY", "Roland Garros")
        .when(seg == "FURNITURE", "US Open")
        .when(seg == "HOUSEHOLD", "Hard Court ")
        .otherwise("City Open")
    )
    explicit = F.when(F.col("c_custkey") % 5 == 0, "clay")
    s = c.select("c_custkey", text.event_surface(ev, explicit).alias("surface"))
    return s.withColumn("rejected", F.col("surface").isNull().cast("int"))


@query(
    "p15_clean_features",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, {r6("CASE WHEN l_partkey % 4 = 3 THEN l_tax ELSE 0 END")} AS a,
        {r6("CASE WHEN l_partkey % 2 = 0 THEN 0 ELSE l_discount END")} AS b FROM lineitem""",
)
def _(spark, d):
    k = F.col("l_partkey")
    a = (
        F.when(k % 4 == 0, float("inf"))
        .when(k % 4 == 1, float("-inf"))
        .when(k % 4 == 2, float("nan"))
        .otherwise(F.col("l_tax"))
    )
    b = F.when(k % 2 == 1, F.col("l_discount"))
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", rnd(text.cleaned(a)).alias("a"), rnd(text.cleaned(b)).alias("b")
    )


@query("p16_participations", "SELECT match_id, entity, opponent, won, ev, surface FROM sides")
def _(spark, d):
    return parts(spark, d).select("match_id", "entity", "opponent", "won", "ev", "surface")


# ---- filters ---------------------------------------------------------------------------


@query("f1_pool_filter", "SELECT match_id, winner, loser FROM matches WHERE pool = 'north'")
def _(spark, d):
    return matches(spark, d).where(F.col("pool") == "north").select("match_id", "winner", "loser")


@query(
    "f3_years_between",
    """SELECT yr, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (yr < 1999) AS BIGINT) AS before_1999
       FROM scored WHERE yr BETWEEN 1996 AND 2000 GROUP BY yr""",
)
def _(spark, d):
    s = scored(spark, d).where(F.col("yr").between(1996, 2000))
    return s.groupBy("yr").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("yr") < 1999).alias("before_1999"))


@query(
    "f4_reject_self_and_unnamed",
    """SELECT a.event_id // 2 AS match_id, a.user_id AS one, b.user_id AS two FROM events a
       JOIN events b ON b.event_id = a.event_id + 1
       WHERE a.event_id % 2 = 0 AND a.event_type <> 'error' AND a.user_id <> b.user_id""",
)
def _(spark, d):
    ev = table(spark, d, "events")
    first = F.col("event_id") % 2 == 0
    name = F.when(F.col("event_type") == "error", "").otherwise(F.col("user_id").cast("string"))
    pairs = ev.groupBy(F.floor(F.col("event_id") / 2).alias("match_id")).agg(
        F.max(F.when(first, name)).alias("one"), F.max(F.when(~first, F.col("user_id").cast("string"))).alias("two")
    )
    ok = (text.normalize_name(F.col("one")) != "") & (text.normalize_name(F.col("two")) != "")
    return pairs.where(ok & (F.col("one") != F.col("two"))).select(
        "match_id", F.col("one").cast("bigint").alias("one"), F.col("two").cast("bigint").alias("two")
    )
