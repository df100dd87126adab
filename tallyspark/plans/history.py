"""Queries over pre-match history: batches, form, rates, rest, workload, metadata, head-to-head."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions.prob import expected_score, recency_weight, service_point
from tallyspark.operators import state
from tallyspark.operators.batches import ROUND_BATCH, VENUE_BATCH, batch_numbers, oriented, paired, with_batch
from tallyspark.operators.state import ENTITY, ENTITY_SURFACE, DecaySpec
from tallyspark.functions import scores
from tallyspark.plans.registry import query, r6, view
from tallyspark.plans.rows import FLIP_PLAIN, SCORE_CTE, flip_of, rnd, with_score
from tallyspark.session import cut_lineage, dealt
from tallyspark.sources.fixtures import matches, parts

view(
    "vb",
    "SELECT *, dense_rank() OVER (PARTITION BY pool ORDER BY match_date, venue) AS batch_no FROM matches",
)
view(
    "rb",
    "SELECT *, dense_rank() OVER (PARTITION BY pool ORDER BY match_date, venue, round_order) AS batch_no FROM matches",
)
view(
    "vparts",
    """SELECT p.*, b.batch_no, o_svpt - (o_first_won + o_second_won) AS return_won, first_won + second_won AS service_won,
       o_bp_faced - o_bp_saved AS bp_converted, date_diff('day', DATE '2000-01-01', p.match_date) AS dn
       FROM parts p JOIN vb b USING (match_id)""",
)
view(
    "rparts",
    """SELECT p.*, b.batch_no, o_svpt - (o_first_won + o_second_won) AS return_won, first_won + second_won AS service_won,
       o_bp_faced - o_bp_saved AS bp_converted, date_diff('day', DATE '2000-01-01', p.match_date) AS dn
       FROM parts p JOIN rb b USING (match_id)""",
)
PRIOR = "(PARTITION BY pool, entity ORDER BY batch_no RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
PRIOR_S = "(PARTITION BY pool, entity, surface ORDER BY batch_no RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


def venue_matches(spark, d):
    """Numbered matches, staged once per query: every later step scans narrow files."""
    return dealt(cut_lineage(with_batch(matches(spark, d), VENUE_BATCH)))


def round_matches(spark, d):
    return dealt(cut_lineage(with_batch(matches(spark, d), ROUND_BATCH)))


def venue_parts(spark, d):
    return state.derived_counts(parts(spark, d, venue_matches(spark, d)))


def round_parts(spark, d):
    return state.derived_counts(parts(spark, d, round_matches(spark, d)))


def attach(p: DataFrame, s: DataFrame, keys=ENTITY) -> DataFrame:
    return p.join(s, [*keys, "batch_no"])


@query(
    "w1_batch_numbers",
    """SELECT DISTINCT 'venue_frozen' AS mode, pool, CAST(match_date AS VARCHAR) AS day, venue, 0 AS round_order, batch_no FROM vb
       UNION ALL SELECT DISTINCT 'round_safe', pool, CAST(match_date AS VARCHAR), venue, round_order, batch_no FROM rb""",
)
def _(spark, d):
    m = matches(spark, d)
    frozen = batch_numbers(m, VENUE_BATCH).withColumn("round_order", F.lit(0))
    safe = batch_numbers(m, ROUND_BATCH)
    cols = ["pool", F.col("match_date").cast("string").alias("day"), "venue", "round_order", "batch_no"]
    return frozen.select(F.lit("venue_frozen").alias("mode"), *cols).unionByName(
        safe.select(F.lit("round_safe").alias("mode"), *cols)
    )


SEQ_CTE = """seqd AS (SELECT *, row_number() OVER (PARTITION BY pool, entity{s} ORDER BY batch_no, match_id) AS rn,
   count(*) OVER (PARTITION BY pool, entity{s} ORDER BY batch_no RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS n
   FROM vparts)"""


def _form_sql(spans, surface=False):
    s = ", surface" if surface else ""
    on = "AND b.surface = a.surface" if surface else ""
    cols = ", ".join(
        r6(f"coalesce(avg(b.won) FILTER (b.rn > a.n - {k} AND b.rn <= a.n), 0.5)") + f" AS form_{k}" for k in spans
    )
    return f"""WITH {SEQ_CTE.format(s=s)} SELECT a.match_id, a.entity, {cols} FROM seqd a LEFT JOIN seqd b
      ON b.pool = a.pool AND b.entity = a.entity {on} AND b.rn <= a.n AND b.rn > a.n - {max(spans)}
      GROUP BY a.match_id, a.entity"""


@query("w2_last_n_win_rate", _form_sql((5, 10, 20)))
def _(spark, d):
    p = venue_parts(spark, d)
    out = attach(p, state.recent_form(p, ENTITY, (5, 10, 20)))
    return out.select("match_id", "entity", *[rnd(f"form_{n}").alias(f"form_{n}") for n in (5, 10, 20)])


@query("w3_surface_win_rate", _form_sql((10,), True))
def _(spark, d):
    p = venue_parts(spark, d)
    out = attach(p, state.recent_form(p, ENTITY_SURFACE, (10,)), ENTITY_SURFACE)
    return out.select("match_id", "entity", rnd("form_10").alias("form_10"))


def prior_form_difference(spark: SparkSession, d: str) -> DataFrame:
    m = oriented(venue_matches(spark, d), flip_of())
    p = parts(spark, d, m)
    out = attach(p, state.recent_form(p, ENTITY, (10,)))
    wide = paired(out, ["match_id", "pool", "label"], ["form_10"], F.col("entity") == F.col("p1"))
    return wide.select("match_id", "pool", "label", rnd(F.col("form_10_1") - F.col("form_10_2")).alias("form_diff"))


@query(
    "flagship_form_difference",
    f"""WITH {SEQ_CTE.format(s="")}, f AS (SELECT a.match_id, a.entity, coalesce(avg(b.won), 0.5) AS form FROM seqd a
        LEFT JOIN seqd b ON b.pool = a.pool AND b.entity = a.entity AND b.rn <= a.n AND b.rn > a.n - 10
        GROUP BY a.match_id, a.entity),
        o AS (SELECT *, {FLIP_PLAIN} AS flip FROM matches)
        SELECT o.match_id, pool, CASE WHEN flip = 0 THEN 0 ELSE 1 END AS label,
        {r6("CASE WHEN flip = 0 THEN l.form - w.form ELSE w.form - l.form END")} AS form_diff
        FROM o JOIN f w ON w.match_id = o.match_id AND w.entity = o.winner
        JOIN f l ON l.match_id = o.match_id AND l.entity = o.loser""",
)
def _(spark, d):
    return prior_form_difference(spark, d)


RATE_SQL = {
    "ace_rate": ("aces", "svpt", 0.055, 120),
    "df_rate": ("dfs", "svpt", 0.035, 120),
    "first_in": ("first_in", "svpt", 0.62, 120),
    "first_won": ("first_won", "first_in", 0.72, 120),
    "second_won": ("second_won", "svpt_second", 0.52, 120),
    "bp_save": ("bp_saved", "bp_faced", 0.58, 40),
    "bp_convert": ("bp_converted", "o_bp_faced", 0.40, 40),
    "return_point_won": ("return_won", "o_svpt", 0.365, 120),
    "serve_point_won": ("service_won", "svpt", 0.635, 120),
}
view(
    "cum_rates",
    "SELECT match_id, pool, entity, batch_no, "
    + ", ".join(
        f"CASE WHEN coalesce(sum({t}) OVER w, 0) > 0 THEN ({p} * {k} + sum({s}) OVER w) / ({k} + sum({t}) OVER w) ELSE {p} END AS {n}"
        for n, (s, t, p, k) in RATE_SQL.items()
    )
    + ", least(coalesce(sum(svpt) OVER w, 0), 6000.0) / 6000.0 AS stat_sample, count(*) OVER w AS n_before"
    + f" FROM (SELECT * REPLACE (CASE WHEN return_won >= 0 THEN return_won END AS return_won) FROM vparts) WINDOW w AS {PRIOR}",
)


@query(
    "w4_cumulative_rates",
    "SELECT match_id, entity, CAST(n_before AS BIGINT) AS n_before, "
    + ", ".join(f"{r6(n)} AS {n}" for n in [*RATE_SQL, "stat_sample"])
    + " FROM cum_rates",
)
def _(spark, d):
    p = venue_parts(spark, d)
    out = attach(p.select("match_id", *ENTITY, "batch_no"), state.cumulative_rates(p))
    return out.select("match_id", "entity", "n_before", *[rnd(n).alias(n) for n in [*RATE_SQL, "stat_sample"]])


STATIC_P = "1.0 / (1.0 + pow(10.0, ((1500 + opponent % 200) - (1500 + entity % 200)) / 400.0))"


def with_static_residual(p: DataFrame) -> DataFrame:
    """Result minus a static expectation, a stand-in where the fold is not the point."""
    strength = lambda c: (F.lit(1500) + F.col(c) % 200).cast("double")
    return p.withColumn("expected", expected_score(strength("entity"), strength("opponent"))).withColumn(
        "residual", F.col("won") - F.col("expected")
    )


def with_margins(p: DataFrame) -> DataFrame:
    sign = F.when(F.col("won") == 1, 1.0).otherwise(-1.0)
    s = with_score(p)
    mg = scores.margins()
    return s.withColumns(
        {
            "game_edge": mg["game_margin"] * sign,
            "set_edge": mg["set_margin"] * sign,
            "tiebreak_edge": F.when(F.col("tiebreaks") > 0, sign),
        }
    )


DECAYS = (
    DecaySpec("residual_form_short", "residual", 90.0),
    DecaySpec("residual_form_medium", "residual", 365.0),
    DecaySpec("score_dominance", "game_edge", 540.0),
    DecaySpec("set_dominance", "set_edge", 540.0),
    DecaySpec("tiebreak_strength", "tiebreak_edge", 900.0),
)
SURFACE_DECAY = (DecaySpec("surface_residual_form", "residual", 365.0),)
view(
    "edges_rb",
    f"""WITH {SCORE_CTE} SELECT r.*, won - {STATIC_P} AS residual,
    (CASE won WHEN 1 THEN 1 ELSE -1 END) * (w_games - l_games) / CAST(greatest(1, w_games + l_games) AS DOUBLE) AS game_edge,
    (CASE won WHEN 1 THEN 1 ELSE -1 END) * (w_sets - l_sets) / CAST(greatest(1, w_sets + l_sets) AS DOUBLE) AS set_edge,
    CASE WHEN tiebreaks > 0 THEN CASE won WHEN 1 THEN 1.0 ELSE -1.0 END END AS tiebreak_edge
    FROM rparts r JOIN summary USING (match_id)""",
)


def decay_sql(spec: DecaySpec, win: str) -> str:
    g = f"CASE WHEN {spec.value} IS NOT NULL THEN pow(2.0, (dn - 8000) / {spec.half_life}) END"
    return f"coalesce(sum({spec.value} * {g}) OVER {win} / sum({g}) OVER {win}, 0.0)"


@query(
    "w5_decayed_means",
    "SELECT match_id, entity, "
    + ", ".join(f"{r6(decay_sql(s, PRIOR))} AS {s.name}" for s in DECAYS)
    + ", "
    + ", ".join(f"{r6(decay_sql(s, PRIOR_S))} AS {s.name}" for s in SURFACE_DECAY)
    + " FROM edges_rb",
)
def _(spark, d):
    p = with_margins(with_static_residual(round_parts(spark, d)))
    out = attach(p, state.decayed_means(p, ENTITY, DECAYS))
    out = attach(out, state.decayed_means(p, ENTITY_SURFACE, SURFACE_DECAY), ENTITY_SURFACE)
    return out.select("match_id", "entity", *[rnd(s.name).alias(s.name) for s in DECAYS + SURFACE_DECAY])


DECAY_SQL = {
    "serve_points": ("svpt", "svpt"),
    "service_won": ("service_won", "svpt"),
    "return_won": ("return_won", "o_svpt"),
    "aces": ("aces", "svpt"),
    "double_faults": ("dfs", "svpt"),
    "first_in": ("first_in", "svpt"),
    "first_won": ("first_won", "first_in"),
    "second_won": ("second_won", "svpt_second"),
    "bp_saved": ("bp_saved", "bp_faced"),
    "bp_converted": ("bp_converted", "o_bp_faced"),
}


def _decayed_counts_sql(win: str, prefix: str = "") -> str:
    out = []
    for n, (s, t) in DECAY_SQL.items():
        for k, v in (("s", f"greatest(0.0, {s})"), ("t", t)):
            g = f"sum(CASE WHEN {t} > 0 THEN {v} * pow(2.0, (dn - 8000) / 730.0) END) OVER {win}"
            last = f"max(CASE WHEN {t} > 0 THEN dn END) OVER {win}"
            out.append(f"coalesce({g} * pow(2.0, -({last} - 8000) / 730.0), 0.0) AS {prefix}{k}_{n}")
    return ", ".join(out)


view(
    "decayed",
    f"SELECT match_id, pool, entity, surface, batch_no, {_decayed_counts_sql(PRIOR)}, {_decayed_counts_sql(PRIOR_S, 'f_')} FROM rparts",
)


def rate_sql(name, prior, k, prefix=""):
    return f"CASE WHEN {prefix}t_{name} > 0 THEN (({prior}) * {k} + {prefix}s_{name}) / ({k} + {prefix}t_{name}) ELSE ({prior}) END"


def decayed_all(p: DataFrame) -> DataFrame:
    """Participations with decayed counts overall and, prefixed ``f_``, on the match's surface."""
    out = attach(p, state.decayed_counts(p, ENTITY, state.DECAYED_STATS))
    on = [s for s in state.DECAYED_STATS]
    return attach(out, state.decayed_counts(p, ENTITY_SURFACE, on, "f_"), ENTITY_SURFACE)


W6_RATES = [
    ("aces", 0.055, 120.0),
    ("double_faults", 0.035, 120.0),
    ("first_in", 0.62, 120.0),
    ("first_won", 0.72, 120.0),
    ("second_won", 0.52, 120.0),
    ("bp_saved", 0.58, 40.0),
    ("bp_converted", 0.40, 40.0),
    ("return_won", 0.365, 120.0),
]


@query(
    "w6_decayed_rates",
    "SELECT match_id, entity, "
    + ", ".join(f"{r6(rate_sql(n, p, k))} AS {n}" for n, p, k in W6_RATES)
    + ", "
    + r6(rate_sql("service_won", rate_sql("service_won", 0.635, 260), 169, "f_"))
    + " AS surface_service, "
    + r6(rate_sql("bp_saved", rate_sql("bp_saved", 0.58, 40), 30, "f_"))
    + " AS surface_bp_saved, "
    + r6("t_serve_points")
    + " AS serve_trials FROM decayed",
)
def _(spark, d):
    out = decayed_all(round_parts(spark, d))
    return out.select(
        "match_id",
        "entity",
        *[rnd(state.decayed_rate(n, p, k)).alias(n) for n, p, k in W6_RATES],
        rnd(state.decayed_surface_rate("service_won", 0.635, 260.0)).alias("surface_service"),
        rnd(state.decayed_surface_rate("bp_saved", 0.58, 40.0)).alias("surface_bp_saved"),
        rnd("t_serve_points").alias("serve_trials"),
    )


GAP = f"date_diff('day', max(match_date) OVER {PRIOR}, match_date)"


@query(
    "w7_days_rest",
    f"""SELECT match_id, entity, CAST(CASE WHEN {GAP} IS NULL THEN 21 ELSE least(90, greatest(0, {GAP})) END AS DOUBLE) AS rest_90,
        CAST(CASE WHEN {GAP} IS NULL THEN 14 ELSE least(60, greatest(0, {GAP})) END AS DOUBLE) AS rest_60 FROM rparts""",
)
def _(spark, d):
    p = round_parts(spark, d)
    s = state.counts_and_rest(p)
    gap = F.datediff("match_date", "last_date").cast("double")
    short = state.rest_days(gap, 14.0, 60.0)
    return attach(p, s).select("match_id", "entity", F.col("days_rest").alias("rest_90"), short.alias("rest_60"))


@query(
    "w8_recovery_curve",
    f"""SELECT match_id, entity, {r6("1 - exp(-rest / 3.5)")} AS recovery FROM (SELECT match_id, entity,
        CASE WHEN {GAP} IS NULL THEN 21 ELSE least(90, greatest(0, {GAP})) END AS rest FROM rparts)""",
)
def _(spark, d):
    p = round_parts(spark, d)
    out = attach(p, state.counts_and_rest(p))
    return out.select("match_id", "entity", rnd(state.recovery(F.col("days_rest"))).alias("recovery"))


@query(
    "w9_workload",
    """SELECT a.match_id, a.entity, CAST(least(51, count(b.match_id) FILTER (a.dn - b.dn <= 3)) AS DOUBLE) AS workload_3d,
       CAST(least(51, count(b.match_id) FILTER (a.dn - b.dn <= 7)) AS DOUBLE) AS workload_7d,
       CAST(least(51, count(b.match_id)) AS DOUBLE) AS workload_14d
       FROM rparts a LEFT JOIN rparts b ON a.pool = b.pool AND a.entity = b.entity AND b.batch_no < a.batch_no
       AND a.dn - b.dn <= 14 GROUP BY a.match_id, a.entity""",
)
def _(spark, d):
    p = round_parts(spark, d)
    return attach(p, state.workload(p)).select("match_id", "entity", "workload_3d", "workload_7d", "workload_14d")


def _carry_sql(fields):
    # arg_min skips null values, so the row is picked first and joined back
    return f"""WITH pick AS (SELECT pool, entity, batch_no, min(CAST(round_order AS BIGINT) * 1000000000 + match_id) AS k FROM vparts GROUP BY ALL),
      entry AS (SELECT v.pool, v.entity, v.batch_no, v.ranking, v.ranking_points, v.age, v.height, nullif(v.hand, '') AS hand
        FROM vparts v JOIN pick p ON p.pool = v.pool AND p.entity = v.entity AND p.batch_no = v.batch_no
        AND p.k = CAST(v.round_order AS BIGINT) * 1000000000 + v.match_id)
      SELECT pool, entity, CAST(batch_no AS BIGINT) AS batch_no, """ + ", ".join(
        f"last_value({f} IGNORE NULLS) OVER (PARTITION BY pool, entity ORDER BY batch_no) AS {f}" for f in fields
    ) + " FROM entry"


@query("w10_carried_metadata", _carry_sql(state.META))
def _(spark, d):
    return state.carried_metadata(venue_parts(spark, d), "batch_no")


@query(
    "w10_last_row_metadata",
    """WITH one AS (SELECT pool, entity, batch_no, arg_max(ranking, match_id) FILTER (ranking <> 0) AS ranking,
       arg_max(ranking_points, match_id) FILTER (ranking_points <> 0) AS ranking_points FROM vparts GROUP BY ALL)
       SELECT pool, entity, CAST(batch_no AS BIGINT) AS batch_no,
       last_value(ranking IGNORE NULLS) OVER (PARTITION BY pool, entity ORDER BY batch_no) AS ranking,
       last_value(ranking_points IGNORE NULLS) OVER (PARTITION BY pool, entity ORDER BY batch_no) AS ranking_points FROM one""",
)
def _(spark, d):
    return state.carried_metadata_last_row(venue_parts(spark, d), "batch_no")


@query(
    "w11_match_counts",
    f"""SELECT match_id, entity, CAST(n AS BIGINT) AS n_before, CAST(sn AS BIGINT) AS surface_n, {r6("ln(1 + n)")} AS log_n,
        {r6("least(n, 350) / 350.0")} AS capped_350, {r6("least(n, 300) / 300.0")} AS capped_300,
        {r6("(ln(1 + n) + ln(1 + sv)) / 10.0")} AS data_strength FROM (SELECT match_id, entity,
        count(*) OVER {PRIOR} AS n, count(*) OVER {PRIOR_S} AS sn, coalesce(sum(svpt) OVER {PRIOR}, 0) AS sv FROM rparts)""",
)
def _(spark, d):
    p = round_parts(spark, d)
    counts = state.prior_totals(p, ENTITY, "batch_no", sums={"n_before": F.lit(1), "sv": F.col("svpt")})
    out = attach(attach(p, counts), state.surface_counts(p), ENTITY_SURFACE)
    n = F.col("n_before")
    return out.select(
        "match_id",
        "entity",
        n.alias("n_before"),
        "surface_n",
        rnd(F.log1p(n)).alias("log_n"),
        rnd(F.least(n, F.lit(350)) / 350.0).alias("capped_350"),
        rnd(F.least(n, F.lit(300)) / 300.0).alias("capped_300"),
        rnd((F.log1p(n) + F.log1p("sv")) / 10.0).alias("data_strength"),
    )


@query(
    "w14_rating_deviation",
    f"""WITH RECURSIVE steps(n, rd) AS (SELECT 0, CAST(350.0 AS DOUBLE) UNION ALL
        SELECT n + 1, greatest(35.0, least(350.0, rd * 0.965 + 350.0 / sqrt(n + 8) * 0.035)) FROM steps WHERE n < 400),
        c AS (SELECT match_id, entity, count(*) OVER {PRIOR} AS n FROM rparts)
        SELECT match_id, entity, {r6("rd")} AS rd FROM c JOIN steps ON steps.n = least(c.n, 400)""",
)
def _(spark, d):
    p = round_parts(spark, d)
    out = attach(p, state.counts_and_rest(p))
    return out.select("match_id", "entity", rnd(state.rating_deviation(F.col("n_before"))).alias("rd"))


@query(
    "w15_uncertainty",
    f"""SELECT match_id, entity, {r6("greatest(28.0, 85.0 * pow(0.992, n))")} AS uncertainty,
        {r6("greatest(28.0, 90.0 / pow(greatest(n, 1), 0.35))")} AS serving FROM
        (SELECT match_id, entity, count(*) OVER {PRIOR} AS n FROM rparts)""",
)
def _(spark, d):
    p = round_parts(spark, d)
    out = attach(p, state.counts_and_rest(p))
    n = F.col("n_before")
    return out.select(
        "match_id",
        "entity",
        rnd(state.rating_uncertainty(n)).alias("uncertainty"),
        rnd(state.serving_uncertainty(n)).alias("serving"),
    )


@query(
    "w16_recency_weight",
    f"""SELECT entity, {r6("sum(won * w) / sum(w)")} AS weighted_wins, {r6("sum(w)")} AS weight FROM (SELECT entity, won,
        CASE WHEN DATE '2024-01-25' <= match_date THEN 1.0 ELSE
        exp(-(0.6931471805599453 / 547.5) * date_diff('day', match_date, DATE '2024-01-25')) END AS w FROM sides) GROUP BY entity""",
)
def _(spark, d):
    age = F.datediff(F.lit("2024-01-25").cast("date"), "match_date")
    p = parts(spark, d).withColumn("w", recency_weight(age))
    return p.groupBy("entity").agg(
        rnd(F.sum(F.col("won") * F.col("w")) / F.sum("w")).alias("weighted_wins"), rnd(F.sum("w")).alias("weight")
    )


# ---- joins on history ------------------------------------------------------------------


@query(
    "j1_attach_both_states",
    f"""WITH s AS MATERIALIZED (SELECT match_id, won, count(*) OVER {PRIOR} AS n, coalesce(sum(won) OVER {PRIOR}, 0) AS w FROM rparts)
        SELECT match_id, CAST(max(n) FILTER (won = 1) AS BIGINT) AS n_1, CAST(max(n) FILTER (won = 0) AS BIGINT) AS n_2,
        CAST(max(w) FILTER (won = 1) AS BIGINT) AS wins_1, CAST(max(w) FILTER (won = 0) AS BIGINT) AS wins_2 FROM s GROUP BY match_id""",
)
def _(spark, d):
    p = round_parts(spark, d)
    out = attach(p, state.counts_and_rest(p))
    wide = paired(out, ["match_id"], ["n_before", "wins_before"], F.col("won") == 1)
    return wide.select(
        "match_id",
        F.col("n_before_1").alias("n_1"),
        F.col("n_before_2").alias("n_2"),
        F.col("wins_before_1").alias("wins_1"),
        F.col("wins_before_2").alias("wins_2"),
    )


@query(
    "j2_asof_state",
    """WITH st AS (SELECT pool, entity, batch_no, max(svpt) AS best_svpt FROM rparts WHERE won = 1 GROUP BY ALL),
       pr AS (SELECT DISTINCT pool, entity, batch_no FROM rparts WHERE won = 0)
       SELECT pr.pool, pr.entity, CAST(pr.batch_no AS BIGINT) AS batch_no, max(st.batch_no) AS seen_at,
       arg_max(st.best_svpt, st.batch_no) AS best_svpt FROM pr LEFT JOIN st ON st.pool = pr.pool
       AND st.entity = pr.entity AND st.batch_no < pr.batch_no GROUP BY ALL""",
)
def _(spark, d):
    p = round_parts(spark, d)
    states = p.where("won = 1").groupBy(*ENTITY, "batch_no").agg(F.max("svpt").alias("best_svpt"))
    states = states.withColumn("seen_at", F.col("batch_no"))
    return state.last_state_before(p.where("won = 0"), states, ["seen_at", "best_svpt"])


H2H = "(PARTITION BY pool, lo, hi{s} ORDER BY batch_no RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
view(
    "pairs_rb",
    """SELECT *, least(winner, loser) AS lo, greatest(winner, loser) AS hi,
       CASE WHEN winner < loser THEN 1 ELSE 0 END AS lo_won FROM rb""",
)
view(
    "h2h",
    "SELECT match_id, winner, lo, "
    + f"coalesce(sum(lo_won) OVER {H2H.format(s='')}, 0) AS lw, coalesce(sum(1 - lo_won) OVER {H2H.format(s='')}, 0) AS hw, "
    + f"coalesce(sum(lo_won) OVER {H2H.format(s=', surface')}, 0) AS slw, coalesce(sum(1 - lo_won) OVER {H2H.format(s=', surface')}, 0) AS shw"
    + " FROM pairs_rb",
)


def with_head_to_head(m: DataFrame, one: str, two: str) -> DataFrame:
    """Earlier wins of ``one`` over ``two`` and back, overall and on the surface."""
    keyed = m.withColumn("lo", F.least(one, two)).withColumn("hi", F.greatest(one, two))
    out = keyed.join(state.head_to_head(m), ["pool", "lo", "hi", "batch_no"]).join(
        state.head_to_head(m, True), ["pool", "lo", "hi", "surface", "batch_no"]
    )
    is_lo = F.col(one) == F.col("lo")
    pick = lambda a, b: F.when(is_lo, F.col(a)).otherwise(F.col(b))
    return out.select(
        "*",
        pick("lo_wins", "hi_wins").alias("h2h_1"),
        pick("hi_wins", "lo_wins").alias("h2h_2"),
        pick("slo_wins", "shi_wins").alias("sh2h_1"),
        pick("shi_wins", "slo_wins").alias("sh2h_2"),
    ).drop("lo", "hi", "lo_wins", "hi_wins", "slo_wins", "shi_wins")


@query(
    "j3_head_to_head",
    f"""SELECT match_id, {r6("(w - l) / 10.0")} AS h2h_raw, {r6("(w - l) / (w + l + 8.0)")} AS h2h_shrunk,
        {r6("(sw - sl) / 10.0")} AS surface_raw, {r6("(sw - sl) / (sw + sl + 8.0)")} AS surface_shrunk FROM (SELECT match_id,
        CASE WHEN winner = lo THEN lw ELSE hw END AS w, CASE WHEN winner = lo THEN hw ELSE lw END AS l,
        CASE WHEN winner = lo THEN slw ELSE shw END AS sw, CASE WHEN winner = lo THEN shw ELSE slw END AS sl FROM h2h)""",
)
def _(spark, d):
    out = with_head_to_head(round_matches(spark, d), "winner", "loser")
    w, l, sw, sl = (F.col(c) for c in ("h2h_1", "h2h_2", "sh2h_1", "sh2h_2"))
    return out.select(
        "match_id",
        rnd((w - l) / 10.0).alias("h2h_raw"),
        rnd((w - l) / (w + l + 8.0)).alias("h2h_shrunk"),
        rnd((sw - sl) / 10.0).alias("surface_raw"),
        rnd((sw - sl) / (sw + sl + 8.0)).alias("surface_shrunk"),
    )
