"""Queries over assembled feature rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.functions import prob
from tallyspark.operators import features as ft
from tallyspark.operators import ratings as rt
from tallyspark.operators import state as st
from tallyspark.operators.batches import ROUND_BATCH, VENUE_BATCH, oriented, with_batch
from tallyspark.plans.evaluation import available_features
from tallyspark.plans.history import (
    DECAYS,
    PRIOR,
    PRIOR_S,
    SURFACE_DECAY,
    decay_sql,
    decayed_all,
    round_parts,
    venue_matches,
)
from tallyspark.plans.opponent import common_sql
from tallyspark.plans.probability import clamp_sql, match_from_points_sql
from tallyspark.plans.registry import query, r6, view
from tallyspark.plans.rows import FLIP_POOL, flip_of, rnd
from tallyspark.session import cut_lineage, dealt, only
from tallyspark.sources.fixtures import matches, parts, scored

def pool_prior():
    return F.when(F.col("pool") == "north", 0.635).otherwise(0.605)


def numbered_matches(spark, d):
    """Oriented matches with both batch numbers and the context labels of the fixture."""

    def numbered():
        m = dealt(cut_lineage(matches(spark, d)))
        m = with_batch(m, VENUE_BATCH).withColumnRenamed("batch_no", "venue_no")
        return with_batch(m, ROUND_BATCH)

    m = dealt(only(numbered))
    pick = lambda values, i: F.element_at(F.array(*[F.lit(v) for v in values]), i.cast("int"))
    m = m.withColumns(
        {
            "level": pick(("G", "M", "500", "250"), F.col("match_id") % 4 + 1),
            "indoor": F.when(F.col("match_id") % 3 == 0, "I").otherwise("O"),
            "round": pick(("R16", "QF", "SF", "F"), F.col("round_order")),
        }
    )
    return oriented(m, flip_of())


def numbered_parts(spark, d, m):
    return st.derived_counts(parts(spark, d, m))


# ---- basic row -------------------------------------------------------------------------

view(
    "snap_plain",
    f"""SELECT match_id, entity, 1500 + coalesce(sum(0.42 * sg) OVER {PRIOR}, 0) AS overall,
        1500 + coalesce(sum(0.72 * sg) OVER {PRIOR_S}, 0) AS on_surface FROM
        (SELECT p.match_id, p.pool, p.entity, p.surface, p.batch_no, CASE won WHEN 1 THEN delta ELSE -delta END AS sg
         FROM vparts p JOIN solved_plain USING (match_id))""",
)
view(
    "vseq",
    f"""SELECT *, row_number() OVER (PARTITION BY pool, entity ORDER BY batch_no, match_id) AS rn,
        row_number() OVER (PARTITION BY pool, entity, surface ORDER BY batch_no, match_id) AS srn,
        count(*) OVER {PRIOR} AS nb, count(*) OVER {PRIOR_S} AS snb,
        date_diff('day', max(match_date) OVER {PRIOR}, match_date) AS gap FROM vparts""",
)
view(
    "form_v",
    """SELECT a.match_id, a.entity, coalesce(avg(b.won) FILTER (b.rn > a.nb - 5), 0.5) AS form_5,
       coalesce(avg(b.won) FILTER (b.rn > a.nb - 10), 0.5) AS form_10, coalesce(avg(b.won), 0.5) AS form_20
       FROM vseq a LEFT JOIN vseq b ON b.pool = a.pool AND b.entity = a.entity AND b.rn <= a.nb AND b.rn > a.nb - 20 GROUP BY ALL""",
)
view(
    "sform_v",
    """SELECT a.match_id, a.entity, coalesce(avg(b.won), 0.5) AS surface_form FROM vseq a LEFT JOIN vseq b ON b.pool = a.pool
       AND b.entity = a.entity AND b.surface = a.surface AND b.srn <= a.snb AND b.srn > a.snb - 10 GROUP BY ALL""",
)
view(
    "load_v",
    """SELECT a.match_id, a.entity, least(40, count(b.match_id)) AS workload_14d FROM vparts a LEFT JOIN vparts b
       ON a.pool = b.pool AND a.entity = b.entity AND b.batch_no < a.batch_no AND a.dn - b.dn <= 14 GROUP BY ALL""",
)
view(
    "meta_v",
    """SELECT pool, entity, batch_no, last_value(r IGNORE NULLS) OVER w AS ranking, last_value(q IGNORE NULLS) OVER w AS points
       FROM (SELECT pool, entity, batch_no, arg_max(ranking, match_id) FILTER (ranking <> 0) AS r,
       arg_max(ranking_points, match_id) FILTER (ranking_points <> 0) AS q FROM vparts GROUP BY ALL)
       WINDOW w AS (PARTITION BY pool, entity ORDER BY batch_no)""",
)
RATES = [s.name for s in st.SERVE_STATS]
view(
    "basic_side",
    f"""SELECT v.match_id, v.entity, v.nb AS n_before, CASE WHEN gap IS NULL THEN 14 ELSE least(60, greatest(0, gap)) END AS days_rest,
        {', '.join('c.' + r for r in RATES)}, c.stat_sample, form_5, form_10, form_20, surface_form, workload_14d,
        coalesce(ranking_m, 999.0) AS ranking, coalesce(points_m, 0.0) AS points, overall, on_surface
        FROM vseq v JOIN cum_rates c ON c.match_id = v.match_id AND c.entity = v.entity
        JOIN form_v f ON f.match_id = v.match_id AND f.entity = v.entity JOIN sform_v s ON s.match_id = v.match_id AND s.entity = v.entity
        JOIN load_v l ON l.match_id = v.match_id AND l.entity = v.entity
        JOIN (SELECT pool, entity, batch_no, ranking AS ranking_m, points AS points_m FROM meta_v) q
          ON q.pool = v.pool AND q.entity = v.entity AND q.batch_no = v.batch_no
        JOIN snap_plain z ON z.match_id = v.match_id AND z.entity = v.entity""",
)
H2HV = "(PARTITION BY pool, least(winner, loser), greatest(winner, loser){s} ORDER BY batch_no RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
view(
    "h2h_v",
    f"""SELECT match_id, coalesce(sum(CASE WHEN winner < loser THEN 1 ELSE -1 END) OVER {H2HV.format(s='')}, 0) AS net,
        coalesce(sum(CASE WHEN winner < loser THEN 1 ELSE -1 END) OVER {H2HV.format(s=', surface')}, 0) AS snet FROM vb""",
)
BASIC_SQL = {
    "overall_elo_diff": "(a.overall - b.overall) / 400.0",
    "surface_elo_diff": "(a.on_surface - b.on_surface) / 400.0",
    **{f"{c}_diff": f"a.{c} - b.{c}" for c in ("form_5", "form_10", "form_20", "surface_form", *RATES, "stat_sample")},
    "matches_diff": "(least(a.n_before, 300) - least(b.n_before, 300)) / 300.0",
    "ranking_diff": "(b.ranking - a.ranking) / 998.0",
    "ranking_points_diff": "(a.points - b.points) / 12000.0",
    "days_rest_diff": "(a.days_rest - b.days_rest) / 60.0",
    "workload_14d_diff": "(a.workload_14d - b.workload_14d) / 8.0",
    "h2h_prior_diff": "(CASE WHEN p1 < p2 THEN net ELSE -net END) / 10.0",
    "surface_h2h_prior_diff": "(CASE WHEN p1 < p2 THEN snet ELSE -snet END) / 10.0",
    "best_of_5": "CASE best_of WHEN 5 THEN 1.0 ELSE 0.0 END",
}


def basic_query(cols):
    return (
        f"""WITH o AS (SELECT *, CASE WHEN f = 0 THEN loser ELSE winner END AS p1, CASE WHEN f = 0 THEN winner ELSE loser END AS p2,
        CASE WHEN f = 0 THEN 0 ELSE 1 END AS label FROM (SELECT *, {FLIP_POOL} AS f FROM vb))
        SELECT o.match_id, label, {', '.join(f'{r6(BASIC_SQL[c])} AS {c}' for c in cols)}
        FROM o JOIN basic_side a ON a.match_id = o.match_id AND a.entity = o.p1
        JOIN basic_side b ON b.match_id = o.match_id AND b.entity = o.p2 JOIN h2h_v h ON h.match_id = o.match_id"""
    )


def basic_rows(spark, d):
    m = oriented(venue_matches(spark, d), flip_of(True))
    return ft.basic_features(m, st.derived_counts(parts(spark, d, m)))


@query("x1_basic_features", basic_query(ft.BASIC))
def _(spark, d):
    return basic_rows(spark, d).select("match_id", "label", *[rnd(f).alias(f) for f in ft.BASIC])


@query("p14_feature_vectors", basic_query(ft.MINIMAL))
def _(spark, d):
    return basic_rows(spark, d).select("match_id", "label", *[rnd(f).alias(f) for f in ft.MINIMAL])


# ---- pieces of the full row ------------------------------------------------------------

SP = "greatest(0.48, least(0.78, ({fi}) * ({fw}) + (1 - ({fi})) * ({sw})))"


def drate(n, p, k=120.0):
    return f"CASE WHEN t_{n} > 0 THEN ({p} * {k} + s_{n}) / ({k} + t_{n}) ELSE {p} END"


SERVICE_SQL = SP.format(fi=drate("first_in", 0.62), fw=drate("first_won", 0.72), sw=drate("second_won", 0.52))


@query("x3_service_point", f"SELECT match_id, entity, {r6(SERVICE_SQL)} AS service_point FROM decayed")
def _(spark, d):
    out = decayed_all(round_parts(spark, d))
    rate = lambda n: st.decayed_rate(*ft.STATE_RATES[n])
    point = prob.service_point(rate("first_in"), rate("first_won"), rate("second_won"))
    return out.select("match_id", "entity", rnd(point).alias("service_point"))


def lg(p):
    return f"ln(greatest(1e-6, least(1 - 1e-6, {p})) / (1 - greatest(1e-6, least(1 - 1e-6, {p}))))"


PP = "(CASE pool WHEN 'north' THEN 0.635 ELSE 0.605 END)"
QP = f"(1 - {PP})"


def srate(n, prior):
    inner = f"(CASE WHEN t_{n} > 0 THEN ({prior} * 260 + s_{n}) / (260 + t_{n}) ELSE {prior} END)"
    return f"(CASE WHEN f_t_{n} > 0 THEN ({inner} * 169 + f_s_{n}) / (169 + f_t_{n}) ELSE {inner} END)"


LATENT_SQL = {
    "latent_serve": f"{lg(drate('service_won', PP, 420.0))} - {lg(PP)}",
    "latent_return": f"{lg(drate('return_won', QP, 420.0))} - {lg(QP)}",
    "surface_serve": f"{lg(srate('service_won', PP))} - {lg(PP)}",
    "surface_return": f"{lg(srate('return_won', QP))} - {lg(QP)}",
    "latent_uncertainty": "sqrt(1.0 / (120.0 + 0.25 * t_serve_points + f_t_serve_points))",
}


@query(
    "x4_latent_skills",
    f"SELECT match_id, entity, {', '.join(f'{r6(e)} AS {n}' for n, e in LATENT_SQL.items())} FROM decayed",
)
def _(spark, d):
    out = decayed_all(round_parts(spark, d))
    return out.select("match_id", "entity", *[rnd(c).alias(n) for n, c in st.latent_skills(pool_prior()).items()])


# ---- full row --------------------------------------------------------------------------

_DEC = ", ".join(f"d.{k}_{n}" for n in ("serve_points", "service_won", "return_won", "aces", "double_faults", "first_in", "first_won", "second_won", "bp_saved", "bp_converted") for k in ("s", "t", "f_s", "f_t"))
view(
    "full_base",
    f"""SELECT e.*, count(*) OVER {PRIOR} AS nb, count(*) OVER {PRIOR_S} AS snb, max(match_date) OVER {PRIOR} AS seen,
        1500 + coalesce(sum(0.42 * sg) OVER {PRIOR}, 0) AS overall, 1500 + coalesce(sum(0.72 * sg) OVER {PRIOR_S}, 0) AS on_surface
        FROM (SELECT x.* EXCLUDE (residual), {_DEC}, CASE won WHEN 1 THEN delta ELSE -delta END AS sg FROM edges_rb x
              JOIN solved_deviation sd ON sd.match_id = x.match_id
              JOIN decayed d ON d.match_id = x.match_id AND d.entity = x.entity) e""",
)
_R = {n: drate(a, b, c) for n, (a, b, c) in ft.STATE_RATES.items()}
view(
    "full_rated",
    f"""SELECT *, {SERVICE_SQL} AS serve, {_R['return_strength']} AS ret, (snb / (snb + 18.0)) * on_surface + (18.0 / (snb + 18.0)) * overall AS shrunk,
        CASE WHEN seen IS NULL THEN 21 ELSE least(90, greatest(0, date_diff('day', seen, match_date))) END AS rest FROM full_base""",
)
view(
    "full_edges",
    """SELECT a.*, CASE a.won WHEN 1 THEN 1 - 1 / (1 + pow(10.0, ((0.58 * b.shrunk + 0.42 * b.overall) - (0.58 * a.shrunk + 0.42 * a.overall)) / 400.0))
       ELSE -(1 - 1 / (1 + pow(10.0, ((0.58 * a.shrunk + 0.42 * a.overall) - (0.58 * b.shrunk + 0.42 * b.overall)) / 400.0))) END AS residual,
       greatest(0, least(1, a.service_won / CAST(a.svpt AS DOUBLE))) - a.serve AS sres,
       greatest(0, least(1, a.return_won / CAST(a.o_svpt AS DOUBLE))) - a.ret AS rres, pow(2.0, (a.dn - 8000) / 730.0) AS g
       FROM full_rated a JOIN full_rated b ON b.match_id = a.match_id AND b.entity <> a.entity""",
)


@query(
    "w17_expectation_residuals",
    f"""SELECT match_id, entity, {r6('residual')} AS residual, {r6('sres')} AS serve_residual, {r6('rres')} AS return_residual
        FROM full_edges""",
)
def _(spark, d):
    m = numbered_matches(spark, d)
    s = ft.side_state(numbered_parts(spark, d, m), pool_prior())
    cols = ("residual", "serve_residual", "return_residual")
    return s.select("match_id", "entity", *[rnd(c).alias(c) for c in cols])


_META_SQL = ", ".join(
    f"last_value({f} IGNORE NULLS) OVER (PARTITION BY pool, entity ORDER BY batch_no) AS m_{f}"
    for f in ("ranking", "ranking_points", "age", "height", "hand")
)
view(
    "meta_entry",
    f"""SELECT pool, entity, match_date, venue, {_META_SQL} FROM (SELECT v.pool, v.entity, v.batch_no, v.match_date, v.venue, v.ranking,
        v.ranking_points, v.age, v.height, nullif(v.hand, '') AS hand, row_number() OVER (PARTITION BY pool, entity, batch_no
        ORDER BY round_order, match_id) AS k FROM vparts v) WHERE k = 1""",
)
view(
    "load_r",
    """SELECT a.match_id, a.entity, least(51, count(b.match_id) FILTER (a.dn - b.dn <= 3)) AS w3,
       least(51, count(b.match_id) FILTER (a.dn - b.dn <= 7)) AS w7, least(51, count(b.match_id)) AS w14
       FROM rparts a LEFT JOIN rparts b ON a.pool = b.pool AND a.entity = b.entity AND b.batch_no < a.batch_no AND a.dn - b.dn <= 14
       GROUP BY a.match_id, a.entity""",
)
_DECAY_COLS = ", ".join(f"{decay_sql(s, PRIOR)} AS {s.name}" for s in DECAYS)
_DECAY_COLS += ", " + ", ".join(f"{decay_sql(s, PRIOR_S)} AS {s.name}" for s in SURFACE_DECAY)
_LAT = ", ".join(f"{e} AS {n}" for n, e in LATENT_SQL.items())
view(
    "full_side",
    f"""SELECT f.match_id, f.entity, f.overall, f.on_surface, f.shrunk, f.snb, f.nb, f.serve, f.ret, f.rest, f.t_serve_points, rd.rd,
        {', '.join(f"{e} AS x_{n}" for n, e in _R.items())}, {_LAT}, {_DECAY_COLS}, w3, w7, w14,
        m_ranking, m_ranking_points, m_age, m_height, coalesce(m_hand, '') AS m_hand
        FROM full_edges f JOIN rd_steps rd ON rd.n = least(f.nb, 400)
        JOIN (SELECT match_id AS lm_, entity AS le_, w3, w7, w14 FROM load_r) l ON lm_ = f.match_id AND le_ = f.entity
        JOIN (SELECT pool AS mp_, entity AS me_, match_date AS md_, venue AS mv_, * EXCLUDE (pool, entity, match_date, venue) FROM meta_entry) q
          ON mp_ = f.pool AND me_ = f.entity AND md_ = f.match_date AND mv_ = f.venue""",
    material=True,
)
view(
    "full_pair",
    """SELECT o.match_id, any_value(s) FILTER (s.entity = o.p1) AS a, any_value(s) FILTER (s.entity = o.p2) AS b
       FROM oriented_rb o JOIN full_side s ON s.match_id = o.match_id GROUP BY o.match_id""",
    material=True,
)
_FLAG = lambda c: f"CASE WHEN {c} THEN 1.0 ELSE 0.0 END"
FULL_SQL = {
    "overall_elo_diff": "(a.overall - b.overall) / 400.0",
    "surface_elo_diff": "(a.on_surface - b.on_surface) / 400.0",
    "surface_elo_shrunk_diff": "(a.shrunk - b.shrunk) / 400.0",
    "rating_rd_diff": "(b.rd - a.rd) / 350.0",
    "rating_uncertainty_sum": "(a.rd + b.rd) / 700.0",
    "matches_diff": "(least(a.nb, 350) - least(b.nb, 350)) / 350.0",
    "match_count_log_diff": "ln(1 + a.nb) - ln(1 + b.nb)",
    "surface_sample_diff": "(a.snb - b.snb) / 80.0",
    "data_strength_diff": "(ln(1 + a.nb) + ln(1 + a.t_serve_points) - ln(1 + b.nb) - ln(1 + b.t_serve_points)) / 10.0",
    "ranking_diff": "(coalesce(b.m_ranking, 999.0) - coalesce(a.m_ranking, 999.0)) / 998.0",
    "ranking_points_diff": "(coalesce(a.m_ranking_points, 0.0) - coalesce(b.m_ranking_points, 0.0)) / 12000.0",
    "rank_known": _FLAG("a.m_ranking IS NOT NULL AND b.m_ranking IS NOT NULL"),
    "age_diff": "(coalesce(a.m_age, 27.0) - coalesce(b.m_age, 27.0)) / 15.0",
    "height_diff": "(coalesce(a.m_height, 185.0) - coalesce(b.m_height, 185.0)) / 30.0",
    "lefty_matchup": f"{_FLAG(chr(40) + 'a.m_hand = ' + chr(39) + 'L' + chr(39) + chr(41))} - {_FLAG('b.m_hand = ' + chr(39) + 'L' + chr(39))}",
    "same_hand": _FLAG("a.m_hand <> '' AND a.m_hand = b.m_hand"),
    "serve_strength_diff": "a.serve - b.serve",
    "return_strength_diff": "a.ret - b.ret",
    "serve_return_edge": "(a.serve - (1 - b.ret)) - (b.serve - (1 - a.ret))",
    **{f"{n}_diff": f"a.x_{n} - b.x_{n}" for n in ("first_in", "first_won", "second_won", "ace_rate", "df_rate", "bp_save", "bp_convert")},
    "return_point_won_diff": "a.ret - b.ret",
    "serve_point_won_diff": "a.serve - b.serve",
    "stat_sample_diff": "(least(a.t_serve_points, 6000.0) - least(b.t_serve_points, 6000.0)) / 6000.0",
    "latent_serve_skill_diff": "a.latent_serve - b.latent_serve",
    "latent_return_skill_diff": "a.latent_return - b.latent_return",
    "latent_surface_serve_skill_diff": "a.surface_serve - b.surface_serve",
    "latent_surface_return_skill_diff": "a.surface_return - b.surface_return",
    "latent_uncertainty_sum": "a.latent_uncertainty + b.latent_uncertainty",
    "days_rest_diff": "(a.rest - b.rest) / 90.0",
    "recovery_curve_diff": "exp(-b.rest / 3.5) - exp(-a.rest / 3.5)",
    "workload_3d_diff": "(a.w3 - b.w3) / 4.0",
    "workload_7d_diff": "(a.w7 - b.w7) / 7.0",
    "workload_14d_diff": "(a.w14 - b.w14) / 10.0",
    **{f"{n}_diff": f"a.{n} - b.{n}" for n in ("residual_form_short", "residual_form_medium", "surface_residual_form", "score_dominance", "set_dominance", "tiebreak_strength")},
    "best_of_5": _FLAG("o.best_of = 5"),
    "h2h_prior_diff": "(CASE WHEN p1 = lo THEN lw - hw ELSE hw - lw END) / (lw + hw + 8.0)",
    "surface_h2h_prior_diff": "(CASE WHEN p1 = lo THEN slw - shw ELSE shw - slw END) / (slw + shw + 8.0)",
    "is_indoor": _FLAG("o.match_id % 3 = 0"),
    **{f"level_{n}": _FLAG(f"o.match_id % 4 = {i}") for i, n in enumerate(("g", "m", "500", "250"))},
    "round_final": _FLAG("round_order = 4"),
    "round_sf": _FLAG("round_order = 3"),
    "round_qf": _FLAG("round_order = 2"),
    "common_opponent_result_residual_diff": "coalesce(common_result, 0.0)",
    "common_opponent_serve_residual_diff": "coalesce(common_serve, 0.0)",
    "common_opponent_return_residual_diff": "coalesce(common_return, 0.0)",
    "common_opponent_surface_residual_diff": "coalesce(common_surface_result, 0.0)",
    "common_opponent_match_weight": "coalesce(common_weight, 0.0)",
}
_S_EDGE = clamp_sql("(sh1 - sh2) / 2400.0", -0.05, 0.05)
_S1 = clamp_sql(f"{clamp_sql('0.72 * sv1 + 0.28 * (1 - rt2)', 0.50, 0.77)} + {_S_EDGE}", 0.50, 0.80)
_S2 = clamp_sql(f"{clamp_sql('0.72 * sv2 + 0.28 * (1 - rt1)', 0.50, 0.77)} - {_S_EDGE}", 0.50, 0.80)


def _lat(s, r):
    return clamp_sql(f"1 / (1 + exp(-(ln({PP} / (1 - {PP})) + {s} - {r})))", 0.50, 0.80)


view(
    "full_points",
    """SELECT o.match_id, o.pool, o.best_of, a.serve AS sv1, b.serve AS sv2, a.ret AS rt1, b.ret AS rt2, a.shrunk AS sh1, b.shrunk AS sh2,
       a.surface_serve AS ls1, b.surface_serve AS ls2, a.surface_return AS lr1, b.surface_return AS lr2 FROM oriented_rb o
       JOIN full_pair x ON x.match_id = o.match_id""",
    material=True,
)
view(
    "full_logits",
    f"""SELECT s.match_id, {lg('s.ps')} AS structural_match_logit, {lg('l.pl')} AS latent_exact_match_logit
        FROM {match_from_points_sql('full_points', _S1, _S2, 'ps')} s
        JOIN {match_from_points_sql('full_points', _lat('ls1', 'lr2'), _lat('ls2', 'lr1'), 'pl')} l ON l.match_id = s.match_id""",
)
view("full_common", common_sql("oriented_rb", "full_edges").replace("e.dn)", "e.dn - 8000)"))


def full_query() -> str:
    cols = ", ".join(f"{r6(FULL_SQL[c])} AS {c}" for c in ft.FULL if c in FULL_SQL)
    return f"""SELECT o.match_id, o.label, {cols}, {r6('structural_match_logit')} AS structural_match_logit,
      {r6('latent_exact_match_logit')} AS latent_exact_match_logit FROM oriented_rb o
      JOIN full_pair x ON x.match_id = o.match_id
      JOIN (SELECT match_id AS hm_, lo, lw, hw, slw, shw FROM h2h) h ON hm_ = o.match_id JOIN full_logits g ON g.match_id = o.match_id
      LEFT JOIN full_common c ON c.match_id = o.match_id"""


def full_rows(spark, d):
    m = numbered_matches(spark, d)
    return ft.full_features(m, numbered_parts(spark, d, m), pool_prior())


@query("x2_full_features", full_query())
def _(spark, d):
    return full_rows(spark, d).select("match_id", "label", *[rnd(f).alias(f) for f in ft.FULL])


@query(
    "x5_shrunk_surface_rating",
    f"SELECT match_id, entity, {r6('(n / (n + 18.0)) * s + (18.0 / (n + 18.0)) * o')} AS shrunk FROM (SELECT match_id, entity, "
    + f"count(*) OVER {PRIOR_S} AS n, 1500.0 + ev % 100 AS s, 1500.0 + oev % 50 AS o FROM rparts)",
)
def _(spark, d):
    p = round_parts(spark, d)
    out = p.join(st.surface_counts(p), [*st.ENTITY_SURFACE, "batch_no"])
    shrunk = prob.shrunk_surface_rating(1500.0 + F.col("oev") % 50, 1500.0 + F.col("ev") % 100, F.col("surface_n"))
    return out.select("match_id", "entity", rnd(shrunk).alias("shrunk"))


CONTEXT = tuple(f for f in ft.FAMILIES["context"] if f != "best_of_5")


@query(
    "x6_context_flags",
    f"SELECT match_id, {', '.join(f'{r6(FULL_SQL[c])} AS {c}' for c in CONTEXT)} FROM matches o",
)
def _(spark, d):
    flags = ft.context_flags()
    return numbered_matches(spark, d).select("match_id", *[flags[c].alias(c) for c in CONTEXT])


@query(
    "x7_candidate_sets",
    """WITH g(grp, feature) AS (VALUES ('size', 'p'), ('size', 'p2'), ('price', 'l_tax'), ('price', 'l_discount'), ('price', 'blank')),
       av AS (SELECT 'p' AS feature, sum(abs(p)) AS s FROM scored UNION ALL SELECT 'p2', sum(abs(p2)) FROM scored UNION ALL
         SELECT 'l_tax', sum(abs(l_tax)) FROM scored UNION ALL SELECT 'l_discount', sum(abs(l_discount)) FROM scored UNION ALL SELECT 'blank', 0.0),
       ok AS (SELECT feature FROM av WHERE s > 0)
       SELECT 'full' AS set_name, feature FROM ok UNION ALL SELECT grp || '_only', feature FROM g JOIN ok USING (feature)
       UNION ALL SELECT 'no_' || n.grp, ok.feature FROM (SELECT DISTINCT grp FROM g) n, ok
       WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.grp = n.grp AND g.feature = ok.feature)""",
)
def _(spark, d):
    s = scored(spark, d).withColumn("blank", F.lit(0.0))
    names = ["p", "p2", "l_tax", "l_discount", "blank"]
    groups = {"size": ("p", "p2"), "price": ("l_tax", "l_discount", "blank")}
    pairs = spark.createDataFrame([(g, f) for g, fs in groups.items() for f in fs], "grp string, feature string")
    return ft.candidate_sets(available_features(s, names).where("available = 1").select("feature"), pairs)


_SETS = {
    **ft.NAMED_SETS,
    **{f"no_{g}": tuple(f for f in ft.FULL if f not in ft.FAMILIES[g]) for g in ft.LEFT_OUT},
    **{f"{g}_only": fs for g, fs in ft.FAMILIES.items()},
}


@query(
    "x7_named_sets",
    f"""WITH s(set_name, feature) AS (VALUES {', '.join(f"('{n}', '{f}')" for n, fs in _SETS.items() for f in fs)}),
       av AS ({' UNION ALL '.join(f"SELECT '{c}' AS feature, sum(abs({FULL_SQL[c]})) AS total FROM matches o" for c in CONTEXT)}
         UNION ALL SELECT 'best_of_5', sum(CASE WHEN best_of = 5 THEN 1 ELSE 0 END) FROM matches)
       SELECT set_name, feature FROM s JOIN av USING (feature) WHERE total > 0""",
)
def _(spark, d):
    flags = ft.context_flags()
    rows = numbered_matches(spark, d).select((F.col("best_of") == 5).cast("double").alias("best_of_5"), *[flags[c].alias(c) for c in CONTEXT])
    return ft.named_sets(available_features(rows, rows.columns).where("available = 1").select("feature"))
