"""Queries over the rating family."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.functions.prob import with_rating_probability_smooth
from tallyspark.operators import ratings as rt
from tallyspark.operators.batches import with_batch
from tallyspark.plans.history import round_parts, venue_parts
from tallyspark.plans.registry import query, r6, view
from tallyspark.plans.rows import rnd
from tallyspark.sources.fixtures import matches, parts


for _kind in ("v", "r"):
    view(
        f"{_kind}fold_sides",
        f"""SELECT *, row_number() OVER (PARTITION BY pool, entity ORDER BY batch_no, match_id) - 1 AS n,
            row_number() OVER (PARTITION BY pool, entity, surface ORDER BY batch_no, match_id) - 1 AS sn,
            CASE WHEN lag(match_date) OVER wi IS NULL THEN 21 ELSE least(90, date_diff('day', lag(match_date) OVER wi, match_date)) END
            AS idle FROM {_kind}parts WINDOW wi AS (PARTITION BY pool, entity ORDER BY batch_no, match_id)""",
    )
    view(
        f"{_kind}fold_base",
        f"""SELECT b.*, w.n AS wn, l.n AS ln, w.sn AS wsn, l.sn AS lsn, greatest(w.idle, l.idle) AS idle,
            row_number() OVER (PARTITION BY b.pool ORDER BY b.batch_no, b.match_id) AS step FROM {_kind}b b
            JOIN {_kind}fold_sides w ON w.match_id = b.match_id AND w.won = 1
            JOIN {_kind}fold_sides l ON l.match_id = b.match_id AND l.won = 0""",
    )
view(
    "rd_steps",
    """WITH RECURSIVE s(n, rd) AS (SELECT CAST(0 AS BIGINT), CAST(350.0 AS DOUBLE) UNION ALL
       SELECT n + 1, greatest(35.0, least(350.0, rd * 0.965 + 350.0 / sqrt(n + 8) * 0.035)) FROM s WHERE n < 400)
       SELECT * FROM s""",
)
view("fold_plain", "SELECT *, (18 + 18 / (1 + least(wn, ln) / 160.0)) * (CASE best_of WHEN 5 THEN 1.08 ELSE 1 END) AS kk FROM vfold_base")
view("fold_service", "SELECT *, (18 + 18 / (1 + least(wn, ln) / 140.0)) * (CASE best_of WHEN 5 THEN 1.08 ELSE 1 END) AS kk FROM vfold_base")
view(
    "fold_deviation",
    """SELECT f.*, (15 + 18 / (1 + least(wn, ln) / 180.0)) * (0.65 + (a.rd + b.rd) / 700.0) * (1 + least(idle, 180) / 600.0)
       * (CASE best_of WHEN 5 THEN 1.06 ELSE 1 END) AS kk FROM rfold_base f JOIN rd_steps a ON a.n = least(wn, 400)
       JOIN rd_steps b ON b.n = least(ln, 400)""",
)


def fold_sql(src: str, blend, init: str = "sides") -> str:
    """The fold as a match-by-match recursion that carries every entity's ratings per pool."""
    gap = f"({blend('l')}) - ({blend('w')})"
    return f"""(WITH RECURSIVE walk(pool, step, who, val, delta, wo, lo, ws, ls) AS (
        SELECT DISTINCT pool, CAST(0 AS BIGINT), entity || c, CAST(1500.0 AS DOUBLE), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE),
          CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE)
        FROM (SELECT pool, entity, unnest(['/o', '/' || surface]) AS c FROM {init})
        UNION ALL
        SELECT t.pool, p.step, t.who, t.val + CASE t.who WHEN p.winner || '/o' THEN 0.42 * p.d WHEN p.loser || '/o' THEN -0.42 * p.d
            WHEN p.winner || '/' || p.surface THEN 0.72 * p.d WHEN p.loser || '/' || p.surface THEN -0.72 * p.d ELSE 0 END,
          p.d, p.wo, p.lo, p.ws, p.ls
        FROM walk t JOIN (SELECT *, kk * (1 - 1 / (1 + pow(10.0, ({gap}) / 400.0))) AS d FROM (
            SELECT s.pool, s.step, s.winner, s.loser, s.surface, s.kk, s.wn, s.ln, s.wsn, s.lsn,
              max(CASE WHEN u.who = s.winner || '/o' THEN u.val END) AS wo, max(CASE WHEN u.who = s.loser || '/o' THEN u.val END) AS lo,
              max(CASE WHEN u.who = s.winner || '/' || s.surface THEN u.val END) AS ws,
              max(CASE WHEN u.who = s.loser || '/' || s.surface THEN u.val END) AS ls
            FROM walk u JOIN {src} s ON s.pool = u.pool AND s.step = u.step + 1 GROUP BY ALL)) p
          ON p.pool = t.pool AND p.step = t.step + 1)
      SELECT s.*, x.delta, x.wo, x.lo, x.ws, x.ls FROM {src} s JOIN
        (SELECT DISTINCT pool, step, delta, wo, lo, ws, ls FROM walk WHERE step > 0) x ON x.pool = s.pool AND x.step = s.step)"""


def plain_blend(x):
    return f"0.62 * {x}s + 0.38 * {x}o"


def service_blend(x):
    return f"0.62 * {x}s + 0.30 * {x}o - 0.08 * greatest(28.0, 85.0 * pow(0.992, {x}n))"


def deviation_blend(x):
    w = f"({x}sn / ({x}sn + 18.0))"
    return f"0.58 * ({w} * {x}s + (1 - {w}) * {x}o) + 0.42 * {x}o"


view("solved_plain", f"SELECT * FROM {fold_sql('fold_plain', plain_blend)}")
view("solved_service", f"SELECT * FROM {fold_sql('fold_service', service_blend)}")
view("solved_deviation", f"SELECT * FROM {fold_sql('fold_deviation', deviation_blend)}")

SOLVED_COLS = {"delta": "delta", "overall_w": "wo", "overall_l": "lo", "surface_w": "ws", "surface_l": "ls"}


def _solved_sql(src):
    return "SELECT match_id, " + ", ".join(f"{r6(s)} AS {n}" for n, s in SOLVED_COLS.items()) + f" FROM {src}"


def _solved(df):
    return df.select("match_id", *[rnd(n).alias(n) for n in SOLVED_COLS])


@query("w12_rating_fold", _solved_sql("solved_plain"))
def _(spark, d):
    return _solved(rt.solve_ratings(venue_parts(spark, d), rt.PLAIN))


@query("w12_rating_fold_service", _solved_sql("solved_service"))
def _(spark, d):
    return _solved(rt.solve_ratings(venue_parts(spark, d), rt.SERVICE))


@query("w13_rating_fold_deviation", _solved_sql("solved_deviation"))
def _(spark, d):
    return _solved(rt.solve_ratings(round_parts(spark, d), rt.DEVIATION))
