"""Queries over shared opponents."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.operators import opponents as op
from tallyspark.operators.batches import oriented
from tallyspark.plans.history import round_matches, with_static_residual
from tallyspark.plans.registry import query, r6, view
from tallyspark.plans.rows import FLIP_PLAIN, flip_of, rnd
from tallyspark.operators.state import derived_counts
from tallyspark.sources.fixtures import parts

view(
    "oriented_rb",
    f"""SELECT *, CASE WHEN f = 0 THEN loser ELSE winner END AS p1, CASE WHEN f = 0 THEN winner ELSE loser END AS p2,
        CASE WHEN f = 0 THEN 0 ELSE 1 END AS label, date_diff('day', DATE '2000-01-01', match_date) - 8000 AS dn
        FROM (SELECT *, {FLIP_PLAIN} AS f FROM rb)""",
)
view(
    "edge_rows",
    """SELECT pool, entity, opponent, batch_no, surface, won, residual, service_won / CAST(svpt AS DOUBLE) - 0.635 AS sres,
       CASE WHEN bp_faced > 3 THEN return_won / CAST(o_svpt AS DOUBLE) - 0.365 END AS rres, dn - 8000 AS dn,
       pow(2.0, (dn - 8000) / 730.0) AS g FROM edges_rb""",
)


def fixture_edges(p):
    service = F.col("service_won") / F.col("svpt") - 0.635
    back = F.when(F.col("bp_faced") > 3, F.col("return_won") / F.col("return_points") - 0.365)
    return with_static_residual(p).withColumn("serve_residual", service).withColumn("return_residual", back)


COMMON_SQL = """WITH side AS (SELECT m.match_id, m.surface AS msurf, {k} AS side, e.opponent AS o,
     sum(e.residual * e.g) / sum(e.g) AS result, coalesce(sum({sres} * e.g) / sum(CASE WHEN {sres} IS NOT NULL THEN e.g END), 0) AS serve,
     coalesce(sum({rres} * e.g) / sum(CASE WHEN {rres} IS NOT NULL THEN e.g END), 0) AS ret,
     coalesce(sum(CASE WHEN e.surface = m.surface THEN e.residual * e.g END) / sum(CASE WHEN e.surface = m.surface THEN e.g END), 0) AS sresult,
     sum(e.g) * pow(2.0, -max(e.dn) / 730.0) AS w
   FROM {src} m JOIN {edges} e ON e.pool = m.pool AND e.entity = m.{p} AND e.batch_no < m.batch_no GROUP BY ALL)"""


def common_sql(src="oriented_rb", edges="edge_rows"):
    one, two = (
        COMMON_SQL.format(k=k, p=p, src=src, edges=edges, sres="e.sres", rres="e.rres")[len("WITH side AS ") :]
        for k, p in ((1, "p1"), (2, "p2"))
    )
    return f"""WITH s1 AS {one}, s2 AS {two}, agg AS (SELECT match_id, count(*) AS shared, sum(least(s1.w, s2.w)) AS tw,
       sum(least(s1.w, s2.w) * (s1.result - s2.result)) AS a, sum(least(s1.w, s2.w) * (s1.serve - s2.serve)) AS b,
       sum(least(s1.w, s2.w) * (s1.ret - s2.ret)) AS c, sum(least(s1.w, s2.w) * (s1.sresult - s2.sresult)) AS d
       FROM s1 JOIN s2 USING (match_id, o) GROUP BY match_id)
     SELECT match_id, CAST(shared AS BIGINT) AS shared, (tw / (tw + 12.0)) * (shared / (shared + 4.0)) * a / tw AS common_result,
       (tw / (tw + 12.0)) * (shared / (shared + 4.0)) * b / tw AS common_serve,
       (tw / (tw + 12.0)) * (shared / (shared + 4.0)) * c / tw AS common_return,
       (tw / (tw + 12.0)) * (shared / (shared + 4.0)) * d / tw AS common_surface_result, least(1.0, tw / 20.0) AS common_weight
     FROM agg"""


COMMON_COLS = ("common_result", "common_serve", "common_return", "common_surface_result", "common_weight")


@query(
    "j4_common_opponents",
    f"SELECT match_id, shared, {', '.join(f'{r6(c)} AS {c}' for c in COMMON_COLS)} FROM ({common_sql()})",
)
def _(spark, d):
    m = oriented(round_matches(spark, d), flip_of())
    edges = fixture_edges(derived_counts(parts(spark, d, m)))
    out = op.common_opponents(m, edges)
    return out.select("match_id", "shared", *[rnd(c).alias(c) for c in COMMON_COLS])


def _record_side(k, p):
    return f"""(SELECT m.match_id, e.opponent AS o, (sum(e.won * e.g) * z + 3.0) / (sum(e.g) * z + 6.0) AS rate, sum(e.g) * z AS cnt,
      sum(e.residual * e.g) / sum(e.g) AS res, coalesce(sum(CASE WHEN e.surface = m.surface THEN e.g END) * z, 0) AS scnt,
      coalesce(sum(CASE WHEN e.surface = m.surface THEN e.residual * e.g END) / sum(CASE WHEN e.surface = m.surface THEN e.g END), 0) AS sresid
      FROM (SELECT *, pow(2.0, -dn / 730.0) AS z FROM oriented_rb) m JOIN edge_rows e ON e.pool = m.pool AND e.entity = m.{p}
      AND e.batch_no < m.batch_no GROUP BY m.match_id, e.opponent, z)"""


RECORD_SQL = f"""WITH s1 AS {_record_side(1, 'p1')}, s2 AS {_record_side(2, 'p2')}, w AS (SELECT match_id, s1.rate AS ra, s2.rate AS rb,
   s1.res - s2.res AS rd, s1.sresid - s2.sresid AS srd, least(2.0, sqrt(least(s1.cnt, s2.cnt))) AS w,
   least(1.5, sqrt(least(s1.scnt, s2.scnt))) AS sw FROM s1 JOIN s2 USING (match_id, o)),
   agg AS (SELECT match_id, CAST(count(*) AS DOUBLE) AS k, CAST(count(*) FILTER (sw > 0) AS DOUBLE) AS sk, sum(ra * w) / sum(w) AS ra,
   sum(rb * w) / sum(w) AS rb, sum(rd * w) / sum(w) AS rd, CASE WHEN sum(sw) > 0 THEN sum(srd * sw) / sum(sw) ELSE 0 END AS srd
   FROM w GROUP BY match_id)
   SELECT m.match_id, coalesce(k, 0.0) AS common_count, {r6('coalesce(ra, 0.0)')} AS winrate_1, {r6('coalesce(rb, 0.0)')} AS winrate_2,
   {r6('coalesce(k / (k + 8.0) * (ra - rb), 0.0)')} AS difference, {r6('coalesce(k / (k + 8.0) * rd, 0.0)')} AS adjusted_edge,
   coalesce(sk, 0.0) AS surface_count, {r6('coalesce(sk / (sk + 6.0) * srd, 0.0)')} AS surface_adjusted_edge
   FROM oriented_rb m LEFT JOIN agg USING (match_id)"""


@query("j5_opponent_records", RECORD_SQL)
def _(spark, d):
    m = oriented(round_matches(spark, d), flip_of())
    edges = fixture_edges(derived_counts(parts(spark, d, m)))
    out = op.opponent_records(m, edges)
    whole = ("common_count", "surface_count")
    return out.select("match_id", *[F.col(c) if c in whole else rnd(c).alias(c) for c in op.RECORD])
