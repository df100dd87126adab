"""Queries over probability expressions and draws."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.functions import prob
from tallyspark.operators import draws, resample
from tallyspark.plans.registry import query, r6, view
from tallyspark.plans.rows import rnd
from tallyspark.sources.fixtures import entrants, matches

view(
    "duels",
    """SELECT match_id, pool, best_of, 0.50 + (winner % 29) / 100.0 AS pa, 0.50 + (loser % 29) / 100.0 AS pb,
       1500.0 + 2 * (winner % 200) AS ra, 1500.0 + 2 * (loser % 200) AS rb, 0.30 + (winner % 13) / 100.0 AS qa,
       0.30 + (loser % 13) / 100.0 AS qb, (winner % 21 - 10) / 50.0 AS za, (loser % 21 - 10) / 50.0 AS zb FROM matches""",
)


def duels(spark, d):
    m = matches(spark, d)
    both = {}
    for c, who in (("a", F.col("winner")), ("b", F.col("loser"))):
        both |= {
            f"p{c}": 0.50 + (who % 29) / 100.0,
            f"r{c}": 1500.0 + 2 * (who % 200),
            f"q{c}": 0.30 + (who % 13) / 100.0,
            f"z{c}": (who % 21 - 10) / 50.0,
        }
    return m.select("match_id", "pool", "best_of", *[v.alias(k) for k, v in both.items()])


def clamp_sql(x, lo, hi):
    return f"greatest({lo}, least({hi}, {x}))"


def game_sql(p):
    c = f"({clamp_sql(p, 0.01, 0.99)})"
    q = f"(1 - {c})"
    return (
        f"(pow({c}, 4) * (1 + 4 * {q} + 10 * {q} * {q}) + 20 * pow({c}, 3) * pow({q}, 3) * {c} * {c} / ({c} * {c} + {q} * {q}))"
    )


def match_sql(s, best_of="best_of"):
    c = f"({clamp_sql(s, 0.01, 0.99)})"
    return f"CASE {best_of} WHEN 5 THEN pow({c}, 3) * (1 + 3 * (1 - {c}) + 6 * (1 - {c}) * (1 - {c})) ELSE {c} * {c} * (3 - 2 * {c}) END"


def walk_sql(src: str, target: int, unit) -> str:
    """Forward walk over the score lattice, one nested select per played unit.

    ``unit(total)`` is the SQL chance that side A takes the next unit. Adds ``won`` (A has won) and
    ``tied`` (level at 6-6).
    """
    cur = f"(SELECT *, CAST(1 AS DOUBLE) AS s0_0, CAST(0 AS DOUBLE) AS won FROM {src})"
    alive = [(0, 0)]
    total = 0
    tie = []
    while alive:
        nxt: dict[tuple[int, int], list[str]] = {}
        won = []
        for a, b in alive:
            for to_a in (True, False):
                sc = (a + 1, b) if to_a else (a, b + 1)
                term = f"s{a}_{b} * {unit(total) if to_a else f'(1 - {unit(total)})'}"
                if sc[0] >= target and sc[0] - sc[1] >= 2:
                    won.append(term)
                elif sc[1] >= target and sc[1] - sc[0] >= 2:
                    continue
                else:
                    nxt.setdefault(sc, []).append(term)
        gone = ", ".join(f"s{a}_{b}" for a, b in alive)
        cols = [f"{' + '.join(t)} AS {'tied' if sc == (6, 6) else f's{sc[0]}_{sc[1]}'}" for sc, t in nxt.items()]
        total_won = " + ".join(["won", *won])
        cur = f"(SELECT * EXCLUDE (won, {gone}), {', '.join([f'{total_won} AS won', *cols])} FROM {cur})"
        alive = [sc for sc in nxt if sc != (6, 6)]
        total += 1
    return cur


def set_sql(src: str, h1: str, h2: str) -> str:
    """``src`` plus ``setp`` from hold probabilities (side 1 serving first)."""
    base = f"(SELECT *, {clamp_sql(h1, 0.01, 0.99)} AS wh1, {clamp_sql(h2, 0.01, 0.99)} AS wh2 FROM {src})"
    w = walk_sql(base, 6, lambda t: "wh1" if t % 2 == 0 else "(1 - wh2)")
    return f"(SELECT * EXCLUDE (won, tied), won + tied * (0.5 + 0.45 * (wh1 - wh2)) AS setp FROM {w})"


def match_from_points_sql(src: str, p1: str, p2: str, out: str) -> str:
    held = f"(SELECT *, {game_sql(p1)} AS gh1, {game_sql(p2)} AS gh2 FROM {src})"
    return f"(SELECT * EXCLUDE (gh1, gh2, wh1, wh2, setp), {clamp_sql(match_sql('setp'), 0.01, 0.99)} AS {out} FROM {set_sql(held, 'gh1', 'gh2')})"


def tiebreak_sql(src: str, pa: str, pb: str, out: str) -> str:
    w = walk_sql(src, 7, lambda t: pa if t % 4 in (0, 3) else f"(1 - {pb})")
    tail = f"({pa} * (1 - {pb}) / ({pa} * (1 - {pb}) + (1 - {pa}) * {pb}))"
    return f"(SELECT * EXCLUDE (won, tied), won + tied * {tail} AS {out} FROM {w})"


def exact_set_sql(src: str) -> str:
    tb = tiebreak_sql(tiebreak_sql(src, "pa", "pb", "tba"), "pb", "pa", "tbb")
    held = f"(SELECT *, {game_sql('pa')} AS gha, {game_sql('pb')} AS ghb FROM {tb})"
    a = walk_sql(held, 6, lambda t: "gha" if t % 2 == 0 else "(1 - ghb)")
    a = f"(SELECT * EXCLUDE (won, tied), won + tied * tba AS af FROM {a})"
    b = walk_sql(a, 6, lambda t: "ghb" if t % 2 == 0 else "(1 - gha)")
    return f"(SELECT * EXCLUDE (won, tied), 0.5 * (af + 1 - (won + tied * tbb)) AS setp FROM {b})"


@query("m1_expected_score", f"SELECT match_id, {r6('1 / (1 + pow(10.0, (rb - ra) / 400.0))')} AS p FROM duels")
def _(spark, d):
    return duels(spark, d).select("match_id", rnd(prob.expected_score(F.col("ra"), F.col("rb"))).alias("p"))


@query(
    "m2_sigmoid_logit",
    f"""SELECT match_id, {r6('1 / (1 + exp(-greatest(-35, least(35, za * 200))))')} AS s,
        {r6('ln(greatest(1e-6, least(1 - 1e-6, pa * 1.4 - 0.4)) / (1 - greatest(1e-6, least(1 - 1e-6, pa * 1.4 - 0.4))))')} AS l FROM duels""",
)
def _(spark, d):
    out = duels(spark, d)
    return out.select(
        "match_id", rnd(prob.sigmoid(F.col("za") * 200)).alias("s"), rnd(prob.logit(F.col("pa") * 1.4 - 0.4)).alias("l")
    )


@query("m3_game", f"SELECT match_id, {r6(game_sql('pa'))} AS hold FROM duels")
def _(spark, d):
    return duels(spark, d).select("match_id", rnd(prob.game_from_point(F.col("pa"))).alias("hold"))


@query("m4_set_from_holds", f"SELECT match_id, {r6('setp')} AS set_p FROM {set_sql('duels', 'pa', 'pb')}")
def _(spark, d):
    return prob.with_set_from_holds(duels(spark, d), "pa", "pb", "s").select("match_id", rnd("s").alias("set_p"))


@query("m5_match_from_set", f"SELECT match_id, {r6(match_sql('pa'))} AS m FROM duels")
def _(spark, d):
    return duels(spark, d).select("match_id", rnd(prob.match_from_set(F.col("pa"), F.col("best_of"))).alias("m"))


@query("m6_exact_tiebreak", f"SELECT match_id, {r6('tb')} AS tb FROM {tiebreak_sql('duels', 'pa', 'pb', 'tb')}")
def _(spark, d):
    return prob.with_tiebreak(duels(spark, d), "pa", "pb", "tb").select("match_id", rnd("tb").alias("tb"))


@query(
    "m7_exact_match",
    f"SELECT match_id, {r6('setp')} AS set_p, {r6(match_sql('setp'))} AS match_p FROM {exact_set_sql('duels')}",
)
def _(spark, d):
    out = prob.with_exact_set(duels(spark, d), "pa", "pb", "s")
    return out.select("match_id", rnd("s").alias("set_p"), rnd(prob.match_from_set(F.col("s"), F.col("best_of"))).alias("match_p"))


STRUCT_EDGE = clamp_sql("(ra - rb) / 2400.0", -0.05, 0.05)
STRUCT_1 = clamp_sql(f"{clamp_sql('0.72 * pa + 0.28 * (1 - qb)', 0.50, 0.77)} + {STRUCT_EDGE}", 0.50, 0.80)
STRUCT_2 = clamp_sql(f"{clamp_sql('0.72 * pb + 0.28 * (1 - qa)', 0.50, 0.77)} - {STRUCT_EDGE}", 0.50, 0.80)


@query("m8_structural", f"SELECT match_id, {r6('p')} AS p FROM {match_from_points_sql('duels', STRUCT_1, STRUCT_2, 'p')}")
def _(spark, d):
    names = {"serve_1": "pa", "serve_2": "pb", "return_1": "qa", "return_2": "qb", "shrunk_1": "ra", "shrunk_2": "rb"}
    x = duels(spark, d).withColumns({k: F.col(v) for k, v in names.items()})
    return prob.with_structural_probability(x, "p").select("match_id", rnd("p").alias("p"))


PRIOR_SQL = "(CASE pool WHEN 'north' THEN 0.635 ELSE 0.605 END)"


def latent_sql(s, r):
    return clamp_sql(f"1 / (1 + exp(-(ln({PRIOR_SQL} / (1 - {PRIOR_SQL})) + {s} - {r})))", 0.50, 0.80)


@query(
    "m9_latent_match",
    f"SELECT match_id, {r6('p')} AS p FROM {match_from_points_sql('duels', latent_sql('za', 'zb / 2'), latent_sql('zb', 'za / 2'), 'p')}",
)
def _(spark, d):
    x = duels(spark, d).withColumns(
        {
            "surface_serve_1": F.col("za"),
            "surface_serve_2": F.col("zb"),
            "surface_return_1": F.col("za") / 2,
            "surface_return_2": F.col("zb") / 2,
        }
    )
    prior = F.when(F.col("pool") == "north", 0.635).otherwise(0.605)
    return prob.with_latent_probability(x, prior, "p").select("match_id", rnd("p").alias("p"))


EDGE = clamp_sql("(ra - rb) / 1150.0", -0.11, 0.11)
POINT_1, POINT_2 = clamp_sql(f"0.635 + {EDGE}", 0.50, 0.78), clamp_sql(f"0.635 - {EDGE}", 0.50, 0.78)
PRIOR_E = "1 / (1 + pow(10.0, (rb - ra) / 400.0))"
HELD = f"(SELECT *, {game_sql(POINT_1)} AS h1, {game_sql(POINT_2)} AS h2 FROM duels)"


@query(
    "m10_rating_match",
    f"""SELECT match_id, {r6(clamp_sql(f"0.62 * ({match_sql('setp')}) + 0.38 * {PRIOR_E}", 0.02, 0.98))} AS chain,
        {r6(clamp_sql(f"0.62 * ({match_sql('(1 / (1 + exp(-(h1 - h2) * 3.4)))')}) + 0.38 * {PRIOR_E}", 0.02, 0.98))} AS smooth
        FROM {set_sql(HELD, 'h1', 'h2')}""",
)
def _(spark, d):
    x = prob.with_rating_probability(duels(spark, d), "ra", "rb", "best_of", "chain")
    x = prob.with_rating_probability_smooth(x, "ra", "rb", "best_of", "smooth")
    return x.select("match_id", rnd("chain").alias("chain"), rnd("smooth").alias("smooth"))


@query("m11_posterior_match")
def _(spark, d):
    m = matches(spark, d)
    won = lambda c: (F.lit(50) + F.col(c) % 20).cast("double")
    x = m.select(
        "match_id",
        "best_of",
        won("winner").alias("alpha_1"),
        F.lit(35.0).alias("beta_1"),
        won("loser").alias("alpha_2"),
        F.lit(39.0).alias("beta_2"),
    )
    out = resample.posterior_match(x, ["match_id"])
    return out.select("match_id", *[rnd(c).alias(c) for c in ("mean", "variance", "low", "high")])


@query(
    "m12_baselines",
    f"SELECT match_id, {r6('1 / (1 + exp(-2.2 * (ra - rb) / 400.0))')} AS rating, {r6('1 / (1 + exp(-9.0 * (pa - pb)))')} AS serve FROM duels",
)
def _(spark, d):
    x = duels(spark, d)
    return x.select(
        "match_id",
        rnd(prob.sigmoid(2.2 * (F.col("ra") - F.col("rb")) / 400.0)).alias("rating"),
        rnd(prob.sigmoid(9.0 * (F.col("pa") - F.col("pb")))).alias("serve"),
    )


# ---- draws -----------------------------------------------------------------------------


def strength_probability(a, b):
    return 1.0 / (1.0 + F.pow(F.lit(10.0), (b - a) / 4000.0))


view(
    "good_draws",
    """SELECT e.*, g.size FROM entrants e JOIN (SELECT draw_id, count(*) AS size FROM entrants GROUP BY draw_id
       HAVING count(*) IN (2, 4, 8) AND count(DISTINCT lower(trim(name))) = count(*)) g USING (draw_id)""",
)
view(
    "pair_p",
    """SELECT a.draw_id, a.slot AS i, b.slot AS j, 1 / (1 + pow(10.0, (b.strength - a.strength) / 4000.0)) AS p
       FROM good_draws a JOIN good_draws b ON a.draw_id = b.draw_id AND a.slot <> b.slot""",
)


@query("j9_draw_pairs", f"SELECT draw_id, i, j, {r6('p')} AS p FROM pair_p")
def _(spark, d):
    out = draws.pair_table(draws.valid_entrants(entrants(spark, d)), strength_probability)
    return out.select("draw_id", "i", "j", rnd("p").alias("p"))


@query(
    "m13_bracket_advancement",
    f"""WITH r1 AS (SELECT e.draw_id, e.slot, e.size, p.p FROM good_draws e JOIN pair_p p ON p.draw_id = e.draw_id AND p.i = e.slot
        AND p.j // 2 = e.slot // 2),
      r2 AS (SELECT a.draw_id, a.slot, a.size, a.p * sum(b.p * q.p) AS p FROM r1 a JOIN r1 b ON a.draw_id = b.draw_id AND a.slot // 4 = b.slot // 4
        AND a.slot // 2 <> b.slot // 2 JOIN pair_p q ON q.draw_id = a.draw_id AND q.i = a.slot AND q.j = b.slot GROUP BY a.draw_id, a.slot, a.size, a.p),
      r3 AS (SELECT a.draw_id, a.slot, a.size, a.p * sum(b.p * q.p) AS p FROM r2 a JOIN r2 b ON a.draw_id = b.draw_id AND a.slot // 4 <> b.slot // 4
        JOIN pair_p q ON q.draw_id = a.draw_id AND q.i = a.slot AND q.j = b.slot GROUP BY a.draw_id, a.slot, a.size, a.p)
      SELECT draw_id, slot, CASE players WHEN 8 THEN 'QF' WHEN 4 THEN 'SF' ELSE 'Final' END AS round, {r6('p')} AS p FROM
      (SELECT draw_id, slot, size AS players, p FROM r1 UNION ALL SELECT draw_id, slot, size // 2, p FROM r2 UNION ALL
       SELECT draw_id, slot, size // 4, p FROM r3)""",
)
def _(spark, d):
    e = draws.valid_entrants(entrants(spark, d))
    out = draws.advancement(e, draws.pair_table(e, strength_probability))
    return out.select("draw_id", "slot", "round", rnd("p").alias("p"))


@query(
    "m14_draw_validation",
    """WITH e AS (SELECT CASE WHEN c_custkey % 50 = 0 THEN (c_custkey + 8) // 8 ELSE c_custkey // 8 END AS draw_id,
       CASE WHEN c_custkey % 80 = 1 THEN 'dup' ELSE lower(c_name) END AS name, c_custkey AS slot FROM customer)
       SELECT draw_id, CAST(count(*) AS BIGINT) AS size, CAST(count(DISTINCT name) AS BIGINT) AS names,
       CASE WHEN count(*) BETWEEN 2 AND 128 AND (count(*) & (count(*) - 1)) = 0 AND count(DISTINCT name) = count(*) THEN 1 ELSE 0 END
       AS valid FROM (SELECT * FROM e UNION ALL SELECT draw_id, 'dup', -slot FROM e WHERE name = 'dup') GROUP BY draw_id""",
)
def _(spark, d):
    from tallyspark.sources.fixtures import div, table

    k = F.col("c_custkey")
    e = table(spark, d, "customer").select(
        F.when(k % 50 == 0, div(k + 8, 8)).otherwise(div(k, 8)).alias("draw_id"),
        F.when(k % 80 == 1, " Dup ").otherwise(F.col("c_name")).alias("name"),
        k.alias("slot"),
    )
    again = e.where(F.trim("name") == "Dup").select("draw_id", F.lit("dUP").alias("name"), (-F.col("slot")).alias("slot"))
    return draws.validate_draws(e.unionByName(again))
