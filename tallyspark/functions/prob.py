"""Win-probability expressions: ratings, points, games, sets, matches."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clamp(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def expected_score(a: Column, b: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.pow(F.lit(10.0), (b - a) / 400.0))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-clamp(x, -35.0, 35.0)))


def logit(p: Column, eps: float = 1e-6) -> Column:
    q = clamp(p, eps, 1.0 - eps)
    return F.log(q / (F.lit(1.0) - q))


def recency_weight(days: Column, half_life: float = 547.5) -> Column:
    return F.when(days <= 0, F.lit(1.0)).otherwise(F.exp(F.lit(-0.6931471805599453 / half_life) * days))


def game_from_point(point: Column) -> Column:
    """Probability of holding a game, deuce included."""
    p = clamp(point, 0.01, 0.99)
    q = F.lit(1.0) - p
    to_deuce = F.lit(20.0) * F.pow(p, F.lit(3)) * F.pow(q, F.lit(3))
    return F.pow(p, F.lit(4)) * (1 + 4 * q + 10 * q * q) + to_deuce * (p * p) / (p * p + q * q)


def match_from_set(set_p: Column, best_of: Column) -> Column:
    p = clamp(set_p, 0.01, 0.99)
    q = F.lit(1.0) - p
    return F.when(best_of == 5, F.pow(p, F.lit(3)) * (1 + 3 * q + 6 * q * q)).otherwise(p * p * (3 - 2 * p))


Monomials = dict[tuple[int, int, int, int], int]


def _expand(target: int, cap: int, a_serves) -> tuple[Monomials, Monomials]:
    """Walk the score lattice once, counting paths by how many serves each side won and lost.

    Returns (paths that side A wins, paths that reach cap-cap). The exponents are
    (A serve won, A serve lost, B serve won, B serve lost).
    """
    won: Monomials = {}
    tied: Monomials = {}
    frontier: dict[tuple[int, int], Monomials] = {(0, 0): {(0, 0, 0, 0): 1}}
    while frontier:
        following: dict[tuple[int, int], Monomials] = {}
        for (a, b), terms in frontier.items():
            serve_a = a_serves(a + b)
            for to_a in (True, False):
                score = (a + 1, b) if to_a else (a, b + 1)
                slot = (0 if to_a else 1) if serve_a else (3 if to_a else 2)
                if score[0] >= target and score[0] - score[1] >= 2:
                    sink = won
                elif score[1] >= target and score[1] - score[0] >= 2:
                    continue
                elif score == (cap, cap):
                    sink = tied
                else:
                    sink = following.setdefault(score, {})
                for exps, n in terms.items():
                    key = tuple(e + (i == slot) for i, e in enumerate(exps))
                    sink[key] = sink.get(key, 0) + n
        frontier = following
    return won, tied


@lru_cache(maxsize=None)
def set_monomials() -> tuple[Monomials, Monomials]:
    """Games to six, serve alternating, side A first; 6-6 left to the tiebreak term."""
    won, tied = _expand(6, 6, lambda total: total % 2 == 0)
    return won, tied


@lru_cache(maxsize=None)
def tiebreak_monomials() -> tuple[Monomials, Monomials]:
    """Points to seven; A serves the first point, then two each."""
    return _expand(7, 6, lambda total: total % 4 in (0, 3))


def _horner(node: dict, names: list[str]) -> Column:
    """Nested evaluation of a sparse polynomial, one variable per level."""
    if not names:
        return F.lit(float(node[()]))
    var = F.col(names[0])
    by_power: dict[int, dict] = {}
    for exps, n in node.items():
        by_power.setdefault(exps[0], {})[exps[1:]] = n
    total = None
    for power in range(max(by_power), -1, -1):
        if total is not None:
            total = total * var
        if power in by_power:
            term = _horner(by_power[power], names[1:])
            total = term if total is None else total + term
    return total


def with_set_from_holds(df: DataFrame, h1: str, h2: str, out: str) -> DataFrame:
    """Set probability of side 1, serving first; 6-6 resolves to ``.5 + .45 (h1 - h2)``."""
    won, tied = set_monomials()
    names = ["_a", "_na", "_b", "_nb"]
    staged = (
        df.withColumn("_a", clamp(F.col(h1), 0.01, 0.99))
        .withColumn("_b", clamp(F.col(h2), 0.01, 0.99))
        .withColumn("_na", 1.0 - F.col("_a"))
        .withColumn("_nb", 1.0 - F.col("_b"))
    )
    tail = F.lit(0.5) + F.lit(0.45) * (F.col("_a") - F.col("_b"))
    value = _horner(won, names) + _horner(tied, names) * tail
    return staged.withColumn(out, clamp(value, 0.0, 1.0)).drop(*names)


def with_tiebreak(df: DataFrame, pa: str, pb: str, out: str) -> DataFrame:
    """Exact first-to-seven, win-by-two tiebreak for side A, who serves first."""
    won, tied = tiebreak_monomials()
    names = ["_a", "_na", "_b", "_nb"]
    staged = (
        df.withColumn("_a", F.col(pa))
        .withColumn("_b", F.col(pb))
        .withColumn("_na", 1.0 - F.col(pa))
        .withColumn("_nb", 1.0 - F.col(pb))
    )
    pair_won = F.col("_a") * F.col("_nb")
    tail = pair_won / (pair_won + F.col("_na") * F.col("_b"))
    return staged.withColumn(out, _horner(won, names) + _horner(tied, names) * tail).drop(*names)


def with_exact_set(df: DataFrame, pa: str, pb: str, out: str) -> DataFrame:
    """Exact set probability of side A averaged over who serves first."""
    won, tied = set_monomials()
    names = ["_ha", "_na", "_hb", "_nb"]
    staged = with_tiebreak(with_tiebreak(df, pa, pb, "_tb_a"), pb, pa, "_tb_b")
    staged = (
        staged.withColumn("_ha", game_from_point(F.col(pa)))
        .withColumn("_hb", game_from_point(F.col(pb)))
        .withColumn("_na", 1.0 - F.col("_ha"))
        .withColumn("_nb", 1.0 - F.col("_hb"))
    )
    a_first = _horner(won, names) + _horner(tied, names) * F.col("_tb_a")
    mirrored = ["_hb", "_nb", "_ha", "_na"]
    b_first = 1.0 - (_horner(won, mirrored) + _horner(tied, mirrored) * F.col("_tb_b"))
    return staged.withColumn(out, 0.5 * (a_first + b_first)).drop(*names, "_tb_a", "_tb_b")


def with_match_from_points(df: DataFrame, p1: str, p2: str, best_of: str, out: str) -> DataFrame:
    """Service-point probabilities to a match probability clamped to [.01, .99]."""
    staged = df.withColumn("_h1", game_from_point(F.col(p1))).withColumn("_h2", game_from_point(F.col(p2)))
    staged = with_set_from_holds(staged, "_h1", "_h2", "_set")
    return staged.withColumn(out, clamp(match_from_set(F.col("_set"), F.col(best_of)), 0.01, 0.99)).drop(
        "_h1", "_h2", "_set"
    )


def service_point(first_in: Column, first_won: Column, second_won: Column) -> Column:
    return clamp(first_in * first_won + (1.0 - first_in) * second_won, 0.48, 0.78)


def shrunk_surface_rating(overall: Column, surface: Column, n: Column, k: float = 18.0) -> Column:
    w = F.when(n > 0, n / (n + F.lit(k))).otherwise(F.lit(0.0))
    return w * surface + (1.0 - w) * overall


def with_structural_probability(df: DataFrame, out: str) -> DataFrame:
    """Match probability from serve, return and shrunk surface ratings of both sides.

    Reads ``serve_{1,2}, return_{1,2}, shrunk_{1,2}, best_of``.
    """
    edge = clamp((F.col("shrunk_1") - F.col("shrunk_2")) / 2400.0, -0.05, 0.05)
    mix1 = 0.72 * F.col("serve_1") + 0.28 * (1.0 - F.col("return_2"))
    mix2 = 0.72 * F.col("serve_2") + 0.28 * (1.0 - F.col("return_1"))
    staged = (
        df.withColumn("_edge", edge)
        .withColumn("_pt1", clamp(clamp(mix1, 0.50, 0.77) + F.col("_edge"), 0.50, 0.80))
        .withColumn("_pt2", clamp(clamp(mix2, 0.50, 0.77) - F.col("_edge"), 0.50, 0.80))
    )
    return with_match_from_points(staged, "_pt1", "_pt2", "best_of", out).drop("_edge", "_pt1", "_pt2")


def with_latent_probability(df: DataFrame, service_prior: Column, out: str) -> DataFrame:
    """Match probability from surface serve and return skills (logit offsets) of both sides."""
    base = logit(service_prior)
    staged = df.withColumn(
        "_pt1", clamp(sigmoid(base + F.col("surface_serve_1") - F.col("surface_return_2")), 0.50, 0.80)
    ).withColumn("_pt2", clamp(sigmoid(base + F.col("surface_serve_2") - F.col("surface_return_1")), 0.50, 0.80))
    return with_match_from_points(staged, "_pt1", "_pt2", "best_of", out).drop("_pt1", "_pt2")


def with_rating_probability(df: DataFrame, r1: str, r2: str, best_of: str, out: str) -> DataFrame:
    """Blend of the point-to-match chain and the rating prior; two sides with blended ratings."""
    edge = clamp((F.col(r1) - F.col(r2)) / 1150.0, -0.11, 0.11)
    staged = (
        df.withColumn("_edge", edge)
        .withColumn("_h1", game_from_point(clamp(0.635 + F.col("_edge"), 0.50, 0.78)))
        .withColumn("_h2", game_from_point(clamp(0.635 - F.col("_edge"), 0.50, 0.78)))
    )
    staged = with_set_from_holds(staged, "_h1", "_h2", "_set")
    chain = match_from_set(F.col("_set"), F.col(best_of))
    value = clamp(0.62 * chain + 0.38 * expected_score(F.col(r1), F.col(r2)), 0.02, 0.98)
    return staged.withColumn(out, value).drop("_edge", "_h1", "_h2", "_set")


def with_rating_probability_smooth(df: DataFrame, r1: str, r2: str, best_of: str, out: str) -> DataFrame:
    """The same blend with a logistic set step, as used by the sequential backtest."""
    edge = clamp((F.col(r1) - F.col(r2)) / 1150.0, -0.11, 0.11)
    staged = (
        df.withColumn("_edge", edge)
        .withColumn("_h1", game_from_point(clamp(0.635 + F.col("_edge"), 0.50, 0.78)))
        .withColumn("_h2", game_from_point(clamp(0.635 - F.col("_edge"), 0.50, 0.78)))
        .withColumn("_set", sigmoid((F.col("_h1") - F.col("_h2")) * 3.4))
    )
    chain = match_from_set(F.col("_set"), F.col(best_of))
    value = clamp(0.62 * chain + 0.38 * expected_score(F.col(r1), F.col(r2)), 0.02, 0.98)
    return staged.withColumn(out, value).drop("_edge", "_h1", "_h2", "_set")
