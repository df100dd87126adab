"""Pre-match feature rows assembled from state, ratings, shared opponents and probabilities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions import scores
from tallyspark.functions.prob import (
    logit,
    service_point,
    shrunk_surface_rating,
    with_latent_probability,
    with_structural_probability,
)
from tallyspark.operators import ratings as rt
from tallyspark.operators import state as st
from tallyspark.operators.batches import paired
from tallyspark.operators.opponents import common_opponents
from tallyspark.operators.prefix import numbers_first, prior_totals
from tallyspark.session import dealt, only

# Feature families, the other features of the full row, named sets, and what the service can compute.
FAMILIES: dict[str, tuple[str, ...]] = {
    "rating": ("overall_elo_diff", "surface_elo_shrunk_diff", "rating_rd_diff", "rating_uncertainty_sum"),
    "ranking": ("ranking_diff", "ranking_points_diff", "rank_known"),
    "serve_return": (
        "serve_strength_diff",
        "return_strength_diff",
        "serve_return_edge",
        "first_in_diff",
        "first_won_diff",
        "second_won_diff",
        "ace_rate_diff",
        "df_rate_diff",
        "return_point_won_diff",
        "serve_point_won_diff",
        "stat_sample_diff",
    ),
    "latent_serve_return": (
        "latent_serve_skill_diff",
        "latent_return_skill_diff",
        "latent_surface_serve_skill_diff",
        "latent_surface_return_skill_diff",
        "latent_uncertainty_sum",
        "latent_exact_match_logit",
    ),
    "common_opponent_v2": (
        "common_opponent_result_residual_diff",
        "common_opponent_serve_residual_diff",
        "common_opponent_return_residual_diff",
        "common_opponent_surface_residual_diff",
        "common_opponent_match_weight",
    ),
    "form": ("residual_form_short_diff", "residual_form_medium_diff", "surface_residual_form_diff"),
    "fatigue": ("days_rest_diff", "recovery_curve_diff", "workload_3d_diff", "workload_7d_diff", "workload_14d_diff"),
    "score": ("score_dominance_diff", "set_dominance_diff", "tiebreak_strength_diff"),
    "bio": ("age_diff", "height_diff", "lefty_matchup", "same_hand"),
    "h2h": ("h2h_prior_diff", "surface_h2h_prior_diff"),
    "context": ("best_of_5", "is_indoor", "level_g", "level_m", "level_500", "level_250", "round_final", "round_sf", "round_qf"),
}
LOOSE = (
    "surface_elo_diff",
    "matches_diff",
    "match_count_log_diff",
    "surface_sample_diff",
    "data_strength_diff",
    "bp_save_diff",
    "bp_convert_diff",
    "structural_match_logit",
)
FULL = tuple(f for g in FAMILIES.values() for f in g) + LOOSE
NOT_SERVED = (*FAMILIES["h2h"], *FAMILIES["common_opponent_v2"], *(f for f in FAMILIES["context"] if f != "best_of_5"))
RUNTIME_SAFE = tuple(f for f in FULL if f not in NOT_SERVED)
_PLUS = ("best_of_5", "matches_diff")
NAMED_SETS: dict[str, tuple[str, ...]] = {
    "enhanced_full": FULL,
    "enhanced_runtime_safe": RUNTIME_SAFE,
    "compact_production_reference": (
        "overall_elo_diff",
        "surface_elo_shrunk_diff",
        "matches_diff",
        "ranking_diff",
        "ranking_points_diff",
        "days_rest_diff",
        "workload_14d_diff",
        "h2h_prior_diff",
        "surface_h2h_prior_diff",
        "best_of_5",
    ),
    "rating_ranking_structural": (*FAMILIES["rating"], *FAMILIES["ranking"], "structural_match_logit", *_PLUS),
    "exact_scoring_expert": ("latent_exact_match_logit", "structural_match_logit", "best_of_5"),
    "serve_return_structural": (*FAMILIES["serve_return"], *FAMILIES["latent_serve_return"], *_PLUS),
    "common_opponent_plus_core": (*FAMILIES["rating"], *FAMILIES["ranking"], *FAMILIES["serve_return"], *FAMILIES["common_opponent_v2"], *_PLUS),
}
# Families that are also tried by leaving them out.
LEFT_OUT = ("h2h", "form", "serve_return", "latent_serve_return", "common_opponent_v2", "fatigue", "score", "bio", "context")
# Rungs of the cumulative ladder; what the full row does not have is left out of them.
RUNGS: dict[str, tuple[str, ...]] = {
    "M0": ("overall_elo_diff", "surface_elo_diff", "surface_elo_shrunk_diff", "ranking_diff", "ranking_points_diff", "rank_known", "matches_diff"),
    "M1": ("rating_rd_diff", "rating_uncertainty_sum", "surface_sample_diff", "match_count_log_diff"),
    "M2": (
        *("serve_strength_diff", "return_strength_diff", "serve_return_edge", "first_in_diff", "first_won_diff", "second_won_diff", "ace_rate_diff", "df_rate_diff"),
        *("return_point_won_diff", "serve_point_won_diff", "stat_sample_diff", "latent_serve_skill_diff", "latent_return_skill_diff"),
        *("latent_surface_serve_skill_diff", "latent_surface_return_skill_diff", "latent_uncertainty_sum"),
    ),
    "M3": ("form_5_diff", "form_10_diff", "form_20_diff", "surface_form_diff", "residual_form_short_diff", "residual_form_medium_diff", "surface_residual_form_diff"),
    "M4": ("structural_match_logit", "latent_exact_match_logit", "best_of_5"),
    "M5": ("score_dominance_diff", "set_dominance_diff", "tiebreak_strength_diff", "days_rest_diff", "recovery_curve_diff", "workload_3d_diff", "workload_7d_diff", "workload_14d_diff"),
    "M6": (
        *("h2h_prior_diff", "surface_h2h_prior_diff", "common_opponent_result_residual_diff", "common_opponent_serve_residual_diff"),
        *("common_opponent_return_residual_diff", "common_opponent_surface_residual_diff", "common_opponent_match_weight"),
    ),
    "M7": (),
    "M8": (
        *("age_diff", "height_diff", "lefty_matchup", "same_hand", "is_indoor", "level_g", "level_m", "level_500", "level_250"),
        *("round_final", "round_sf", "round_qf", "data_strength_diff"),
    ),
}
# Two older feature rows and the columns that go with every row.
BASIC = (
    "overall_elo_diff",
    "surface_elo_diff",
    "form_5_diff",
    "form_10_diff",
    "form_20_diff",
    "surface_form_diff",
    "matches_diff",
    "ranking_diff",
    "ranking_points_diff",
    "ace_rate_diff",
    "df_rate_diff",
    "first_in_diff",
    "first_won_diff",
    "second_won_diff",
    "bp_save_diff",
    "bp_convert_diff",
    "return_point_won_diff",
    "serve_point_won_diff",
    "stat_sample_diff",
    "days_rest_diff",
    "workload_14d_diff",
    "h2h_prior_diff",
    "surface_h2h_prior_diff",
    "best_of_5",
)
MINIMAL = (
    "overall_elo_diff",
    "surface_elo_diff",
    "form_5_diff",
    "form_10_diff",
    "days_rest_diff",
    "h2h_prior_diff",
    "best_of_5",
)
META = ("match_id", "pool", "match_date", "venue", "surface", "p1", "p2", "label")


def _side(df: DataFrame, other: DataFrame, keys: Sequence[str] = st.ENTITY) -> DataFrame:
    return df.join(other, [*numbers_first(df, keys), "batch_no"])


def _diff(c: str) -> Column:
    return F.col(f"{c}_1") - F.col(f"{c}_2")


def _pair_wins(m: DataFrame) -> DataFrame:
    """Earlier wins of p1 over p2 and back, overall and on the surface."""
    keyed = m.withColumn("lo", F.least("p1", "p2")).withColumn("hi", F.greatest("p1", "p2"))
    out = keyed.join(st.head_to_head(m), ["pool", "lo", "hi", "batch_no"]).join(
        st.head_to_head(m, True), ["pool", "lo", "hi", "surface", "batch_no"]
    )
    low = F.col("p1") == F.col("lo")
    pick = lambda a, b: F.when(low, F.col(a)).otherwise(F.col(b))
    return out.select(
        *m.columns,
        pick("lo_wins", "hi_wins").alias("h2h_1"),
        pick("hi_wins", "lo_wins").alias("h2h_2"),
        pick("slo_wins", "shi_wins").alias("sh2h_1"),
        pick("shi_wins", "slo_wins").alias("sh2h_2"),
    )


def basic_features(m: DataFrame, parts: DataFrame) -> DataFrame:
    """The 24-column difference row; ``m`` is oriented and numbered by venue batch."""
    rates = [s.name for s in st.SERVE_STATS]

    def sides() -> DataFrame:
        p = dealt(only(lambda: _with_changes(parts, rt.solve_ratings(parts, rt.PLAIN), rt.PLAIN)))
        career = [st.cumulative_measures(), st.count_rest_measures(14.0, 60.0), rt.overall_measures()]
        form = dealt(only(lambda: st.recent_form(p, st.ENTITY, (5, 10, 20))))
        on = dealt(only(lambda: st.recent_form(p, st.ENTITY_SURFACE, (10,)).withColumnRenamed("form_10", "surface_form")))
        rows = p.select("match_id", *st.ENTITY_SURFACE, "batch_no", "p1")
        # what meets on the surface is written first: the other state tables share one key, and only their shuffles stand at once
        s = dealt(only(lambda: _side(_side(rows, st.state_table(p, st.ENTITY_SURFACE, [rt.surface_measures()]), st.ENTITY_SURFACE), on, st.ENTITY_SURFACE)))
        s = _side(s, st.state_table(p, st.ENTITY, career))
        s = _side(s, form)
        s = _side(s, st.workload(p, (14,), keep=40))
        return _side(s, st.carried_metadata_last_row(p, "batch_no"))

    s = dealt(only(sides))
    cols = [*rates, "stat_sample", "n_before", "days_rest", "form_5", "form_10", "form_20", "surface_form"]
    cols += ["workload_14d", "ranking", "ranking_points", "overall", "on_surface"]
    wide = paired(s, ["match_id"], cols, F.col("entity") == F.col("p1"))
    x = _pair_wins(m).join(wide, "match_id")
    cap = lambda i: F.least(F.col(f"n_before_{i}"), F.lit(300))
    rank = lambda i: F.coalesce(F.col(f"ranking_{i}"), F.lit(999.0))
    points = lambda i: F.coalesce(F.col(f"ranking_points_{i}"), F.lit(0.0))
    out = {
        "overall_elo_diff": _diff("overall") / 400.0,
        "surface_elo_diff": _diff("on_surface") / 400.0,
        **{f"{c}_diff": _diff(c) for c in ("form_5", "form_10", "form_20", "surface_form", *rates, "stat_sample")},
        "matches_diff": (cap(1) - cap(2)) / 300.0,
        "ranking_diff": (rank(2) - rank(1)) / 998.0,
        "ranking_points_diff": (points(1) - points(2)) / 12000.0,
        "days_rest_diff": _diff("days_rest") / 60.0,
        "workload_14d_diff": _diff("workload_14d") / 8.0,
        "h2h_prior_diff": _diff("h2h") / 10.0,
        "surface_h2h_prior_diff": _diff("sh2h") / 10.0,
        "best_of_5": (F.col("best_of") == 5).cast("double"),
    }
    return x.select(*META, *[out[f].alias(f) for f in BASIC])


DECAYED_SCORE = (
    st.DecaySpec("score_dominance", "game_edge", 540.0),
    st.DecaySpec("set_dominance", "set_edge", 540.0),
    st.DecaySpec("tiebreak_strength", "tiebreak_edge", 900.0),
)
RESIDUAL_FORM = (
    st.DecaySpec("residual_form_short", "residual", 90.0),
    st.DecaySpec("residual_form_medium", "residual", 365.0),
)
SURFACE_FORM = (st.DecaySpec("surface_residual_form", "residual", 365.0),)
LATENT_STATS = tuple(s for s in st.DECAYED_STATS if s.name in ("serve_points", "service_won", "return_won"))
STATE_RATES = {
    "ace_rate": ("aces", 0.055, 120.0),
    "df_rate": ("double_faults", 0.035, 120.0),
    "first_in": ("first_in", 0.62, 120.0),
    "first_won": ("first_won", 0.72, 120.0),
    "second_won": ("second_won", 0.52, 120.0),
    "bp_save": ("bp_saved", 0.58, 40.0),
    "bp_convert": ("bp_converted", 0.40, 40.0),
    "return_strength": ("return_won", 0.365, 120.0),
}


def with_score_edges(parts: DataFrame) -> DataFrame:
    """Game, set and tiebreak margins seen from each side."""
    sign = F.when(F.col("won") == 1, 1.0).otherwise(-1.0)
    s = parts.withColumn("_sets", scores.score_sets(F.col("score")))
    s = s.withColumns(scores.score_columns(F.col("_sets"))).drop("_sets")
    mg = scores.margins()
    return s.withColumns(
        {
            "game_edge": mg["game_margin"] * sign,
            "set_edge": mg["set_margin"] * sign,
            "tiebreak_edge": F.when(F.col("tiebreaks") > 0, sign),
        }
    )


def _with_changes(parts: DataFrame, solved: DataFrame, spec: rt.RatingSpec) -> DataFrame:
    """``parts`` with the rating change of every side, to be summed by the scans that read them anyway."""
    changes = rt.rating_changes(solved, spec).select("match_id", "entity", "d_overall", "d_surface")
    return parts.join(changes, ["match_id", "entity"])


def side_tables(
    parts: DataFrame, service_prior: Column, spec: rt.RatingSpec = rt.DEVIATION, solved: DataFrame | None = None, cols: Sequence[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """``side_state`` as two staged tables that share ``_row`` and the keys, so that nobody has to deal the wide one by row.

    The first holds the ratings, rates and means of a side, or those of them that are in ``cols``. The second holds its
    residuals and what meets them by other keys: residual form, workload and metadata.
    """

    def state() -> DataFrame:
        ratings = rt.solve_ratings(parts, spec) if solved is None else solved
        p = dealt(only(lambda: _with_changes(parts, ratings, spec)))
        scored = with_score_edges(p)
        first = st.state_table(
            scored,
            st.ENTITY,
            [st.decayed_count_measures(st.DECAYED_STATS), st.count_rest_measures(), st.decayed_mean_measures(DECAYED_SCORE), rt.overall_measures()],
        )
        on = st.state_table(p, st.ENTITY_SURFACE, [st.decayed_count_measures(LATENT_STATS, "f_"), rt.surface_measures()])
        keep = ["match_id", *st.ENTITY, "opponent", "surface", "batch_no", "venue_no", "match_date", "won", "p1"]
        raw = ["svpt", "service_won", "return_won", "return_points"]
        s = p.select(*keep, *[F.col(c).alias(f"raw_{c}") for c in raw])
        s = _side(dealt(only(lambda: _side(s, on, st.ENTITY_SURFACE))), first)
        rates = {n: st.decayed_rate(*v) for n, v in STATE_RATES.items()}
        s = s.withColumns(rates | st.latent_skills(service_prior) | {"rd": st.rating_deviation(F.col("n_before"))})
        s = s.withColumn("serve_strength", service_point(F.col("first_in"), F.col("first_won"), F.col("second_won")))
        s = s.withColumn("shrunk", shrunk_surface_rating(F.col("overall"), F.col("on_surface"), F.col("surface_n")))
        s = s.withColumn("blended", rt.blend(spec, F.col("overall"), F.col("on_surface"), F.col("surface_n"), F.col("n_before")))
        rate = lambda a, b: F.when(F.col(b) > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(a) / F.col(b))))
        s = s.withColumns(
            {
                "serve_residual": rate("raw_service_won", "raw_svpt") - F.col("serve_strength"),
                "return_residual": rate("raw_return_won", "raw_return_points") - F.col("return_strength"),
            }
        )
        s = s.drop(*[f"raw_{c}" for c in raw])
        if cols is not None:
            s = s.select(*keep, "blended", "serve_residual", "return_residual", *[c for c in cols if c in s.columns])
        return s.withColumn("_row", F.monotonically_increasing_id())

    wide = dealt(only(state))

    def rest() -> DataFrame:
        residual = F.when(F.col("won") == 1, 1.0 - F.col("pre_p")).otherwise(F.col("pre_p") - 1.0)
        keys = ["_row", "match_id", *st.ENTITY_SURFACE, "opponent", "batch_no", "venue_no", "match_date", "won", "p1"]
        rows = rt.with_expectation(wide.select(*keys, "blended", "serve_residual", "return_residual"))
        rows = dealt(only(lambda: rows.withColumn("residual", residual).drop("blended")))
        # rows are gathered on the keys alone
        more = rows.select("_row", *st.ENTITY_SURFACE, "batch_no", "venue_no")
        more = _side(more, st.decayed_means(rows, st.ENTITY_SURFACE, SURFACE_FORM), st.ENTITY_SURFACE)
        more = _side(more, st.decayed_means(rows, st.ENTITY, RESIDUAL_FORM))
        more = _side(more, st.workload(parts))
        meta = st.carried_metadata(parts.withColumnRenamed("batch_no", "_r"), "venue_no")
        more = more.join(meta, [*numbers_first(more, st.ENTITY), "venue_no"])
        return rows.join(dealt(only(lambda: more.drop(*st.ENTITY_SURFACE, "batch_no", "venue_no"))), "_row")

    return wide, dealt(only(rest))


def side_state(
    parts: DataFrame, service_prior: Column, spec: rt.RatingSpec = rt.DEVIATION, solved: DataFrame | None = None, cols: Sequence[str] | None = None
) -> DataFrame:
    """Everything known about each side at the start of its batch, ratings and residuals included.

    Two scans per entity and per (entity, surface) produce it; the second one exists because
    residual form needs the expectation that follows from the first. ``solved`` spares solving the
    ratings of the same ``parts`` and ``spec`` again, ``cols`` cuts the state to some of its columns.
    """
    wide, more = side_tables(parts, service_prior, spec, solved, cols)
    return wide.join(more.select("_row", *[c for c in more.columns if c not in wide.columns]), "_row").drop("_row")


SIDE_COLS = (
    *STATE_RATES,
    *("serve_strength", "overall", "on_surface", "shrunk", "surface_n", "rd", "n_before", "t_serve_points", "days_rest"),
    *("latent_serve", "latent_return", "surface_serve", "surface_return", "latent_uncertainty"),
    *("residual_form_short", "residual_form_medium", "surface_residual_form"),
    *("score_dominance", "set_dominance", "tiebreak_strength"),
    *("workload_3d", "workload_7d", "workload_14d", "ranking", "ranking_points", "age", "height", "hand"),
)


def full_features(m: DataFrame, parts: DataFrame, service_prior: Column) -> DataFrame:
    """The full feature row of every match.

    ``m`` is oriented and carries ``batch_no`` (round batches), ``venue_no`` (venue batches),
    ``level``, ``indoor`` and ``round``; ``parts`` are its participations.
    """
    # each table is dealt to its matches once, by itself
    wide, more = side_tables(parts, service_prior, cols=SIDE_COLS)
    first = F.col("entity") == F.col("p1")
    sides = paired(wide, ["match_id"], [c for c in SIDE_COLS if c in wide.columns], first)
    sides = sides.join(paired(more, ["match_id"], [c for c in SIDE_COLS if c not in wide.columns], first), "match_id")
    met = dealt(only(lambda: common_opponents(m, more)))
    x = dealt(only(lambda: _pair_wins(m))).join(sides, "match_id").join(met, "match_id", "left")
    x = with_structural_probability(
        x.withColumns({f"{a}_{i}": F.col(f"{b}_{i}") for a, b in (("serve", "serve_strength"), ("return", "return_strength")) for i in (1, 2)}),
        "p_structural",
    )
    x = with_latent_probability(x, service_prior, "p_latent")
    cap = lambda c, top, i: F.least(F.col(f"{c}_{i}"), F.lit(top))
    known = lambda c, default, i: F.coalesce(F.nullif(F.col(f"{c}_{i}"), F.lit(0.0)), F.lit(default))
    rank = lambda i: F.coalesce(F.col(f"ranking_{i}"), F.lit(999.0))
    points = lambda i: F.coalesce(F.col(f"ranking_points_{i}"), F.lit(0.0))
    hand = lambda i: F.coalesce(F.col(f"hand_{i}"), F.lit(""))
    flag = lambda c: c.cast("double")
    rates = ("first_in", "first_won", "second_won", "ace_rate", "df_rate", "bp_save", "bp_convert")
    same = ("serve_strength", "return_strength", "residual_form_short", "residual_form_medium", "surface_residual_form")
    same += ("score_dominance", "set_dominance", "tiebreak_strength")
    logs = lambda i: F.log1p(f"n_before_{i}") + F.log1p(f"t_serve_points_{i}")
    edge = lambda i, j: F.col(f"serve_strength_{i}") - (1.0 - F.col(f"return_strength_{j}"))
    out = {
        "overall_elo_diff": _diff("overall") / 400.0,
        "surface_elo_diff": _diff("on_surface") / 400.0,
        "surface_elo_shrunk_diff": _diff("shrunk") / 400.0,
        "rating_rd_diff": -_diff("rd") / 350.0,
        "rating_uncertainty_sum": (F.col("rd_1") + F.col("rd_2")) / 700.0,
        "matches_diff": (cap("n_before", 350, 1) - cap("n_before", 350, 2)) / 350.0,
        "match_count_log_diff": F.log1p("n_before_1") - F.log1p("n_before_2"),
        "surface_sample_diff": _diff("surface_n") / 80.0,
        "data_strength_diff": (logs(1) - logs(2)) / 10.0,
        "ranking_diff": (rank(2) - rank(1)) / 998.0,
        "ranking_points_diff": (points(1) - points(2)) / 12000.0,
        "rank_known": flag(F.col("ranking_1").isNotNull() & F.col("ranking_2").isNotNull()),
        "age_diff": (known("age", 27.0, 1) - known("age", 27.0, 2)) / 15.0,
        "height_diff": (known("height", 185.0, 1) - known("height", 185.0, 2)) / 30.0,
        "lefty_matchup": flag(hand(1) == "L") - flag(hand(2) == "L"),
        "same_hand": flag((hand(1) != "") & (hand(1) == hand(2))),
        "serve_return_edge": edge(1, 2) - edge(2, 1),
        **{f"{c}_diff": _diff(c) for c in (*rates, *same)},
        "return_point_won_diff": _diff("return_strength"),
        "serve_point_won_diff": _diff("serve_strength"),
        "stat_sample_diff": (cap("t_serve_points", 6000.0, 1) - cap("t_serve_points", 6000.0, 2)) / 6000.0,
        "latent_serve_skill_diff": _diff("latent_serve"),
        "latent_return_skill_diff": _diff("latent_return"),
        "latent_surface_serve_skill_diff": _diff("surface_serve"),
        "latent_surface_return_skill_diff": _diff("surface_return"),
        "latent_uncertainty_sum": F.col("latent_uncertainty_1") + F.col("latent_uncertainty_2"),
        "latent_exact_match_logit": logit(F.col("p_latent")),
        "days_rest_diff": _diff("days_rest") / 90.0,
        "recovery_curve_diff": st.recovery(F.col("days_rest_1")) - st.recovery(F.col("days_rest_2")),
        "workload_3d_diff": _diff("workload_3d") / 4.0,
        "workload_7d_diff": _diff("workload_7d") / 7.0,
        "workload_14d_diff": _diff("workload_14d") / 10.0,
        "structural_match_logit": logit(F.col("p_structural")),
        "best_of_5": flag(F.col("best_of") == 5),
        "h2h_prior_diff": _diff("h2h") / (F.col("h2h_1") + F.col("h2h_2") + 8.0),
        "surface_h2h_prior_diff": _diff("sh2h") / (F.col("sh2h_1") + F.col("sh2h_2") + 8.0),
        **context_flags(),
        "common_opponent_result_residual_diff": F.coalesce("common_result", F.lit(0.0)),
        "common_opponent_serve_residual_diff": F.coalesce("common_serve", F.lit(0.0)),
        "common_opponent_return_residual_diff": F.coalesce("common_return", F.lit(0.0)),
        "common_opponent_surface_residual_diff": F.coalesce("common_surface_result", F.lit(0.0)),
        "common_opponent_match_weight": F.coalesce("common_weight", F.lit(0.0)),
    }
    return x.select(*META, *[out[f].alias(f) for f in FULL])


def context_flags() -> dict[str, Column]:
    is_ = lambda c, v: (F.col(c) == v).cast("double")
    return {
        "is_indoor": is_("indoor", "I"),
        "level_g": is_("level", "G"),
        "level_m": is_("level", "M"),
        "level_500": is_("level", "500"),
        "level_250": is_("level", "250"),
        "round_final": is_("round", "F"),
        "round_sf": is_("round", "SF"),
        "round_qf": is_("round", "QF"),
    }


def clean_features(df: DataFrame, features: Sequence[str]) -> DataFrame:
    from tallyspark.functions.text import cleaned

    return df.withColumns({f: cleaned(F.col(f)) for f in features})


def candidate_sets(available: DataFrame, groups: DataFrame) -> DataFrame:
    """(set_name, feature): everything, each group alone, everything but each group.

    ``available`` lists usable features, ``groups`` (grp, feature) pairs; plain set algebra.
    """
    usable = groups.join(available, "feature", "left_semi")
    names = groups.select("grp").distinct()
    whole = available.select(F.lit("full").alias("set_name"), "feature")
    only = usable.select(F.concat("grp", F.lit("_only")).alias("set_name"), "feature")
    spread = names.select(F.concat(F.lit("no_"), F.col("grp")).alias("set_name"), "grp", F.lit(1).alias("_j"))
    every = spread.join(available.withColumn("_j", F.lit(1)), "_j").select("set_name", "grp", "feature")
    without = every.join(usable, ["grp", "feature"], "left_anti").select("set_name", "feature")
    return whole.unionByName(only).unionByName(without)


def named_sets(available: DataFrame) -> DataFrame:
    """(set_name, feature) of every named set, left-out family and single family, cut to the usable features."""
    sets = dict(NAMED_SETS)
    sets |= {f"no_{g}": tuple(f for f in FULL if f not in FAMILIES[g]) for g in LEFT_OUT}
    sets |= {f"{g}_only": fs for g, fs in FAMILIES.items()}
    spark = available.sparkSession
    pairs = spark.createDataFrame([(n, f) for n, fs in sets.items() for f in fs], "set_name string, feature string")
    return pairs.join(available.select("feature"), "feature", "left_semi").select("set_name", "feature")
