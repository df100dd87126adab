"""Queries that fit, score and compare models."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyspark.functions.prob import sigmoid
from tallyspark.operators import features as ft
from tallyspark.operators import learn, metrics as mx, splits
from tallyspark.operators import ratings as rt
from tallyspark.operators import state as st
from tallyspark.functions import prob
from tallyspark.plans.evaluation import available_features, bundle_sql, cl, rounded, two_models
from tallyspark.plans.feature import full_rows
from tallyspark.plans.history import STATIC_P, attach, round_parts, venue_parts
from tallyspark.plans.people import latest_states
from tallyspark.plans.probability import clamp_sql, game_sql, match_from_points_sql, match_sql, set_sql
from tallyspark.plans.rating import SOLVED_COLS, fold_sql, plain_blend
from tallyspark.plans import newton
from tallyspark.plans.registry import query, r6, view
from tallyspark.plans.rows import rnd
from tallyspark.session import cut_lineage, only
from tallyspark.sources.fixtures import matches, parts, scored, table

# A small coefficient table used by the scoring queries.
COEF = (("p", 1.4, 0.5, 0.3), ("l_discount", -2.0, 0.05, 0.03), ("l_tax", 0.7, 0.04, 0.026), ("price", 0.25, 0.4, 0.0))
INTERCEPT, SLOPE, SHIFT = -0.3, 0.9, 0.05
FEATURES = ("p", "l_discount", "l_tax", "price")
view("mrows", "SELECT *, l_extendedprice / 100000.0 AS price FROM scored")
LINEAR_SQL = f"{INTERCEPT} + " + " + ".join(f"{b} * (({f} - {c}) / {s or 1.0})" for f, b, c, s in COEF)


def model_rows(spark, d):
    return scored(spark, d).withColumn("price", F.col("l_extendedprice") / 100000.0)


def linear():
    f, b, c, s = zip(*COEF, strict=True)
    return learn.linear_score(f, b, INTERCEPT, c, s)


@query(
    "l1_linear_score",
    f"""SELECT l_orderkey, l_linenumber, {r6(LINEAR_SQL)} AS raw, {r6(f'1 / (1 + exp(-({SLOPE} * ({LINEAR_SQL}) + {SHIFT})))')} AS p,
        {r6('CASE grp WHEN ' + chr(39) + 'F' + chr(39) + ' THEN 0.1 + 0.5 * p + 2 * l_tax ELSE -0.2 + 1.5 * p - l_tax END')} AS own FROM mrows""",
)
def _(spark, d):
    rows = model_rows(spark, d)
    cal = learn.Calibration(SLOPE, SHIFT)
    f = F.col("grp") == "F"
    coef = F.when(f, F.array(F.lit(0.5), F.lit(2.0))).otherwise(F.array(F.lit(1.5), F.lit(-1.0)))
    own = learn.row_model_score(F.array("p", "l_tax"), coef, F.when(f, 0.1).otherwise(-0.2))
    return rows.select(
        "l_orderkey",
        "l_linenumber",
        rnd(linear()).alias("raw"),
        rnd(sigmoid(cal.apply(linear()))).alias("p"),
        rnd(own).alias("own"),
    )


STACK = {"full_logistic": 0.6, "size": 0.3, "tax": -0.2}
STACK_BASE = {"size": ("p", 2.2), "tax": ("l_tax", 9.0)}


def _lg(x):
    c = cl(x)
    return f"ln({c} / (1 - {c}))"


@query(
    "l2_stacked_score",
    f"""SELECT l_orderkey, l_linenumber, l_partkey_, {r6(f"0.1 + 0.6 * ({LINEAR_SQL}) + 0.3 * {_lg('(1 / (1 + exp(-2.2 * p)))')} - 0.2 * {_lg('(1 / (1 + exp(-9.0 * l_tax)))')}")} AS z
        FROM (SELECT *, l_linenumber AS l_partkey_ FROM mrows)""",
)
def _(spark, d):
    z = learn.stacked_score(linear(), STACK, 0.1, STACK_BASE)
    return model_rows(spark, d).select("l_orderkey", "l_linenumber", F.col("l_linenumber").alias("l_partkey_"), rnd(z).alias("z"))


@query(
    "l3_winner_and_edge",
    f"""SELECT match_id, CASE WHEN p >= 0.5 THEN winner ELSE loser END AS winner, {r6('abs(p - 0.5) * 2')} AS edge,
        round({clamp_sql('p', 0.01, 0.99)} + 1e-9, 4) + 0.0 AS probability, CASE WHEN sd >= 0 THEN winner ELSE loser END AS factor_side,
        round(sd / 400.0 + 1e-9, 4) + 0.0 AS factor_impact FROM (SELECT match_id, winner, loser, CAST(winner % 200 - loser % 200 AS DOUBLE) AS sd,
        1 / (1 + pow(10.0, (loser % 200 - winner % 200) / 400.0)) AS p FROM matches)""",
)
def _(spark, d):
    gap = (F.col("winner") % 200 - F.col("loser") % 200).cast("double")
    m = matches(spark, d).withColumn("gap", gap)
    p = prob.expected_score(F.lit(0.0), -F.col("gap"))
    factor = F.struct(
        F.when(F.col("gap") >= 0, F.col("winner")).otherwise(F.col("loser")).alias("side"), (F.col("gap") / 400.0).alias("impact")
    )
    out = m.select("match_id", *[c.alias(n) for n, c in learn.outcome(p, F.col("winner"), F.col("loser")).items()], F.array(factor).alias("factors"))
    return out.select(
        "match_id",
        "winner",
        rnd("edge").alias("edge"),
        "probability",
        F.col("factors")[0]["side"].alias("factor_side"),
        F.round(F.col("factors")[0]["impact"] + 1e-9, 4).alias("factor_impact"),
    )


view(
    "served",
    f"""SELECT c.pool, c.entity, 0.30 * overall - 0.08 * greatest(28.0, 90.0 / pow(greatest(matches, 1), 0.35)) AS base, overall, {', '.join(rt.SURFACES)}, serve_point_won, c.matches
        FROM career c JOIN last_ratings r ON r.pool = c.pool AND r.entity = c.entity""",
)
view("asked_pairs", "SELECT DISTINCT pool, winner AS a, loser AS b, surface, best_of FROM matches")


def _on_surface(side):
    return "CASE q.surface " + " ".join(f"WHEN '{s}' THEN {side}.{s}" for s in rt.SURFACES) + " END"


_SC = {
    "overall_elo_diff": ("(x.overall - y.overall) / 400.0", 1.1),
    "surface_elo_diff": (f"({_on_surface('x')} - {_on_surface('y')}) / 400.0", 0.6),
    "serve_point_won_diff": ("x.serve_point_won - y.serve_point_won", 3.0),
    "matches_diff": ("(least(x.matches, 300) - least(y.matches, 300)) / 300.0", 0.2),
}
view(
    "pair_state",
    f"""SELECT q.pool, q.a, q.b, q.surface, q.best_of, 0.62 * {_on_surface('x')} + x.base AS ra, 0.62 * {_on_surface('y')} + y.base AS rb, {' + '.join(f'{k} * ({e})' for e, k in _SC.values())} AS raw
        FROM asked_pairs q JOIN served x ON x.pool = q.pool AND x.entity = q.a JOIN served y ON y.pool = q.pool AND y.entity = q.b""",
)
_E = clamp_sql("(ra - rb) / 1150.0", -0.11, 0.11)
_HELD = f"(SELECT *, {game_sql(clamp_sql(f'0.635 + {_E}', 0.50, 0.78))} AS h1, {game_sql(clamp_sql(f'0.635 - {_E}', 0.50, 0.78))} AS h2 FROM pair_state)"


@query(
    "l4_matchup_scoring",
    f"""SELECT pool, a, b, surface, CAST(best_of AS INTEGER) AS best_of, {r6(clamp_sql(f"0.62 * ({match_sql('setp')}) + 0.38 / (1 + pow(10.0, (rb - ra) / 400.0))", 0.02, 0.98))} AS rating_p,
        round({clamp_sql('1 / (1 + exp(-raw))', 0.01, 0.99)} + 1e-9, 4) + 0.0 AS model_p FROM {set_sql(_HELD, 'h1', 'h2')}""",
)
def _(spark, d):
    s = latest_states(spark, d)
    unc = st.serving_uncertainty(F.col("matches"))
    s = s.withColumn("base", 0.30 * F.col("overall") - 0.08 * unc)
    cols = ("overall", *rt.SURFACES, "serve_point_won", "matches", "base")
    s = cut_lineage(s.select("pool", "entity", *cols))
    side = lambda k, i: s.select("pool", F.col("entity").alias(k), *[F.col(c).alias(f"{c}_{i}") for c in cols])
    pairs = matches(spark, d).select("pool", F.col("winner").alias("a"), F.col("loser").alias("b"), "surface", "best_of").distinct()
    x = pairs.join(side("a", 1), ["pool", "a"]).join(side("b", 2), ["pool", "b"])
    cap = lambda i: F.least(F.col(f"matches_{i}"), F.lit(300))
    on = lambda i: F.coalesce(*[F.when(F.col("surface") == n, F.col(f"{n}_{i}")) for n in rt.SURFACES])
    x = x.withColumns(
        {
            "blended_1": 0.62 * on(1) + F.col("base_1"),
            "blended_2": 0.62 * on(2) + F.col("base_2"),
            "overall_elo_diff": (F.col("overall_1") - F.col("overall_2")) / 400.0,
            "surface_elo_diff": (on(1) - on(2)) / 400.0,
            "serve_point_won_diff": F.col("serve_point_won_1") - F.col("serve_point_won_2"),
            "matches_diff": (cap(1) - cap(2)) / 300.0,
        }
    )
    x = prob.with_rating_probability(x, "blended_1", "blended_2", "best_of", "rating_p")
    raw = learn.linear_score(tuple(_SC), [k for _, k in _SC.values()], 0.0)
    model_p = F.round(prob.clamp(prob.sigmoid(raw), 0.01, 0.99) + 1e-9, 4)
    return x.select("pool", "a", "b", "surface", F.col("best_of").cast("int").alias("best_of"), rnd("rating_p").alias("rating_p"), model_p.alias("model_p"))


@query(
    "l5_standardize",
    "SELECT feature, "
    + r6("m")
    + " AS center, "
    + r6("CASE WHEN s < 1e-6 THEN 1.0 ELSE s END")
    + " AS scale FROM ("
    + " UNION ALL ".join(f"SELECT '{f}' AS feature, avg({f}) AS m, stddev_pop({f}) AS s FROM mrows" for f in FEATURES)
    + " UNION ALL SELECT 'flat', 2.0, 0.0)",
)
def _(spark, d):
    rows = model_rows(spark, d).withColumn("flat", F.lit(2.0))
    names = [*FEATURES, "flat"]
    center, scale = learn.standardization(rows, names)
    out = spark.createDataFrame(list(zip(names, center, scale, strict=True)), "feature string, center double, scale double")
    return out.select("feature", rnd("center").alias("center"), rnd("scale").alias("scale"))


def short(c):
    """Five decimals of the six-decimal value, in the same two steps as the SQL."""
    return F.round(rnd(c), 5)


def s5(expression):
    return f"round({r6(expression)}, 5)"


SCORES = ("accuracy", "auc", "log_loss", "brier", "ece")


def scores_sql(source, keys, extra=""):
    """Metric bundle per group with rank-based AUC; the SQL twin of ``fold_metrics``."""
    by = ", ".join(keys)
    c = "greatest(1e-6, least(1 - 1e-6, probability))"
    return f"""(SELECT {by}, count(*) AS n, avg(CASE WHEN (q >= 0.5) = (label = 1) THEN 1.0 ELSE 0.0 END) AS accuracy,
      avg(CASE WHEN label = 1 THEN -ln(q) ELSE -ln(1 - q) END) AS log_loss, avg((q - label) * (q - label)) AS brier,
      (sum(rk) FILTER (label = 1) - sum(label) * (sum(label) + 1) / 2.0) / (sum(label) * sum(1 - label)) AS auc {extra}
      FROM (SELECT *, rank() OVER (PARTITION BY {by} ORDER BY q) + (count(*) OVER (PARTITION BY {by}, q) - 1) / 2.0 AS rk FROM (SELECT *, {c} AS q FROM {source})) GROUP BY {by})
      JOIN (SELECT {by}, sum(gap) / sum(cnt) AS ece FROM (SELECT {by}, least(floor({c} * 10), 9) AS bk, abs(sum({c} - label)) AS gap, count(*) AS cnt FROM {source} GROUP BY {by}, bk) GROUP BY {by}) USING ({by})"""


def scores_select(keys=()):
    return ", ".join([*keys, "CAST(n AS BIGINT) AS n", *(f"{s5(c)} AS {c}" for c in SCORES)])


YEARS = range(1997, 2002)
ROWS_IN = "rows_in AS MATERIALIZED (SELECT * FROM mrows)"
ELIGIBLE = """elig AS MATERIALIZED (SELECT fold FROM (SELECT unnest(range(1995, 2003)) AS fold), (SELECT yr, count(*) AS n FROM rows_in GROUP BY yr), (SELECT count(*) AS total FROM rows_in)
  GROUP BY fold HAVING sum(n) FILTER (yr < fold - 1) >= any_value(total) // 10 AND sum(n) FILTER (yr = fold - 1) >= any_value(total) // 50 AND sum(n) FILTER (yr = fold) >= any_value(total) // 50)"""


def folds_sql(name, features=FEATURES, l2=0.004, steps=newton.STEPS):
    """CTEs of all folds' test rows; the last one is ``name``."""
    out = []
    for y in YEARS:
        out += newton.fold_ctes(f"{name}{y}", features, y, l2=l2, steps=steps)
    union = " UNION ALL ".join(f"SELECT yr, label, l2, probability, fold FROM {name}{y}_out" for y in YEARS)
    return [*out, f"{name} AS MATERIALIZED (SELECT * FROM ({union}) WHERE fold IN (SELECT fold FROM elig))"]


def with_folds(ctes, select):
    return "WITH " + ",\n".join([ROWS_IN, ELIGIBLE, *ctes]) + "\n" + select


@query(
    "l6_logistic_fit",
    "WITH " + ",\n".join(newton.logistic_ctes("m", "mrows", FEATURES)) + f" SELECT '(intercept)' AS feature, {s5('b0')} AS coefficient FROM m_b{newton.STEPS} "
    + " ".join(f"UNION ALL SELECT '{f}', {s5(f'b{i}')} FROM m_b{newton.STEPS}" for i, f in enumerate(FEATURES, 1)),
)
def _(spark, d):
    model = learn.fit_logistic(model_rows(spark, d), FEATURES)
    data = [("(intercept)", model.intercept), *zip(model.features, model.coefficients, strict=True)]
    return spark.createDataFrame(data, "feature string, coefficient double").select("feature", short("coefficient").alias("coefficient"))


LOGIT_SQL = "ln({0} / (1 - {0}))"


@query(
    "l7_calibration",
    "WITH fr AS (SELECT * FROM mrows WHERE grp = 'F'), orows AS (SELECT * FROM mrows WHERE grp = 'O'), "
    + ", ".join([*newton.calibration_ctes("f", "fr", LOGIT_SQL.format("p"), steps=12, damped=True), *newton.calibration_ctes("o", "orows", LOGIT_SQL.format("p"), steps=12, damped=True)])
    + f" SELECT 'F' AS grp, {s5('slope')} AS slope, {s5('shift')} AS intercept FROM f_c UNION ALL SELECT 'O', {s5('slope')}, {s5('shift')} FROM o_c",
)
def _(spark, d):
    out = []
    for g in ("F", "O"):
        cal = learn.fit_calibration(model_rows(spark, d).where(F.col("grp") == g), prob.logit(F.col("p")))
        out.append((g, cal.slope, cal.intercept))
    return spark.createDataFrame(out, "grp string, slope double, intercept double").select("grp", short("slope").alias("slope"), short("intercept").alias("intercept"))


@query(
    "l8_calibration_diagnostic",
    "WITH "
    + ", ".join([*newton.calibration_ctes("a", "mrows", LOGIT_SQL.format("p"), 0.0, steps=12, damped=True), *newton.calibration_ctes("b", "mrows", LOGIT_SQL.format("p2"), 0.0, steps=12, damped=True)])
    + f" SELECT 'a' AS model, {s5('slope')} AS slope, {s5('shift')} AS intercept FROM a_c UNION ALL SELECT 'b', {s5('slope')}, {s5('shift')} FROM b_c",
)
def _(spark, d):
    rows = model_rows(spark, d)
    pairs = [(m, learn.fit_calibration(rows, prob.logit(F.col(c)), pull=0.0)) for m, c in (("a", "p"), ("b", "p2"))]
    out = spark.createDataFrame([(m, c.slope, c.intercept) for m, c in pairs], "model string, slope double, intercept double")
    return out.select("model", short("slope").alias("slope"), short("intercept").alias("intercept"))


def fold_metrics(df, *keys):
    return df.select(*keys, "n", *[short(c).alias(c) for c in SCORES])


def eligible(spark, d):
    """Every test year of the fixture with enough rows; the bounds follow the fixture's size."""
    rows = scored(spark, d)
    n = rows.count()
    return splits.eligible_folds(rows, "yr", n // 10, n // 50, n // 50)


@query("l9_boosted_trees")
def _(spark, d):
    rows = model_rows(spark, d)
    return fold_metrics(learn.walk_forward(rows, FEATURES, eligible(spark, d), "boosted", {"trees": 20, "depth": 3}), "fold")


PENALTIES = (0.0015, 0.003, 0.006, 0.012)


@query(
    "l10_parameter_grid",
    with_folds(
        folds_sql("g", l2=PENALTIES),
        f"SELECT l2, {s5('avg(log_loss)')} AS log_loss, {s5('avg(brier)')} AS brier FROM {scores_sql('g', ['l2', 'fold'])} GROUP BY l2 ORDER BY 2, 3, 1 LIMIT 1",
    ),
)
def _(spark, d):
    variants = {str(l2): learn.Variant(tuple(FEATURES), l2) for l2 in PENALTIES}
    out = learn.parameter_grid(model_rows(spark, d), variants, eligible(spark, d))
    out = out.select(F.col("variant").cast("double").alias("l2"), short("log_loss").alias("log_loss"), short("brier").alias("brier"))
    return learn.best_by(out, "l2", "log_loss", "brier")


@query(
    "l11_fold_table",
    """WITH c AS (SELECT yr, count(*) AS n FROM scored GROUP BY yr), f AS (SELECT CAST(unnest(range(1995, 2003)) AS INTEGER) AS test_year),
       s AS (SELECT test_year, sum(n) FILTER (yr < test_year - 1) AS train_rows, sum(n) FILTER (yr = test_year - 1) AS calibration_rows,
         sum(n) FILTER (yr = test_year) AS test_rows FROM f, c GROUP BY test_year)
       SELECT test_year, CAST(train_rows AS BIGINT) AS train_rows, CAST(calibration_rows AS BIGINT) AS calibration_rows, CAST(test_rows AS BIGINT) AS test_rows
       FROM s WHERE train_rows >= 500 AND calibration_rows >= 100 AND test_rows >= 100""",
)
def _(spark, d):
    return splits.fold_table(scored(spark, d), "yr", range(1995, 2003), 500, 100, 100)


@query(
    "l11_walk_forward",
    with_folds(
        [*folds_sql("w"), "b AS MATERIALIZED (SELECT fold, label, probability FROM w UNION ALL SELECT 0, label, probability FROM w)"],
        f"SELECT CAST(fold AS INTEGER) AS fold, {scores_select()} FROM {scores_sql('b', ['fold'])}",
    ),
)
def _(spark, d):
    return fold_metrics(learn.walk_forward(model_rows(spark, d), FEATURES, eligible(spark, d)), "fold")


@query(
    "l12_out_of_fold",
    with_folds(folds_sql("w"), f"SELECT CAST(fold AS INTEGER) AS fold, label, CAST(count(*) AS BIGINT) AS n, {s5('avg(probability)')} AS mean_p FROM w GROUP BY ALL"),
)
def _(spark, d):
    pred = learn.fold_predictions(model_rows(spark, d), FEATURES, eligible(spark, d))
    return pred.groupBy("fold", "label").agg(F.count(F.lit(1)).alias("n"), short(F.avg("probability")).alias("mean_p"))


WEIGHTS = [[round(v, 6) for v in w] for w in learn.simplex_weights(2, 1200)]
_MIX = cl("w0 * p + w1 * p2")
_LOSSES = f"""WITH g(weight_id, w0, w1) AS (VALUES {', '.join(f'({i}, {a}, {b})' for i, (a, b) in enumerate(WEIGHTS))}),
  t AS (SELECT weight_id, w0, w1, avg(CASE WHEN label = 1 THEN -ln({_MIX}) ELSE -ln(1 - {_MIX}) END) AS loss FROM scored, g GROUP BY ALL)"""


@query("l13_weighted_ensemble", f"{_LOSSES} SELECT CAST(weight_id AS INTEGER) AS weight_id, {r6('loss')} AS log_loss FROM t")
def _(spark, d):
    out = learn.blend_search(scored(spark, d), ["p", "p2"], WEIGHTS)
    return out.select("weight_id", rnd("log_loss").alias("log_loss"))


@query("l13_ensemble_winner", f"{_LOSSES} SELECT {r6('min(loss)')} AS log_loss, {r6('arg_min(w0, loss)')} AS w0, {r6('arg_min(w1, loss)')} AS w1 FROM t")
def _(spark, d):
    out = learn.blend_winner(learn.blend_search(scored(spark, d), ["p", "p2"], WEIGHTS), WEIGHTS)
    return out.select(rnd("log_loss").alias("log_loss"), *[rnd(F.col("weights")[i]).alias(f"w{i}") for i in range(2)])


def _stack_ctes(name, rows, years):
    """CTEs of the stacker fitted on ``rows``; its model is ``<name>``."""
    out = []
    for y in years:
        out.append(f"{name}t{y} AS MATERIALIZED (SELECT * FROM {rows} WHERE yr < {y})")
        out += newton.logistic_ctes(f"{name}{y}", f"{name}t{y}", FEATURES)
    held = " UNION ALL ".join(
        f"SELECT {newton.logit_sql(f'{name}{y}', FEATURES)} AS full_logistic, 2.2 * p AS size, 9.0 * l_tax AS tax, label, {y} AS fold FROM {rows}, {newton.model_from(f'{name}{y}')} WHERE yr = {y}" for y in years
    )
    out.append(f"{name}h AS MATERIALIZED (SELECT * FROM ({held}) WHERE fold IN (SELECT fold FROM elig))")
    return [*out, *newton.logistic_ctes(name, f"{name}h", ("full_logistic", "size", "tax"))]


STACKED = ("full_logistic", "size", "tax")


@query(
    "l14_stacking",
    with_folds(_stack_ctes("k", "rows_in", YEARS), " UNION ALL ".join(f"SELECT '{f}' AS feature, {s5(f'b{i}')} AS coefficient FROM k_b{newton.STEPS}" for i, f in enumerate(STACKED, 1))),
)
def _(spark, d):
    model, _ = learn.stack(model_rows(spark, d), FEATURES, eligible(spark, d), STACK_BASE)
    out = spark.createDataFrame(list(zip(model.features, model.coefficients, strict=True)), "feature string, coefficient double")
    return out.select("feature", short("coefficient").alias("coefficient"))


ROLES = """ys AS MATERIALIZED (SELECT max(yr) AS last, max(yr) FILTER (yr < (SELECT max(yr) FROM rows_in)) AS cal FROM rows_in),
  tr AS MATERIALIZED (SELECT r.* FROM rows_in r, ys WHERE yr < cal), ca AS MATERIALIZED (SELECT r.* FROM rows_in r, ys WHERE yr = cal), te AS MATERIALIZED (SELECT r.* FROM rows_in r, ys WHERE yr = last)"""


@query(
    "l14_stacked_evaluation",
    with_folds(
        [
            ROLES,
            *_stack_ctes("k", "tr", range(1997, 2000)),
            *newton.logistic_ctes("m", "tr", FEATURES),
            *(f"s{x} AS MATERIALIZED (SELECT {newton.logit_sql('m', FEATURES)} AS full_logistic, 2.2 * p AS size, 9.0 * l_tax AS tax, label FROM {x}, {newton.model_from('m')})" for x in ("ca", "te")),
            f"zca AS MATERIALIZED (SELECT {newton.logit_sql('k', STACKED)} AS z, label FROM sca, {newton.model_from('k')})",
            *newton.calibration_ctes("q", "zca", "z"),
            f"o AS MATERIALIZED (SELECT 0 AS one, label, 1 / (1 + exp(-(slope * {newton.logit_sql('k', STACKED)} + shift))) AS probability FROM ste, {newton.model_from('k')}, q_c)",
        ],
        f"SELECT {scores_select()} FROM {scores_sql('o', ['one'])}",
    ),
)
def _(spark, d):
    rows = cut_lineage(splits.split_roles(model_rows(spark, d), "yr"))
    last = rows.where("role = 'train'").agg(F.max("yr")).first()[0]
    out = learn.stacked_evaluation(rows, FEATURES, [f for f in eligible(spark, d) if f <= last], STACK_BASE)
    return fold_metrics(out)


@query(
    "l15_final_evaluation",
    with_folds(
        [
            ROLES,
            *newton.logistic_ctes("m", "tr", FEATURES),
            f"zc AS MATERIALIZED (SELECT {newton.logit_sql('m', FEATURES)} AS z, label FROM ca, {newton.model_from('m')})",
            *newton.calibration_ctes("q", "zc", "z"),
            f"o AS MATERIALIZED (SELECT 'latest_two_year_holdout' AS split_rule, label, 1 / (1 + exp(-(slope * {newton.logit_sql('m', FEATURES)} + shift))) AS probability FROM te, {newton.model_from('m')}, q_c)",
        ],
        f"SELECT split_rule, {scores_select()} FROM {scores_sql('o', ['split_rule'])}",
    ),
)
def _(spark, d):
    rows = splits.split_roles(model_rows(spark, d), "yr")
    scorer, cal = learn.fixed_split(rows, FEATURES)
    test = scorer(rows.where("role = 'test'")).withColumn("probability", sigmoid(cal.apply(F.col("raw"))))
    return fold_metrics(mx.bundle(test, ["split_rule"], "probability"), "split_rule")


FAMILY_SETS = {"full": FEATURES, "size": FEATURES[1:], "money": FEATURES[:1]}
_ABLATED = " UNION ALL ".join(f"SELECT dropped, n, accuracy, auc, log_loss, brier, ece FROM {scores_sql(f'a{k}', ['dropped'])}" for k in FAMILY_SETS)


@query(
    "l16_ablation",
    with_folds(
        [c for k, f in FAMILY_SETS.items() for c in (*folds_sql(f"w{k}", f, steps=5), f"a{k} AS MATERIALIZED (SELECT '{k}' AS dropped, label, probability FROM w{k})")],
        f"SELECT dropped, round({r6('log_loss - (SELECT log_loss FROM u WHERE dropped = ' + chr(39) + 'full' + chr(39) + ')')}, 5) AS delta_log_loss, {scores_select()} FROM u",
    ).replace("SELECT dropped, round", f", u AS MATERIALIZED ({_ABLATED}) SELECT dropped, round", 1),
)
def _(spark, d):
    out = learn.ablation(model_rows(spark, d), FEATURES, {"size": ("p",), "money": ("l_discount", "l_tax", "price")}, eligible(spark, d))
    return fold_metrics(out, "dropped", short("delta_log_loss").alias("delta_log_loss"))


def fold_rows(spark, d):
    """The full feature rows, the features that are not blank, and the test periods with enough rows.

    The fixture's matches lie within a month, so periods of five days take the place of years.
    """
    period = F.floor(st.day_number(F.col("match_date")) / 5).cast("int")
    rows = only(lambda: full_rows(spark, d).select("match_id", "venue", "match_date", period.alias("yr"), "label", *ft.FULL), "features")
    usable = {r["feature"] for r in available_features(rows, list(ft.FULL)).where("available = 1").collect()}
    n = rows.count()
    return rows, usable, splits.eligible_folds(rows, "yr", n // 10, n // 50, n // 50)


@query("l16_family_ablation")
def _(spark, d):
    rows, usable, folds = fold_rows(spark, d)
    out = learn.ablation(rows, [f for f in ft.FULL if f in usable], ft.FAMILIES, folds)
    return fold_metrics(out, "dropped", short("delta_log_loss").alias("delta_log_loss"))


@query("l17_feature_ladder")
def _(spark, d):
    rows, usable, folds = fold_rows(spark, d)
    rungs = [(name, [f for f in added if f in usable]) for name, added in ft.RUNGS.items()]
    out = learn.ladder(rows, rungs, folds, ["match_id"], ["venue", "match_date"])
    numbers = ("log_loss", "brier", "mean_delta", "low", "high")
    return out.select("rung", "added", "features", "status", *[short(c).alias(c) for c in numbers], "decision")


@query(
    "l18_promotion_gate",
    f"""SELECT model, log_loss, brier, high, CASE WHEN log_loss < 0.8995 AND brier < 0.3195 THEN 1 ELSE 0 END AS both_better,
        CASE WHEN log_loss < 0.8995 OR brier < 0.3195 THEN 1 ELSE 0 END AS any_better,
        CASE WHEN log_loss < 0.9 AND brier <= 0.32 AND high < 0 THEN 1 ELSE 0 END AS recommend FROM
        (SELECT model, log_loss, brier, {r6('ece - 0.2')} AS high FROM ({bundle_sql('two_models', 'model')}))""",
)
def _(spark, d):
    t = rounded(mx.bundle(two_models(spark, d), ["model"], "p"), ["model"])
    t = t.select("model", "log_loss", "brier", rnd(F.col("ece") - 0.2).alias("high"))
    return learn.promotion(t, {"log_loss": 0.9, "brier": 0.32})


@query(
    "l19_parameter_comparison",
    f"""WITH a AS (SELECT yr, avg(p) AS c, avg(l_tax) AS m FROM mrows WHERE grp = 'F' GROUP BY yr), b AS (SELECT yr, avg(p) AS c, avg(l_tax) AS m FROM mrows WHERE grp = 'O' GROUP BY yr)
        SELECT 'c' AS field, {r6('max(abs(a.c - b.c))')} AS max_delta FROM a JOIN b USING (yr) UNION ALL SELECT 'm', {r6('max(abs(a.m - b.m))')} FROM a JOIN b USING (yr)""",
)
def _(spark, d):
    fit = lambda g: model_rows(spark, d).where(F.col("grp") == g).groupBy("yr").agg(F.avg("p").alias("c"), F.avg("l_tax").alias("m"))
    return learn.parameter_diff(fit("F"), fit("O"), ["yr"], ["c", "m"]).select("field", rnd("max_delta").alias("max_delta"))


# ---- comparisons of prediction sets ----------------------------------------------------


def two_predictions(spark, d):
    m = matches(spark, d)
    p = lambda k: prob.expected_score((F.col("winner") % k).cast("double"), (F.col("loser") % k).cast("double"))
    base = m.select("match_id", "venue", "match_date", "pool", (F.col("match_id") % 2).alias("label"), p(200).alias("probability"))
    other = m.select("match_id", (F.col("match_id") % 2).alias("label"), p(90).alias("probability"))
    return base, other


PE = "1 / (1 + pow(10.0, (loser % {k} - winner % {k}) / 400.0))"


@query("j6_paired_predictions", f"SELECT match_id, {r6(PE.format(k=200))} AS probability_1, {r6(PE.format(k=90))} AS probability_2 FROM matches")
def _(spark, d):
    a, b = two_predictions(spark, d)
    out = learn.paired_predictions(a, b, ["match_id"])
    return out.select("match_id", rnd("probability_1").alias("probability_1"), rnd("probability_2").alias("probability_2"))


@query(
    "j7_alignment",
    """WITH a AS (SELECT match_id, match_id % 2 AS l FROM matches WHERE match_id % 11 <> 0), b AS (SELECT match_id, CASE WHEN match_id % 13 = 0 THEN 7 ELSE match_id % 2 END AS l
       FROM matches WHERE match_id % 7 <> 0)
       SELECT CAST(count(*) FILTER (a.match_id IS NULL) AS BIGINT) AS only_second, CAST(count(*) FILTER (b.match_id IS NULL) AS BIGINT) AS only_first,
       CAST(count(*) FILTER (a.l <> b.l) AS BIGINT) AS label_mismatch FROM a FULL OUTER JOIN b ON a.match_id = b.match_id""",
)
def _(spark, d):
    a, b = two_predictions(spark, d)
    k = F.col("match_id")
    b = b.withColumn("label", F.when(k % 13 == 0, 7).otherwise(F.col("label")))
    return learn.alignment(a.where(k % 11 != 0), b.where(k % 7 != 0), ["match_id"])


@query(
    "j8_tolerance_diff",
    f"""SELECT pool, {r6('max(greatest(g1, g2))')} AS max_delta, CAST(sum(CASE WHEN g1 > 1e-10 THEN 1 ELSE 0 END + CASE WHEN g2 > 1e-10 THEN 1 ELSE 0 END) AS BIGINT) AS differing
        FROM (SELECT pool, CASE WHEN match_id % 10 = 0 THEN 0.25 ELSE 0 END AS g1, CASE WHEN match_id % 6 = 0 THEN 0.125 ELSE 0 END AS g2 FROM matches) GROUP BY pool""",
)
def _(spark, d):
    m = matches(spark, d).select("match_id", "pool", (F.col("winner") * 1.0).alias("x"), (F.col("loser") * 1.0).alias("y"))
    k = F.col("match_id")
    other = m.withColumns({"x": F.col("x") + F.when(k % 10 == 0, 0.25).otherwise(0.0), "y": F.col("y") - F.when(k % 6 == 0, 0.125).otherwise(0.0)})
    out = learn.tolerance_diff(m, other, ["match_id"], ["x", "y"], "pool")
    return out.select("pool", rnd("max_delta").alias("max_delta"), "differing")


@query(
    "w19_two_temporal_modes",
    f"""WITH a AS (SELECT match_id, entity, count(*) OVER (PARTITION BY pool, entity ORDER BY batch_no RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS n FROM rparts),
        b AS (SELECT match_id, entity, pool, count(*) OVER (PARTITION BY pool, entity ORDER BY batch_no RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS n FROM vparts)
        SELECT b.pool, CAST(count(*) AS BIGINT) AS sides, CAST(count(*) FILTER (a.n <> b.n) AS BIGINT) AS differing, CAST(sum(a.n - b.n) AS BIGINT) AS extra
        FROM a JOIN b ON a.match_id = b.match_id AND a.entity = b.entity GROUP BY b.pool""",
)
def _(spark, d):
    r, v = round_parts(spark, d), venue_parts(spark, d)
    a = attach(r, st.counts_and_rest(r)).select("match_id", "entity", F.col("n_before").alias("n_r"))
    b = attach(v, st.counts_and_rest(v)).select("match_id", "entity", "pool", F.col("n_before").alias("n_v"))
    both = a.join(b, ["match_id", "entity"])
    gap = F.col("n_r") - F.col("n_v")
    return both.groupBy("pool").agg(F.count(F.lit(1)).alias("sides"), F.count_if(gap != 0).alias("differing"), F.sum(gap).alias("extra"))


# ---- sequential backtest ---------------------------------------------------------------

view("all_sides", "SELECT 'all' AS pool, entity, CASE surface WHEN 'carpet' THEN 'hard' ELSE surface END AS surface FROM sides")
view(
    "all_base",
    """SELECT 'all' AS pool, m.* EXCLUDE (pool, surface), pool AS tour, CASE surface WHEN 'carpet' THEN 'hard' ELSE surface END AS surface,
       row_number() OVER (ORDER BY match_date, match_id) AS step FROM matches m""",
)
view(
    "all_counts",
    """SELECT match_id, entity, row_number() OVER (PARTITION BY entity ORDER BY step) - 1 AS n FROM (SELECT match_id, step, winner AS entity FROM all_base
       UNION ALL SELECT match_id, step, loser FROM all_base)""",
)
view(
    "fold_all",
    """SELECT b.*, w.n AS wn, l.n AS ln, 0 AS wsn, 0 AS lsn, (18 + 18 / (1 + least(w.n, l.n) / 140.0)) * (CASE best_of WHEN 5 THEN 1.08 ELSE 1 END) AS kk
       FROM all_base b JOIN all_counts w ON w.match_id = b.match_id AND w.entity = b.winner JOIN all_counts l ON l.match_id = b.match_id AND l.entity = b.loser""",
)
view("solved_all", f"SELECT * FROM {fold_sql('fold_all', lambda x: f'0.55 * {x}s + 0.45 * {x}o', 'all_sides')}")
_BB = "0.58 * {x}s + 0.32 * {x}o - 0.10 * greatest(28.0, 85.0 * pow(0.992, {x}n))"
view(
    "backtest_points",
    f"SELECT match_id, tour, surface, best_of, {_BB.format(x='w')} AS ra, {_BB.format(x='l')} AS rb FROM solved_all",
)
_BH = f"(SELECT *, {game_sql(clamp_sql(f'0.635 + {_E}', 0.50, 0.78))} AS h1, {game_sql(clamp_sql(f'0.635 - {_E}', 0.50, 0.78))} AS h2 FROM backtest_points)"
_BM = match_sql("(1 / (1 + exp(-(h1 - h2) * 3.4)))")
view(
    "backtest_p",
    f"SELECT match_id, tour, surface, {clamp_sql(f'0.62 * ({_BM}) + 0.38 / (1 + pow(10.0, (rb - ra) / 400.0))', 0.02, 0.98)} AS pw FROM {_BH}",
)


@query(
    "a9_sequential_backtest",
    f"""WITH r AS (SELECT *, greatest(pw, 1 - pw) AS conf FROM backtest_p),
      g AS (SELECT 'all' AS part, 'all' AS value, pw, conf FROM r UNION ALL SELECT 'pool', tour, pw, conf FROM r UNION ALL SELECT 'surface', surface, pw, conf FROM r
        UNION ALL SELECT 'confidence', CAST(CAST(round(floor(conf * 10) * 10) AS INTEGER) AS VARCHAR) || '-' || CAST(CAST(round(floor(conf * 10) * 10 + 10) AS INTEGER) AS VARCHAR) || '%', pw, conf FROM r)
      SELECT part, value, CAST(count(*) AS BIGINT) AS matches, {r6('avg(CASE WHEN pw >= 0.5 THEN 1.0 ELSE 0.0 END)')} AS accuracy, {r6('avg((1 - pw) * (1 - pw))')} AS brier,
      {r6('avg(-ln(greatest(0.001, least(0.999, pw))))')} AS log_loss, {r6('avg(conf)')} AS confidence FROM g GROUP BY part, value""",
)
def _(spark, d):
    surface = F.when(F.col("surface") == "carpet", "hard").otherwise(F.col("surface"))
    m = matches(spark, d).withColumn("tour", F.col("pool")).withColumn("pool", F.lit("all")).withColumn("surface", surface)
    m = m.withColumn("batch_no", st.day_number(F.col("match_date")).cast("bigint"))
    solved = rt.solve_ratings(parts(spark, d, m), rt.BACKTEST)
    n = lambda w: F.filter("sides", lambda s: s["won"] == w)[0]["n"]
    blended = lambda s, w: (
        0.58 * F.col(f"surface_{s}") + 0.32 * F.col(f"overall_{s}") - 0.10 * st.rating_uncertainty(n(w))
    )
    x = solved.select("match_id", blended("w", 1).alias("ra"), blended("l", 0).alias("rb"))
    x = m.select("match_id", "tour", "surface", "best_of").join(x, "match_id")
    x = prob.with_rating_probability_smooth(x, "ra", "rb", "best_of", "pw").withColumn("conf", mx.favourite(F.col("pw")))
    low = (F.floor(F.col("conf") * 10) * 10).cast("int")
    bucket = F.concat(low.cast("string"), F.lit("-"), (low + 10).cast("string"), F.lit("%"))
    dims = {"all": F.lit("all"), "pool": F.col("tour"), "surface": F.col("surface"), "confidence": bucket}
    flat = x.select("pw", "conf", F.inline(F.array(*[F.struct(F.lit(k).alias("part"), v.alias("value")) for k, v in dims.items()])))
    return flat.groupBy("part", "value").agg(
        F.count(F.lit(1)).alias("matches"),
        rnd(F.avg((F.col("pw") >= 0.5).cast("double"))).alias("accuracy"),
        rnd(F.avg((1 - F.col("pw")) * (1 - F.col("pw")))).alias("brier"),
        rnd(F.avg(-F.log(prob.clamp(F.col("pw"), 0.001, 0.999)))).alias("log_loss"),
        rnd(F.avg("conf")).alias("confidence"),
    )
