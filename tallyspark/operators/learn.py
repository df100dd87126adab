"""Fitting, calibrating, scoring and comparing probability models.

Sums over the rows are taken on the cluster; what comes back to the driver grows with the features alone.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.prob import clamp, logit, sigmoid
from tallyspark.operators import metrics as mx
from tallyspark.operators.newton import Calibration, Fit, Linear, calibrate_all, fit_all
from tallyspark.operators.resample import log_loss_of, resampled_means
from tallyspark.session import cut_lineage, drop_staged, only, staged


def model_logit(model: Linear) -> Column:
    return linear_score(model.features, model.coefficients, model.intercept, model.center, model.scale)


def linear_score(
    features: Sequence[str],
    coefficients: Sequence[float],
    intercept: float,
    center: Sequence[float] | None = None,
    scale: Sequence[float] | None = None,
) -> Column:
    """One projection; a zero scale counts as one."""
    total = F.lit(float(intercept))
    for i, (f, b) in enumerate(zip(features, coefficients, strict=True)):
        x = F.col(f)
        if center and scale:
            x = (x - F.lit(float(center[i]))) / F.lit(float(scale[i]) or 1.0)
        total = total + F.lit(float(b)) * x
    return total


def row_model_score(values: Column, coefficients: Column, intercept: Column) -> Column:
    """Score where every row carries its own coefficient array."""
    return F.aggregate(F.zip_with(values, coefficients, lambda x, b: x * b), intercept, lambda acc, v: acc + v)


# Logit scale of the single-feature baselines.
BASELINES = {
    "overall_elo": ("overall_elo_diff", 2.2),
    "surface_elo": ("surface_elo_diff", 2.2),
    "ranking": ("ranking_diff", 2.2),
    "serve_return": ("serve_point_won_diff", 9.0),
}


def baseline_logits(baselines: dict[str, tuple[str, float]] = BASELINES) -> dict[str, Column]:
    return {n: logit(sigmoid(F.lit(k) * F.col(f))) for n, (f, k) in baselines.items()}


def stacked_score(base: Column, stacker: dict[str, float], intercept: float, baselines: dict[str, tuple[str, float]]) -> Column:
    parts = {"full_logistic": base, **baseline_logits(baselines)}
    total = F.lit(float(intercept))
    for n, b in stacker.items():
        total = total + F.lit(float(b)) * parts[n]
    return total


def standardization(df: DataFrame, features: Sequence[str]) -> tuple[list[float], list[float]]:
    """Mean and population deviation of every feature in one pass; tiny deviations become one."""
    row = df.agg(*[F.avg(f).alias(f"m{i}") for i, f in enumerate(features)], *[F.stddev_pop(f).alias(f"s{i}") for i, f in enumerate(features)]).first()
    n = len(features)
    center = [float(row[i] or 0.0) for i in range(n)]
    scale = [float(row[n + i] or 0.0) for i in range(n)]
    return center, [s if s >= 1e-6 else 1.0 for s in scale]


def fit_logistic(df: DataFrame, features: Sequence[str], l2: float = 0.004, label: str = "label", iterations: int = 60) -> Linear:
    """One ridge logistic regression on standardized features."""
    return fit_all(df, {"all": F.lit(True)}, [Fit("all", tuple(features), l2)], label, iterations)[0]


def fit_calibration(df: DataFrame, raw: Column, label: str = "label", pull: float = 0.002, steps: int = 25) -> Calibration:
    """Slope and intercept of one model's logits; the slope is pulled towards one."""
    return calibrate_all(df.select(F.lit(0).alias("model"), raw.alias("raw"), F.col(label)), 1, label, pull, steps)[0]


Scorer = Callable[[DataFrame], DataFrame]


def logistic_candidate(train: DataFrame, features: Sequence[str], params: dict) -> Scorer:
    model = fit_logistic(train, features, l2=params.get("l2", 0.004))
    return lambda df: df.withColumn("raw", model_logit(model))


def boosted_candidate(train: DataFrame, features: Sequence[str], params: dict) -> Scorer:
    """Gradient-boosted trees on the same contract; the raw score is a logit."""
    asm = VectorAssembler(inputCols=list(features), outputCol="_v")
    gbt = GBTClassifier(
        featuresCol="_v",
        labelCol="_y",
        maxIter=params.get("trees", 20),
        maxDepth=params.get("depth", 3),
        stepSize=params.get("rate", 0.1),
        minInstancesPerNode=params.get("leaf", 20),
        seed=11,
    )
    model = gbt.fit(asm.transform(train.select(*features, F.col("label").cast("double").alias("_y"))))

    def score(df: DataFrame) -> DataFrame:
        out = model.transform(asm.transform(df))
        return out.withColumn("raw", logit(vector_to_array("probability")[1])).drop("_v", "rawPrediction", "probability", "prediction")

    return score


CANDIDATES = {"logistic": logistic_candidate, "boosted": boosted_candidate}


@dataclass(frozen=True)
class Variant:
    """A logistic candidate: its features and penalty."""

    features: tuple[str, ...]
    l2: float = 0.004


def _scored_by_year(rows: DataFrame, models: Sequence[tuple[str, int, Linear]], years: Sequence[int], year: str) -> DataFrame:
    """Rows of the years with the logit ``raw`` of every model of their year; each model has a ``variant`` and a ``fold``.

    Coefficients come as a small table joined on the year, so rows are only multiplied by the models that score them. The
    table has one row per model and goes to every task: dealt by year, a whole year's rows would be one task's.
    """
    features = list(dict.fromkeys(f for _, _, m in models for f in m.features))
    table = [(y, i, v, f, *m.plain(features)) for i, ((v, f, m), y) in enumerate(zip(models, years, strict=True))]
    weights = rows.sparkSession.createDataFrame(table, "_year int, model int, variant string, fold int, _weights array<double>, _shift double")
    values = F.array(*[F.col(f).cast("double") for f in features]).cast("array<double>")
    term = lambda x, b: F.when(b == 0.0, F.lit(0.0)).otherwise(x * b)
    raw = F.aggregate(F.zip_with("_values", "_weights", term), F.col("_shift"), lambda total, v: total + v)
    scored = rows.withColumn("_values", values).join(F.broadcast(weights), F.col(year) == F.col("_year"))
    return scored.withColumn("raw", raw).drop("_values", "_weights", "_shift", "_year")


def variant_predictions(rows: DataFrame, variants: dict[str, Variant], folds: Sequence[int], year: str = "yr") -> DataFrame:
    """Out-of-fold rows of every variant with ``variant``, ``fold``, ``raw`` and ``probability``.

    Each fold is fit before y-1, calibrated on y-1 and predicts y. All variants and folds are fitted in the same
    passes over the rows, calibrated in the same passes, and scored in one.
    """
    if not folds or not variants:
        return rows.withColumns({"variant": F.lit(""), "fold": F.lit(0), "raw": F.lit(0.0), "probability": F.lit(0.5)}).where(F.lit(False))
    rows = staged(rows)
    samples = {str(f): F.col(year) < f - 1 for f in folds}
    keys = [(name, fold) for name in variants for fold in folds]
    fitted = fit_all(rows, samples, [Fit(str(fold), variants[name].features, variants[name].l2) for name, fold in keys])
    models = [(name, fold, m) for (name, fold), m in zip(keys, fitted, strict=True)]
    held = _scored_by_year(rows, models, [fold - 1 for _, fold, _ in models], year)
    lines = calibrate_all(held.select("model", "raw", "label"), len(models))
    scored = _scored_by_year(rows, models, [fold for _, fold, _ in models], year)
    line = F.element_at(F.array(*[F.struct(F.lit(c.slope).alias("a"), F.lit(c.intercept).alias("b")) for c in lines]), F.col("model") + 1)
    return scored.withColumn("probability", sigmoid(line["a"] * F.col("raw") + line["b"])).drop("model")


def fold_predictions(
    rows: DataFrame, features: Sequence[str], folds: Sequence[int], kind: str = "logistic", params: dict | None = None, year: str = "yr"
) -> DataFrame:
    """Out-of-fold rows with ``probability`` and ``fold``: fit before y-1, calibrate on y-1, predict y."""
    if kind == "logistic" or not folds:
        return variant_predictions(rows, {kind: Variant(tuple(features), (params or {}).get("l2", 0.004))}, folds, year).drop("variant")
    pieces = None
    y = F.col(year)
    rows = cut_lineage(rows) if len(folds) > 1 else rows
    for fold in folds:
        scorer = CANDIDATES[kind](rows.where(y < fold - 1), features, params or {})
        held = scorer(rows.where(y == fold - 1))
        cal = fit_calibration(held, F.col("raw"))
        test = scorer(rows.where(y == fold)).withColumn("probability", sigmoid(cal.apply(F.col("raw")))).withColumn("fold", F.lit(fold))
        pieces = test if pieces is None else pieces.unionByName(test)
    return pieces


def parameter_grid(rows: DataFrame, variants: dict[str, Variant], folds: Sequence[int], year: str = "yr") -> DataFrame:
    """Mean log loss and Brier score over the folds of every variant."""
    features = dict.fromkeys(f for v in variants.values() for f in v.features)
    # the metrics read the predictions several times, so they are made once
    made = lambda: variant_predictions(rows.select(*dict.fromkeys([*features, year, "label"])), variants, folds, year).select("variant", "fold", "label", "probability")
    return mx.bundle(only(made), ["variant", "fold"], "probability").groupBy("variant").agg(F.avg("log_loss").alias("log_loss"), F.avg("brier").alias("brier"))


def walk_forward(rows: DataFrame, features, folds, kind="logistic", params=None, year="yr") -> DataFrame:
    """Metric bundle per fold plus the pooled bundle (``fold`` 0)."""
    narrow = rows.select(*dict.fromkeys([*features, year, "label"]))
    # the metrics read the predictions several times, so they are made once
    pred = only(lambda: fold_predictions(narrow, features, folds, kind, params, year).select("label", "probability", "fold"))
    both = pred.withColumn("fold", F.explode(F.array("fold", F.lit(0))))
    return mx.bundle(both, ["fold"], "probability")


def fixed_split(rows: DataFrame, features, kind="logistic", params=None, role: str = "role") -> tuple[Scorer, Calibration]:
    """Fit on the train role and calibrate on the calibration role."""
    scorer = CANDIDATES[kind](rows.where(F.col(role) == "train"), features, params or {})
    return scorer, fit_calibration(scorer(rows.where(F.col(role) == "calibration")), F.col("raw"))


def best_by(table: DataFrame, key: str, *order: str) -> DataFrame:
    """The row with the smallest (order...) tuple."""
    return table.agg(F.min_by(F.struct(*table.columns), F.struct(*order, key)).alias("_b")).select("_b.*")


def blend_search(rows: DataFrame, members: Sequence[str], weights: Sequence[Sequence[float]], label: str = "label") -> DataFrame:
    """Mean log loss of every weight vector.

    Rows are not multiplied by the grid: each Arrow batch returns one partial sum per weight vector.
    """
    import numpy as np
    import pyarrow as pa

    grid = np.array(weights, dtype=float).T

    def partial(batches):
        for batch in batches:
            probs = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[:-1]])
            y = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
            total = np.zeros(grid.shape[1])
            for at in range(0, len(y), 1024):
                p = np.clip(probs[at : at + 1024] @ grid, 1e-6, 1 - 1e-6)
                total -= np.log(np.where(y[at : at + 1024, None] == 1, p, 1 - p)).sum(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total), pa.array(np.full(len(total), len(y)))], names=["weight_id", "total", "n"])

    flat = rows.select(*[F.col(m).cast("double") for m in members], F.col(label).cast("double"))
    sums = flat.mapInArrow(partial, "weight_id int, total double, n long")
    return sums.groupBy("weight_id").agg((F.sum("total") / F.sum("n")).alias("log_loss"))


def blend_winner(losses: DataFrame, weights: Sequence[Sequence[float]]) -> DataFrame:
    """The weight vector with the smallest loss; the earlier one of equals."""
    best = losses.agg(F.min_by(F.struct("weight_id", "log_loss"), F.struct("log_loss", "weight_id")).alias("b")).select("b.*")
    grid = F.array(*[F.array(*[F.lit(float(v)) for v in w]) for w in weights])
    return best.withColumn("weights", F.element_at(grid, F.col("weight_id") + 1))


def simplex_weights(members: int, count: int, seed: int = 29) -> list[list[float]]:
    """Deterministic random weight vectors that sum to one."""
    import numpy as np

    return np.random.default_rng(seed).dirichlet(np.ones(members), count).tolist()


def stack(rows: DataFrame, features, folds, baselines, year="yr", params=None) -> tuple[Linear, DataFrame]:
    """Stacker on out-of-fold logits: the full model, fitted on all years before the fold, beside the baselines."""
    if not folds:
        raise ValueError("no fold to stack on")
    rows = cut_lineage(rows)
    fits = [Fit(str(fold), tuple(features), (params or {}).get("l2", 0.004)) for fold in folds]
    models = fit_all(rows, {str(fold): F.col(year) < fold for fold in folds}, fits)
    held = _scored_by_year(rows, [("", fold, m) for fold, m in zip(folds, models, strict=True)], folds, year)
    oof = held.withColumnRenamed("raw", "full_logistic").withColumns(baseline_logits(baselines))
    oof = cut_lineage(oof.select("label", "fold", "full_logistic", *baselines))
    return fit_logistic(oof, ["full_logistic", *baselines]), oof


def stacked_evaluation(rows: DataFrame, features, folds, baselines, role: str = "role", year: str = "yr", params=None) -> DataFrame:
    """Test metrics of the stack: base model on the train role, calibration on its own role."""
    train = rows.where(F.col(role) == "train")
    stacker, _ = stack(train, features, folds, baselines, year, params)
    base = fit_logistic(train, features, l2=(params or {}).get("l2", 0.004))
    weights = dict(zip(stacker.features, stacker.coefficients, strict=True))
    names = ["full_logistic", *baselines]
    scored = rows.withColumn("full_logistic", model_logit(base)).withColumns(baseline_logits(baselines))
    scored = scored.withColumn("stacked", linear_score(names, [weights[n] for n in names], stacker.intercept, stacker.center, stacker.scale))
    cal = fit_calibration(scored.where(F.col(role) == "calibration"), F.col("stacked"))
    test = scored.where(F.col(role) == "test").withColumn("probability", sigmoid(cal.apply(F.col("stacked"))))
    return mx.bundle(test, [], "probability")


def ablation(rows: DataFrame, features, families: dict[str, Sequence[str]], folds, year="yr") -> DataFrame:
    """Pooled metrics with one family dropped, and the change against the full set.

    A family without any of the features, and one that holds them all, is left out.
    """
    variants = {}
    for name, dropped in {"full": (), **families}.items():
        kept = tuple(f for f in features if f not in set(dropped))
        if kept and (name == "full" or len(kept) < len(features)):
            variants[name] = Variant(kept)
    pred = only(lambda: variant_predictions(rows, variants, folds, year).select(F.col("variant").alias("dropped"), "label", "probability"))
    full = F.max(F.when(F.col("dropped") == "full", F.col("log_loss"))).over(Window.partitionBy(F.lit(0)))
    table = cut_lineage(mx.bundle(pred, ["dropped"], "probability"))
    drop_staged(pred)
    return table.withColumn("delta_log_loss", F.col("log_loss") - full)


def ladder(rows: DataFrame, rungs: Sequence[tuple[str, Sequence[str]]], folds, key: Sequence[str], block: Sequence[str], year="yr", iterations: int = 600) -> DataFrame:
    """Cumulative feature ladder: each rung is kept when it lowers pooled and bootstrapped log loss.

    A rung adds its features to those of all rungs before it, kept or not, and is compared with the rung before it; one
    that adds nothing repeats that rung's predictions. Rungs that still have no feature at all, and all rungs when there
    are no folds, are not evaluated and say DELETE. Keys are unique, keys and blocks hold no nulls.
    """
    spark = rows.sparkSession
    variants: dict[str, Variant] = {}
    steps, sets, features = [], {}, ()
    for name, added in rungs:
        fresh = tuple(f for f in dict.fromkeys(added) if f not in features)
        features = (*features, *fresh)
        # equal sets are fitted once
        fitted = sets.setdefault(features, name)
        if features and fitted == name:
            variants[name] = Variant(features)
        steps.append((name, len(fresh), len(features), fitted if features else None))
    schema = "rung string, added int, features int, status string, log_loss double, brier double, mean_delta double, low double, high double, decision string"
    left_out = lambda name, added, n: (name, added, n, "not_enough_fold_rows" if n else "not_evaluated_no_supported_features", *[None] * 5, "DELETE")
    if not variants or not folds:
        return spark.createDataFrame([left_out(*s[:3]) for s in steps], schema)

    rows = staged(rows)
    pred = only(lambda: variant_predictions(rows, variants, folds, year).select(*dict.fromkeys([*key, *block]), "label", "variant", "probability"), "ladder")
    scores = {r["variant"]: r for r in mx.bundle(pred, ["variant"], "probability").collect()}
    if not scores:
        return spark.createDataFrame([left_out(*s[:3]) for s in steps], schema)
    order = list(variants)
    # one row per key: the losses of all variants side by side, so a draw of blocks serves every rung
    single = F.assert_true(F.count(F.lit(1)) == len(order), "prediction keys are not unique").isNull()
    wide = pred.withColumn("_loss", log_loss_of(F.col("probability"), F.col("label"))).groupBy(*dict.fromkeys([*key, *block])).agg(
        single.alias("_single"), *[F.sum(F.when(F.col("variant") == v, F.col("_loss"))).alias(f"_l{i}") for i, v in enumerate(order)]
    )
    sums = wide.where("_single").groupBy(*block).agg(F.count(F.lit(1)).alias("n"), *[F.sum(f"_l{i}").alias(f"_l{i}") for i in range(len(order))])
    draws = resampled_means(sums, block, [f"_l{i}" for i in range(len(order))], iterations)
    gap = [F.col(f"_l{i}") - F.col(f"_l{i - 1}") for i in range(1, len(order))]
    bounds = F.array(F.lit(0.025), F.lit(0.975))
    deltas = draws.agg(F.count(F.lit(1)), *[c for g in gap for c in (F.avg(g), F.percentile(g, bounds))]).first()[1:]

    results, last = [], None
    for name, added, n, variant in steps:
        if variant is None:
            results.append(left_out(name, added, n))
            continue
        score, mean, low, high, decision = scores[variant], None, None, None, "KEEP_BASELINE"
        if last is not None:
            i = order.index(variant)
            mean, (low, high) = (0.0, (0.0, 0.0)) if variant == last else deltas[2 * (i - 1) : 2 * i]
            decision = "KEEP" if score["log_loss"] < scores[last]["log_loss"] and mean < 0 else "DELETE"
        last = variant
        results.append((name, added, n, "evaluated", score["log_loss"], score["brier"], mean, low, high, decision))
    return spark.createDataFrame(results, schema)


def paired_predictions(one: DataFrame, two: DataFrame, key: Sequence[str]) -> DataFrame:
    """One-to-one join of two prediction sets; a repeated key on either side is an error."""
    check = lambda c: F.assert_true(c == 1, "prediction keys are not unique")
    single = lambda df, i: (
        df.groupBy(*key)
        .agg(F.count(F.lit(1)).alias("_n"), *[F.first(c).alias(c) for c in df.columns if c not in key])
        .where(check(F.col("_n")).isNull())
        .drop("_n")
        .withColumnRenamed("probability", f"probability_{i}")
    )
    right = single(two, 2).select(*key, "probability_2")
    return single(one, 1).join(right, list(key))


def alignment(one: DataFrame, two: DataFrame, key: Sequence[str], label: str = "label") -> DataFrame:
    """How many keys are missing on a side or disagree on the label."""
    a = one.select(*key, F.col(label).alias("_a"))
    b = two.select(*key, F.col(label).alias("_b"))
    both = a.join(b, list(key), "full_outer")
    return both.agg(
        F.count_if(F.col("_a").isNull()).alias("only_second"),
        F.count_if(F.col("_b").isNull()).alias("only_first"),
        F.count_if(F.col("_a") != F.col("_b")).alias("label_mismatch"),
    )


def tolerance_diff(one: DataFrame, two: DataFrame, key: Sequence[str], features: Sequence[str], year: str, eps: float = 1e-10) -> DataFrame:
    """Largest difference and differing cells per year of two versions of a feature table."""
    right = two.select(*key, *[F.col(f).alias(f"_o_{f}") for f in features])
    gaps = F.array(*[F.abs(F.col(f) - F.col(f"_o_{f}")) for f in features])
    cells = one.join(right, list(key)).select(year, F.explode(gaps).alias("gap"))
    return cells.groupBy(year).agg(F.max("gap").alias("max_delta"), F.count_if(F.col("gap") > eps).alias("differing"))


def parameter_diff(one: DataFrame, two: DataFrame, key: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Largest absolute difference per parameter field of two coefficient tables."""
    right = two.select(*key, *[F.col(f).alias(f"_o_{f}") for f in fields])
    flat = F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.abs(F.col(f) - F.col(f"_o_{f}")).alias("gap")) for f in fields]))
    return one.join(right, list(key)).select(flat).groupBy("field").agg(F.max("gap").alias("max_delta"))


def promotion(table: DataFrame, current: dict[str, float], margin: float = 0.0005) -> DataFrame:
    """Gate columns per candidate: both losses better by the margin, either one, and interval below zero."""
    ll = F.col("log_loss") < current["log_loss"] - margin
    br = F.col("brier") < current["brier"] - margin
    return table.select(
        "*",
        (ll & br).cast("int").alias("both_better"),
        (ll | br).cast("int").alias("any_better"),
        ((F.col("log_loss") < current["log_loss"]) & (F.col("brier") <= current["brier"]) & (F.col("high") < 0)).cast("int").alias("recommend"),
    )


def outcome(p: Column, one: Column, two: Column) -> dict[str, Column]:
    """Winner, edge and display probability of a scored matchup."""
    return {
        "winner": F.when(p >= 0.5, one).otherwise(two),
        "edge": F.abs(p - 0.5) * 2,
        "probability": F.round(clamp(p, 0.01, 0.99) + 1e-9, 4),
    }
