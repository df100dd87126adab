"""What was known about an entity before each batch: counts, rates, form, rest, workload, metadata."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.prob import logit
from tallyspark.operators.prefix import asof_before, numbers_first, prior_totals, sequence_rows, trailing_means

ENTITY = ("pool", "entity")
ENTITY_SURFACE = ("pool", "entity", "surface")
EPOCH = "2000-01-01"


@dataclass(frozen=True)
class StatSpec:
    name: str
    success: str
    trials: str
    prior: float
    weight: float = 120.0


# Success and trial columns, prior rate and prior weight of each rate.
SERVE_STATS = (
    StatSpec("ace_rate", "aces", "svpt", 0.055),
    StatSpec("df_rate", "dfs", "svpt", 0.035),
    StatSpec("first_in", "first_in", "svpt", 0.62),
    StatSpec("first_won", "first_won", "first_in", 0.72),
    StatSpec("second_won", "second_won", "svpt_second", 0.52),
    StatSpec("bp_save", "bp_saved", "bp_faced", 0.58, 40.0),
    StatSpec("bp_convert", "bp_converted", "bp_opps", 0.40, 40.0),
    StatSpec("return_point_won", "return_won", "return_points", 0.365),
    StatSpec("serve_point_won", "service_won", "svpt", 0.635),
)
DECAY_DAYS = 730.0


def derived_counts(p: DataFrame) -> DataFrame:
    """Service, return and break-point counts of a side from both sides' raw counts."""
    service = F.col("first_won") + F.col("second_won")
    return p.withColumns(
        {
            "service_won": service,
            "return_points": F.col("o_svpt"),
            "return_won": F.col("o_svpt") - (F.col("o_first_won") + F.col("o_second_won")),
            "bp_converted": F.col("o_bp_faced") - F.col("o_bp_saved"),
            "bp_opps": F.col("o_bp_faced"),
        }
    )


def day_number(date: Column, origin: str = EPOCH) -> Column:
    return F.datediff(date, F.lit(origin).cast("date"))


def smoothed(success: Column, trials: Column, prior: Column | float, weight: float) -> Column:
    prior = F.lit(prior) if isinstance(prior, float) else prior
    w = F.lit(float(weight))
    return F.when(trials > 0, (prior * w + success) / (w + trials)).otherwise(prior)


@dataclass(frozen=True)
class Measures:
    """Running sums and maxima plus the columns built from them once the totals are known."""

    sums: dict[str, Column]
    maxes: dict[str, Column]
    outs: list[Column]


def state_table(parts: DataFrame, keys: Sequence[str], measures: Sequence[Measures]) -> DataFrame:
    """All measures of a key in one pre-batch scan, one row per (keys, batch_no)."""
    sums = {n: c for m in measures for n, c in m.sums.items()}
    maxes = {n: c for m in measures for n, c in m.maxes.items()}
    dated = parts.withColumn("_day", day_number(F.col("match_date")))
    totals = prior_totals(dated, keys, ["batch_no", "match_date"], sums=sums, maxes=maxes, combine=False)
    return totals.select(*keys, "batch_no", *[c for m in measures for c in m.outs])


def latest_table(parts: DataFrame, keys: Sequence[str], measures: Sequence[Measures]) -> DataFrame:
    """All measures of a key after its last row: one combined aggregation, one row per key."""
    dated = parts.withColumn("_day", day_number(F.col("match_date")))
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(n) for m in measures for n, c in m.sums.items()]
    maxes = [F.max(c).alias(n) for m in measures for n, c in m.maxes.items()]
    return dated.groupBy(*keys).agg(*sums, *maxes).select(*keys, *[c for m in measures for c in m.outs])


# ---- cumulative rates -------------------------------------------------------------------


def cumulative_measures(stats: Sequence[StatSpec] = SERVE_STATS) -> Measures:
    """Smoothed career rates; negative or missing counts are left out."""
    cols = sorted({s.success for s in stats} | {s.trials for s in stats} | {"svpt"})
    sums = {f"c_{c}": F.when(F.col(c) >= 0, F.col(c).cast("double")) for c in cols}
    rates = [smoothed(F.col(f"c_{s.success}"), F.col(f"c_{s.trials}"), s.prior, s.weight).alias(s.name) for s in stats]
    sample = (F.least(F.col("c_svpt"), F.lit(6000.0)) / 6000.0).alias("stat_sample")
    return Measures(sums, {}, [*rates, sample])


def cumulative_rates(parts: DataFrame, stats: Sequence[StatSpec] = SERVE_STATS) -> DataFrame:
    return state_table(parts, ENTITY, [cumulative_measures(stats), Measures({"n_before": F.lit(1)}, {}, [F.col("n_before")])])


# ---- exponentially decayed values -------------------------------------------------------
# Weights grow as 2^(day / half-life) from a fixed origin; dividing two such sums equals decaying
# to the last update. (span in days) / half-life must stay below 900 to fit a double.


def growth_sql(half_life: float) -> str:
    """2^(day / half-life); an error where a double could not hold the sums."""
    far = f"_day / {half_life}D"
    return f"CASE WHEN abs({far}) < 900D THEN pow(2D, {far}) ELSE CAST(raise_error('span over half-life is beyond 900') AS DOUBLE) END"


@dataclass(frozen=True)
class DecaySpec:
    name: str
    value: str
    half_life: float


def decayed_mean_measures(specs: Sequence[DecaySpec]) -> Measures:
    """Decayed mean of each value; null values do not count, no value is 0."""
    sums: dict[str, Column] = {}
    for s in specs:
        growth = growth_sql(s.half_life)
        sums[f"n_{s.name}"] = F.expr(f"{s.value} * ({growth})")
        sums[f"d_{s.name}"] = F.expr(f"CASE WHEN {s.value} IS NOT NULL THEN {growth} END")
    means = [F.expr(f"CASE WHEN d_{s.name} > 0 THEN n_{s.name} / d_{s.name} ELSE 0D END AS {s.name}") for s in specs]
    return Measures(sums, {}, means)


def decayed_means(parts: DataFrame, keys: Sequence[str], specs: Sequence[DecaySpec]) -> DataFrame:
    return state_table(parts, keys, [decayed_mean_measures(specs)])


# The decayed success/trial pairs.
DECAYED_STATS = (
    StatSpec("serve_points", "svpt", "svpt", 0.0),
    StatSpec("service_won", "service_won", "svpt", 0.0),
    StatSpec("return_won", "return_won", "return_points", 0.365),
    StatSpec("aces", "aces", "svpt", 0.055),
    StatSpec("double_faults", "dfs", "svpt", 0.035),
    StatSpec("first_in", "first_in", "svpt", 0.62),
    StatSpec("first_won", "first_won", "first_in", 0.72),
    StatSpec("second_won", "second_won", "svpt_second", 0.52),
    StatSpec("bp_saved", "bp_saved", "bp_faced", 0.58, 40.0),
    StatSpec("bp_converted", "bp_converted", "bp_opps", 0.40, 40.0),
)


def decayed_count_measures(stats: Sequence[StatSpec], prefix: str = "", half_life: float = DECAY_DAYS) -> Measures:
    """Decayed successes ``s_*`` and trials ``t_*`` as of the last valid row.

    Rows without positive trials neither count nor move the decay date.
    """
    sums, maxes, outs = {}, {}, []
    h = f"{half_life}D"
    for s in stats:
        valid = f"{s.trials} > 0 AND {s.success} IS NOT NULL"
        amount = {"s": f"greatest(0D, CAST({s.success} AS DOUBLE))", "t": f"CAST({s.trials} AS DOUBLE)"}
        for k, v in amount.items():
            sums[f"d{k}_{s.name}"] = F.expr(f"CASE WHEN {valid} THEN {v} * ({growth_sql(half_life)}) END")
            outs.append(F.expr(f"d{k}_{s.name} * pow(2D, -coalesce(dl_{s.name}, 0) / {h}) AS {prefix}{k}_{s.name}"))
        maxes[f"dl_{s.name}"] = F.expr(f"CASE WHEN {valid} THEN _day END")
    return Measures(sums, maxes, outs)


def decayed_counts(parts: DataFrame, keys: Sequence[str], stats: Sequence[StatSpec], prefix: str = "") -> DataFrame:
    return state_table(parts, keys, [decayed_count_measures(stats, prefix)])


def decayed_rate(name: str, prior: Column | float, weight: float = 120.0, prefix: str = "") -> Column:
    return smoothed(F.col(f"{prefix}s_{name}"), F.col(f"{prefix}t_{name}"), prior, weight)


def decayed_surface_rate(name: str, prior: float, weight: float = 120.0, prefix: str = "f_") -> Column:
    """The surface rate shrinks towards the overall rate."""
    overall = decayed_rate(name, prior, weight)
    return smoothed(F.col(f"{prefix}s_{name}"), F.col(f"{prefix}t_{name}"), overall, max(30.0, 0.65 * weight))


def latent_skills(prior: Column) -> dict[str, Column]:
    """Serve and return skill as logit distance from the pool's prior, overall and on the surface."""
    back = 1.0 - prior

    def rate(name: str, base: Column, weight: float) -> Column:
        return smoothed(F.col(f"s_{name}"), F.col(f"t_{name}"), base, weight)

    def on_surface(name: str, base: Column) -> Column:
        return smoothed(F.col(f"f_s_{name}"), F.col(f"f_t_{name}"), rate(name, base, 260.0), 169.0)

    spread = F.lit(120.0) + 0.25 * F.col("t_serve_points") + F.col("f_t_serve_points")
    return {
        "latent_serve": logit(rate("service_won", prior, 420.0)) - logit(prior),
        "latent_return": logit(rate("return_won", back, 420.0)) - logit(back),
        "surface_serve": logit(on_surface("service_won", prior)) - logit(prior),
        "surface_return": logit(on_surface("return_won", back)) - logit(back),
        "latent_uncertainty": F.sqrt(1.0 / spread),
    }


# ---- form ------------------------------------------------------------------------------


def recent_form(parts: DataFrame, keys: Sequence[str], spans: Sequence[int]) -> DataFrame:
    """Win rate over the last N results before each batch; .5 without results."""
    keys = list(keys)
    rows = sequence_rows(parts.select(*keys, "batch_no", "match_id", "won"), keys, "batch_no", "match_id")
    trail = trailing_means(rows, keys, "seq", "won", spans)
    body = F.struct("seq", *[F.col(f"won_{n}") for n in spans])
    last = prior_totals(trail, keys, "batch_no", maxes={"_body": body})
    return last.select(
        *keys, "batch_no", *[F.coalesce(F.col(f"_body.won_{n}"), F.lit(0.5)).alias(f"form_{n}") for n in spans]
    )


# ---- rest, counts, workload ------------------------------------------------------------


def count_rest_measures(default: float = 21.0, cap: float = 90.0) -> Measures:
    """Matches and wins so far and days since the last earlier match."""
    gap = F.datediff("match_date", "last_date").cast("double")
    return Measures(
        {"n_before": F.lit(1), "wins_before": F.col("won")},
        {"last_date": F.col("match_date")},
        [F.col("n_before"), F.col("wins_before"), F.col("last_date"), rest_days(gap, default, cap).alias("days_rest")],
    )


def counts_and_rest(parts: DataFrame, default: float = 21.0, cap: float = 90.0) -> DataFrame:
    return state_table(parts, ENTITY, [count_rest_measures(default, cap)])


def rest_days(gap: Column, default: float, cap: float) -> Column:
    """Days since the last match within [0, cap]; the default where there is none."""
    return F.when(gap.isNull(), F.lit(default)).otherwise(F.least(F.lit(cap), F.greatest(F.lit(0.0), gap)))


def surface_count_measures() -> Measures:
    return Measures({"surface_n": F.lit(1)}, {}, [F.col("surface_n")])


def surface_counts(parts: DataFrame) -> DataFrame:
    return state_table(parts, ENTITY_SURFACE, [surface_count_measures()])


def recovery(rest: Column) -> Column:
    return 1.0 - F.exp(-rest / 3.5)


def workload(parts: DataFrame, windows: Sequence[int] = (3, 7, 14), keep: int = 51) -> DataFrame:
    """Matches in the last N days (inclusive) from other, earlier batches.

    Days of an entity are bounded by the calendar and batches of a day by the day's venues, so
    both windows run over pre-aggregated rows only. ``keep`` is the length of the remembered
    history, which bounds the count.
    """
    per_batch = parts.groupBy(*ENTITY, "match_date", "batch_no").agg(F.count(F.lit(1)).alias("_n"))
    per_day = per_batch.groupBy(*ENTITY, "match_date").agg(F.sum("_n").alias("_n"))
    by_day = Window.partitionBy(*ENTITY).orderBy("_day")
    days = per_day.withColumn("_day", day_number(F.col("match_date"))).select(
        *ENTITY,
        "match_date",
        *[F.coalesce(F.sum("_n").over(by_day.rangeBetween(-n, -1)), F.lit(0)).alias(f"_w{n}") for n in windows],
    )
    same_day = Window.partitionBy(*ENTITY, "match_date").orderBy("batch_no").rowsBetween(Window.unboundedPreceding, -1)
    today = per_batch.withColumn("_today", F.coalesce(F.sum("_n").over(same_day), F.lit(0)))
    return today.join(days, [*ENTITY, "match_date"]).select(
        *ENTITY,
        "batch_no",
        *[F.least(F.lit(keep), F.col(f"_w{n}") + F.col("_today")).cast("double").alias(f"workload_{n}d") for n in windows],
    )


# ---- metadata --------------------------------------------------------------------------

META = ("ranking", "ranking_points", "age", "height", "hand")


def _metadata_entries(parts: DataFrame, venue_batch: str, fields: Sequence[str]) -> tuple[DataFrame, dict[str, Column]]:
    """One row per entity and venue batch, and per field a struct that is null where the field is unknown."""
    entry = parts.groupBy(*ENTITY, venue_batch).agg(
        F.min_by(F.struct(*fields), F.struct("round_order", "match_id")).alias("_m")
    )
    known = {
        f: (F.col(f"_m.{f}") != "") if dict(parts.dtypes)[f] == "string" else F.col(f"_m.{f}").isNotNull()
        for f in fields
    }
    body = {
        f"_b_{f}": F.when(known[f], F.struct(F.col(venue_batch).alias("at"), F.col(f"_m.{f}").alias("v")))
        for f in fields
    }
    return entry, body


def carried_metadata(parts: DataFrame, venue_batch: str, fields: Sequence[str] = META) -> DataFrame:
    """Latest known metadata per venue batch, that batch included.

    Inside a batch only the entity's earliest round (then lowest match) speaks; afterwards every
    known field overwrites the older one and unknown fields keep it.
    """
    entry, body = _metadata_entries(parts, venue_batch, fields)
    carried = prior_totals(entry, ENTITY, venue_batch, maxes=body, inclusive=True)
    return carried.select(*ENTITY, venue_batch, *[F.col(f"_b_{f}.v").alias(f) for f in fields])


def latest_metadata(parts: DataFrame, venue_batch: str, fields: Sequence[str] = META) -> DataFrame:
    """What ``carried_metadata`` says after the last venue batch of each entity."""
    entry, body = _metadata_entries(parts, venue_batch, fields)
    last = entry.groupBy(*ENTITY).agg(*[F.max(c).alias(n) for n, c in body.items()])
    return last.select(*ENTITY, *[F.col(f"_b_{f}.v").alias(f) for f in fields])


def carried_metadata_last_row(parts: DataFrame, batch: str, fields: Sequence[str] = ("ranking", "ranking_points")) -> DataFrame:
    """The simpler rule: the last row of the batch with a nonzero value wins."""
    body = {
        f"_b_{f}": F.when(F.col(f) != 0, F.struct(F.col(batch).alias("at"), F.col("match_id"), F.col(f).alias("v")))
        for f in fields
    }
    carried = prior_totals(parts, ENTITY, batch, maxes=body, inclusive=True)
    return carried.select(*ENTITY, batch, *[F.col(f"_b_{f}.v").alias(f) for f in fields])


# ---- uncertainty -----------------------------------------------------------------------


def deviation_steps() -> list[float]:
    """Rating deviation after n matches, up to the first n at the floor."""
    out = [350.0]
    while out[-1] > 35.0:
        n = len(out) - 1
        out.append(max(35.0, min(350.0, out[-1] * 0.965 + 350.0 / (n + 8) ** 0.5 * 0.035)))
    return out


def rating_deviation(n: Column) -> Column:
    steps = deviation_steps()
    return F.element_at(F.array(*[F.lit(x) for x in steps]), (F.least(n, F.lit(len(steps) - 1)) + 1).cast("int"))


def rating_uncertainty(n: Column) -> Column:
    return F.greatest(F.lit(28.0), F.lit(85.0) * F.pow(F.lit(0.992), n.cast("double")))


def serving_uncertainty(n: Column) -> Column:
    return F.greatest(F.lit(28.0), F.lit(90.0) / F.pow(F.greatest(n, F.lit(1)).cast("double"), F.lit(0.35)))


# ---- pairs -----------------------------------------------------------------------------


def head_to_head(m: DataFrame, by_surface: bool = False) -> DataFrame:
    """Earlier wins of the lower and the higher entity of each unordered pair, per batch."""
    pair = m.select(
        "pool",
        "batch_no",
        "surface",
        F.least("winner", "loser").alias("lo"),
        F.greatest("winner", "loser").alias("hi"),
        (F.col("winner") < F.col("loser")).cast("int").alias("_lo_won"),
    )
    keys = ["pool", "lo", "hi"] + (["surface"] if by_surface else [])
    tag = "s" if by_surface else ""
    return prior_totals(
        pair, keys, "batch_no", sums={f"{tag}lo_wins": F.col("_lo_won"), f"{tag}hi_wins": 1 - F.col("_lo_won")}
    )


def last_state_before(probes: DataFrame, states: DataFrame, payload: Sequence[str]) -> DataFrame:
    return asof_before(probes, states, ENTITY, "batch_no", payload)


# ---- latest ----------------------------------------------------------------------------


def latest_state(parts: DataFrame) -> DataFrame:
    """Career totals, smoothed rates, last-5/10/20 form and newest ranking after the last match.

    Form reads the last twenty results only: every task keeps the last twenty of what it reads, and only those are
    dealt to their entities, so a long career is never gathered in one place.
    """
    sums = cumulative_measures()
    known = F.max(F.when(F.col("ranking") != 0, F.struct("batch_no", "match_id", "ranking")))
    totals = parts.groupBy(*ENTITY).agg(
        *[F.coalesce(F.sum(c), F.lit(0.0)).alias(n) for n, c in sums.sums.items()],
        F.count(F.lit(1)).alias("matches"),
        F.max("match_date").alias("last_date"),
        known["ranking"].alias("ranking"),
    )
    state = totals.select(*ENTITY, "matches", "last_date", "ranking", *sums.outs)
    newest = Window.partitionBy(*numbers_first(parts, ENTITY)).orderBy(F.desc("batch_no"), F.desc("match_id"))
    rows = parts.select(*ENTITY, "batch_no", "match_id", "won").withColumn("_age", F.row_number().over(newest)).where("_age <= 20")
    form = rows.groupBy(*ENTITY).agg(*[F.avg(F.when(F.col("_age") <= n, F.col("won"))).alias(f"form_{n}") for n in (5, 10, 20)])
    return state.join(form, list(ENTITY))
