"""Paired ratings over a whole match history.

An update reads both sides' ratings as left by their earlier matches, so the history is a chain of
nonlinear steps. A rating is 1500 plus the signed sum of the entity's own earlier changes, so all
changes solve one strictly causal system: change(m) = k(m) * (1 - expected(ratings from changes of
earlier matches)). The solver repeats a sweep over *all* matches at once: running sums per entity
give every rating, ratings give every change. A match is final once its predecessors are, so the
sweeps end at exactly the sequential result, and since one change moves later ones only a little
they get there long before the longest chain is walked. Each sweep is two shuffles of narrow rows;
no task holds a pool, an entity or a batch as a whole.

A match can move only if a match of its pool in the same batch or before moves. So everything ahead of a pool's first
moving batch is settled: it leaves the sweeps, and its sums stay with the entities as what they bring along. The same
sums let a solution start in the middle of a history (``carry``), which is how late results are taken in.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.prob import expected_score
from tallyspark.operators.prefix import CHUNK, prior_totals, sequence_rows
from tallyspark.operators.state import ENTITY, ENTITY_SURFACE, Measures, counts_and_rest, rating_deviation, rest_days
from tallyspark.session import cut_lineage, dealt, drop_staged, only

START = 1500.0
SURFACES = ("hard", "clay", "grass", "carpet")


@dataclass(frozen=True)
class RatingSpec:
    """One member of the rating family; the defaults are the plain surface-aware rating."""

    k_base: float = 18.0
    k_gain: float = 18.0
    experience: float = 160.0
    long_match: float = 1.08
    surface_weight: float = 0.62
    overall_weight: float = 0.38
    surface_shrink: float = 0.0
    uncertainty_weight: float = 0.0
    deviation: bool = False
    overall_step: float = 0.42
    surface_step: float = 0.72


# The variants in use.
PLAIN = RatingSpec()
DEVIATION = RatingSpec(15.0, 18.0, 180.0, 1.06, 0.58, 0.42, surface_shrink=18.0, deviation=True)
SERVICE = RatingSpec(18.0, 18.0, 140.0, 1.08, 0.62, 0.30, uncertainty_weight=0.08)
BACKTEST = RatingSpec(18.0, 18.0, 140.0, 1.08, 0.55, 0.45)


def step_size(spec: RatingSpec, fewer: Column, long: Column, rd_sum: Column | None, idle: Column | None) -> Column:
    k = F.lit(spec.k_base) + F.lit(spec.k_gain) / (1.0 + fewer / F.lit(spec.experience))
    if spec.deviation:
        k = k * (0.65 + rd_sum / 700.0) * (1.0 + F.least(idle, F.lit(180.0)) / 600.0)
    return k * F.when(long, F.lit(spec.long_match)).otherwise(F.lit(1.0))


def blend(spec: RatingSpec, overall: Column, surface: Column, surface_n: Column, n: Column) -> Column:
    if spec.surface_shrink:
        w = surface_n / (surface_n + F.lit(spec.surface_shrink))
        surface = w * surface + (1.0 - w) * overall
    value = spec.surface_weight * surface + spec.overall_weight * overall
    if spec.uncertainty_weight:
        value = value - spec.uncertainty_weight * F.greatest(F.lit(28.0), 85.0 * F.pow(F.lit(0.992), n.cast("double")))
    return value


# the order in which rows are dealt and sorted: pools are few, so comparing entities first settles almost every comparison
RUN = ("entity", "pool", "chunk")


def _running(rows: DataFrame, value: Column, split: bool) -> DataFrame:
    """Adds the sums of ``value`` over the entity's earlier matches, all (``_all``) and same-surface (``_own``).

    Where entities are cut into chunks, rows are dealt to (entity, chunk) once, and the scan and the chunk totals work on
    that one exchange.
    """
    rows = rows.select("*", value.alias("_d"))
    if split:
        rows = rows.repartition(*RUN)
    run = Window.partitionBy(*RUN).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)

    def own(per_surface) -> Column:
        return F.coalesce(*[F.when(F.col("surface") == s, per_surface(s)) for s in SURFACES], F.lit(0.0))

    out = rows.select(
        "*",
        F.coalesce(F.sum("_d").over(run), F.lit(0.0)).alias("_all"),
        own(lambda s: F.sum(F.when(F.col("surface") == s, F.col("_d"))).over(run)).alias("_own"),
    )
    if not split:
        return out
    by = {"a": F.sum("_d")} | {s: F.sum(F.when(F.col("surface") == s, F.col("_d"))) for s in SURFACES}
    totals = rows.groupBy(*RUN).agg(*[c.alias(f"_t{n}") for n, c in by.items()])
    across = Window.partitionBy("entity", "pool").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(*RUN, *[F.sum(f"_t{n}").over(across).alias(f"_c{n}") for n in by])
    joined = out.join(carry, list(RUN))
    return joined.select(
        *rows.columns,
        (F.col("_all") + F.coalesce("_ca", F.lit(0.0))).alias("_all"),
        (F.col("_own") + own(lambda s: F.col(f"_c{s}"))).alias("_own"),
    )


MATCH = ("pool", "match_id", "surface", "batch_no")
SIDE = ("entity", "won", "seq", "n", "surface_n", "chunk", "base_o", "base_s")
RATED = ("expected", "overall_w", "overall_l", "surface_w", "surface_l")
CARRIED = ("matches", "last_date", "overall", *SURFACES, *[f"n_{s}" for s in SURFACES])


def _on(prefix: str) -> Column:
    """The column named after the row's surface."""
    return F.coalesce(*[F.when(F.col("surface") == s, F.col(f"{prefix}{s}")) for s in SURFACES])


def fold_edges(parts: DataFrame, spec: RatingSpec, carry: DataFrame | None = None) -> tuple[DataFrame, bool]:
    """Both sides of every match, a row each, with everything about an update that does not depend on ratings.

    ``carry`` has the CARRIED columns of entities that played before the first of these matches: counts, last date,
    and ratings overall and per surface. Entities without a row start anew.

    Counts, deviation and rest are taken at the update, i.e. after earlier matches of the same
    batch: such matches raise the counts and bring the rest to zero days. Also tells whether some
    entity is long enough to be cut into chunks.
    """
    slim = parts.select(*ENTITY, "surface", "match_id", "match_date", "batch_no", "best_of", "won")
    rows = sequence_rows(slim, ENTITY, "batch_no", "match_id")
    rows = rows.withColumn("chunk", F.floor((F.col("seq") - 1) / CHUNK)).withColumn("n", F.col("seq") - 1)
    if spec.deviation:
        rest = counts_and_rest(slim).select(*ENTITY, "batch_no", "days_rest")
        rows = rows.join(rest, [*ENTITY, "batch_no"]).withColumn(
            "idle", F.when(F.col("seq") > F.col("seq_before") + 1, F.lit(0.0)).otherwise(F.col("days_rest"))
        )
    if carry is not None:
        rows = rows.join(carry.select(*ENTITY, *CARRIED), list(ENTITY), "left")
        if spec.deviation:
            gap = F.when(F.col("last_date").isNotNull(), F.datediff("match_date", "last_date").cast("double"))
            rows = rows.withColumn("idle", F.when((F.col("seq") == 1) | ((F.col("seq_before") == 0) & (F.col("idle") > 0)), rest_days(gap, 21.0, 90.0)).otherwise(F.col("idle")))
        rows = rows.withColumns({"n": F.col("n") + F.coalesce("matches", F.lit(0)), "more": F.coalesce(_on("n_"), F.lit(0))})
        rows = rows.withColumns({"base_o": F.coalesce(F.col("overall") - START, F.lit(0.0)), "base_s": F.coalesce(_on("") - START, F.lit(0.0))}).drop(*CARRIED)
    else:
        rows = rows.withColumns({"more": F.lit(0), "base_o": F.lit(0.0), "base_s": F.lit(0.0)})
    rows = dealt(cut_lineage(rows.drop("seq_before", "days_rest")))
    longest, strange = rows.agg(F.max("chunk"), F.count_if(~F.coalesce(F.col("surface").isin(*SURFACES), F.lit(False)))).first()
    if strange:
        raise ValueError(f"{strange} sides on a surface other than {', '.join(SURFACES)}")
    split = bool(longest)
    rows = _running(rows, F.lit(1.0), split).withColumn("surface_n", F.col("_own") + F.col("more"))
    of = Window.partitionBy("match_id", "pool", "surface", "batch_no", "best_of")
    rd_sum = idle = None
    if spec.deviation:
        rd_sum, idle = F.sum(rating_deviation(F.col("n"))).over(of), F.max("idle").over(of)
    k = step_size(spec, F.min("n").over(of), F.col("best_of") == 5, rd_sum, idle)
    edges = rows.select(*MATCH, k.alias("k"), *SIDE)
    return edges.select(*MATCH, "k", (0.5 * F.col("k")).alias("delta"), *SIDE), split


def _sweeps(rows: DataFrame, spec: RatingSpec, split: bool, times: int) -> DataFrame:
    """``times`` sweeps over the sides ``rows``; adds RATED and ``old``, the change before the last one.

    Sides are dealt to their entities and back to their matches as narrow rows; nothing is gathered in arrays.
    """
    rows = rows.select(*MATCH, "k", "delta", *SIDE)
    columns = [c for c in rows.columns if c != "delta"]
    won = F.col("won") == 1
    match = Window.partitionBy("match_id")
    side = lambda c, w: F.max(F.when(won if w else ~won, F.col(c))).over(match)
    overall = START + F.col("base_o") + spec.overall_step * F.col("_all")
    surface = START + F.col("base_s") + spec.surface_step * F.col("_own")
    for left in reversed(range(times)):
        rated = _running(rows, F.when(won, F.col("delta")).otherwise(-F.col("delta")), split)
        rated = rated.select(*rows.columns, overall.alias("_o"), surface.alias("_s"), blend(spec, overall, surface, F.col("surface_n"), F.col("n")).alias("_b"))
        met = {"_bw": side("_b", True), "_bl": side("_b", False)}
        if not left:
            met |= {"overall_w": side("_o", True), "overall_l": side("_o", False), "surface_w": side("_s", True), "surface_l": side("_s", False)}
        rows = rated.select(*columns, F.col("delta").alias("old"), *[c.alias(n) for n, c in met.items()])
        rows = rows.withColumn("expected", expected_score(F.col("_bw"), F.col("_bl"))).withColumn("delta", F.col("k") * (1.0 - F.col("expected")))
        rows = rows.select(*columns, "delta", *([] if left else [*RATED, "old"]))
    return rows


def _retired(moving: DataFrame, settled: DataFrame, spec: RatingSpec) -> DataFrame:
    """``moving`` with the changes of ``settled``, which come before, in what its entities bring along."""
    d = {s: F.sum(F.when(F.col("surface") == s, F.col("d_surface"))) for s in SURFACES}
    totals = _changes(settled, spec).groupBy(*ENTITY).agg(F.sum("d_overall").alias("_to"), *[c.alias(f"_t{s}") for s, c in d.items()])
    rows = moving.join(totals, list(ENTITY), "left")
    rows = rows.withColumns({"base_o": F.col("base_o") + F.coalesce("_to", F.lit(0.0)), "base_s": F.col("base_s") + F.coalesce(_on("_t"), F.lit(0.0))})
    return rows.select(*moving.columns)


def _matches(rows: DataFrame) -> DataFrame:
    """One row per match with both of its ``sides``."""
    match = Window.partitionBy("match_id")
    place = F.row_number().over(match.orderBy(F.col("won").desc()))
    per = rows.select(*MATCH, F.collect_list(F.struct(*SIDE)).over(match).alias("sides"), "k", "delta", *RATED, place.alias("_place"))
    return per.where("_place = 1").drop("_place")


def solve_ratings(
    parts: DataFrame, spec: RatingSpec, tolerance: float = 1e-10, sweeps_per_cut: int = 4, max_sweeps: int = 100_000, carry: DataFrame | None = None, begin: DataFrame | None = None, log: list[int] | None = None
) -> DataFrame:
    """Change and pre-update ratings of every match, equal to the sequential fold.

    Returns ``pool, match_id, surface, batch_no, sides, k, delta, expected, overall_w, overall_l,
    surface_w, surface_l``. Every few sweeps the rows are written to the shared folder, which
    bounds the lineage and lets the loop resume after lost executors; matches ahead of the first that still moves
    leave the sweeps once they are a third of the rows. ``carry`` is what entities bring along (``fold_edges``),
    ``begin`` (match_id, begin) a first guess of changes, ``log`` takes the rows in the sweeps at every cut.
    """
    return dealt(only(lambda: _solved(parts, spec, tolerance, sweeps_per_cut, max_sweeps, carry, begin, log)))


def _solved(parts: DataFrame, spec: RatingSpec, tolerance: float, sweeps_per_cut: int, max_sweeps: int, carry: DataFrame | None, begin: DataFrame | None, log: list[int] | None) -> DataFrame:
    split = False

    def start() -> DataFrame:
        nonlocal split
        edges, split = fold_edges(parts, spec, carry)
        if begin is None:
            return edges
        return edges.join(begin.select("match_id", "begin"), "match_id", "left").withColumn("delta", F.coalesce("begin", "delta")).drop("begin").select(*edges.columns)

    current = dealt(only(start))
    finished: DataFrame | None = None
    moves = F.abs(F.col("delta") - F.col("old"))
    won = F.col("won") == 1
    done = 0
    while True:
        swept = dealt(cut_lineage(_sweeps(current, spec, split, sweeps_per_cut)))
        drop_staged(current)
        current = swept
        done += sweeps_per_cut
        fronts = {r.pool: r for r in current.groupBy("pool").agg(F.max(moves).alias("worst"), F.min(F.when(moves > tolerance, F.col("batch_no"))).alias("front"), F.count_if(won).alias("rows")).collect()}
        worst = max((r.worst for r in fronts.values()), default=None)
        if any(r.worst != r.worst for r in fronts.values()):
            raise ValueError("a rating change is not a number")
        if log is not None:
            log.append(sum(r.rows for r in fronts.values()))
        if worst is None or worst <= tolerance:
            current = current.drop("old")
            return _matches(current if finished is None else finished.unionByName(current))
        if done >= max_sweeps:
            raise RuntimeError(f"ratings still moving by {worst} after {done} sweeps")
        front = F.coalesce(*[F.when(F.col("pool") == pool, F.lit(r.front)) for pool, r in fronts.items() if r.front is not None])
        settled = current.where(front.isNull() | (F.col("batch_no") < front))
        if 3 * settled.where(won).count() < sum(r.rows for r in fronts.values()):
            continue
        settled = cut_lineage(settled.drop("old"))
        moving = dealt(cut_lineage(_retired(current.where(F.col("batch_no") >= front), settled, spec)))
        drop_staged(current)
        current = moving
        finished = settled if finished is None else finished.unionByName(settled)


def _changes(sides: DataFrame, spec: RatingSpec) -> DataFrame:
    sign = F.when(F.col("won") == 1, 1.0).otherwise(-1.0)
    return sides.withColumn("d_overall", spec.overall_step * sign * F.col("delta")).withColumn("d_surface", spec.surface_step * sign * F.col("delta"))


def rating_changes(solved: DataFrame, spec: RatingSpec) -> DataFrame:
    """Signed rating changes, one row per side of each match."""
    return _changes(solved.select("pool", "match_id", "surface", "batch_no", "delta", F.inline("sides")), spec)


def rating_snapshots(solved: DataFrame, spec: RatingSpec) -> DataFrame:
    """Ratings and counts of every side as frozen at the start of its batch."""
    changes = rating_changes(solved, spec)
    overall = prior_totals(changes, ENTITY, "batch_no", sums={"_o": F.col("d_overall"), "n_before": F.lit(1)}, combine=False)
    surface = prior_totals(changes, ENTITY_SURFACE, "batch_no", sums={"_s": F.col("d_surface"), "surface_n": F.lit(1)}, combine=False)
    slim = changes.select("match_id", "won", *ENTITY_SURFACE, "batch_no")
    out = slim.join(overall, [*ENTITY, "batch_no"]).join(surface, [*ENTITY_SURFACE, "batch_no"])
    out = out.withColumn("overall", START + F.col("_o")).withColumn("on_surface", START + F.col("_s")).drop("_o", "_s")
    return out.withColumn(
        "blended", blend(spec, F.col("overall"), F.col("on_surface"), F.col("surface_n"), F.col("n_before"))
    )


def overall_measures() -> Measures:
    """The overall rating before each batch, of rows that carry the changes of ``rating_changes``."""
    return Measures({"_o": F.col("d_overall")}, {}, [(START + F.col("_o")).alias("overall")])


def surface_measures() -> Measures:
    """The same on a surface, with the matches there."""
    return Measures({"_s": F.col("d_surface"), "surface_n": F.lit(1)}, {}, [(START + F.col("_s")).alias("on_surface"), F.col("surface_n")])


def pre_match_expectation(snapshots: DataFrame) -> DataFrame:
    """Winner's expected score from the frozen ratings of both sides."""
    won = F.col("won") == 1
    per = snapshots.groupBy("match_id").agg(
        F.max(F.when(won, F.col("blended"))).alias("_w"), F.max(F.when(~won, F.col("blended"))).alias("_l")
    )
    return per.select("match_id", expected_score(F.col("_w"), F.col("_l")).alias("pre_p"))


def with_expectation(snapshots: DataFrame) -> DataFrame:
    """Both sides of every match with the winner's expected score ``pre_p`` of ``pre_match_expectation``."""
    match = Window.partitionBy("match_id")
    won = F.col("won") == 1
    best = lambda mine: F.max(F.when(mine, F.col("blended"))).over(match)
    return snapshots.withColumns({"_w": best(won), "_l": best(~won)}).withColumn("pre_p", expected_score(F.col("_w"), F.col("_l"))).drop("_w", "_l")


def final_ratings(solved: DataFrame, spec: RatingSpec) -> DataFrame:
    """Ratings after the last match, overall and per surface, with match counts."""
    changes = rating_changes(solved, spec)
    per = {s: F.sum(F.when(F.col("surface") == s, F.col("d_surface"))) for s in SURFACES}
    return changes.groupBy(*ENTITY).agg(
        F.count(F.lit(1)).alias("matches"),
        (START + F.sum("d_overall")).alias("overall"),
        *[(START + F.coalesce(c, F.lit(0.0))).alias(s) for s, c in per.items()],
        *[F.count_if(F.col("surface") == s).alias(f"n_{s}") for s in SURFACES],
    )
