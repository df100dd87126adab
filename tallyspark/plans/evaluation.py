"""Queries over scored rows: splits, filters, metrics, bands, resampling, set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyspark.operators import metrics as mx
from tallyspark.operators import resample, splits
from tallyspark.operators.order import numbered_within
from tallyspark.operators.prefix import sequence_rows
from tallyspark.plans.history import round_matches, venue_matches
from tallyspark.plans.registry import query, r6, view
from tallyspark.plans.rows import rnd
from tallyspark.session import scratch_path
from tallyspark.sources.fixtures import matches, parts, scored, table


def cl(p: str) -> str:
    return f"greatest(1e-6, least(1 - 1e-6, {p}))"


def basic_sql(p: str) -> str:
    c = cl(p)
    return (
        f"{r6(f'avg(CASE WHEN ({c} >= 0.5) = (label = 1) THEN 1.0 ELSE 0.0 END)')} AS accuracy, "
        f"{r6(f'avg(CASE WHEN label = 1 THEN -ln({c}) ELSE -ln(1 - {c}) END)')} AS log_loss, "
        f"{r6(f'avg(({c} - label) * ({c} - label))')} AS brier"
    )


def auc_sql(src: str, keys: str, p: str = "p") -> str:
    """Pairs counted over distinct probabilities, independent of any ranking."""
    on = " AND ".join(f"a.{k.strip()} = b.{k.strip()}" for k in keys.split(","))
    sel = ", ".join(f"a.{k.strip()}" for k in keys.split(","))
    return f"""(WITH g AS (SELECT {keys}, {p} AS pv, CAST(sum(label) AS DOUBLE) AS pos, CAST(sum(1 - label) AS DOUBLE) AS neg
      FROM {src} GROUP BY {keys}, {p}),
      t AS (SELECT {keys}, sum(pos) AS tp, sum(neg) AS tn FROM g GROUP BY {keys}),
      c AS (SELECT {sel}, sum(a.pos * (CASE WHEN a.pv > b.pv THEN b.neg ELSE b.neg / 2 END)) AS s FROM g a JOIN g b
        ON {on} AND b.pv <= a.pv GROUP BY {sel})
      SELECT t.*, CASE WHEN tp > 0 AND tn > 0 THEN s / (tp * tn) ELSE 0.5 END AS auc FROM t JOIN c USING ({keys}))"""


def ece_sql(src: str, keys: str, p: str = "p") -> str:
    return f"""(SELECT {keys}, sum(gap) / sum(cnt) AS ece FROM (SELECT {keys}, least(floor({p} * 10), 9) AS b,
      abs(sum({p} - label)) AS gap, count(*) AS cnt FROM {src} GROUP BY {keys}, least(floor({p} * 10), 9)) GROUP BY {keys})"""


def bundle_sql(src: str, keys: str, p: str = "p", having: str = "") -> str:
    return f"""SELECT {keys}, CAST(m.n AS BIGINT) AS n, m.accuracy, {r6('auc')} AS auc, m.log_loss, m.brier, {r6('ece')} AS ece
      FROM (SELECT {keys}, count(*) AS n, {basic_sql(p)} FROM {src} GROUP BY {keys} {having}) m
      JOIN {auc_sql(src, keys, p)} a USING ({keys}) JOIN {ece_sql(src, keys, p)} e USING ({keys})"""


def rounded(df, keys):
    return df.select(*keys, "n", *[rnd(c).alias(c) for c in ("accuracy", "auc", "log_loss", "brier", "ece")])


@query("a1_a3_basic_metrics", f"SELECT grp, CAST(count(*) AS BIGINT) AS n, {basic_sql('p')} FROM scored GROUP BY grp")
def _(spark, d):
    out = mx.basic_metrics(mx.outcomes(scored(spark, d), ["grp"], "p"), ["grp"])
    return out.select("grp", "n", *[rnd(c).alias(c) for c in ("accuracy", "log_loss", "brier")])


@query("a4_auc", f"SELECT grp, yr, {r6('auc')} AS auc FROM {auc_sql('scored', 'grp, yr', 'p2')}")
def _(spark, d):
    k = ["grp", "yr"]
    return mx.auc(mx.outcome_counts(scored(spark, d), k, "p2"), k).select(*k, rnd("auc").alias("auc"))


@query(
    "a5_calibration_table",
    f"""SELECT grp, CAST(least(floor(p * 10), 9) AS INTEGER) AS bucket, CAST(count(*) AS BIGINT) AS n,
        {r6('avg(p)')} AS mean_p, {r6('avg(label)')} AS win_rate FROM scored GROUP BY ALL""",
)
def _(spark, d):
    out = mx.calibration_table(mx.outcomes(scored(spark, d), ["grp"], "p"), ["grp"])
    return out.select("grp", "bucket", "n", rnd("mean_p").alias("mean_p"), rnd("win_rate").alias("win_rate"))


@query("a6_calibration_error", f"SELECT grp, {r6('ece')} AS ece FROM {ece_sql('scored', 'grp', 'p2')}")
def _(spark, d):
    out = mx.calibration_error(mx.outcomes(scored(spark, d), ["grp"], "p2"), ["grp"])
    return out.select("grp", rnd("ece").alias("ece"))


FAV = "greatest(p, 1 - p)"
FAV_BAND = f"""CASE WHEN {FAV} < 0.55 THEN '50-55' WHEN {FAV} < 0.65 THEN '55-65' WHEN {FAV} < 0.75 THEN '65-75'
   WHEN {FAV} < 0.85 THEN '75-85' ELSE '85-100' END"""
GAP = "abs((l_discount - 0.05) * 2 * 998)"
GAP_BAND = f"""CASE WHEN {GAP} < 25 THEN 'rank_gap_0_25' WHEN {GAP} < 75 THEN 'rank_gap_25_75' WHEN {GAP} < 200
   THEN 'rank_gap_75_200' ELSE 'rank_gap_200_plus' END"""
view(
    "dims",
    f"""SELECT 'status' AS dim, grp AS value, p, label FROM scored UNION ALL
        SELECT 'season', CAST(yr AS VARCHAR), p, label FROM scored UNION ALL
        SELECT 'favourite', {FAV_BAND}, p, label FROM scored UNION ALL
        SELECT 'rank_gap', {GAP_BAND}, p, label FROM scored""",
)


def rank_diff():
    return (F.col("l_discount") - 0.05) * 2


@query("a7_bundle_by_dimension", bundle_sql("dims", "dim, value", "p", "HAVING count(*) >= 50"))
def _(spark, d):
    dims = {
        "status": F.col("grp"),
        "season": F.col("yr"),
        "favourite": mx.favourite_band(F.col("p")),
        "rank_gap": mx.rank_gap_band(rank_diff()),
    }
    return rounded(mx.by_dimensions(scored(spark, d), dims, "p", min_rows=50), ["dim", "value"])


EDGE = "abs((l_discount - 0.05) * 2)"


@query(
    "a8_bands",
    f"""SELECT CASE WHEN {FAV} <= 0.55 THEN '50-55' WHEN {FAV} <= 0.6 THEN '55-60' WHEN {FAV} <= 0.7 THEN '60-70'
        WHEN {FAV} <= 0.8 THEN '70-80' ELSE '80-100' END AS fav_closed,
        CASE WHEN {FAV} < 0.55 THEN 'close_50_55' WHEN {FAV} < 0.65 THEN 'lean_55_65' WHEN {FAV} < 0.8 THEN 'favorite_65_80'
        ELSE 'heavy_favorite_80_plus' END AS fav_named,
        CASE WHEN {EDGE} <= 0.03 THEN 'near' WHEN {EDGE} <= 0.12 THEN 'small' WHEN {EDGE} <= 0.35 THEN 'medium' ELSE 'large' END
        AS edge, {GAP_BAND} AS gap, CAST(count(*) AS BIGINT) AS n FROM scored GROUP BY ALL""",
)
def _(spark, d):
    p = F.col("p")
    return (
        scored(spark, d)
        .groupBy(
            mx.favourite_band_closed(p).alias("fav_closed"),
            mx.favourite_band_named(p).alias("fav_named"),
            mx.rank_edge_band(rank_diff()).alias("edge"),
            mx.rank_gap_band(rank_diff()).alias("gap"),
        )
        .agg(F.count(F.lit(1)).alias("n"))
    )


view(
    "two_models",
    "SELECT 'a' AS model, yr, p, label FROM scored UNION ALL SELECT 'b', yr, p2, label FROM scored",
)


def two_models(spark, d):
    pairs = F.array(
        F.struct(F.lit("a").alias("model"), F.col("p").alias("p")), F.struct(F.lit("b").alias("model"), F.col("p2").alias("p"))
    )
    return scored(spark, d).select("yr", "label", F.inline(pairs))


@query(
    "a10_fold_summary",
    f"""SELECT model, CAST(count(*) AS BIGINT) AS folds, {r6('avg(log_loss)')} AS mean_log_loss, {r6('avg(brier)')} AS mean_brier,
        {r6('avg(accuracy)')} AS mean_accuracy, {r6('avg(ece)')} AS mean_ece
        FROM ({bundle_sql('two_models', 'model, yr')}) GROUP BY model""",
)
def _(spark, d):
    folds = rounded(mx.bundle(two_models(spark, d), ["model", "yr"], "p"), ["model", "yr"])
    means = {"log_loss": "mean_log_loss", "brier": "mean_brier", "accuracy": "mean_accuracy", "ece": "mean_ece"}
    return folds.groupBy("model").agg(
        F.count(F.lit(1)).alias("folds"), *[rnd(F.avg(c)).alias(n) for c, n in means.items()]
    )


@query(
    "a11_pooled_and_per_fold",
    f"""SELECT coalesce(CAST(yr AS VARCHAR), 'pooled') AS fold, CAST(count(*) AS BIGINT) AS n, {basic_sql('p')}
        FROM scored GROUP BY ROLLUP (yr)""",
)
def _(spark, d):
    counts = mx.outcomes(scored(spark, d), ["yr"], "p")
    folds = F.explode(F.array(F.col("yr").cast("string"), F.lit("pooled")))
    out = mx.basic_metrics(counts.withColumn("fold", folds), ["fold"])
    return out.select("fold", "n", *[rnd(c).alias(c) for c in ("accuracy", "log_loss", "brier")])


view(
    "thresholded",
    f"""SELECT t AS threshold, p2 AS p, label FROM scored,
        (SELECT unnest([0.55, 0.60, 0.65, 0.70, 0.75, 0.80]) AS t) WHERE greatest(p2, 1 - p2) >= CAST(t AS DOUBLE)""",
)


@query(
    "a12_selective",
    f"""SELECT CAST(threshold AS DOUBLE) AS threshold, n, accuracy, auc, log_loss, brier, ece,
        {r6('n / CAST((SELECT count(*) FROM scored) AS DOUBLE)')} AS coverage FROM ({bundle_sql('thresholded', 'threshold')})""",
)
def _(spark, d):
    out = mx.selective(scored(spark, d), "p2")
    return rounded(out, ["threshold", rnd("coverage").alias("coverage")])


@query(
    "f6_confidence_filter",
    "SELECT l_orderkey, l_linenumber, " + r6("p2") + " AS p2 FROM scored WHERE greatest(p2, 1 - p2) >= 0.7",
)
def _(spark, d):
    return scored(spark, d).where(mx.favourite(F.col("p2")) >= 0.7).select(
        "l_orderkey", "l_linenumber", rnd("p2").alias("p2")
    )


@query(
    "a13_data_profile",
    """WITH c AS (SELECT pool, surface, CAST(best_of AS VARCHAR) AS level, CAST(round_order AS VARCHAR) AS round FROM matches),
       r AS (SELECT match_id, count(ranking) AS k, count(nullif(hand, '')) AS h, count(age) AS a FROM parts GROUP BY match_id),
       f AS (SELECT 'pool' AS what, pool AS value, count(*) AS n FROM c GROUP BY ALL UNION ALL
       SELECT 'surface', surface, count(*) FROM c GROUP BY ALL UNION ALL SELECT 'level', level, count(*) FROM c GROUP BY ALL
       UNION ALL SELECT 'round', round, count(*) FROM c GROUP BY ALL
       UNION ALL SELECT 'pair_known', 'ranking', count(*) FILTER (k = 2) FROM r
       UNION ALL SELECT 'pair_known', 'hand', count(*) FILTER (h = 2) FROM r
       UNION ALL SELECT 'pair_known', 'age', count(*) FILTER (a = 2) FROM r
       UNION ALL SELECT 'first_day', CAST(min(match_date) AS VARCHAR), 1 FROM matches
       UNION ALL SELECT 'last_day', CAST(max(match_date) AS VARCHAR), 1 FROM matches)
       SELECT what, value, CAST(n AS BIGINT) AS n FROM f""",
)
def _(spark, d):
    m = matches(spark, d)
    dims = {"pool": "pool", "surface": "surface", "level": "best_of", "round": "round_order"}
    flat = m.select(
        F.inline(F.array(*[F.struct(F.lit(w).alias("what"), F.col(c).cast("string").alias("value")) for w, c in dims.items()]))
    )
    counted = flat.groupBy("what", "value").agg(F.count(F.lit(1)).alias("n"))
    top = Window.partitionBy("what").orderBy(F.desc("n"), "value")
    counted = counted.where("what <> 'round'").unionByName(
        counted.where("what = 'round'").withColumn("_k", F.row_number().over(top)).where("_k <= 12").drop("_k")
    )
    known = {"ranking": F.col("ranking").isNotNull(), "hand": F.col("hand") != "", "age": F.col("age").isNotNull()}
    pairs = parts(spark, d).groupBy("match_id").agg(*[F.count_if(c).alias(n) for n, c in known.items()])
    rates = pairs.agg(*[F.count_if(F.col(n) == 2).alias(n) for n in known]).select(
        F.inline(
            F.array(*[F.struct(F.lit("pair_known").alias("what"), F.lit(n).alias("value"), F.col(n).alias("n")) for n in known])
        )
    )
    days = m.agg(F.min("match_date").alias("a"), F.max("match_date").alias("b")).select(
        F.inline(
            F.array(
                F.struct(F.lit("first_day").alias("what"), F.col("a").cast("string").alias("value"), F.lit(1).cast("bigint").alias("n")),
                F.struct(F.lit("last_day").alias("what"), F.col("b").cast("string").alias("value"), F.lit(1).cast("bigint").alias("n")),
            )
        )
    )
    return counted.unionByName(rates).unionByName(days)


def ll_sql(p: str) -> str:
    return f"CASE WHEN label = 1 THEN -ln({cl(p)}) ELSE -ln(1 - {cl(p)}) END"


@query(
    "a14_block_sums",
    f"""SELECT CAST(block AS VARCHAR) AS block, CAST(count(*) AS BIGINT) AS n, {r6(f"sum({ll_sql('p')})")} AS ll_base,
        {r6(f"sum({ll_sql('p2')})")} AS ll_other, {r6('sum((p - label) * (p - label))')} AS br_base,
        {r6('sum((p2 - label) * (p2 - label))')} AS br_other FROM scored GROUP BY block""",
)
def _(spark, d):
    s = resample.block_sums(scored(spark, d), ["block"], "p", "p2")
    cols = ("ll_base", "ll_other", "br_base", "br_other")
    return s.select(F.col("block").cast("string").alias("block"), "n", *[rnd(c).alias(c) for c in cols])


def bootstrap_sql(sums, block, iterations=500, seed=11):
    """(metric, mean, low, high) from a relation of block sums, with the draws of the operator."""
    return f"""(WITH i AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY CAST('0x' || md5({block})[1:3] AS BIGINT), {block}) - 1 AS idx, count(*) OVER () AS total FROM {sums}),
      dr AS MATERIALIZED (SELECT it, CAST('0x' || md5('{seed}|' || it || '|' || idx)[1:12] AS BIGINT) % total AS pick FROM i, (SELECT unnest(range(0, {iterations})) AS it)),
      per AS MATERIALIZED (SELECT it, (sum(ll_other) - sum(ll_base)) / sum(n) AS log_loss, (sum(br_other) - sum(br_base)) / sum(n) AS brier FROM dr JOIN i ON i.idx = dr.pick GROUP BY it),
      l AS (SELECT 'log_loss' AS metric, log_loss AS delta FROM per UNION ALL SELECT 'brier', brier FROM per)
      SELECT metric, avg(delta) AS mean, quantile_cont(delta, 0.025) AS low, quantile_cont(delta, 0.975) AS high FROM l GROUP BY metric)"""


@query(
    "a14_block_bootstrap",
    f"""WITH sums AS (SELECT CAST(block AS VARCHAR) AS bl, count(*) AS n, sum({ll_sql('p')}) AS ll_base, sum({ll_sql('p2')}) AS ll_other,
        sum((p - label) * (p - label)) AS br_base, sum((p2 - label) * (p2 - label)) AS br_other FROM scored GROUP BY block)
        SELECT metric, {r6('mean')} AS mean, {r6('low')} AS low, {r6('high')} AS high FROM {bootstrap_sql('sums', 'bl')}""",
)
def _(spark, d):
    s = resample.block_sums(scored(spark, d), ["block"], "p", "p2")
    out = resample.bootstrap_delta(s, ["block"])
    return out.select("metric", *[rnd(c).alias(c) for c in ("mean", "low", "high")])


@query(
    "w18_tie_averaged_rank",
    """SELECT grp, round(p, 6) + 0.0 AS p, CAST(count(*) AS BIGINT) AS n, avg(rn) AS avg_rank FROM
       (SELECT grp, p, row_number() OVER (PARTITION BY grp ORDER BY p) AS rn FROM scored) GROUP BY grp, p""",
)
def _(spark, d):
    out = mx.average_ranks(scored(spark, d), ["grp"], "p", F.floor(F.col("p") * mx.AUC_CHUNKS))
    return out.select("grp", F.round("p", 6).alias("p"), "n", "avg_rank")


@query(
    "f2_year_split",
    """SELECT yr, CASE WHEN yr < 2000 THEN 'train' WHEN yr = 2000 THEN 'calibration' ELSE 'test' END AS role,
       'latest_two_year_holdout' AS split_rule, CAST(count(*) AS BIGINT) AS n FROM scored GROUP BY ALL""",
)
def _(spark, d):
    return splits.split_roles(scored(spark, d), "yr").groupBy("yr", "role", "split_rule").agg(F.count(F.lit(1)).alias("n"))


@query(
    "f2_row_count_split",
    """WITH o AS (SELECT match_id, row_number() OVER (ORDER BY batch_no, match_id) AS rn, count(*) OVER () AS n FROM vb)
       SELECT match_id, CASE WHEN rn <= CAST(floor(n * 0.7) AS BIGINT) THEN 'train' WHEN rn <= CAST(floor(n * 0.85) AS BIGINT)
       THEN 'calibration' ELSE 'test' END AS role, 'row_count_fallback' AS split_rule FROM o""",
)
def _(spark, d):
    m = venue_matches(spark, d).withColumn("year", F.year("match_date"))
    return splits.split_roles(m, "year").select("match_id", "role", "split_rule")


@query(
    "f5_feature_availability",
    """SELECT 'p' AS feature, CASE WHEN sum(abs(p)) > 0 THEN 1 ELSE 0 END AS available FROM scored UNION ALL
       SELECT 'l_tax', CASE WHEN sum(abs(l_tax)) > 0 THEN 1 ELSE 0 END FROM scored UNION ALL
       SELECT 'blank', 0 UNION ALL SELECT 'absent', 0""",
)
def _(spark, d):
    s = scored(spark, d).withColumn("blank", F.lit(0.0))
    return available_features(s, ["p", "l_tax", "blank", "absent"])


def available_features(df, names):
    """A feature counts when its column exists and is not zero everywhere; one pass for all."""
    have = [n for n in names if n in df.columns]
    one = df.agg(*[F.sum(F.abs(F.col(n))).alias(n) for n in have])
    flags = [
        F.struct(
            F.lit(n).alias("feature"), ((F.col(n) > 0) if n in have else F.lit(False)).cast("int").alias("available")
        )
        for n in names
    ]
    return one.select(F.inline(F.array(*flags)))


@query(
    "f7_schedule_by_venue",
    """SELECT pool, venue, match_id, CAST(row_number() OVER (PARTITION BY pool, venue ORDER BY match_date, match_id) AS BIGINT)
       AS position FROM matches WHERE round_order > 1 AND pool = 'south'""",
)
def _(spark, d):
    m = matches(spark, d).where((F.col("round_order") > 1) & (F.col("pool") == "south"))
    dated = m.withColumn("day_no", F.datediff("match_date", F.lit("2000-01-01").cast("date")))
    numbered = sequence_rows(dated, ["pool", "venue"], "day_no", "match_id")
    return numbered.select("pool", "venue", "match_id", F.col("seq").alias("position"))


@query(
    "f8_single_pool",
    """SELECT surface, CAST(count(DISTINCT pool) AS BIGINT) AS pools, CASE WHEN count(DISTINCT pool) = 1 THEN 1 ELSE 0 END
       AS single FROM matches GROUP BY surface""",
)
def _(spark, d):
    m = matches(spark, d)
    n = F.count_distinct("pool")
    return m.groupBy("surface").agg(n.alias("pools"), (n == 1).cast("int").alias("single"))


@query(
    "k1_canonical_order",
    """SELECT match_id, CAST(row_number() OVER (PARTITION BY pool ORDER BY match_date, venue, winner, loser, match_id) AS BIGINT)
       AS idx FROM matches""",
)
def _(spark, d):
    m = matches(spark, d).select("pool", "match_date", "venue", "winner", "loser", "match_id")
    out = numbered_within(m, "pool", ["match_date", "venue", "winner", "loser", "match_id"], "idx")
    return out.select("match_id", "idx")


@query(
    "k2_best_model",
    f"""SELECT * FROM ({bundle_sql('two_models', 'model')}) ORDER BY log_loss, brier, ece LIMIT 1""",
)
def _(spark, d):
    out = rounded(mx.bundle(two_models(spark, d), ["model"], "p"), ["model"])
    return out.orderBy("log_loss", "brier", "ece").limit(1)


@query(
    "s5_saved_rows_year",
    "SELECT year(o_orderdate) AS year, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY ALL",
)
def _(spark, d):
    from tallyspark.sources.rows import read_feature_rows

    path = scratch_path(spark, "rows")
    table(spark, d, "orders").select(
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.col("o_totalprice").alias("x")
    ).write.parquet(path)
    return read_feature_rows(spark, path).groupBy(F.col("year").cast("bigint").alias("year")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "s6_write_partitioned_rows",
    """SELECT pool, CAST(year(match_date) AS INTEGER) AS year, CAST(count(*) AS BIGINT) AS n, CAST(sum(svpt) AS BIGINT) AS svpt
       FROM parts GROUP BY ALL""",
)
def _(spark, d):
    from tallyspark.sources.rows import write_feature_rows

    path = scratch_path(spark, "features")
    p = parts(spark, d).withColumn("year", F.year("match_date")).select("pool", "year", "match_id", "svpt")
    write_feature_rows(p, path)
    back = spark.read.parquet(path)
    return back.groupBy("pool", F.col("year").cast("int").alias("year")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("svpt").alias("svpt")
    )


# ---- set operations --------------------------------------------------------------------


@query(
    "u1_union_of_folds",
    """SELECT model, yr, CAST(count(*) AS BIGINT) AS n, """ + r6("sum(p)") + """ AS total FROM two_models
       GROUP BY ALL""",
)
def _(spark, d):
    s = scored(spark, d)
    years = sorted(r[0] for r in s.select("yr").distinct().collect())
    pieces = [
        s.where(F.col("yr") == y).select(F.lit(m).alias("model"), "yr", F.col(c).alias("p"))
        for y in years
        for m, c in (("a", "p"), ("b", "p2"))
    ]
    out = pieces[0]
    for piece in pieces[1:]:
        out = out.unionByName(piece)
    return out.groupBy("model", "yr").agg(F.count(F.lit(1)).alias("n"), rnd(F.sum("p")).alias("total"))


@query(
    "u2_shared_opponents",
    """WITH o AS (SELECT DISTINCT pool, entity, opponent FROM sides)
       SELECT n.entity, CAST(count(*) AS BIGINT) AS shared FROM o n JOIN o s ON n.entity = s.entity AND n.opponent = s.opponent
       WHERE n.pool = 'north' AND s.pool = 'south' GROUP BY n.entity""",
)
def _(spark, d):
    o = parts(spark, d).select("pool", "entity", "opponent").distinct()
    north, south = (o.where(F.col("pool") == p).drop("pool") for p in ("north", "south"))
    return north.intersect(south).groupBy("entity").agg(F.count(F.lit(1)).alias("shared"))


@query(
    "u3_missing_members",
    """SELECT DISTINCT entity FROM sides WHERE pool = 'north' AND surface = 'grass'
       EXCEPT SELECT DISTINCT entity FROM sides WHERE pool = 'south' AND surface = 'carpet'""",
)
def _(spark, d):
    p = parts(spark, d)
    have = p.where("pool = 'north' and surface = 'grass'").select("entity").distinct()
    seen = p.where("pool = 'south' and surface = 'carpet'").select("entity").distinct()
    return have.exceptAll(seen)


@query(
    "u4_subset_test",
    """SELECT surface, CASE WHEN count(*) FILTER (entity NOT IN (SELECT entity FROM sides WHERE surface = 'hard')) = 0
       THEN 1 ELSE 0 END AS subset FROM sides GROUP BY surface""",
)
def _(spark, d):
    p = parts(spark, d).select("surface", "entity").distinct()
    allowed = p.where("surface = 'hard'").select("entity", F.lit(1).alias("ok"))
    return p.join(allowed, "entity", "left").groupBy("surface").agg(
        (F.count_if(F.col("ok").isNull()) == 0).cast("int").alias("subset")
    )
