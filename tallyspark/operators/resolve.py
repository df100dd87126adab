"""Finding entities by name: tiered resolution, ranked search, pool membership.

Every tier is an equi join. Prefixes and substrings of a directory name are spelled out as join
keys, and names within two edits meet on a shared spelling with up to two letters deleted, so no
tier compares a query with the whole directory or with a block of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.text import initial_forms, key_to_id, letters_only
from tallyspark.session import cut_lineage

FAR = 99999
EDITS = 2


def _pieces(c: Column, shortest: int = 2) -> Column:
    """All substrings of at least ``shortest`` letters."""
    n = F.length(c)
    starts = F.sequence(F.lit(1), F.greatest(n - shortest + 1, F.lit(1)))
    spans = F.transform(
        starts,
        lambda s: F.transform(
            F.sequence(F.least(F.lit(shortest), n - s + 1), n - s + 1), lambda size: F.substr(c, s, size)
        ),
    )
    return F.array_distinct(F.flatten(spans))


def _starts(c: Column, shortest: int = 2) -> Column:
    n = F.length(c)
    return F.transform(F.sequence(F.least(F.lit(shortest), n), n), lambda size: F.substr(c, F.lit(1), size))


def _deletions(c: Column) -> Column:
    """The word and every spelling with one or two letters removed."""
    drop = lambda w: F.transform(
        F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substr(w, F.lit(1), i - 1), F.substr(w, i + 1, F.length(w)))
    )
    once = F.array_distinct(drop(c))
    twice = F.flatten(F.transform(F.filter(once, lambda w: F.length(w) > 0), drop))
    return F.array_distinct(F.concat(F.array(c), once, twice))


def _rank() -> Column:
    return F.coalesce(F.nullif("ranking", F.lit(0.0)), F.lit(float(FAR)))


def _best_per(df: DataFrame, key: str, *first: str) -> DataFrame:
    """Best name per key: given columns, then ranking (unknown last), then name.

    Taken as a minimum, so a key that many names share shrinks to one row before any join.
    """
    best = df.groupBy(key).agg(F.min(F.struct(*first, "rank", "name")).alias("_best"))
    return best.select(key, *[F.col(f"_best.{c}").alias(c) for c in (*first, "rank", "name")])


def resolve_names(queries: DataFrame, directory: DataFrame) -> DataFrame:
    """Best directory entry per distinct query text, with the tier that found it.

    Tiers: 1 exact letters, 2 ``Last F.`` forms, 3 prefix either way, 4 substring, 5 at most two
    edits; 0 when nothing matches. Later tiers only see what earlier ones left, and every lookup
    table holds one row per spelling.
    """
    q = queries.select("query").distinct().withColumn("key", letters_only(F.col("query")))
    listed = directory.select("name", _rank().alias("rank"), letters_only(F.col("name")).alias("name_key"))
    names = cut_lineage(_best_per(listed, "name_key"))
    short, comma = initial_forms(F.col("query"))
    rest = cut_lineage(q.where(F.length("key") >= 2))
    found = []

    def settle(hits: DataFrame, tier: int, *first: str) -> None:
        nonlocal rest
        hits = cut_lineage(_best_per(hits, "query", *first).select("query", "name", F.lit(tier).alias("tier")))
        found.append(hits)
        if tier < 5:
            rest = cut_lineage(rest.join(hits, "query", "left_anti"))

    settle(rest.join(names.withColumnRenamed("name_key", "key"), "key"), 1)

    forms = rest.select("query", F.posexplode(F.array(short, comma)).alias("which", "form")).where("form is not null")
    settle(forms.withColumn("name_key", letters_only(F.col("form"))).join(names, "name_key"), 2, "which")

    starts = _best_per(names.select("rank", "name", F.explode(_starts(F.col("name_key"))).alias("key")), "key")
    heads = rest.select("query", F.explode(_starts(F.col("key"), 1)).alias("name_key"))
    longer = rest.join(starts, "key").select("query", "rank", "name")
    settle(longer.unionByName(heads.join(names, "name_key").select("query", "rank", "name")), 3)

    inside = _best_per(names.select("rank", "name", F.explode(_pieces(F.col("name_key"))).alias("key")), "key")
    settle(rest.join(inside, "key"), 4)

    near_q = rest.select("query", "key", F.explode(_deletions(F.col("key"))).alias("_d"))
    near_n = names.select("name", "rank", "name_key", F.explode(_deletions(F.col("name_key"))).alias("_d"))
    close = near_q.join(near_n, "_d").withColumn("dist", F.levenshtein("key", "name_key", EDITS))
    settle(close.where(F.col("dist").between(0, EDITS)), 5, "dist")

    hits = found[0]
    for f in found[1:]:
        hits = hits.unionByName(f)
    return q.select("query").join(hits, "query", "left").select(
        "query", "name", F.coalesce("tier", F.lit(0)).alias("tier")
    )


def search_rank(name: Column, query: str) -> Column:
    """0 exact, 1 prefix, 2 elsewhere; null when the name does not match."""
    text, low = query.strip().lower(), F.lower(name)
    if not text:
        return F.lit(2)
    words = [w.strip(" ,.") for w in text.split() if w.strip(" ,.")]
    hit = low.contains(text)
    if len(words) >= 2:
        for form in (f"{words[-1]} {words[0][0]}.", f"{words[-1]}, {words[0][0]}."):
            hit = hit | F.lit(form).contains(low) | F.lit(text in form)
    return F.when(~hit, F.lit(None)).when(low == text, 0).when(low.startswith(text), 1).otherwise(2)


def search(directory: DataFrame, query: str, limit: int = 30, offset: int = 0, pool: str | None = None) -> DataFrame:
    """One page of a ranked name search: match quality, then name, then ranking."""
    rows = directory if pool is None else directory.where(F.col("pool") == pool)
    rows = rows.withColumn("score", search_rank(F.col("name"), query)).where("score is not null")
    rank = F.coalesce(F.nullif("ranking", F.lit(0.0)), F.lit(float(FAR)))
    ordered = rows.orderBy("score", F.lower("name"), rank, "name", "pool", "key")
    return ordered.offset(offset).limit(limit)


def pools_of_names(directory: DataFrame) -> DataFrame:
    """Pools each name occurs in; the set is bounded by the number of pools."""
    return directory.groupBy(F.lower(F.trim("name")).alias("who")).agg(
        F.sort_array(F.collect_set("pool")).alias("pools")
    )


def check_pairs(pairs: DataFrame, directory: DataFrame) -> DataFrame:
    """Reject pairs outside the requested pool or without a common pool; unknown names pass."""
    pools = pools_of_names(directory)
    side = lambda i: pools.select(F.col("who").alias(f"_w{i}"), F.col("pools").alias(f"pools_{i}"))
    x = pairs.join(side(1), F.lower(F.trim("name_1")) == F.col("_w1"), "left").join(
        side(2), F.lower(F.trim("name_2")) == F.col("_w2"), "left"
    )
    outside = lambda i: F.col(f"pools_{i}").isNotNull() & ~F.array_contains(f"pools_{i}", F.col("pool"))
    apart = F.col("pools_1").isNotNull() & F.col("pools_2").isNotNull() & ~F.arrays_overlap("pools_1", "pools_2")
    verdict = (
        F.when(F.lower(F.trim("name_1")) == F.lower(F.trim("name_2")), "same_name")
        .when(outside(1) | outside(2), "wrong_pool")
        .when(apart, "pools_differ")
        .otherwise("ok")
    )
    return x.select(*pairs.columns, verdict.alias("verdict"))


def lookup_by_id(ids: DataFrame, states: DataFrame) -> DataFrame:
    """Summaries for ``pool:slug`` identifiers; a missing surface rating falls back to the overall one."""
    asked = ids.select("id", F.regexp_replace("id", "^([^:]+):", "$1::").alias("key"))
    rating = lambda c: F.round(F.coalesce(c, "overall"), 2).alias(c)
    return asked.join(states, "key").select(
        "id",
        key_to_id(F.col("key")).alias("own_id"),
        "matches",
        F.round("overall", 2).alias("overall"),
        *[rating(s) for s in ("hard", "clay", "grass")],
    )


def roster(directory: DataFrame, limit: int = 40) -> DataFrame:
    """Ranking order with unknown rankings last, then name."""
    rank = F.coalesce(F.nullif("ranking", F.lit(0.0)), F.lit(float(FAR)))
    return directory.orderBy(rank, "name", "key").limit(limit)
