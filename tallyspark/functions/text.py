"""Row-level normalization of names, dates, numbers and categories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Surface spellings and event names with their surface.
SURFACES_THREE = ("hard", "clay", "grass")
SURFACES_FOUR = ("hard", "clay", "grass", "carpet")
EVENT_SURFACES = {
    "hard court": "hard",
    "clay court": "clay",
    "grass court": "grass",
    "australian open": "hard",
    "roland garros": "clay",
    "french open": "clay",
    "wimbledon": "grass",
    "us open": "hard",
}


def normalize_name(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.replace(c, F.lit("_"), F.lit(" ")), r"\s+", " "))


def entity_key(name: Column, pool: Column) -> Column:
    return F.concat_ws("::", F.lower(F.trim(pool)), F.lower(normalize_name(name)))


def key_to_id(key: Column) -> Column:
    return F.regexp_replace(key, "::", ":")


def slug_id(name: Column, pool: Column) -> Column:
    return F.concat_ws(":", pool, F.replace(F.lower(name), F.lit(" "), F.lit("-")))


def letters_only(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z]", "")


def initial_forms(name: Column) -> tuple[Column, Column]:
    """``First ... Last`` as ``Last F.`` and ``Last, F.``; null for one-word names."""
    words = F.filter(
        F.transform(F.split(F.trim(name), r"\s+"), lambda w: F.regexp_replace(w, r"^[ ,.]+|[ ,.]+$", "")),
        lambda w: F.length(w) > 0,
    )
    usable = F.size(words) >= 2
    last, first = F.element_at(words, -1), F.substring(F.element_at(words, 1), 1, 1)
    return (
        F.when(usable, F.concat(last, F.lit(" "), first, F.lit("."))),
        F.when(usable, F.concat(last, F.lit(", "), first, F.lit("."))),
    )


def parse_date(c: Column) -> Column:
    """``YYYYMMDD`` or an ISO date (a time part is dropped); anything else is null."""
    v = F.trim(c)
    return F.when(v.rlike(r"^[0-9]{8}$"), F.try_to_date(v, "yyyyMMdd")).when(
        v.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([T ].*)?$"), F.try_to_date(F.substring(v, 1, 10))
    )


def first_float(*cols: Column) -> Column:
    """The first column whose text parses as a number."""
    return F.coalesce(*[F.trim(c).try_cast("double") for c in cols])


def canonical_surface(c: Column, known: Sequence[str] = SURFACES_THREE, default: str = "hard") -> Column:
    v = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return F.when(v.isin(*known), v).otherwise(F.lit(default))


def best_of_or_default(value: Column, pool: Column, level: Column, long_pool: str = "atp") -> Column:
    n = F.coalesce(
        F.when(value != 0, value).cast("int"),
        F.when((pool == long_pool) & (level == "G"), F.lit(5)).otherwise(F.lit(3)),
    )
    return F.when(n.isin(3, 5), n).otherwise(F.lit(3))


def event_surface(event: Column, explicit: Column) -> Column:
    """An explicit surface wins; otherwise a known event name; otherwise null (rejected)."""
    name = F.lower(F.trim(event))
    known = F.create_map(*[F.lit(x) for pair in EVENT_SURFACES.items() for x in pair])
    return F.coalesce(F.when(explicit != "", explicit), F.try_element_at(known, name))


def clipped_ratio(num: Column, den: Column) -> Column:
    return F.when((den > 0) & num.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), num / den)))


def polynomial_parity(seed: Column, base: int = 131, modulus: int = 1_000_003) -> Column:
    """True where the polynomial code-point hash of ``seed`` is even."""
    chars = F.filter(F.split(seed, ""), lambda ch: ch != "")
    value = F.aggregate(
        chars, F.lit(0).cast("bigint"), lambda acc, ch: (acc * F.lit(base) + F.ascii(ch)) % F.lit(modulus)
    )
    return value % 2 == 0


def side_flip(date: Column, venue: Column, winner: Column, loser: Column, pool: Column | None = None) -> Column:
    parts = [F.date_format(date, "yyyy-MM-dd")] + ([pool] if pool is not None else []) + [venue, winner, loser]
    return polynomial_parity(F.concat_ws("|", *[p.cast("string") for p in parts]))


def cleaned(c: Column) -> Column:
    """Null, NaN and both infinities become zero."""
    inf = float("inf")
    return F.when(c.isNull() | F.isnan(c) | (c == inf) | (c == -inf), F.lit(0.0)).otherwise(c)
