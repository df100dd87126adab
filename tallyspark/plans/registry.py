"""The catalogue of named queries and, beside each, the SQL that states the same result."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

VIEWS: dict[str, str] = {
    "matches": """
SELECT a.event_id // 2 AS match_id,
       CASE WHEN (a.event_id // 2) % 2 = 0 THEN 'north' ELSE 'south' END AS pool,
       CAST(a.ts AS DATE) AS match_date,
       'V' || CAST((a.event_id // 2) % 7 AS VARCHAR) AS venue,
       CAST(1 + hour(a.ts) // 6 AS INTEGER) AS round_order,
       CASE a.event_type WHEN 'view' THEN 'clay' WHEN 'purchase' THEN 'grass'
                         WHEN 'signup' THEN 'carpet' ELSE 'hard' END AS surface,
       CASE WHEN (a.event_id // 2) % 5 = 0 THEN 5 ELSE 3 END AS best_of,
       CASE WHEN a.value > b.value THEN a.user_id ELSE b.user_id END AS winner,
       CASE WHEN a.value > b.value THEN b.user_id ELSE a.user_id END AS loser,
       CASE WHEN a.value > b.value THEN a.event_id ELSE b.event_id END AS w_ev,
       CASE WHEN a.value > b.value THEN b.event_id ELSE a.event_id END AS l_ev,
       CASE (a.event_id // 2) % 6 WHEN 0 THEN '6-4 6-4' WHEN 1 THEN '7-6(5) 6-3' WHEN 2 THEN '6-3 3-6 7-5'
            WHEN 3 THEN '6-0 6-1' WHEN 4 THEN '4-6 7-6(7) 6-4' ELSE '6-2 RET' END AS score
FROM events a JOIN events b ON b.event_id = a.event_id + 1
WHERE a.event_id % 2 = 0 AND a.user_id <> b.user_id AND a.value <> b.value""",
    "sides": """
SELECT match_id, pool, match_date, venue, round_order, surface, best_of, score,
       winner AS entity, loser AS opponent, 1 AS won, w_ev AS ev, l_ev AS oev FROM matches
UNION ALL
SELECT match_id, pool, match_date, venue, round_order, surface, best_of, score,
       loser, winner, 0, l_ev, w_ev FROM matches""",
    "parts": """
SELECT s.*, 50 + (7 * ev) % 40 AS svpt, 30 + (11 * ev) % 20 AS first_in, 18 + (5 * ev) % 12 AS first_won,
       (50 + (7 * ev) % 40) - (30 + (11 * ev) % 20) AS svpt_second,
       (((50 + (7 * ev) % 40) - (30 + (11 * ev) % 20)) * ((3 * ev) % 60 + 20)) // 100 AS second_won,
       ev % 11 AS bp_faced, ((ev % 11) * (ev % 5)) // 5 AS bp_saved, (13 * ev) % 9 AS aces, ev % 5 AS dfs,
       50 + (7 * oev) % 40 AS o_svpt, 18 + (5 * oev) % 12 AS o_first_won,
       (((50 + (7 * oev) % 40) - (30 + (11 * oev) % 20)) * ((3 * oev) % 60 + 20)) // 100 AS o_second_won,
       oev % 11 AS o_bp_faced, ((oev % 11) * (oev % 5)) // 5 AS o_bp_saved,
       CASE WHEN ev % 17 <> 0 THEN CAST(1 + entity % 200 AS DOUBLE) END AS ranking,
       CASE WHEN ev % 19 <> 0 THEN CAST(100 * (entity % 80) AS DOUBLE) END AS ranking_points,
       CASE WHEN ev % 13 <> 0 THEN CAST(18 + ev % 20 AS DOUBLE) END AS age,
       CASE WHEN ev % 7 <> 0 THEN CAST(165 + entity % 35 AS DOUBLE) END AS height,
       CASE WHEN ev % 23 = 0 THEN '' WHEN entity % 5 = 0 THEN 'L' ELSE 'R' END AS hand
FROM sides s""",
    "scored": """
SELECT l_orderkey, l_linenumber, (l_quantity + 1) / 52.0 AS p,
       0.5 * ((l_quantity + 1) / 52.0) + 0.5 * (0.02 + 9 * l_discount) AS p2,
       CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label, l_linestatus AS grp,
       CAST(date_trunc('month', l_shipdate) AS DATE) AS block, CAST(year(l_shipdate) AS INTEGER) AS yr,
       l_discount, l_tax, l_extendedprice FROM lineitem""",
    "lm": """
SELECT label AS clip_id, vec_id AS frame_idx, i AS idx,
       CAST(embedding[2 * i + 1] AS DOUBLE) AS x, CAST(embedding[2 * i + 2] AS DOUBLE) AS y,
       0.5 + ((vec_id + 7 * i) % 10) / 20.0 AS visibility
FROM embeddings, (SELECT unnest(range(0, 32)) AS i)""",
    "entrants": """
SELECT c_custkey // 8 AS draw_id, CAST(c_custkey % 8 AS INTEGER) AS slot, c_acctbal AS strength, c_name AS name
FROM customer""",
    "requests": """
SELECT c_custkey AS request_id, CAST(1 + c_custkey % 6 AS INTEGER) AS days,
       [0, 1, 2, 4, 6, 8][(c_custkey // 6) % 6 + 1] AS weeks, [30, 45, 60, 75, 90][c_custkey % 5 + 1] AS duration,
       ['Beginner', 'Intermediate', 'Advanced', 'Competitive'][c_custkey % 4 + 1] AS level,
       c_mktsegment AS segment
FROM customer""",
}


MATERIAL: set[str] = set()


def view(name: str, sql: str, material: bool = False) -> None:
    """A fixture view; a ``material`` one is computed once however often it is read."""
    VIEWS[name] = sql
    if material:
        MATERIAL.add(name)


def _needs(sql: str, seen: list[str]) -> None:
    for name in VIEWS:
        if name not in seen and re.search(rf"\b{name}\b", sql):
            _needs(VIEWS[name], seen)
            if name not in seen:
                seen.append(name)


def complete(sql: str, recursive: bool = False) -> str:
    """Prefix ``sql`` with the fixture views it mentions."""
    used: list[str] = []
    _needs(sql, used)
    body = sql.strip()
    extra = ""
    if body.upper().startswith("WITH "):
        extra = body[5:]
        if extra.upper().lstrip().startswith("RECURSIVE "):
            extra, recursive = extra.lstrip()[10:], True
    if not used and not extra:
        return body
    word = "WITH RECURSIVE " if recursive else "WITH "
    heads = ",\n".join(f"{n} AS {'MATERIALIZED ' * (n in MATERIAL)}({VIEWS[n]})" for n in used)
    if extra:
        return word + (heads + ",\n" if heads else "") + extra
    return word + heads + "\n" + body


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = complete(sql)
        return fn

    return register


def r6(expression: str) -> str:
    """Six decimals; the tiny shift makes every engine break ties the same way."""
    return f"round(({expression}) + 1e-9, 6) + 0.0"
