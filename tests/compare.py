"""Run a query on Spark and its SQL on DuckDB and compare the two results row by row."""

from __future__ import annotations

import math
import sys
import time

import duckdb

sys.path.insert(0, __file__.rsplit("/", 2)[0])
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


# Queries that SQL does not state; any other query without SQL counts as a failure.
ROWS_ONLY = ("q6_fingerprints", "l9_boosted_trees", "l16_family_ablation", "l17_feature_ladder", "m11_posterior_match", "op", "pipeline")


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def norm(v):
    if v is None:
        return "~"
    if isinstance(v, bool):
        return str(int(v))
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v + 0.0:.6f}"
    if hasattr(v, "as_tuple"):
        return f"{float(v):.6f}"
    return str(v)


def rows_of(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(norm(r[i]) for i in order) for r in data), [columns[i] for i in order]


def close(a, b):
    if a == b:
        return True
    try:
        return abs(float(a) - float(b)) <= 1.5e-6
    except ValueError:
        return False


def compare(spark, con, sf_dir, name, queries, oracles, verbose=True):
    start = time.time()
    df = queries[name](spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    took = time.time() - start
    got_rows, got_cols = rows_of(df.columns, got)
    if name not in oracles:
        return name.startswith(ROWS_ONLY), f"{name}: rows-only {len(got)} in {took:.1f}s cols={got_cols}"
    start = time.time()
    res = con.execute(oracles[name])
    cols = [d[0] for d in res.description]
    types = {d[0]: str(d[1]) for d in res.description}
    want_rows, want_cols = rows_of(cols, res.fetchall())
    otook = time.time() - start
    exact = got_rows == want_rows
    ok = exact
    note = ""
    if not exact:
        if got_cols != want_cols:
            note = f" columns {got_cols} vs {want_cols}"
        elif len(got_rows) != len(want_rows):
            extra = [r for r in got_rows if r not in set(want_rows)][:2]
            missing = [r for r in want_rows if r not in set(got_rows)][:2]
            note = f" rows {len(got_rows)} vs {len(want_rows)} extra={extra} missing={missing}"
        else:
            bad = [(a, b) for a, b in zip(got_rows, want_rows) if a != b]
            far = [(a, b) for a, b in bad if not all(close(x, y) for x, y in zip(a, b))]
            note = f" {len(bad)} rows differ, {len(far)} beyond rounding: {(far or bad)[:2]}"
    tmap = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    pairs = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE"}
    off = {c: (t, types.get(c)) for c, t in tmap.items() if pairs.get(t, "?") not in types.get(c, "")}
    tnote = f" TYPES {off}" if off else ""
    return ok, f"{name}: {'ok' if ok else 'MISMATCH'} {len(got)} rows spark {took:.1f}s duck {otook:.1f}s{note}{tnote}"


if __name__ == "__main__":
    from __spark_entry__ import oracle_sql, queries
    from tallyspark.session import local_session

    sf = sys.argv[1]
    picks = sys.argv[2:]
    q, o = queries(), oracle_sql()
    names = [n for n in q if not picks or any(n.startswith(p) for p in picks)]
    spark = local_session("compare", 8)
    con = duck(sf)
    bad = 0
    for n in names:
        try:
            ok, line = compare(spark, con, sf, n, q, o)
        except Exception as exc:  # noqa: BLE001
            ok, line = False, f"{n}: ERROR {type(exc).__name__} {str(exc)[:700]}"
        bad += not ok
        print(line, flush=True)
    print(f"{len(names)} queries, {bad} bad")
