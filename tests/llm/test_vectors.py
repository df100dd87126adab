"""Vector groups and neighbours against brute force, and odd vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import tallyspark.llm.nearest as nearest
import tallyspark.llm.vector_dedup as dedup

SCHEMA = "vec_id long, embedding array<float>, label int, node long, copies int, dim int, cell int, id int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, lab, 1, 2, 3, 4, 5) for i, v, lab in rows], SCHEMA)


def sample(rng, n, size=16):
    base = rng.standard_normal((n // 4, size))
    near = base[rng.integers(0, len(base), n - len(base))] + 0.04 * rng.standard_normal((n - len(base), size)) * rng.random((n - len(base), 1))
    return np.concatenate([base, near]).astype(np.float32)


ODD = [(900, None, 1), (901, [], 1), (902, [0.0] * 16, 1), (903, [float("nan")] + [1.0] * 15, 1), (904, [float("inf")] + [1.0] * 15, 1), (905, [None] + [1.0] * 15, 1), (906, [1.0] * 3, 1), (907, [2.0] * 3, 1), (908, [1.0] * 16, None)]


@pytest.mark.parametrize("block", [16, 2048])
def test_vector_groups(spark, monkeypatch, block):
    monkeypatch.setattr(dedup, "BLOCK", block)
    rng = np.random.default_rng(block)
    x = sample(rng, 240)
    x[50:60] = x[50]
    rows = [(i, v.tolist(), i % 2) for i, v in enumerate(x)] + ODD
    got = {r.id: r for r in dedup.vector_groups(table(spark, rows)).collect()}
    good = [(i, np.array(v, dtype=float), lab) for i, v, lab in rows if lab is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    links = {i: set() for i, _, _ in rows}
    for a, u, la in good:
        for b, v, lb in good:
            if a != b and la == lb and len(u) == len(v) and u @ v / np.sqrt((u @ u) * (v @ v)) >= 0.98:
                links[a].add(b)
    component = {i: i for i in links}
    changed = True
    while changed:
        new = {i: min([component[i], *(component[j] for j in links[i])]) for i in links}
        changed, component = new != component, new
    assert {i: r.n_links for i, r in got.items()} == {i: len(s) for i, s in links.items()}
    assert {i: r.component_id for i, r in got.items()} == component
    assert all(r.kept == (r.id == r.component_id) for r in got.values())
    assert dedup.vector_groups(table(spark, [])).count() == 0


def test_collisions_needed():
    assert 0 < dedup.collisions_needed(16) < 16 and dedup.collisions_needed(64) > 40


def test_estimates_lie_within_their_bounds():
    rng = np.random.default_rng(3)
    data, queries = rng.standard_normal((2000, 64)), rng.standard_normal((50, 64))
    guess, bound = nearest.estimate(queries, *nearest.encode(data))
    assert (np.abs(guess - queries @ data.T) <= bound).mean() > 0.99


@pytest.mark.parametrize("block", [32, 4096])
def test_nearest(spark, monkeypatch, block):
    monkeypatch.setattr(nearest, "DATA_BLOCK", block)
    monkeypatch.setattr(nearest, "QUERY_BLOCK", 8)
    rng = np.random.default_rng(block)
    x = sample(rng, 300)
    x[100:130] = x[100]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + ODD
    got = {}
    for r in nearest.nearest(nearest.build_index(table(spark, rows)), F.col("id") % 10 == 0, 20).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    pool = [(i, x[i].astype(float)) for i in range(300)] + [(908, np.ones(16))]
    hits = wanted = 0
    for q, u in pool:
        if q % 10 == 0:
            best = sorted((-float(u @ v), i) for i, v in pool if i != q)[:20]
            mine = [got[q][k] for k in range(1, 21)]
            assert mine == sorted(mine, key=lambda t: (-t[1], t[0]))
            assert all(abs(s - float(u @ dict(pool)[i])) < 1e-9 for i, s in mine)
            hits += len({i for _, i in best} & {i for i, _ in mine})
            wanted += 20
    assert hits >= 0.99 * wanted
    assert nearest.nearest(nearest.build_index(table(spark, [])), F.col("id") % 10 == 0, 20).count() == 0
    short = nearest.nearest(nearest.build_index(table(spark, [(0, [1.0, 2.0], 0), (1, [2.0, 1.0], 0)])), F.col("id") == 0, 20).collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in short] == [(0, 1, 1, 4.0)]
