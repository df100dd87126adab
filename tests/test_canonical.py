"""Canonical JSON against the standard library's own form, and damped SQL steps."""

import hashlib
import json

import duckdb

from tallyspark.plans import newton
from tallyspark.sources.results import canonical_json_hash

TEXTS = [
    '{"a":"1"}', '{"a":1}', '{"a":{"x":1,"y":2}}', '{"a":{"y":2,"x":1}}', '{"b":[{"z":1,"a":[]},null,true],"a":{}}', '[3, "a", {"z":1,"a":2}]',
    '{"x":1.0,"y":1e5,"z":-0.0,"w":12345678901234567890}', '"é\\u00e9🙂\\n\\u0001\\\\\\""', "null", "7", '{"a":1,"a":2}', " { } ",
]


def test_canonical_json(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(100, None, "x"), (101, "{bad", "x"), (102, "", "x")]
    got = {r.id: r.sha256 for r in canonical_json_hash(spark.createDataFrame(rows, "id int, v string, sha256 string"), "id", "v").collect()}
    want = {i: hashlib.sha256(json.dumps(json.loads(t), sort_keys=True, separators=(",", ":")).encode()).hexdigest() for i, t in enumerate(TEXTS)}
    assert got == want | {100: None, 101: None, 102: None}
    assert got[0] != got[1] and got[2] == got[3]
    assert canonical_json_hash(spark.createDataFrame([], "id int, v string"), "id", "v").collect() == []


def test_damped_steps_reach_the_minimum():
    con = duckdb.connect()
    con.execute("CREATE TABLE t AS SELECT CASE WHEN i % 3 = 0 THEN 9.0 ELSE -8.0 END + i % 5 AS z, CAST(i % 7 < 3 AS INT) AS label FROM range(210) r(i)")
    fitted = con.execute("WITH " + ", ".join(newton.calibration_ctes("c", "t", "z", steps=20, damped=True)) + " SELECT slope, shift FROM c_c").fetchone()
    slope, grad = con.execute(f"SELECT avg((p - label) * z) + 0.002 * ({fitted[0]} - 1), avg(p - label) FROM (SELECT *, 1 / (1 + exp(-({fitted[0]} * z + {fitted[1]}))) AS p FROM t)").fetchone()
    assert abs(slope) < 1e-4 and abs(grad) < 1e-5
