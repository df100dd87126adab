"""Every catalogued query against its SQL; TALLY_ALL=1 adds the long-running ones."""

import os

import pytest

import __spark_entry__ as entry
from compare import compare, duck

SF = os.environ.get("TALLY_SF_DIR", "/root/testdata/sf0.001")
SLOW = (
    *("w12_rating_fold_service", "w17_", "x2_", "p14_", "l4_", "l9_", "l16_", "l17_", "l20_", "s9_", "s11_", "j14_"),
    *("j10_", "m11_", "a9_", "t2_incremental_ratings"),
)
NAMES = [n for n in entry.queries() if os.environ.get("TALLY_ALL") or not n.startswith(SLOW)]


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    ok, line = compare(spark, con, SF, name, entry.queries(), entry.oracle_sql())
    assert ok, line


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
