"""Every query that has a DuckDB oracle against it on the sf0.01 tables (the
driver's correctness gate, run locally)."""

from __future__ import annotations

import os
import sys

import pytest
from conftest import SF01

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as ent  # noqa: E402
from check_oracle import compare, duck  # noqa: E402

QUERIES = ent.queries()
ORACLE = ent.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF01)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF01)
    got = [tuple(r) for r in df.collect()]
    res = con.execute(ORACLE[name])
    why = compare(got, df.columns, res.fetchall(), [d[0] for d in res.description])
    assert why is None, why


def test_keys_match():
    assert set(ent.registry()) == set(ent.oracle_registry())
    assert set(ORACLE) <= set(QUERIES)
