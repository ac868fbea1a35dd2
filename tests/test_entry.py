"""The driver contract in __spark_entry__."""

from __future__ import annotations

import __spark_entry__ as ent


def test_entry_runs_on_smoke_tables(spark):
    df = ent.entry(spark)
    assert df.columns == ["price_bucket", "order_count", "prev_bucket_count", "pct_change", "flag"]
    assert df.count() >= 0


def test_every_query_has_oracle_and_distinct_key():
    q, o = ent.registry(), ent.oracle_registry()
    assert set(q) == set(o)
    assert len(q) == 86
    for name in q:
        assert name.split("_")[0][0] in "wqn"
    assert set(q) <= set(ent.queries()) and set(o) <= set(ent.oracle_sql()) <= set(ent.queries())
