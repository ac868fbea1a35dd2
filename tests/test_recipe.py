"""The README's at-scale recipe runs end to end and agrees with standalone runs."""

from __future__ import annotations

from fixture_data import fixture_lines, fixture_roles

from bandwise import configure
from bandwise.plans import OrderLines, group_all, reports
from bandwise.plans.catalog import ENTRIES
from bandwise.sources import bucket_count, save_roles, table_roles


def test_recipe(spark, scratch):
    from bandwise.session import _DEFAULTS, scale_settings
    touched = {**_DEFAULTS, **scale_settings(10_000)}
    before = {k: spark.conf.get(k, None) for k in touched}
    try:
        configure(spark, input_bytes=10_000)
        save_roles(fixture_roles(spark, scratch), prefix="recipe_", buckets=bucket_count(10_000))
        lines = OrderLines(table_roles(spark, prefix="recipe_"))
        lines.materialize()
        group_all(lines)
        alone = fixture_lines(spark, scratch)
        for e in ENTRIES:
            if e.qid.startswith("q"):
                assert sorted(map(tuple, e.build(lines).collect()), key=repr) == \
                    sorted(map(tuple, e.build(alone).collect()), key=repr), e.qid
        assert reports.demand_cliff(lines).count() == 4
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
