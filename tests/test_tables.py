"""Role tables bucketed by order id: the order-grain join shuffles neither side."""

from __future__ import annotations

import re

from fixture_data import GEOGRAPHY, fixture_roles

from bandwise.operators.master import build_master
from bandwise.plans import reports as r
from bandwise.plans.reports import OrderLines
from bandwise.sources.tables import save_roles, table_roles


def test_bucketed_roles_join_without_shuffle(spark, scratch):
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        geo = GEOGRAPHY + "o4,NJ,Tier 3,gym\n"  # a duplicate key: fan-out must survive
        save_roles(fixture_roles(spark, scratch, {"geography_occasion": geo}), prefix="bk_", buckets=4)
        lines = OrderLines(table_roles(spark, prefix="bk_"))
        m = build_master(lines.transactions, lines.consumers, lines.products, lines.geography,
                         need=("geo",), max_rows=0)
        counts = m.groupBy("occasion").count()
        got = {row["occasion"]: row["count"] for row in counts.collect()}
        plan = counts._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan
        assert not re.search(r"Exchange hashpartitioning\(order_id", plan)
        assert got == {"gym": 3, "festive": 2, None: 3}  # o4 twice (gym and festive)
        # the same reports as over the CSV roles
        csv_lines = OrderLines(fixture_roles(spark, scratch, {"geography_occasion": geo}))
        assert r.occasion_summary(lines).collect() == r.occasion_summary(csv_lines).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "32MB")
