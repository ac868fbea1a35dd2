"""A key holding a third of all order lines: the order-grain join splits it
(AQE skew join on the order-line side) and the results stay whole and equal
to the broadcast plan."""

from __future__ import annotations

from pyspark.sql import functions as F

from bandwise.operators.master import build_master
from bandwise.plans import reports as r
from bandwise.plans.reports import OrderLines
from bandwise.sources.bindings import Roles


def _roles(spark, n=30_000):
    ids = spark.range(n)
    order = F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("o"), F.col("id").cast("string")))
    tx = ids.select(
        order.alias("order_id"), (F.col("id") % 50).cast("string").alias("user_id"),
        (F.col("id") % 7).cast("string").alias("product_id"),
        ((F.col("id") % 20000) / 100.0 + 0.01).alias("price"), F.lit(1).alias("quantity"),
        F.lit("t").alias("timestamp"), F.lit("app").alias("channel"))
    geo = ids.filter(F.col("id") % 3 != 0).select(
        order.alias("order_id"), F.lit("CA").alias("state"), F.lit("Tier 1").alias("city_tier"),
        (F.col("id") % 4).cast("string").alias("occasion"))
    geo = geo.unionByName(spark.createDataFrame([("hot", "NY", "Tier 2", "gym")], geo.schema))
    cons = spark.range(50).select(F.col("id").cast("string").alias("user_id"), F.lit("fit").alias("persona"),
                                  F.lit("t").alias("trend_affinity"), F.lit("a").alias("age_group"),
                                  F.lit("g").alias("gender_identity"), F.lit("high").alias("income_bracket"),
                                  F.lit(None).cast("string").alias("dietary_restriction"))
    prods = spark.range(7).select(F.col("id").cast("string").alias("product_id"), F.lit("Bar").alias("category"),
                                  F.lit("keto").alias("claims"), F.lit("x").alias("ingredient_tags"),
                                  F.lit("single").alias("pack_size"))
    comp = spark.createDataFrame([("k", 1.0, "t")], "competitor_product_id string, price double, timestamp string")
    return Roles(transactions=lambda: tx, consumers=lambda: cons, products=lambda: prods,
                 geography=lambda: geo, competitors=lambda: comp)


def test_hot_order_key_is_split_and_results_are_whole(spark):
    conf = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1024",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4096",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.shuffle.partitions": "16",
        # keep the sort-merge join (the data is tiny; at scale the side is large)
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    }
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        lines = OrderLines(_roles(spark))
        shuffled = build_master(lines.transactions, lines.consumers, lines.products, lines.geography,
                                need=("geo",), max_rows=0)
        per_occasion = shuffled.groupBy("occasion").agg(F.count(F.lit(1)).alias("n"),
                                                        F.sum("price").alias("s"))
        got = dict((o, n) for o, n, _ in per_occasion.collect())
        plan = per_occasion._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan
        assert "skew=true" in plan or "isSkewJoin=true" in plan
        assert got["gym"] == 10_000  # the hot order's lines, all kept
        assert sum(got.values()) == 30_000
        broadcast = dict((r["occasion"], r["order_count"]) for r in r.occasion_summary(lines).collect())
        assert all(broadcast[o] == got[o] for o in broadcast)
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
