"""Properties on the driver's tables: shares add up, counts telescope, the
exploded tag relation equals the per-tag union, one best band per segment,
final orders hold, and answers do not depend on the partitioning."""

from __future__ import annotations

import functools

import pytest
from conftest import SF01
from pyspark.sql import functions as F

import __spark_entry__ as ent
from bandwise.operators.tags import CLAIM_TAGS, claim_map
from bandwise.plans import reports as r
from bandwise.plans.catalog import order_lines
from bandwise.sources.bindings import CLAIM_TAGS_ALL


@pytest.fixture(scope="module")
def lines_b(spark):
    return order_lines(spark, SF01, "b")


def test_shares_sum_to_100(lines_b):
    total = sum(x["pct_of_orders"] for x in r.price_bucket_distribution(lines_b).collect())
    assert abs(total - 100) < 0.06
    per = {}
    for x in r.segment_bucket_share(lines_b).collect():
        per[x["persona"]] = per.get(x["persona"], 0) + x["pct_within_persona"]
    assert all(abs(v - 100) < 0.06 for v in per.values())


def test_bucket_counts_add_up_to_master(lines_b):
    counts = [x["order_count"] for x in r.price_bucket_distribution(lines_b).collect()]
    assert sum(counts) == lines_b.master().count()
    cliff = r.demand_cliff(lines_b).collect()
    for x in cliff:  # each row's previous count is the count of the row before it
        assert x["prev_bucket_count"] in counts


def test_exploded_tags_equal_per_tag_union(lines_b):
    one_pass = claim_map(lines_b.products, CLAIM_TAGS_ALL)
    union = functools.reduce(
        lambda a, b: a.unionByName(b),
        [lines_b.products.filter(F.col("claims").ilike(f"%{t}%"))
         .select("product_id", F.lit(t).alias("claim_tag")) for t in CLAIM_TAGS_ALL])
    assert one_pass.exceptAll(union).count() == 0 and union.exceptAll(one_pass).count() == 0
    assert claim_map(lines_b.products, CLAIM_TAGS).count() == 0  # no reference tags in test data


def test_one_best_band_per_segment(lines_b):
    best = r.launch_band(lines_b)
    assert best.count() == best.select("persona", "city_tier").distinct().count()


def _sorted_by(rows, keys):
    def k(row):
        return tuple((-row[c[1:]] if c.startswith("-") else row[c]) for c in keys)
    return [k(x) for x in rows] == sorted(k(x) for x in rows)


@pytest.mark.parametrize("fn,keys", [
    (r.price_bucket_distribution, ["price_bucket"]),
    (r.segment_price_summary, ["-avg_price"]),
    (r.state_top_price, ["-avg_price", "state"]),
    (r.segment_occasion_top, ["-avg_price", "persona", "occasion"]),
    (r.tier_segment_yield, ["city_tier", "-revenue_per_order"]),
    (r.launch_band, ["persona", "city_tier"]),
    (r.city_tier_yield, ["-revenue_per_order"]),
    (r.occasion_vs_baseline, ["-avg_price"]),
    (r.competitor_gap, ["-gap_vs_competitor"]),
])
def test_final_order(lines_b, fn, keys):
    assert _sorted_by(fn(lines_b).collect(), keys)


def test_top_k_limits(lines_b):
    assert r.state_top_price(lines_b).count() == 20
    assert r.segment_occasion_top(lines_b).count() <= 30


@pytest.mark.parametrize("name", ["q08_tag_performance_b", "q18_best_band_b", "q21_tag_premium_b",
                                  "w08_quality_audit_b"])
def test_independent_of_partitioning(spark, name):
    q = ent.queries()[name]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        one = sorted(map(tuple, q(spark, SF01).collect()), key=repr)
        spark.conf.set("spark.sql.shuffle.partitions", "13")
        many = sorted(map(tuple, q(spark, SF01).collect()), key=repr)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert one == many
