"""Partials that merge: key proofs, counted tags, order bitmaps, exact sums, batches."""

from __future__ import annotations

import os

import pytest
from fixture_data import GEOGRAPHY, TRANSACTIONS, fixture_lines, fixture_roles
from pyspark.sql import functions as F

from bandwise.functions.money import from_parts, price_parts
from bandwise.operators import joins
from bandwise.operators.measures import merged, partial
from bandwise.operators.tags import explode_weighted, finish_tags, merge_tag_partials, tag_partials, tag_weights
from bandwise.plans import reports as r
from bandwise.plans.catalog import ENTRIES
from bandwise.plans.reports import OrderLines
from bandwise.plans.suite import store_partials, stored_lines
from bandwise.sources.proofs import stored_proof, table_location
from bandwise.sources.tables import save_roles, table_roles


def jobs_of(spark, group, work):
    spark.sparkContext.setJobGroup(group, group)
    try:
        work()
    finally:
        spark.sparkContext.setJobGroup("", "")
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_a_proven_table_needs_no_job_at_plan_time(spark, scratch):
    save_roles(fixture_roles(spark, scratch), prefix="pk_", buckets=2)
    joins.clear_size_proofs()
    roles = table_roles(spark, prefix="pk_")
    assert set(roles.proofs) == {"buyer", "product", "geo"}
    lines = OrderLines(roles)
    assert jobs_of(spark, "proven", lambda: [f(lines) for f in (r.occasion_summary, r.segment_channel, r.tier_segment_yield)]) == 0
    assert jobs_of(spark, "unproven", lambda: r.occasion_summary(fixture_lines(spark, scratch))) > 0
    alone = fixture_lines(spark, scratch)
    assert r.occasion_summary(lines).collect() == r.occasion_summary(alone).collect()


def test_a_rewritten_table_loses_its_proof(spark, scratch):
    save_roles(fixture_roles(spark, scratch), prefix="pr_", buckets=2)
    table = "pr_consumer_insights"
    proof = stored_proof(spark, table, "user_id")
    assert (proof.rows, proof.repeated_keys) == (5, 0)
    assert stored_proof(spark, table, "persona") is None
    spark.table(table).limit(2).write.mode("append").saveAsTable(table)
    assert os.path.isdir(table_location(spark, table).removeprefix("file:"))
    assert stored_proof(spark, table, "user_id") is None
    assert "buyer" not in table_roles(spark, prefix="pr_").proofs


def test_proven_repeats_still_multiply_lines(spark, scratch):
    geo = GEOGRAPHY + "o4,NJ,Tier 3,gym\no4,NJ,Tier 3,gym\n,NJ,Tier 1,gym\n"
    save_roles(fixture_roles(spark, scratch, {"geography_occasion": geo}), prefix="pm_", buckets=2)
    roles = table_roles(spark, prefix="pm_")
    assert roles.proofs["geo"].repeated_keys == 1
    proven, alone = OrderLines(roles), fixture_lines(spark, scratch, {"geography_occasion": geo})
    assert proven.master().count() == alone.master().count() == 9
    assert r.price_bucket_distribution(proven).collect() == r.price_bucket_distribution(alone).collect()


def test_a_product_listed_a_million_times(spark):
    listed = spark.range(1_000_000).select(F.lit("p").alias("product_id"), F.lit("keto, vegan").alias("claims"))
    others = spark.createDataFrame([("q", "KETO"), ("q", None), (None, "keto"), ("s", "none")], "product_id string, claims string")
    weights = {x.product_id: [tuple(t) for t in x.tags] for x in tag_weights(listed.unionAll(others), ["keto", "vegan", "halal"]).collect()}
    assert weights == {"p": [("keto", 1_000_000), ("vegan", 1_000_000)], "q": [("keto", 1)]}


@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_distinct_orders_by_bitmap_and_by_text(spark, kind):
    rows = [(i // 3 * 40_000 - 70_000, "a" if i % 2 else "b", 1.01 * (i % 7), i % 4) for i in range(300)]
    rows += [(None, "a", 5.0, 1), (0, "a", 2.5, 1), (0, "a", 2.5, 1), (-1, "b", 1.0, 2)]
    df = spark.createDataFrame(rows, "order_id bigint, claim_tag string, price double, quantity int")
    df = df.selectExpr(f"CAST(order_id AS {kind}) AS order_id", "claim_tag", "2L AS copies", "price", "quantity", "price AS line_revenue")
    whole = finish_tags(tag_partials(df)).collect()
    halves = tag_partials(df.filter("price < 3")).unionByName(tag_partials(df.filter("price >= 3")))
    assert sorted(whole) == sorted(finish_tags(merge_tag_partials(halves)).collect())
    want = {t: len({o for o, u, *_ in rows if u == t and o is not None}) for t in "ab"}
    assert {x.claim_tag: x._orders for x in whole} == want
    assert {x.claim_tag: x._n for x in whole} == {t: 2 * sum(u == t for _, u, *_ in rows) for t in "ab"}


def test_means_do_not_depend_on_the_partitioning(spark):
    df = spark.range(20_000).selectExpr("pmod(xxhash64(id), 22499) / 100.0D + pmod(id, 997) * 1e-8 AS price", "id % 3 AS k")
    whole, rest = price_parts("price")
    answers = set()
    for n in (1, 3, 16):
        got = df.repartition(n, F.rand(n)).agg(from_parts(F.sum(whole), F.sum(rest)).alias("s")).first()["s"]
        answers.add(got.hex())
    assert len(answers) == 1
    parts = df.groupBy("k").agg(*[partial(p) for p in ("_n", "_sc", "_sr", "_m2", "_mn", "_mx")])
    one = parts.agg(*[merged(p) for p in ("_n", "_sc", "_sr", "_m2", "_mn", "_mx")]).first()
    all_at_once = df.agg(*[partial(p) for p in ("_n", "_sc", "_sr", "_m2", "_mn", "_mx")]).first()
    assert one._n == all_at_once._n and one._sc == all_at_once._sc and one._sr == all_at_once._sr
    assert one._m2 == pytest.approx(all_at_once._m2, rel=1e-12)


def test_a_verdict_at_the_bound_does_not_flip(spark):
    """A tag's mean at exactly 1.15 times the baseline is not above it."""
    from bandwise.operators.baseline import lift_vs_baseline
    # means 11.5 and 10.0 out of many equal prices, added in any order
    df = spark.range(3000).selectExpr("IF(id % 3 = 0, 11.4D, 11.55D) AS price")
    for n in (1, 7):
        whole, rest = price_parts("price")
        s = df.repartition(n, F.rand(3)).agg(F.sum(whole).alias("c"), F.sum(rest).alias("r"), F.count("*").alias("n"))
        out = lift_vs_baseline(s, from_parts("c", "r") / F.col("n"), F.lit(10.0)).first()
        assert (out.avg_price, out.verdict) == (11.5, "about average")


def test_reports_from_batches_equal_reports_from_lines(spark, scratch):
    head, *rows = TRANSACTIONS.splitlines(keepends=True)
    path = os.path.join(scratch, "stored")
    for k, batch in enumerate((rows[:4], rows[4:9], rows[9:])):
        folder = os.path.join(scratch, f"batch{k}")
        os.mkdir(folder)
        store_partials(fixture_lines(spark, folder, {"transactions": head + "".join(batch)}), path)
    alone = fixture_lines(spark, scratch)
    after = stored_lines(spark, path, competitors=alone.competitors)
    for e in ENTRIES:
        if e.qid.startswith("q"):
            build = e.build.func if e.qid in ("q08", "q21") else e.build
            assert sorted(map(tuple, build(after).collect()), key=repr) == sorted(map(tuple, build(alone).collect()), key=repr), e.qid
    with pytest.raises(ValueError, match="do not hold"):
        r.summarize(after, ("buyer",), ["age_group"], {"n": "count"})
