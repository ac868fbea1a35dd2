"""Q01-Q23 and the notebook variants on the micro-fixture (expected values
worked out by hand from the fixture rows)."""

from __future__ import annotations

import pytest
from fixture_data import COMPETITORS, fixture_lines, rows
from pyspark.sql import functions as F

from bandwise.functions.buckets import NOTEBOOK_BUCKETS
from bandwise.operators.aggregates import lag_change
from bandwise.plans import reports as r


@pytest.fixture()
def lines(spark, scratch):
    return fixture_lines(spark, scratch)


def test_q01_bucket_counts_and_shares(lines):
    got = rows(r.price_bucket_distribution(lines), "price_bucket", "order_count", "pct_of_orders")
    assert got == [
        ("01. Under $10", 1, 14.29),
        ("02. $10–$19", 3, 42.86),
        ("03. $20–$29", 1, 14.29),
        ("06. $50–$74", 1, 14.29),
        ("10. $200+", 1, 14.29),
    ]
    units = dict(rows(r.price_bucket_distribution(lines), "price_bucket", "units_sold"))
    assert units["03. $20–$29"] == 3


def test_n1_notebook_labels_and_columns(lines):
    df = r.price_bucket_distribution(lines, buckets=NOTEBOOK_BUCKETS, notebook=True)
    assert df.columns == ["price_bucket", "order_count", "pct_of_orders", "total_revenue"]
    assert rows(df, "price_bucket")[1] == ("02. $10-$19",)


def test_q02_demand_cliff(lines):
    got = rows(r.demand_cliff(lines), "price_bucket", "prev_bucket_count", "pct_change", "flag")
    assert got == [
        ("02. $10–$19", 1, 200.0, ""),
        ("03. $20–$29", 3, -66.67, "threshold here"),
        ("06. $50–$74", 1, 0.0, ""),  # previous is 03: empty buckets are absent
        ("10. $200+", 1, 0.0, ""),
    ]


def test_q19_keeps_first_bucket(lines):
    got = rows(r.price_wall(lines), "price_bucket", "order_count", "note")
    assert got[0] == ("01. under $10", 1, "")
    assert got[2] == ("03. $20–$29", 1, "demand drops here")


def test_rounded_versus_unrounded_threshold(spark):
    agg = spark.createDataFrame([(0, 100000), (1, 79996)], "_b int, order_count long")
    q02 = rows(lag_change(agg, "_b", "order_count"), "pct_change", "flag")
    q19 = rows(lag_change(agg, "_b", "order_count", prev_col=None, flag_col="note",
                          compare_rounded=True, keep_first=True, flag_text="demand drops here"),
               "pct_change", "note")
    assert q02 == [(-20.0, "threshold here")]  # -20.004 unrounded
    assert q19 == [(None, ""), (-20.0, "")]


def test_q03_share_within_persona(lines):
    got = rows(r.segment_bucket_share(lines), "persona", "price_bucket", "order_count",
               "pct_within_persona")
    assert got == [
        ("fitness", "01. Under $10", 1, 50.0),
        ("fitness", "02. $10–$19", 1, 50.0),
        ("premium", "10. $200+", 1, 100.0),
    ]


def test_q04_and_n3(lines):
    got = rows(r.segment_price_summary(lines), "persona", "total_orders", "avg_price",
               "price_variance_pct")
    # fitness: 9.99 and 10.00 -> mean 9.995, population variance 0.000025
    assert got == [("premium", 1, 225.0, 0.0), ("fitness", 2, 10.0, 0.0)]
    n3 = r.segment_price_summary(lines, notebook=True)
    assert n3.columns == ["persona", "orders", "avg_price", "min_price", "max_price", "total_revenue"]


def test_q05_threshold_split(lines):
    got = rows(r.price_threshold_split(lines), "persona", "orders_under_20", "orders_20_plus",
               "total_orders", "pct_at_20_or_above")
    assert got == [("premium", 0, 1, 1, 100.0), ("fitness", 2, 0, 2, 0.0)]


def test_q06_q07(lines):
    assert rows(r.segment_channel(lines), "persona", "channel", "order_count") == [
        ("fitness", "app", 2), ("premium", "app", 1)]
    got = rows(r.income_price_tier(lines), "income_bracket", "price_tier", "order_count")
    assert got == [("high", "budget range (under $20)", 2), ("high", "premium range ($50+)", 1)]


def test_q08_tag_performance(lines):
    tags = ("high-protein", "keto", "vegan", "low-sugar", "halal")
    got = {t: (n, p) for t, n, p in rows(r.tag_performance(lines, tags=tags),
                                          "claim_tag", "order_count", "avg_price")}
    assert got == {"high-protein": (2, 10.0), "keto": (4, 15.0), "vegan": (2, 20.0),
                   "low-sugar": (1, 60.0)}


def test_q08_token_match_is_stricter(lines):
    got = dict(rows(r.tag_performance(lines, tags=("keto",), match="token"), "claim_tag", "order_count"))
    assert got == {"keto": 2}  # 'keto-friendly' is not the token 'keto'


def test_q09_category_summary(lines):
    got = rows(r.category_summary(lines), "category", "order_count", "avg_price", "total_units")
    assert got == [("Unknown", 2, 142.5, 3.0), ("Protein Bar", 2, 20.0, 4.0),
                   ("Protein Shake", 2, 10.0, 3.0)]


def test_q10_q11_q13(lines):
    got = rows(r.pack_size_mix(lines), "pack_size", "order_count", "pct_of_all_orders")
    assert got == [("single", 4, 66.67), ("4-pack", 2, 33.33)]
    assert rows(r.state_top_price(lines, limit=1), "state") == [("TX",)]
    assert rows(r.occasion_summary(lines), "occasion", "order_count", "avg_price") == [
        ("festive", 2, 20.0), ("gym", 2, 10.0)]


def test_q12_q22_tier_filter(lines):
    assert rows(r.city_tier_mix(lines), "city_tier", "order_count", "pct_of_orders") == [
        ("Tier 2", 2, 66.67), ("Tier 1", 1, 33.33)]
    assert rows(r.city_tier_yield(lines), "city_tier", "orders", "revenue_per_order") == [
        ("Tier 2", 2, 90.0), ("Tier 1", 1, 19.98)]


def test_q14_q15_q17_q20(lines):
    assert rows(r.segment_occasion_top(lines), "persona", "occasion", "order_count") == [
        ("fitness", "gym", 2)]
    assert rows(r.tier_segment_yield(lines), "city_tier", "persona", "revenue_per_order") == [
        ("Tier 1", "fitness", 19.98)]
    assert rows(r.affinity_summary(lines), "trend_affinity", "order_count") == [
        ("keto", 1), ("gut-health", 2)]
    assert rows(r.segment_income(lines), "persona", "income_bracket", "orders") == [
        ("fitness", "high", 2), ("premium", "high", 1)]


def test_q16_competitor_gap(lines):
    got = {c: (o, a, lo, hi, g, w) for c, o, a, lo, hi, g, w in rows(
        r.competitor_gap(lines), "category", "our_avg_price", "competitor_avg", "competitor_floor",
        "competitor_ceiling", "gap_vs_competitor", "where_we_sit")}
    assert got["Protein Shake"] == (10.0, 27.5, 10.0, 40.0, -17.5, "slightly below market")
    assert got["Unknown"][5] == "overpriced — watch churn risk"
    assert got["Protein Bar"][5] == "slightly below market"


def test_q16_without_competitor_data(spark, scratch):
    empty = COMPETITORS.splitlines()[0] + "\n"
    lines = fixture_lines(spark, scratch, {"competitor_pricing": empty})
    got = rows(r.competitor_gap(lines), "competitor_avg", "where_we_sit")
    assert got and all(a is None and w == "at market rate" for a, w in got)


def test_q21_tag_premium_and_n5(lines):
    tags = ("high-protein", "keto", "vegan", "low-sugar", "halal")
    got = {t: (a, d, v) for t, a, d, v in rows(r.tag_premium(lines, tags=tags), "claim_tag",
                                                "avg_price", "vs_overall_avg", "verdict")}
    assert got == {
        "low-sugar": (60.0, 8.57, "worth the premium claim"),
        "vegan": (20.0, -31.44, "not pulling its weight"),
        "keto": (15.0, -36.44, "not pulling its weight"),
        "high-protein": (10.0, -41.44, "not pulling its weight"),
    }
    n5 = {t: (o, d, v) for t, o, d, v in rows(r.tag_premium_orders(lines, tags=tags), "claim_tag",
                                               "orders", "vs_market_avg", "verdict")}
    assert n5["keto"] == (4, -36.44, "below market")
    assert n5["low-sugar"] == (1, 8.57, "premium justified")


def test_q23_occasion_vs_baseline(lines):
    got = rows(r.occasion_vs_baseline(lines), "occasion", "orders", "avg_price", "vs_overall_avg")
    assert got == [("festive", 2, 20.0, -31.44), ("gym", 2, 10.0, -41.44)]


def test_q18_best_band(lines):
    got = rows(r.launch_band(lines), "persona", "city_tier", "recommended_launch_range",
               "order_count", "revenue_per_order")
    assert got == [("fitness", "Tier 1", "under $20", 1, 19.98)]


def _one_segment(spark, scratch, tx_rows):
    tx = "order_id,user_id,product_id,price,quantity,timestamp,channel\n" + "".join(
        f"t{i},u1,p1,{p},{q},t,app\n" for i, (p, q) in enumerate(tx_rows))
    geo = "order_id,state,city_tier,occasion\n" + "".join(
        f"t{i},CA,Tier 1,gym\n" for i in range(len(tx_rows)))
    return fixture_lines(spark, scratch, {"transactions": tx, "geography_occasion": geo})


def test_q18_low_band_can_win(spark, scratch):
    lines = _one_segment(spark, scratch, [(5.00, 20), (60.00, 1)])
    assert rows(r.launch_band(lines), "recommended_launch_range", "revenue_per_order") == [
        ("under $20", 100.0)]


def test_q18_tie_goes_to_lower_band(spark, scratch):
    lines = _one_segment(spark, scratch, [(10.00, 6), (30.00, 2), (60.00, 1)])
    assert rows(r.launch_band(lines), "recommended_launch_range") == [("under $20",)]


def test_every_report_accepts_empty_input(spark, scratch):
    header = "order_id,user_id,product_id,price,quantity,timestamp,channel\n"
    lines = fixture_lines(spark, scratch, {"transactions": header})
    for fn in (r.price_bucket_distribution, r.demand_cliff, r.price_wall, r.segment_bucket_share,
               r.segment_price_summary, r.price_threshold_split, r.segment_channel,
               r.income_price_tier, r.tag_performance, r.category_summary, r.pack_size_mix,
               r.state_top_price, r.city_tier_mix, r.occasion_summary, r.segment_occasion_top,
               r.tier_segment_yield, r.competitor_gap, r.affinity_summary, r.launch_band,
               r.segment_income, r.tag_premium, r.tag_premium_orders, r.city_tier_yield,
               r.occasion_vs_baseline):
        assert fn(lines).count() == 0, fn.__name__
    assert rows(r.master_row_count(lines), "rows") == [(0,)]


def test_materialized_master_gives_same_reports(spark, scratch):
    a = fixture_lines(spark, scratch)
    b = fixture_lines(spark, scratch)
    b.materialize()
    for fn in (r.price_bucket_distribution, r.launch_band, r.tag_premium, r.occasion_vs_baseline):
        assert a and fn(a).collect() == fn(b).collect()
    assert b.master().filter(F.col("persona").isNotNull()).count() == 3


def test_n2_notebook_cliff(lines):
    from bandwise.functions.buckets import NOTEBOOK_BUCKETS
    df = r.demand_cliff(lines, buckets=NOTEBOOK_BUCKETS, flag_text="demand drops here", with_prev=False)
    assert df.columns == ["price_bucket", "order_count", "pct_change", "flag"]
    assert rows(df, "price_bucket", "pct_change", "flag") == [
        ("02. $10-$19", 200.0, ""), ("03. $20-$29", -66.67, "demand drops here"),
        ("06. $50-$74", 0.0, ""), ("10. $200+", 0.0, "")]


def test_n8_notebook_launch_range(lines):
    from bandwise.functions.buckets import NOTEBOOK_LAUNCH_BANDS
    df = r.launch_band(lines, bands=NOTEBOOK_LAUNCH_BANDS, label="recommended_range", count_name="orders")
    assert df.columns == ["persona", "city_tier", "recommended_range", "orders", "revenue_per_order"]
    assert rows(df, "persona", "recommended_range", "orders") == [("fitness", "under $20", 1)]
