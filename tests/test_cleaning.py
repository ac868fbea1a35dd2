"""W01-W06, W08-W10 on the dirty micro-fixture."""

from __future__ import annotations

from fixture_data import GEOGRAPHY, fixture_lines, fixture_roles, rows
from pyspark.sql import functions as F

from bandwise.operators.audit import duplicate_keys, join_key_audit, quality_audit
from bandwise.operators.cleaning import clean_geography, competitor_summary
from bandwise.operators.master import ALL_PARTS, row_count
from bandwise.sources.csv import load_table


def test_load_table_types_and_na_tokens(spark, scratch):
    roles = fixture_roles(spark, scratch)
    tx = roles.transactions
    assert [f.dataType.simpleString() for f in tx.schema] == [
        "string", "string", "string", "double", "double", "string", "string"]
    got = dict(rows(tx, "order_id", "price"))
    assert got["o10"] is None  # 'abc' -> NULL, no error
    assert got["o1"] == 9.99
    diet = dict(rows(roles.consumers, "user_id", "dietary_restriction"))
    assert diet["u1"] is None and diet["u2"] is None  # 'NA', 'None'
    assert diet["u3"] == "vegan"
    # ids stay text, blanks inside text are kept for the cleaning step
    assert dict(rows(roles.consumers, "user_id", "persona"))["u2"] == "  "


def test_load_table_keeps_fractional_quantities(spark, scratch):
    path = f"{scratch}/tx.csv"
    with open(path, "w") as fh:
        fh.write("order_id,user_id,product_id,price,quantity,timestamp,channel\n"
                 "a,u,p,1.5,2,t,c\nb,u,p,2,1.5,t,c\nc,u,p,NaN,3.0,t,c\n")
    got = rows(load_table(spark, path, "transactions"), "order_id", "price", "quantity")
    assert got == [("a", 1.5, 2.0), ("b", 2.0, 1.5), ("c", None, 3.0)]


def test_clean_transactions(spark, scratch):
    tx = fixture_lines(spark, scratch).transactions
    got = dict(rows(tx, "order_id", "line_revenue"))
    assert sorted(got) == sorted(["o1", "o2", "o3", "o4", "o5", "o11", "o12"])
    assert got["o1"] == 19.98 and got["o4"] == 60.00 and got["o12"] == 120.00
    assert tx.schema["line_revenue"].dataType.simpleString() == "double"


def test_clean_consumers(spark, scratch):
    got = dict(rows(fixture_lines(spark, scratch).consumers, "user_id", "persona"))
    assert got == {"u1": "fitness", "u3": "premium", "u4": "casual"}
    trend = dict(rows(fixture_lines(spark, scratch).consumers, "user_id", "trend_affinity"))
    assert trend["u1"] == "gut-health"


def test_clean_products(spark, scratch):
    got = rows(fixture_lines(spark, scratch).products.orderBy("product_id"),
               "product_id", "category", "ingredient_tags")
    assert got == [
        ("p1", "Protein Shake", "whey"),
        ("p2", "Protein Bar", "unlisted"),
        ("p3", "Unknown", "oats"),
        ("p4", "Snack", "nuts"),
        ("p5", "Unknown", "unlisted"),
    ]


def test_clean_geography(spark, scratch):
    got = rows(clean_geography(fixture_lines(spark, scratch).geography).orderBy("order_id"),
               "order_id", "city_tier")
    assert got == [("o1", "Tier 1"), ("o12", "Tier 2"), ("o4", "Tier 2")]


def test_competitor_summary(spark, scratch):
    got = rows(competitor_summary(fixture_lines(spark, scratch).competitors)
               .orderBy("competitor_product_id"),
               "competitor_product_id", "avg_price", "min_price", "max_price", "how_many_observations")
    assert got == [("k1", 15.0, 10.0, 20.0, 2), ("k2", 40.0, 40.0, 40.0, 1)]


def test_master(spark, scratch):
    m = fixture_lines(spark, scratch).master(*ALL_PARTS)
    assert len(m.columns) == 20
    got = {r["order_id"]: r for r in m.collect()}
    assert len(got) == 7
    for o in ("o3", "o4", "o11", "o12"):
        assert got[o]["persona"] is None
    assert got["o11"]["category"] is None  # no product match: NULL, not 'Unknown'
    assert got["o1"]["persona"] == "fitness" and got["o1"]["category"] == "Protein Shake"
    assert got["o2"]["city_tier"] == "Unknown" and got["o5"]["state"] is None


def test_master_keeps_fanout_of_duplicate_keys(spark, scratch):
    geo = GEOGRAPHY + "o4,NJ,Tier 3,gym\n"
    lines = fixture_lines(spark, scratch, {"geography_occasion": geo})
    full = lines.master(*ALL_PARTS)
    assert full.count() == 8
    assert full.filter(F.col("order_id") == "o4").count() == 2
    # without the geography columns the duplicate still multiplies the lines
    assert lines.master().count() == 8
    assert lines.master("buyer").filter(F.col("order_id") == "o4").count() == 2
    assert rows(row_count(lines.master()), "rows") == [(8,)]
    dup = rows(join_key_audit(lines.consumers, lines.products, lines.geography),
               "dimension", "key", "copies")
    assert dup == [("geography_occasion", "o4", 2)]


def test_master_shuffle_path_equals_broadcast_path(spark, scratch):
    from bandwise.operators.master import build_master
    geo = GEOGRAPHY + "o4,NJ,Tier 3,gym\n"
    lines = fixture_lines(spark, scratch, {"geography_occasion": geo})
    args = (lines.transactions, lines.consumers, lines.products, lines.geography)
    for need in [ALL_PARTS, (), ("buyer",)]:
        small = build_master(*args, need=need)
        big = build_master(*args, need=need, max_rows=0)  # nothing may be broadcast
        assert sorted(map(tuple, small.collect()), key=repr) == sorted(map(tuple, big.collect()), key=repr)


def test_duplicate_keys(spark):
    df = spark.createDataFrame([(1,), (1,), (2,)], "k int")
    assert rows(duplicate_keys(df, ["k"]), "k", "copies") == [(1, 2)]


def test_quality_audit(spark, scratch):
    r = fixture_roles(spark, scratch)
    got = {(s, c): v for s, c, v in rows(
        quality_audit(r.transactions, r.consumers, r.products, r.geography, r.competitors),
        "source", "check_name", "value")}
    assert got[("transactions", "negative_prices")] == 1
    assert got[("transactions", "max_price")] == 225.01
    assert got[("consumer_insights", "blank_personas")] == 2
    assert got[("product_metadata", "category_typos")] == 2
    assert got[("product_metadata", "missing_categories")] == 2
    assert got[("geography_occasion", "unknown_tiers")] == 1
    assert got[("competitor_pricing", "null_competitor_prices")] == 1
    import numpy as np
    prices = [9.99, 10, 19.99, 20, 225, 225.01, -5, 0, 30, 15, 60]
    assert got[("transactions", "p99_price")] == round(float(np.percentile(prices, 99)), 2)


def test_null_dimension_keys_do_not_multiply_lines(spark, scratch):
    geo = GEOGRAPHY + ",XX,Tier 1,gym\n,YY,Tier 2,gym\n"  # two rows without an order id
    lines = fixture_lines(spark, scratch, {"geography_occasion": geo})
    assert lines.master().count() == 7
    assert lines.master(*ALL_PARTS).count() == 7
