"""Column helpers: rounding, buckets, tag matching, missing-value tokens."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from bandwise.functions.buckets import PRICE_BUCKETS, Buckets
from bandwise.functions.money import cent_sum, money, money_round, money_sql, pct
from bandwise.functions.text import blank_default, has_tag, is_blank, matched_tags, na_to_null


def one(spark, expr, value=None, ddl="x double"):
    return spark.createDataFrame([(value,)], ddl).select(expr.alias("v")).first()["v"]


@pytest.mark.parametrize("x,want", [(10.005, 10.01), (1.005, 1.01), (-10.005, -10.01),
                                    (2.675, 2.68), (0.125, 0.13), (19.994999, 19.99)])
def test_money_round_half_away_from_zero(spark, x, want):
    assert one(spark, money_round(F.col("x")), x) == want


def test_pct_is_double_precision(spark):
    df = spark.createDataFrame([(1, 3)], "a long, b long")
    assert df.select(pct("a", "b").alias("p")).first()["p"] == 33.33


@pytest.mark.parametrize("price,label", [(9.99, "01. Under $10"), (10.0, "02. $10–$19"),
                                         (19.99, "02. $10–$19"), (20.0, "03. $20–$29"),
                                         (199.99, "09. $150–$199"), (200.0, "10. $200+"),
                                         (None, "10. $200+")])
def test_bucket_edges_are_half_open(spark, price, label):
    ordinal = PRICE_BUCKETS.ordinal(F.col("x"))
    assert one(spark, PRICE_BUCKETS.label(ordinal), price) == label


def test_buckets_validate():
    with pytest.raises(ValueError):
        Buckets((1, 2), ("a", "b"))
    with pytest.raises(ValueError):
        Buckets((2, 1), ("a", "b", "c"))


def test_tag_matching(spark):
    text = "High-Protein, keto-friendly, 50%_off"
    assert one(spark, has_tag(F.col("x"), "high-protein"), text, "x string")
    assert one(spark, has_tag(F.col("x"), "keto"), text, "x string")  # substring rule
    assert not one(spark, has_tag(F.col("x"), "keto", "token"), text, "x string")
    assert one(spark, has_tag(F.col("x"), "50%_off"), text, "x string")  # wildcards escaped
    assert not one(spark, has_tag(F.col("x"), "5_%"), text, "x string")
    assert one(spark, matched_tags(F.col("x"), ["vegan", "keto", "high-protein"]), text,
               "x string") == ["keto", "high-protein"]
    assert one(spark, matched_tags(F.col("x"), ["keto"]), None, "x string") == []


def test_text_helpers(spark):
    assert one(spark, na_to_null(F.col("x")), "NA", "x string") is None
    assert one(spark, na_to_null(F.col("x")), "None", "x string") is None
    assert one(spark, na_to_null(F.col("x")), "n.a.", "x string") == "n.a."
    assert one(spark, is_blank(F.col("x")), "   ", "x string")
    assert not one(spark, is_blank(F.col("x")), "\t", "x string")  # TRIM removes spaces only
    assert one(spark, blank_default(F.col("x"), "unlisted"), " ", "x string") == "unlisted"
    assert one(spark, blank_default(F.col("x"), "unlisted"), " oats ", "x string") == "oats"


def test_per_row_money_equals_decimal_rule(spark):
    import numpy as np
    rng = np.random.default_rng(5)
    vals = [float(v) for v in np.round(rng.uniform(-500, 500, 5000), 3)]
    vals += [float(v) for v in rng.uniform(0, 3e6, 2000)] + [1.005, 29.985, -0.005, 899999.995]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    diff = df.filter(money("x") != money_round("x")).count()
    assert diff == 0
    assert df.filter(money_sql("x") != money_round("x")).count() == 0
    assert df.filter(money_sql("x").isNull()).count() == 0


def test_cent_sum_is_exact(spark):
    df = spark.createDataFrame([(0.1,)] * 1000 + [(0.2,)] * 1000, "x double")
    assert df.agg(cent_sum("x").alias("c")).first()["c"] == 30000
