"""Data-quality audit of the raw roles (W08) and duplicate join keys (W10)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bandwise.functions.money import money_round
from bandwise.functions.text import is_blank
from bandwise.operators.cleaning import CATEGORY_CORRECTIONS, UNKNOWN_TIER
from bandwise.operators.quantile import percentile_with


def _long(df: DataFrame, source: str, checks: Mapping[str, Column]) -> DataFrame:
    """One aggregate pass over ``df``, returned as (source, check_name, value) rows."""
    wide = df.agg(*[c.cast("double").alias(name) for name, c in checks.items()])
    pairs = ", ".join(f"'{name}', `{name}`" for name in checks)
    return wide.selectExpr(f"stack({len(checks)}, {pairs}) AS (check_name, value)").select(
        F.lit(source).alias("source"), "check_name", "value")


def quality_audit(transactions: DataFrame, consumers: DataFrame, products: DataFrame,
                  geography: DataFrame, competitors: DataFrame, q: float = 0.99,
                  corrections: Mapping[str, str] = CATEGORY_CORRECTIONS,
                  unknown_tier: str = UNKNOWN_TIER) -> DataFrame:
    """The defect counts reported before cleaning, one row per check.

    Every table is read once for its counts, the order lines once more for the
    exact (interpolated) price percentile (``operators.quantile``).
    """
    price = F.col("price")
    name = f"p{round(q * 100):d}_price"
    tx = percentile_with(transactions, "price", q, {"negative": F.count_if(price < 0), "highest": F.max(price)})
    tx = tx.select(
        F.lit("transactions").alias("source"),
        F.expr(f"stack(3, 'negative_prices', CAST(negative AS DOUBLE), 'max_price', CAST(highest AS DOUBLE), "
               f"'{name}', value) AS (check_name, value)")).select(
        "source", "check_name",
        F.when(F.col("check_name") == name, money_round("value")).otherwise(F.col("value")).alias("value"))
    cons = _long(consumers, "consumer_insights", {"blank_personas": F.count_if(is_blank("persona"))})
    prods = _long(products, "product_metadata", {
        "category_typos": F.count_if(F.trim("category").isin(*corrections)),
        "missing_categories": F.count_if(is_blank("category")),
    })
    geo = _long(geography, "geography_occasion", {
        "unknown_tiers": F.count_if(F.col("city_tier") == unknown_tier),
    })
    comp = _long(competitors, "competitor_pricing", {
        "null_competitor_prices": F.count_if(price.isNull()),
    })
    return tx.unionByName(cons).unionByName(prods).unionByName(geo).unionByName(comp)


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key values that occur more than once (they would multiply joined rows)."""
    return (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies"))
            .filter(F.col("copies") > 1))


def join_key_audit(consumers: DataFrame, products: DataFrame, geography: DataFrame) -> DataFrame:
    """Duplicate right-hand join keys of the master join, per dimension. A NULL
    key matches nothing, so it multiplies no row and is not reported."""
    parts = [("consumer_insights", consumers, "user_id"),
             ("product_metadata", products, "product_id"),
             ("geography_occasion", geography, "order_id")]
    out = None
    for name, df, key in parts:
        d = duplicate_keys(df.select(key).filter(F.col(key).isNotNull()), [key]).select(
            F.lit(name).alias("dimension"), F.col(key).cast("string").alias("key"), "copies")
        out = d if out is None else out.unionByName(d)
    return out
