"""Cleaning steps for the five roles (W02-W06).

Each step is a pure DataFrame -> DataFrame function (the reference's views):
nothing is materialised, filters sit directly on the source columns so the
parquet reader receives them as pushed filters.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandwise.functions.money import high, low, mean, money_sql, rows
from bandwise.functions.text import blank_default, is_blank

# The reference's cleaning constants.
PRICE_FLOOR = 0
PRICE_CEILING = 225
CATEGORY_CORRECTIONS = {"Proten Shake": "Protein Shake", "Protein bar": "Protein Bar"}
CATEGORY_DEFAULT = "Unknown"
INGREDIENTS_DEFAULT = "unlisted"
UNKNOWN_TIER = "Unknown"


def clean_transactions(tx: DataFrame, floor: float = PRICE_FLOOR,
                       ceiling: float = PRICE_CEILING) -> DataFrame:
    """Keep floor < price <= ceiling and quantity > 0; add line_revenue.

    NULL price or quantity fails the comparison and is dropped. line_revenue
    is ROUND(price * quantity, 2), a whole number of cents; every later sum of
    revenue adds whole cents, so it is exact and independent of partition
    order.
    """
    price, qty = F.col("price"), F.col("quantity")
    kept = tx.filter((price > floor) & (price <= ceiling) & (qty > 0))
    return kept.select(
        "order_id", "user_id", "product_id", "price", "quantity", "timestamp", "channel",
        money_sql("price * quantity").alias("line_revenue"),
    )


def clean_consumers(consumers: DataFrame) -> DataFrame:
    """Drop buyers without a persona; trim persona and trend affinity."""
    return consumers.filter(~is_blank("persona")).select(
        "user_id",
        F.trim("persona").alias("persona"),
        F.trim("trend_affinity").alias("trend_affinity"),
        "age_group", "gender_identity", "income_bracket", "dietary_restriction",
    )


def clean_products(products: DataFrame,
                   corrections: Mapping[str, str] = CATEGORY_CORRECTIONS,
                   default: str = CATEGORY_DEFAULT,
                   tags_default: str = INGREDIENTS_DEFAULT) -> DataFrame:
    """Normalise category (blank -> default, typo map, trimmed) and default
    blank ingredient tags. No row is dropped."""
    trimmed = F.trim("category")
    category = F.when(is_blank("category"), F.lit(default))
    for wrong, right in corrections.items():
        category = category.when(trimmed == wrong, F.lit(right))
    category = category.otherwise(trimmed)
    return products.select(
        "product_id",
        category.alias("category"),
        "claims",
        blank_default("ingredient_tags", tags_default).alias("ingredient_tags"),
        "pack_size",
    )


def known_tier(column: str = "city_tier", unknown: str = UNKNOWN_TIER):
    """city_tier is present and not the 'Unknown' marker."""
    c = F.col(column)
    return c.isNotNull() & (c != unknown)


def clean_geography(geo: DataFrame, unknown: str = UNKNOWN_TIER) -> DataFrame:
    """Drop order geography rows whose tier is NULL or unknown."""
    return geo.filter(known_tier("city_tier", unknown)).select(
        "order_id", "state", "city_tier", "occasion")


def competitor_summary(comp: DataFrame) -> DataFrame:
    """Per competitor product: rounded mean / min / max over non-NULL prices
    and the number of observations. Partial aggregation runs map-side, so a
    product with most of the observations costs one row per task."""
    return (
        comp.filter(F.col("price").isNotNull())
        .groupBy("competitor_product_id")
        .agg(
            mean("price").alias("avg_price"),
            low("price").alias("min_price"),
            high("price").alias("max_price"),
            rows().alias("how_many_observations"),
        )
    )
