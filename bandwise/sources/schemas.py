"""The five input roles and their declared column types."""

from __future__ import annotations

from pyspark.sql import types as T

S, D, I = T.StringType(), T.DoubleType(), T.IntegerType()


def _struct(*cols: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in cols])


TRANSACTIONS = _struct(
    ("order_id", S), ("user_id", S), ("product_id", S), ("price", D),
    ("quantity", D), ("timestamp", S), ("channel", S),
)
CONSUMERS = _struct(
    ("user_id", S), ("persona", S), ("trend_affinity", S), ("age_group", S),
    ("gender_identity", S), ("income_bracket", S), ("dietary_restriction", S),
)
PRODUCTS = _struct(
    ("product_id", S), ("category", S), ("claims", S), ("ingredient_tags", S),
    ("pack_size", S),
)
GEOGRAPHY = _struct(("order_id", S), ("state", S), ("city_tier", S), ("occasion", S))
COMPETITORS = _struct(("competitor_product_id", S), ("price", D), ("timestamp", S))

ROLE_SCHEMAS = {
    "transactions": TRANSACTIONS,
    "consumer_insights": CONSUMERS,
    "product_metadata": PRODUCTS,
    "geography_occasion": GEOGRAPHY,
    "competitor_pricing": COMPETITORS,
}

# Columns the reference coerces to numbers while loading; everything else is text.
NUMERIC_COLUMNS = {
    "transactions": ("price", "quantity"),
    "competitor_pricing": ("price",),
}

# Columns of the wide order-line table, in order: order part, buyer part,
# product part, geography part.
MASTER_COLUMNS = (
    "order_id", "user_id", "product_id", "price", "quantity", "line_revenue",
    "channel", "timestamp",
    "persona", "trend_affinity", "age_group", "income_bracket", "dietary_restriction",
    "category", "claims", "ingredient_tags", "pack_size",
    "state", "city_tier", "occasion",
)
CONSUMER_PART = ("persona", "trend_affinity", "age_group", "income_bracket", "dietary_restriction")
PRODUCT_PART = ("category", "claims", "ingredient_tags", "pack_size")
GEOGRAPHY_PART = ("state", "city_tier", "occasion")
