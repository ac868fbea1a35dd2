"""Named views over one data set, for users who query with SQL.

``register_views`` exposes the raw roles, the cleaned roles and the order-line
master as session temp views under the names the reference's SQL uses, so a
report can be written as ``spark.sql(...)`` text and planned by Catalyst like
the DataFrame reports. Two dialect points carry over from SQLite: ``LIKE`` is
case-sensitive in Spark (use ``ILIKE``), and a column that is neither grouped
nor aggregated must be wrapped in an aggregate (``MAX(baseline)``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from bandwise.operators.cleaning import clean_geography, competitor_summary
from bandwise.operators.master import ALL_PARTS
from bandwise.plans.reports import OrderLines

RAW_NAMES = {
    "transactions": "transactions",
    "consumers": "consumer_insights",
    "products": "product_metadata",
    "geography": "geography_occasion",
    "competitors": "competitor_pricing",
}


def register_views(lines: OrderLines, prefix: str = "") -> dict[str, DataFrame]:
    """Create or replace the temp views; returns name -> DataFrame."""
    views: dict[str, DataFrame] = {}
    for attr, name in RAW_NAMES.items():
        views[name] = getattr(lines.raw, attr)
    views["clean_transactions"] = lines.transactions
    views["clean_consumer_insights"] = lines.consumers
    views["clean_product_metadata"] = lines.products
    views["clean_geography"] = clean_geography(lines.geography)
    views["clean_competitor_pricing"] = competitor_summary(lines.competitors)
    views["master_view"] = lines.master(*ALL_PARTS)
    for name, df in views.items():
        df.createOrReplaceTempView(prefix + name)
    return views
