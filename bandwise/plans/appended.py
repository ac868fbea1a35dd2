"""Reports over order lines that arrive in batches (the reference's append-load,
then its reports), from stored partials instead of the lines."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandwise.plans import reports as r
from bandwise.plans.suite import store_partials, stored_lines
from bandwise.session import checkpoint_root
from bandwise.sources.bindings import CLAIM_TAGS_ALL


def _long(report: str, df: DataFrame, key1: str, key2: str | None, orders: str, price: str) -> DataFrame:
    return df.select(
        F.lit(report).alias("report"), F.col(key1).alias("key1"),
        (F.col(key2) if key2 else F.lit(None).cast("string")).alias("key2"),
        F.col(orders).alias("orders"), F.col(price).alias("avg_price"), "total_revenue")


def reports_after_append(lines: r.OrderLines, until: str = "1995-07-01") -> DataFrame:
    """Q01, Q03, Q04, Q06, Q07 and Q08 after two batches, the order lines before
    ``until`` and all others, have each been reduced to partials and appended."""
    transactions = lines.raw.transactions
    spark = transactions.sparkSession
    path = f"{checkpoint_root(spark).rstrip('/')}/stored-{uuid.uuid4().hex}"
    early = F.coalesce(F.col("timestamp") < until, F.lit(False))
    for batch in (transactions.filter(early), transactions.filter(~early)):
        store_partials(r.OrderLines(lines.raw.replaced(transactions=batch)), path, CLAIM_TAGS_ALL)
    after = stored_lines(spark, path, CLAIM_TAGS_ALL)
    parts = [
        _long("q01", r.price_bucket_distribution(after), "price_bucket", None, "order_count", "avg_price"),
        _long("q03", r.segment_bucket_share(after), "persona", "price_bucket", "order_count", "avg_price_paid"),
        _long("q04", r.segment_price_summary(after), "persona", None, "total_orders", "avg_price"),
        _long("q06", r.segment_channel(after), "persona", "channel", "order_count", "avg_price"),
        _long("q07", r.income_price_tier(after), "income_bracket", "price_tier", "order_count", "avg_price"),
        _long("q08", r.tag_performance(after, CLAIM_TAGS_ALL), "claim_tag", None, "order_count", "avg_price"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out
