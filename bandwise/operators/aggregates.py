"""Shares of a total, adjacent-bucket change, threshold column names.

All of these aggregate first (partial aggregation map-side, so a hot group
costs one row per task) and only then apply windows, which therefore run on
one row per group, never on raw rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bandwise.functions.money import money_round, pct, raw_pct


def share_of_total(agg: DataFrame, count_col: str, out: str,
                   within: Sequence[str] | None = None) -> DataFrame:
    """ROUND(100 * n / SUM(n) OVER (PARTITION BY within), 2) over grouped rows.

    ``agg`` holds one row per group (a bucket, tier or pack size), so even the
    unpartitioned total gathers only that many rows in one task; the raw rows
    were reduced by the partial aggregation before any shuffle.
    """
    total = F.sum(count_col).over(Window.partitionBy(*(within or [])))
    return agg.withColumn(out, pct(count_col, total))


def lag_change(agg: DataFrame, order_col: str, value_col: str, change_col: str = "pct_change",
               prev_col: str | None = "prev_bucket_count", flag_col: str | None = "flag",
               drop_pct: float = -20.0, compare_rounded: bool = False, keep_first: bool = False,
               flag_text: str = "threshold here") -> DataFrame:
    """Percent change of ``value_col`` against the previous existing bucket.

    Runs on bucket-level aggregates (a handful of rows), ordered by the
    bucket ordinal; an empty bucket is simply absent, so "previous" is the
    previous non-empty one. The flag tests the unrounded change unless
    ``compare_rounded``. The first bucket (no previous) is dropped unless
    ``keep_first``; when kept its change is NULL and its flag ''.
    """
    prev = F.lag(value_col, 1).over(Window.orderBy(order_col))
    out = agg.withColumn("_prev", prev)
    raw = raw_pct(F.col(value_col) - F.col("_prev"), F.col("_prev"))
    out = out.withColumn(change_col, money_round(raw))
    if flag_col:
        test = F.col(change_col) if compare_rounded else raw
        out = out.withColumn(flag_col, F.when(test < drop_pct, F.lit(flag_text)).otherwise(F.lit("")))
    if not keep_first:
        out = out.filter(F.col("_prev").isNotNull())
    if prev_col:
        out = out.withColumnRenamed("_prev", prev_col)
    else:
        out = out.drop("_prev")
    return out


def threshold_names(threshold: float) -> tuple[str, str, str]:
    t = f"{threshold:g}"
    return f"orders_under_{t}", f"orders_{t}_plus", f"pct_at_{t}_or_above"
