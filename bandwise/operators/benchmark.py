"""Our category prices against the competitor price range."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandwise.functions.money import high, low, mean, money_round

# The reference's five positions, tested in this order.
POSITIONS = (
    "underpriced — room to raise",
    "overpriced — watch churn risk",
    "slightly below market",
    "slightly above market",
    "at market rate",
)


def competitor_range(summary: DataFrame) -> DataFrame:
    """One row: mean of the per-product rounded means, lowest min, highest max.

    Empty input gives one row of NULLs."""
    return summary.agg(
        mean("avg_price").alias("mid"),
        low("min_price").alias("lowest"),
        high("max_price").alias("highest"),
    )


def benchmark_gap(ours: DataFrame, summary: DataFrame, key: str = "category",
                  our_col: str = "our_avg_price") -> DataFrame:
    """Attach competitor_avg / floor / ceiling, the rounded gap and the
    position label. The competitor figures enter as scalar subqueries (one
    merged subquery), so no join with ``ours`` is needed. With no competitor
    data every comparison is NULL and the position is 'at market rate'."""
    rng = competitor_range(summary)
    mid, lowest, highest = (rng.select(c).scalar() for c in ("mid", "lowest", "highest"))
    ours_c = F.col(our_col)
    under, over, below, above, at = POSITIONS
    where = (F.when(ours_c < lowest, F.lit(under))
             .when(ours_c > highest, F.lit(over))
             .when(ours_c < mid, F.lit(below))
             .when(ours_c > mid, F.lit(above))
             .otherwise(F.lit(at)))
    return ours.select(
        key, our_col,
        mid.alias("competitor_avg"),
        lowest.alias("competitor_floor"),
        highest.alias("competitor_ceiling"),
        money_round(ours_c - mid).alias("gap_vs_competitor"),
        where.alias("where_we_sit"),
    )
