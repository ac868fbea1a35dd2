"""Group means compared against an overall baseline mean."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bandwise.functions.money import from_parts, money_round

# The reference's verdict bounds and wording.
UPPER, LOWER = 1.15, 0.90
FINDINGS_VERDICTS = ("worth the premium claim", "not pulling its weight", "about average")
NOTEBOOK_VERDICTS = ("premium justified", "below market", "at market")


def with_baseline(grouped: DataFrame, whole: str, rest: str, count_col: str,
                  total_row: Column | None = None, out: str = "_baseline") -> DataFrame:
    """Attach ROUND(overall mean, 2) to every grouped row.

    Sums come in two whole parts (``functions.money.price_parts``). Either one
    row holds the overall sum and count (``total_row`` picks it), or the grouped
    rows together cover every input row (the NULL group included) and the overall
    mean is their summed sums over summed counts.
    The input is read once; the window runs over the grouped rows only (one
    per tag or occasion), never over raw rows.
    """
    w = Window.partitionBy()
    if total_row is None:
        overall = from_parts(F.sum(whole).over(w), F.sum(rest).over(w)) / F.sum(count_col).over(w)
    else:
        overall = F.max(F.when(total_row, from_parts(whole, rest) / F.col(count_col))).over(w)
    return grouped.withColumn(out, money_round(overall))


def lift_vs_baseline(df: DataFrame, raw_mean: Column, baseline: Column,
                     avg_col: str = "avg_price", diff_col: str = "vs_overall_avg",
                     verdict_col: str | None = "verdict",
                     labels: Sequence[str] = FINDINGS_VERDICTS,
                     upper: float = UPPER, lower: float = LOWER) -> DataFrame:
    """Rounded group mean, its rounded gap to the (already rounded) baseline,
    and a verdict on the unrounded mean against ``baseline * upper/lower``."""
    out = df.withColumn(avg_col, money_round(raw_mean)).withColumn(
        diff_col, money_round(raw_mean - baseline))
    if verdict_col:
        above, below, between = labels
        verdict = (F.when(raw_mean > baseline * F.lit(upper), F.lit(above))
                   .when(raw_mean < baseline * F.lit(lower), F.lit(below))
                   .otherwise(F.lit(between)))
        out = out.withColumn(verdict_col, verdict)
    return out
