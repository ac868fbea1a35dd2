"""Exact percentile by rank bracketing.

One pass takes the row count and two approximate quantiles, one safely below and
one safely above the wanted rank (the sketch's rank error is at most 1 / accuracy
of the rows, and the bracket leaves three times that on both sides; of fewer than
2 * accuracy rows, where two ranks are more than that, it is the whole range). A second pass
counts the rows below the bracket -- one row per task, they share a group -- and
groups the rows inside it by value, so a value that a third of the rows hold is
one row per task too. Only the distinct values inside, about 6 / accuracy of the
distinct ones, are sorted; running counts then name the values at the two ranks
around ``q * (n - 1)``, which are interpolated linearly (the ``quantile_cont``
definition). The sketch only decides how much is sorted: the counts prove that the
bracket holds both ranks, and the query fails rather than answer without them.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ACCURACY = 10_000


def percentile_with(df: DataFrame, col: str, q: float, extra: Mapping[str, Column] | None = None,
                    accuracy: int = ACCURACY) -> DataFrame:
    """One-row DataFrame: ``value``, the interpolated q-quantile of the non-NULL
    values of ``col`` (NULL when there are none), and the ``extra`` aggregates
    over all rows of ``df``, computed in the bracketing pass."""
    if not 0.0 <= q <= 1.0:
        raise ValueError("q must be within [0, 1]")
    extra = dict(extra or {})
    v = F.col(col).cast("double")
    ends = F.percentile_approx(v, [max(0.0, q - 3 / accuracy), min(1.0, q + 3 / accuracy)], accuracy)
    few = F.count(v) < 2 * accuracy
    # one struct, one scalar subquery: the bracketing pass runs once however
    # often its figures are used
    pass1 = df.agg(F.struct(F.count(v).alias("_n"), F.when(few, F.min(v)).otherwise(ends[0]).alias("_lo"),
                            F.when(few, F.max(v)).otherwise(ends[1]).alias("_hi"),
                            *[c.alias(name) for name, c in extra.items()]).alias("s")).scalar()
    lo, hi = pass1["_lo"], pass1["_hi"]
    upper = df.select(v.alias("v")).filter(F.col("v") <= hi)
    inside = upper.groupBy(F.when(F.col("v") >= lo, F.col("v")).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    upto = F.sum("c").over(Window.orderBy(F.asc_nulls_first("v")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = inside.withColumn("upto", upto)
    pos = (pass1["_n"] - F.lit(1)).cast("double") * F.lit(float(q))
    r0, r1 = F.floor(pos), F.ceil(pos)

    def at(rank: Column) -> Column:
        hit = F.col("v").isNotNull() & (F.col("upto") - F.col("c") <= rank) & (rank < F.col("upto"))
        return F.max(F.when(hit, F.col("v")))

    picked = ranked.agg(at(r0).alias("v0"), at(r1).alias("v1"))
    value = F.col("v0") + (F.col("v1") - F.col("v0")) * (pos - r0)
    missed = F.raise_error(F.lit("the bracket does not hold the rank"))
    return picked.select(
        F.when((pass1["_n"] > 0) & value.isNull(), missed.cast("double")).otherwise(value).alias("value"),
        *[pass1[name].alias(name) for name in extra])


def exact_percentile(df: DataFrame, col: str, q: float, accuracy: int = ACCURACY) -> DataFrame:
    """One-row DataFrame with column ``value``: the interpolated q-quantile of
    the non-NULL values of ``col`` (NULL when there are none)."""
    return percentile_with(df, col, q, accuracy=accuracy)
