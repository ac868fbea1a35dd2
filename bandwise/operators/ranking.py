"""Pick the best band per segment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best_band(grouped: DataFrame, keys: Sequence[str], score: Column, band_ord: str) -> DataFrame:
    """Keep, per ``keys``, the row with the highest ``score``; ties go to the
    lower band ordinal so the answer is deterministic.

    Runs on grouped rows (segments x bands); ``row_number() = 1`` is planned
    as a per-partition group limit before the window.
    """
    w = Window.partitionBy(*keys).orderBy(score.desc(), F.col(band_ord).asc())
    return grouped.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")
