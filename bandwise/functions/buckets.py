"""Ordered price buckets: an integer ordinal plus a display label.

Grouping happens on the small integer ordinal (cheap to hash and to sort);
the label is attached after aggregation. Intervals are half-open ``[lo, hi)``
as in a ``CASE WHEN price < hi`` chain, and anything that fails every test,
NULL included, lands in the last (open-ended) bucket, as the CASE ELSE arm.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Buckets:
    edges: tuple[float, ...]
    labels: tuple[str, ...]

    def __post_init__(self):
        if len(self.labels) != len(self.edges) + 1:
            raise ValueError("need exactly one more label than edges")
        if list(self.edges) != sorted(self.edges):
            raise ValueError("edges must be ascending")

    def ordinal(self, c: Column | str) -> Column:
        value = F.col(c) if isinstance(c, str) else c
        expr = None
        for i, edge in enumerate(self.edges):
            cond = value < F.lit(edge)
            expr = F.when(cond, F.lit(i)) if expr is None else expr.when(cond, F.lit(i))
        return expr.otherwise(F.lit(len(self.edges)))

    def label(self, ordinal: Column | str) -> Column:
        o = F.col(ordinal) if isinstance(ordinal, str) else ordinal
        return F.element_at(F.array(*[F.lit(x) for x in self.labels]), o + 1)

    def with_labels(self, labels: tuple[str, ...]) -> "Buckets":
        return Buckets(self.edges, tuple(labels))


# Bucket edges and labels exactly as the reference prints them.
# Ten-way price buckets of the sensitivity queries (en dash in the labels).
PRICE_EDGES = (10, 20, 30, 40, 50, 75, 100, 150, 200)
PRICE_BUCKETS = Buckets(PRICE_EDGES, (
    "01. Under $10", "02. $10–$19", "03. $20–$29", "04. $30–$39", "05. $40–$49",
    "06. $50–$74", "07. $75–$99", "08. $100–$149", "09. $150–$199", "10. $200+",
))
# Same buckets as labelled by the key-findings "price wall" query.
PRICE_WALL_BUCKETS = PRICE_BUCKETS.with_labels((
    "01. under $10", "02. $10–$19", "03. $20–$29", "04. $30–$39", "05. $40–$49",
    "06. $50–$74", "07. $75–$99", "08. $100–$149", "09. $150–$199", "10. $200+",
))
# Same buckets as labelled in the notebook (ASCII hyphen).
NOTEBOOK_BUCKETS = PRICE_BUCKETS.with_labels((
    "01. Under $10", "02. $10-$19", "03. $20-$29", "04. $30-$39", "05. $40-$49",
    "06. $50-$74", "07. $75-$99", "08. $100-$149", "09. $150-$199", "10. $200+",
))
# Three-way tiers of the income query.
INCOME_TIERS = Buckets((20, 50), (
    "budget range (under $20)", "mid range ($20–$49)", "premium range ($50+)",
))
# Three-way launch bands of the best-band query, and the notebook's wording.
LAUNCH_BANDS = Buckets((20, 50), ("under $20", "$20–$49", "$50 and above"))
NOTEBOOK_LAUNCH_BANDS = Buckets((20, 50), ("under $20", "$20-$49", "$50+"))
