"""Column-level helpers: money rounding, buckets, text and tag matching."""

from bandwise.functions.buckets import (
    INCOME_TIERS,
    LAUNCH_BANDS,
    NOTEBOOK_BUCKETS,
    NOTEBOOK_LAUNCH_BANDS,
    PRICE_BUCKETS,
    PRICE_EDGES,
    PRICE_WALL_BUCKETS,
    Buckets,
)
from bandwise.functions.money import (
    cent_sum,
    cents,
    money,
    high,
    low,
    mean,
    money_round,
    money_sum,
    from_parts,
    pct,
    price_parts,
    raw_pct,
    rows,
)
from bandwise.functions.text import (
    NA_TOKENS,
    blank_default,
    has_tag,
    is_blank,
    matched_tags,
    na_to_null,
)

__all__ = [
    "Buckets", "PRICE_EDGES", "PRICE_BUCKETS", "PRICE_WALL_BUCKETS", "NOTEBOOK_BUCKETS",
    "INCOME_TIERS", "LAUNCH_BANDS", "NOTEBOOK_LAUNCH_BANDS",
    "money", "cents", "cent_sum", "money_round", "money_sum", "mean", "low", "high", "rows",
    "price_parts", "from_parts", "pct", "raw_pct",
    "NA_TOKENS", "na_to_null", "is_blank", "blank_default", "has_tag", "matched_tags",
]
