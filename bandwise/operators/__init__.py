"""DataFrame -> DataFrame building blocks."""

from bandwise.operators.aggregates import lag_change, share_of_total
from bandwise.operators.audit import duplicate_keys, join_key_audit, quality_audit
from bandwise.operators.baseline import lift_vs_baseline, with_baseline
from bandwise.operators.benchmark import benchmark_gap, competitor_range
from bandwise.operators.cleaning import (
    clean_consumers,
    clean_geography,
    clean_products,
    clean_transactions,
    competitor_summary,
    known_tier,
)
from bandwise.operators.joins import bounded_broadcast, measure
from bandwise.operators.master import ALL_PARTS, build_master, keep_fanout, row_count
from bandwise.operators.quantile import exact_percentile
from bandwise.operators.ranking import best_band
from bandwise.operators.tags import (
    CLAIM_TAGS,
    PREMIUM_CLAIM_TAGS,
    claim_map,
    explode_weighted,
    finish_tags,
    merge_tag_partials,
    tag_explode,
    tag_partials,
    tag_weights,
)

__all__ = [
    "share_of_total", "lag_change",
    "quality_audit", "duplicate_keys", "join_key_audit",
    "with_baseline", "lift_vs_baseline", "benchmark_gap", "competitor_range",
    "clean_transactions", "clean_consumers", "clean_products", "clean_geography",
    "competitor_summary", "known_tier", "bounded_broadcast", "measure",
    "build_master", "keep_fanout", "row_count", "ALL_PARTS", "exact_percentile", "best_band",
    "CLAIM_TAGS", "PREMIUM_CLAIM_TAGS", "claim_map", "tag_explode", "tag_weights",
    "explode_weighted", "tag_partials", "merge_tag_partials", "finish_tags",
]
