"""Registry of the queries: one entry per operator / report and binding."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from bandwise.functions.buckets import NOTEBOOK_BUCKETS, NOTEBOOK_LAUNCH_BANDS
from bandwise.plans import appended, oracle
from bandwise.plans import reports as r
from bandwise.sources.bindings import CLAIM_TAGS_ALL, CLAIM_TAGS_PREMIUM, bind

BOTH = ("a", "b")
# with repeated and NULL dimension keys, all positions and verdicts (binding c)
THREE = ("a", "b", "c")


@dataclass(frozen=True)
class Entry:
    qid: str
    name: str
    build: Callable[[r.OrderLines], DataFrame]
    bindings: tuple[str, ...] = BOTH
    has_oracle: bool = True

    def key(self, binding: str) -> str:
        base = f"{self.qid}_{self.name}"
        return base if self.qid in SHARED_ROLES else f"{base}_{binding}"


# Steps that read only the roles both bindings share are registered once.
SHARED_ROLES = {"w03", "w04", "w05", "w06", "w11", "w12"}

ENTRIES: tuple[Entry, ...] = (
    Entry("w01", "csv_load_transactions", r.csv_round_trip),
    Entry("w02", "clean_transactions", r.cleaned_transactions),
    Entry("w03", "clean_consumers", r.cleaned_consumers, ("a",)),
    Entry("w04", "clean_products", r.cleaned_products, ("a",)),
    Entry("w05", "clean_geography", r.cleaned_geography, ("a",)),
    Entry("w06", "competitor_summary", r.competitor_prices, ("a",)),
    Entry("w07", "master", r.master_table, THREE),
    Entry("w08", "quality_audit", r.data_quality_audit),
    Entry("w09", "master_row_count", r.master_row_count, THREE),
    Entry("w10", "duplicate_keys", r.join_key_duplicates, THREE),
    Entry("w11", "csv_hard_consumers", partial(r.csv_hard_load, role="consumers"), ("a",)),
    Entry("w11", "csv_hard_products", partial(r.csv_hard_load, role="products"), ("a",)),
    Entry("w11", "csv_hard_geography", partial(r.csv_hard_load, role="geography"), ("a",)),
    Entry("w11", "csv_hard_competitors", partial(r.csv_hard_load, role="competitors"), ("a",)),
    Entry("w12", "load_report", r.csv_load_report, ("a",)),
    Entry("w13", "replace_table", r.table_replaced),
    Entry("w14", "reports_after_append", appended.reports_after_append, ("b", "c")),
    Entry("q01", "price_bucket_distribution", r.price_bucket_distribution),
    Entry("q02", "demand_cliff", r.demand_cliff),
    Entry("q03", "segment_bucket_share", r.segment_bucket_share),
    Entry("q04", "segment_price_summary", r.segment_price_summary),
    Entry("q05", "threshold_split", r.price_threshold_split),
    Entry("q06", "segment_channel", r.segment_channel),
    Entry("q07", "income_price_tier", r.income_price_tier),
    Entry("q08", "tag_performance", partial(r.tag_performance, tags=CLAIM_TAGS_ALL), THREE),
    Entry("q09", "category_summary", r.category_summary),
    Entry("q10", "pack_size_mix", r.pack_size_mix),
    Entry("q11", "state_top_price", r.state_top_price),
    Entry("q12", "city_tier_mix", r.city_tier_mix),
    Entry("q13", "occasion_summary", r.occasion_summary),
    Entry("q14", "segment_occasion_top", r.segment_occasion_top, THREE),
    Entry("q15", "tier_segment_yield", r.tier_segment_yield),
    Entry("q16", "competitor_gap", r.competitor_gap, THREE),
    Entry("q17", "affinity_summary", r.affinity_summary),
    Entry("q18", "best_band", r.launch_band, THREE),
    Entry("q19", "price_wall", r.price_wall),
    Entry("q20", "segment_income", r.segment_income),
    Entry("q21", "tag_premium", partial(r.tag_premium, tags=CLAIM_TAGS_PREMIUM), THREE),
    Entry("q22", "city_tier_yield", r.city_tier_yield),
    Entry("q23", "occasion_vs_baseline", r.occasion_vs_baseline),
    Entry("n1", "bucket_distribution_notebook",
          partial(r.price_bucket_distribution, buckets=NOTEBOOK_BUCKETS, notebook=True), ("a",)),
    Entry("n2", "demand_cliff_notebook",
          partial(r.demand_cliff, buckets=NOTEBOOK_BUCKETS, flag_text="demand drops here",
                  with_prev=False), ("a",)),
    Entry("n3", "persona_price_notebook", partial(r.segment_price_summary, notebook=True), ("a",)),
    Entry("n5", "claim_premium_notebook",
          partial(r.tag_premium_orders, tags=CLAIM_TAGS_PREMIUM), ("a", "c")),
    Entry("n8", "launch_range_notebook",
          partial(r.launch_band, bands=NOTEBOOK_LAUNCH_BANDS, label="recommended_range",
                  count_name="orders"), ("a", "c")),
)


def order_lines(spark: SparkSession, sf_dir: str, binding: str) -> r.OrderLines:
    return r.OrderLines(bind(spark, sf_dir, binding))


def _runner(entry: Entry, binding: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return entry.build(order_lines(spark, sf_dir, binding))
    run.__name__ = entry.key(binding)
    return run


def registry() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {e.key(b): _runner(e, b) for e in ENTRIES for b in e.bindings}


def oracle_registry() -> dict[str, str]:
    out = {}
    for e in ENTRIES:
        if not e.has_oracle:
            continue
        for b in e.bindings:
            out[e.key(b)] = oracle.sql_for(e.qid, e.name, b)
    return out


def entries_by_key() -> dict[str, tuple[Entry, str]]:
    return {e.key(b): (e, b) for e in ENTRIES for b in e.bindings}
