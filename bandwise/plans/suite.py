"""All reports from one pass over the master, and from stored partials.

A run of every report would otherwise scan the master once per report. Here one
aggregation computes the mergeable partials (``operators.measures``) at four
*grains*, fine key sets that between them contain the key sets of all grouped
reports: each line is expanded into one copy per grain (not one per report) inside
its task, and partial aggregation collapses the copies before the only shuffle. The
report's key sets are then rolled up from the grains, which are as many rows as
there are key combinations, however many lines there were. A second aggregation
keeps, per claim tag and range of order ids, sums and a bitmap of the orders.

Both tables hold partials, so they can be kept: ``store_partials`` appends those of
one batch of order lines to a folder, and ``stored_lines`` serves every report from
the merged partials of all batches, without the lines.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bandwise.functions.buckets import INCOME_TIERS, LAUNCH_BANDS, PRICE_BUCKETS
from bandwise.operators.joins import bounded_broadcast
from bandwise.operators.master import ALL_PARTS
from bandwise.operators.measures import merged, partial
from bandwise.operators.tags import CLAIM_TAGS, explode_weighted, merge_tag_partials, tag_partials, tag_weights
from bandwise.plans.reports import Key, OrderLines, key_column, key_name
from bandwise.session import checkpoint_root

# Grain -> the key sets of Q01-Q07, Q09-Q20, Q22, Q23 and the notebook variants
# that are rolled up from it. The bucket columns of a grain are all functions of
# the price, so together they split it no finer than their joint edges.
SUITE_GRAINS: dict[tuple[Key, ...], tuple[tuple[Key, ...], ...]] = {
    ("persona", "channel", "income_bracket", "trend_affinity", PRICE_BUCKETS, INCOME_TIERS): (
        (PRICE_BUCKETS,),
        ("persona",),
        ("persona", PRICE_BUCKETS),
        ("persona", "channel"),
        ("income_bracket", INCOME_TIERS),
        ("persona", "income_bracket"),
        ("trend_affinity",),
    ),
    ("persona", "city_tier", "occasion", LAUNCH_BANDS): (
        ("city_tier",),
        ("occasion",),
        ("persona", "occasion"),
        ("city_tier", "persona"),
        ("persona", "city_tier", LAUNCH_BANDS),
    ),
    ("category", "pack_size"): (("category",), ("pack_size",)),
    ("state",): (("state",),),
}
SUITE_SETS = tuple(s for sets in SUITE_GRAINS.values() for s in sets)
SUITE_PARTIALS = ("_n", "_sc", "_sr", "_mn", "_mx", "_m2", "_rc", "_q", "_lt20", "_ge20")


def _names(keys: Sequence[Key]) -> list[str]:
    return list(dict.fromkeys(key_name(k) for k in keys))


def _grouping_id(names: Sequence[str], members: Sequence[str]) -> int:
    """grouping_id(): one bit per grouping column, most significant first,
    set when the column is not part of the set."""
    gid = 0
    for name in names:
        gid = (gid << 1) | (0 if name in members else 1)
    return gid


def _all_keys() -> list[Key]:
    keys = {key_name(k): k for grain in SUITE_GRAINS for k in grain}
    return list(keys.values())


def grain_partials(lines: OrderLines) -> DataFrame:
    """The partials of every grain: one scan of the master, one shuffle."""
    keys = _all_keys()
    names = [key_name(k) for k in keys]
    base = lines.master(*ALL_PARTS).select(*[key_column(k) for k in keys], "price", "quantity", "line_revenue")
    return base.groupingSets([_names(g) for g in SUITE_GRAINS], *names).agg(
        *[partial(p) for p in SUITE_PARTIALS], F.grouping_id().alias("_grain"))


def claim_partials(lines: OrderLines, tags: Sequence[str], match: str) -> DataFrame:
    """The partials of every claim tag (``operators.tags.tag_partials``)."""
    weights, _ = bounded_broadcast(tag_weights(lines.products, tags, match))
    rows = lines.master().select("order_id", "product_id", "price", "quantity", "line_revenue")
    return tag_partials(explode_weighted(rows.join(weights, "product_id")))


def store_partials(lines: OrderLines, path: str, tags: Sequence[str] = CLAIM_TAGS, match: str = "substring") -> None:
    """Append the partials of these order lines to ``path``. Each call adds one
    batch; calling it twice with the same lines counts them twice."""
    path = path.rstrip("/")
    grain_partials(lines).write.mode("append").parquet(f"{path}/grains")
    claim_partials(lines, tags, match).write.mode("append").parquet(f"{path}/tags")


def _roll_up(grains: DataFrame) -> tuple[DataFrame, dict[tuple[str, ...], int]]:
    """One row per key set and key combination, from (merged) grain partials."""
    names = [key_name(k) for k in _all_keys()]
    out, ids = None, {}
    for number, (grain, sets) in enumerate(SUITE_GRAINS.items()):
        own = _names(grain)
        rows = grains.filter(F.col("_grain") == _grouping_id(names, own)).select(*own, *SUITE_PARTIALS)
        offset = number << len(names)
        ids.update({tuple(_names(s)): offset + _grouping_id(own, _names(s)) for s in sets})
        rolled = rows.groupingSets([_names(s) for s in sets], *own).agg(
            *[merged(p) for p in SUITE_PARTIALS], (F.grouping_id() + F.lit(offset)).alias("_gid"))
        out = rolled if out is None else out.unionByName(rolled, allowMissingColumns=True)
    return out, ids


def serve(lines: OrderLines, spark: SparkSession, path: str, tags: Sequence[str], match: str) -> DataFrame:
    """Let ``lines`` finish its reports from the partials under ``path``."""
    path = path.rstrip("/")
    rolled, ids = _roll_up(spark.read.parquet(f"{path}/grains"))
    groups = f"{checkpoint_root(spark).rstrip('/')}/groups-{uuid.uuid4().hex}"
    rolled.write.parquet(groups)
    table = spark.read.parquet(groups)
    lines.use_groups(table, ids, SUITE_PARTIALS)
    lines.use_tags(merge_tag_partials(spark.read.parquet(f"{path}/tags")), tags, match)
    return table


def group_all(lines: OrderLines, path: str | None = None, tags: Sequence[str] = CLAIM_TAGS,
              match: str = "substring") -> DataFrame:
    """Compute and attach the partials of these lines; returns the rolled-up table."""
    spark = lines.transactions.sparkSession
    if path is None:
        path = f"{checkpoint_root(spark).rstrip('/')}/partials-{uuid.uuid4().hex}"
    store_partials(lines, path, tags, match)
    return serve(lines, spark, path, tags, match)


class StoredLines(OrderLines):
    """Reports over stored partials; there are no order lines to go back to."""

    def __init__(self, competitors: DataFrame | None = None):
        super().__init__(None)
        self._competitors = competitors

    @property
    def competitors(self) -> DataFrame:
        if self._competitors is None:
            raise ValueError("give the competitor prices to report the gap to them")
        return self._competitors

    def master(self, *parts: str) -> DataFrame:
        raise ValueError("the stored partials do not hold what this report asks for")


def stored_lines(spark: SparkSession, path: str, tags: Sequence[str] = CLAIM_TAGS, match: str = "substring",
                 competitors: DataFrame | None = None) -> StoredLines:
    """The reports over all batches that ``store_partials`` appended to ``path``."""
    lines = StoredLines(competitors)
    serve(lines, spark, path, tags, match)
    return lines
