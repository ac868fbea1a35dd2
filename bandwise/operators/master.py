"""The order-line master table (W07) and its row count (W09).

Order lines are left-joined to buyers (user_id), products (product_id) and
order geography (order_id). Semantics follow a plain left join exactly: an
order line with no match is kept with NULL attributes, and a key that occurs
k times on the right multiplies the line k times.

Plan choices, made per dimension:

* needed columns -> left join; the right side is broadcast when its measured
  size is within the bound, otherwise both sides are shuffled on the key
  (sort-merge join; AQE splits a hot key on the order-line side).
* columns not needed by the report -> the join would only matter through its
  fan-out. The keys that occur more than once are found with one aggregate on
  the dimension; none -> the join is dropped (proven no-op); a bounded set ->
  broadcast and each matching line is repeated k times; otherwise the plain
  join on the key is kept. The order-line table is never shuffled for a
  dimension whose columns nobody reads.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandwise.operators.joins import Size, bounded_broadcast, limits, measure, measure_many
from bandwise.sources.schemas import CONSUMER_PART, GEOGRAPHY_PART, MASTER_COLUMNS, PRODUCT_PART

if TYPE_CHECKING:
    from bandwise.sources.proofs import KeyProof

PARTS = {
    "buyer": ("user_id", CONSUMER_PART),
    "product": ("product_id", PRODUCT_PART),
    "geo": ("order_id", GEOGRAPHY_PART),
}
ALL_PARTS = tuple(PARTS)
ORDER_PART = ("order_id", "user_id", "product_id", "price", "quantity", "line_revenue",
              "channel", "timestamp")


def repeated_keys(dim: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once on the right side, with their copies.
    NULL keys never match in a join, so they cannot multiply a line."""
    return (dim.filter(F.col(key).isNotNull()).groupBy(key)
            .agg(F.count(F.lit(1)).alias("_copies")).filter(F.col("_copies") > 1))


def keep_fanout(lines: DataFrame, dim: DataFrame, key: str,
                max_rows: int | None = None, max_bytes: int | None = None,
                size: Size | None = None) -> DataFrame:
    """``lines LEFT JOIN dim USING (key)`` projected back onto ``lines``.

    Equal rows to the join, without reading the dimension's attributes.
    ``size`` is the measured size of ``repeated_keys(dim, key)`` if known.
    """
    max_rows, max_bytes = limits(max_rows, max_bytes)
    repeated = repeated_keys(dim, key)
    size = size or measure(repeated)
    if size.rows == 0:
        return lines
    if size.fits(max_rows, max_bytes):
        tagged = lines.join(F.broadcast(repeated), key, "left")
        copies = F.explode(F.sequence(F.lit(1), F.coalesce(F.col("_copies"), F.lit(1))))
        return tagged.select(*lines.columns, copies.alias("_copy")).drop("_copy")
    return lines.join(dim.select(key), key, "left").select(*lines.columns)


def build_master(tx: DataFrame, consumers: DataFrame, products: DataFrame,
                 geography: DataFrame, need: Iterable[str] = ALL_PARTS,
                 max_rows: int | None = None,
                 max_bytes: int | None = None,
                 proofs: Mapping[str, "KeyProof"] | None = None) -> DataFrame:
    """Wide order-line table from cleaned order lines, cleaned buyers, cleaned
    products and raw order geography. ``need`` names the attribute groups the
    caller reads (``buyer``, ``product``, ``geo``); the others only keep their
    row multiplicity. The result has the order columns plus the needed groups,
    in the reference's column order.

    All three dimensions are measured in one job before planning the joins:
    the needed ones in full (broadcast or shuffle), the others by their
    repeated keys only (drop the join, broadcast the repeats, or join on key).
    A dimension that has a stored proof (``proofs``, by attribute group) is
    planned from it; if all have, no job runs here.
    """
    max_rows, max_bytes = limits(max_rows, max_bytes)
    need = set(need)
    unknown = need - set(PARTS)
    if unknown:
        raise ValueError(f"unknown master parts {sorted(unknown)}")
    dims = {"buyer": consumers, "product": products, "geo": geography}
    proofs = proofs or {}
    right, unproven, sizes = {}, {}, {}
    for part, (key, cols) in PARTS.items():
        dim, proof = dims[part], proofs.get(part)
        if part in need:
            right[part] = dim.select(key, *cols)
        if proof is not None and proof.key == key:
            sizes[part] = proof.size if part in need else proof.repeats
        else:
            unproven[part] = right[part] if part in need else repeated_keys(dim.select(key), key)
    sizes.update(measure_many(unproven))
    master = tx.select(*ORDER_PART)
    for part, (key, _cols) in PARTS.items():
        if part in need:
            side, _ = bounded_broadcast(right[part], max_rows, max_bytes, size=sizes[part])
            master = master.join(side, key, "left")
        else:
            master = keep_fanout(master, dims[part].select(key), key, max_rows, max_bytes,
                                 size=sizes[part])
    keep = [c for c in MASTER_COLUMNS if c in master.columns]
    return master.select(*keep)


def row_count(df: DataFrame) -> DataFrame:
    """COUNT(*) as a one-row DataFrame."""
    return df.agg(F.count(F.lit(1)).alias("rows"))
