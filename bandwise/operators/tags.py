"""Tag fan-out: which products carry which claim tags.

The reference builds the product -> tag relation as a UNION ALL of one
filtered product scan per tag. Here one pass over the products counts, per
product, the listings that carry each tag; order lines are joined to these
counts and figures are weighted by them: the same numbers, one scan instead of
one per tag, and no row per listing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bandwise.functions.money import cents, price_parts
from bandwise.functions.text import has_tag, matched_tags

# Claim tags the reference analyses, in its order.
CLAIM_TAGS = ("high-protein", "plant-based", "clean-label", "low-sugar", "vegan", "halal",
              "kosher", "keto", "nut-free", "jain-friendly", "gluten-free")
PREMIUM_CLAIM_TAGS = ("high-protein", "plant-based", "clean-label", "low-sugar", "vegan", "keto")


def tag_explode(df: DataFrame, text_col: str, tags: Sequence[str], match: str = "substring",
                out: str = "claim_tag") -> DataFrame:
    """One row per (input row, matched tag); rows matching no tag vanish."""
    return df.select(*df.columns, F.explode(matched_tags(text_col, tags, match)).alias(out))


def claim_map(products: DataFrame, tags: Sequence[str], match: str = "substring",
              id_col: str = "product_id", text_col: str = "claims") -> DataFrame:
    """(product_id, claim_tag) for every product row and tag it carries.

    A product listed twice appears twice, like the reference's per-tag scans.
    """
    return tag_explode(products.select(id_col, text_col), text_col, tags, match).select(
        id_col, "claim_tag")


def tag_weights(products: DataFrame, tags: Sequence[str], match: str = "substring",
                id_col: str = "product_id", text_col: str = "claims") -> DataFrame:
    """(product_id, tags): per product the tags it carries, each with the number
    of its listings that carry it (a product listed twice counts its lines twice).

    The counts are one aggregation with a map-side part, so a product listed a
    million times is one row per task, and no array is longer than ``tags``.
    Rows without an id match no order line and are left out.
    """
    counted = products.filter(F.col(id_col).isNotNull()).groupBy(id_col).agg(
        *[F.count_if(has_tag(text_col, t, match)).alias(f"_t{i}") for i, t in enumerate(tags)])
    entries = F.array(*[F.struct(F.lit(t).alias("claim_tag"), F.col(f"_t{i}").alias("copies"))
                        for i, t in enumerate(tags)])
    carried = F.filter(entries, lambda e: e["copies"] > 0)
    return counted.select(id_col, carried.alias("tags")).filter(F.size("tags") > 0)


def explode_weighted(df: DataFrame, total: bool = False, tags_col: str = "tags") -> DataFrame:
    """One row per tag of the row, with its ``copies``. With ``total`` also one
    row with a NULL tag for every input row: grouping by the tag then yields,
    under the NULL tag, the figures over all input rows in the same aggregation."""
    kind = "array<struct<claim_tag:string,copies:bigint>>"
    entries = F.col(tags_col).cast(kind)
    if total:
        marker = F.array(F.struct(F.lit(None).alias("claim_tag"), F.lit(1).alias("copies"))).cast(kind)
        entries = F.concat(marker, F.coalesce(entries, F.array().cast(kind)))
    keep = [c for c in df.columns if c != tags_col]
    return df.select(*keep, F.explode(entries).alias("_entry")).select(*keep, "_entry.claim_tag", "_entry.copies")


# How many orders a tag has is COUNT(DISTINCT order). For whole-number ids the
# distinct ids are kept as bitmaps, one of 32,768 bits per (tag, range of ids):
# exact, and mergeable by OR, so they are partials like sums and counts. Text ids
# keep one row per (tag, order).
_SUMS = {"_n": "copies", "_sc": "copies * _whole", "_sr": "copies * _rest", "_rc": "copies * _cents",
         "_q": "copies * quantity"}


def tag_partials(tagged: DataFrame, order_col: str = "order_id") -> DataFrame:
    """Mergeable figures per (claim_tag, ``_bucket``) of order lines that carry
    ``claim_tag`` and ``copies``; the NULL tag counts no orders."""
    whole, rest = price_parts("price")
    rows = tagged.select(
        "claim_tag", "copies", F.when(F.col("claim_tag").isNotNull(), F.col(order_col)).alias("_o"),
        whole.alias("_whole"), rest.alias("_rest"), cents("line_revenue").alias("_cents"), "quantity")
    sums = [F.sum(F.expr(e)).alias(name) for name, e in _SUMS.items()]
    if isinstance(rows.schema["_o"].dataType, T.IntegralType):
        return rows.groupBy("claim_tag", F.bitmap_bucket_number("_o").alias("_bucket")).agg(
            F.bitmap_construct_agg(F.bitmap_bit_position("_o")).alias("_orders"), *sums)
    return rows.groupBy("claim_tag", F.col("_o").alias("_bucket")).agg(*sums)


def merge_tag_partials(partials: DataFrame) -> DataFrame:
    """Partials of several batches as those of all their lines."""
    orders = [F.bitmap_or_agg("_orders").alias("_orders")] if "_orders" in partials.columns else []
    return partials.groupBy("claim_tag", "_bucket").agg(*orders, *[F.sum(c).alias(c) for c in _SUMS])


def finish_tags(partials: DataFrame) -> DataFrame:
    """Per claim_tag: its distinct orders (``_orders``) and sums."""
    if "_orders" in partials.columns:
        orders = F.sum(F.bitmap_count("_orders"))
    else:
        orders = F.count("_bucket")
    return partials.groupBy("claim_tag").agg(orders.alias("_orders"), *[F.sum(c).alias(c) for c in _SUMS])
