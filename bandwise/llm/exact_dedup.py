"""Exact deduplication by a heavy-hitter split, in DataFrame functions alone.

1. Each text becomes (sha-256, byte length); the pairs are written once.
2. ``approx_top_k`` (a mergeable Misra-Gries summary: every task sends a summary
   of bounded size) finds the frequent digests. There are at most ``heavy`` of
   them, which bounds what is broadcast.
3. Their groups are counted exactly with map-side partial aggregation; the
   verified winners, at most ``heavy`` rows, are broadcast and joined map-side,
   so a text that fills a third of the table never meets in one task.
4. All other digests go through one ordinary shuffle. The summary's error bound
   says that none of them has more than rows / ``tracked`` copies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bandwise.llm import scratch

HEAVY = 1000
TRACKED = 16384


def dedup_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 heavy: int = HEAVY, tracked: int = TRACKED) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Equal texts are identical strings; null counts as empty. The largest id of a
    group stays (a null id only if all are null). Repeated rows count in
    ``group_size`` and share one decision: rows that repeat the winner's id and
    text are all marked kept. An empty table gives no rows; extra columns are
    not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = scratch.cut(
        docs.select(F.col(id_col).alias("doc_id"), F.sha2(text, 256).alias("sha"),
                    F.octet_length(text).cast("long").alias("len")), "digests")
    frequent = (
        keyed.agg(F.expr(f"approx_top_k(sha, {int(heavy)}, {int(tracked)})").alias("top"))
        .select(F.explode("top").alias("top")).where("top.count > 1")
        .select(F.col("top.item").alias("sha")))
    winners = (
        keyed.join(F.broadcast(frequent), "sha", "left_semi")
        .groupBy("sha", "len").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")))
    split = keyed.join(F.broadcast(scratch.cut(winners, "winners")), ["sha", "len"], "left")
    hot = split.where("group_size IS NOT NULL").select("doc_id", "sha", "keep_id", "group_size")
    same = Window.partitionBy("sha", "len")
    rest = (
        split.where("group_size IS NULL")
        .select("doc_id", "sha", F.max("doc_id").over(same).alias("keep_id"),
                F.count("*").over(same).alias("group_size")))
    return hot.unionAll(rest).select(
        "doc_id", "keep_id", "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("sha").alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                heavy: int = HEAVY, tracked: int = TRACKED) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one per text, also
    where the winning row is itself repeated."""
    losers = (
        dedup_groups(docs, id_col, text_col, heavy, tracked).where("group_size > 1")
        .groupBy("doc_id", "text_sha256", "kept").agg(F.count("*").alias("copies"))
        .select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha"),
                F.col("kept").alias("__kept")))
    rows = docs.select(F.struct("*").alias("__row"), F.col(id_col).alias("__id"),
                       F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("__sha"))
    same = Window.partitionBy("__id", "__sha").orderBy(F.lit(1))
    joined = rows.join(
        losers.select(F.col("__id").alias("__l"), F.col("__sha").alias("__s"), "__kept"),
        F.col("__id").eqNullSafe(F.col("__l")) & (F.col("__sha") == F.col("__s")), "left")
    return (joined.where(F.coalesce(F.col("__kept"), F.lit(True)))
            .withColumn("__n", F.when(F.col("__kept").isNotNull(), F.row_number().over(same)).otherwise(1))
            .where("__n = 1").select("__row.*"))
