"""The reference's append-load and bucket counts on Structured Streaming.

The reference is a batch analysis: it appends CSV rows into tables and
re-reads them for every report. Two of its steps carry over to a stream
without changing meaning:

* ``ingest_role``: the CSV append-load (W01) as a file-stream query -- each
  new CSV file in a landing folder is coerced exactly like the batch loader
  and appended to a parquet table, exactly once (the file-source offsets and
  the sink commit log live in the checkpoint folder that the caller names; it
  must be the same for every application that feeds the table, so a restarted
  query neither skips nor duplicates a file).
* ``bucket_counts``: running order count, units and revenue per price
  bucket over a stream of raw order lines, cleaned by the same stateless
  filter as the batch step. State is one row per bucket.

Shares, lag changes and baselines need a second aggregation over the first
and are computed by the batch reports on the ingested table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from bandwise.functions.buckets import PRICE_BUCKETS, Buckets
from bandwise.functions.money import money_sum, rows
from bandwise.operators.cleaning import clean_transactions
from bandwise.sources.csv import DIALECT, coerce, role_schema, text_schema


def read_role_stream(spark: SparkSession, landing: str, role: str,
                     max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming DataFrame of a role's CSV files arriving in ``landing``."""
    schema, numeric = role_schema(role, None, None)
    reader = spark.readStream.options(**DIALECT, multiLine=True).schema(text_schema(schema))
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return coerce(reader.csv(landing), schema, numeric)


def ingest_role(spark: SparkSession, landing: str, role: str, table: str,
                checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append every new CSV file of ``role`` in ``landing`` to the parquet
    ``table``; with ``once`` the query processes what is there and stops."""
    stream = read_role_stream(spark, landing, role)
    writer = (stream.writeStream.format("parquet")
              .option("checkpointLocation", checkpoint)
              .outputMode("append"))
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 minute")
    return writer.start(table)


def bucket_counts(transactions: DataFrame, buckets: Buckets = PRICE_BUCKETS) -> DataFrame:
    """Orders, units and revenue per price bucket of cleaned order lines
    (streaming or batch input; complete output mode when streaming)."""
    clean = clean_transactions(transactions)
    agg = clean.groupBy(buckets.ordinal("price").alias("_b")).agg(
        rows().alias("order_count"), F.sum("quantity").alias("units_sold"),
        money_sum("line_revenue").alias("total_revenue"))
    return agg.select(buckets.label("_b").alias("price_bucket"), "order_count", "units_sold",
                      "total_revenue", "_b")


def run_bucket_counts(spark: SparkSession, landing: str, name: str,
                      checkpoint: str) -> StreamingQuery:
    """Start the running bucket counts over CSV order lines in ``landing``,
    published as the in-memory table ``name`` (complete mode)."""
    counts = bucket_counts(read_role_stream(spark, landing, "transactions"))
    return (counts.writeStream.outputMode("complete").format("memory").queryName(name)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
