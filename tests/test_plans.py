"""Physical plan shape: pruning and pushdown reach the scan, unread
dimensions cost no join, broadcasts appear only within the measured bound."""

from __future__ import annotations

import contextlib
import io
import os
import re

import pytest
from conftest import SF001
from fixture_data import fixture_roles
from pyspark.sql import functions as F

from bandwise.operators import joins
from bandwise.operators.master import build_master
from bandwise.plans import reports as r
from bandwise.plans.catalog import order_lines
from bandwise.plans.reports import OrderLines
from bandwise.plans.suite import claim_partials, grain_partials
from bandwise.sources.bindings import Roles


def plan(df) -> str:
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", "10000")
    df.write.format("noop").mode("overwrite").save()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture()
def parquet_lines(spark, scratch):
    """Fixture roles written to parquet, so the order lines are a plain scan."""
    roles = fixture_roles(spark, scratch)
    paths = {}
    for name in ("transactions", "consumers", "products", "geography", "competitors"):
        path = os.path.join(scratch, f"{name}.parquet")
        getattr(roles, name).write.mode("overwrite").parquet(path)
        paths[name] = path
    return OrderLines(Roles(**{n: (lambda p=p: spark.read.parquet(p)) for n, p in paths.items()}))


def test_cleaning_filters_and_pruning_reach_the_scan(parquet_lines):
    text = plan(r.price_bucket_distribution(parquet_lines))
    scan = [line for line in text.splitlines() if "FileScan parquet" in line and "transactions" in line][0]
    assert "GreaterThan(price,0.0)" in scan and "LessThanOrEqual(price,225.0)" in scan
    assert "GreaterThan(quantity,0.0)" in scan
    read_schema = scan.split("ReadSchema: ")[1]
    assert "channel" not in read_schema and "timestamp" not in read_schema
    assert "user_id" not in read_schema


def test_unread_dimensions_cost_no_join_when_keys_are_unique(parquet_lines):
    text = plan(r.price_bucket_distribution(parquet_lines))
    assert "Join" not in text
    geo = plan(r.occasion_summary(parquet_lines))
    assert "BroadcastHashJoin" in geo and "geography.parquet" in geo
    assert "consumers.parquet" not in geo and "products.parquet" not in geo


def test_sort_merge_join_when_bound_forbids_broadcast(parquet_lines):
    lines = parquet_lines
    m = build_master(lines.transactions, lines.consumers, lines.products, lines.geography,
                     need=("geo",), max_rows=0)
    text = plan(m.groupBy("occasion").count())
    assert "SortMergeJoin" in text or "ShuffledHashJoin" in text


def test_tag_fanout_is_one_product_scan(parquet_lines):
    text = plan(r.tag_performance(parquet_lines))
    assert text.count("products.parquet") == 1  # one pass, not one scan per tag
    assert "Union" not in text


def test_broadcast_follows_the_selected_columns_not_the_file(spark, scratch):
    """A wide file whose selected columns are small is broadcast."""
    from bandwise.operators.joins import bounded_broadcast, measure
    path = os.path.join(scratch, "wide.parquet")
    spark.range(2000).selectExpr("id", "sha2(CAST(id AS STRING), 512) || uuid() AS filler").write.parquet(path)
    narrow = spark.read.parquet(path).select("id")
    assert measure(narrow).bytes == 2000 * 16
    assert os.path.getsize(next(f.path for f in os.scandir(path) if f.name.endswith(".parquet"))) > 40_000 / 8
    assert bounded_broadcast(narrow, max_bytes=40_000)[1]
    assert not bounded_broadcast(spark.read.parquet(path), max_bytes=40_000)[1]


def test_size_proofs_can_be_cleared(spark, parquet_lines):
    from bandwise.operators import joins
    joins.measure_many({"g": parquet_lines.geography})
    assert joins._PROOFS
    joins.clear_size_proofs()
    assert not joins._PROOFS


@pytest.mark.parametrize("binding", ["b", "c"])
def test_batches_are_reduced_by_compiled_code(spark, monkeypatch, binding):
    """No generated method of an appended batch passes the 8,000 bytes up to which
    the JVM compiles it, when no dimension can be broadcast."""
    monkeypatch.setattr(joins, "DEFAULT_MAX_ROWS", 0)
    monkeypatch.setattr(joins, "_PROOFS", type(joins._PROOFS)())
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        lines = order_lines(spark, SF001, binding)
        late = lines.raw.transactions.filter(~F.coalesce(F.col("timestamp") < "1995-07-01", F.lit(False)))
        batch = OrderLines(lines.raw.replaced(transactions=late))
        for partials in (grain_partials(batch), claim_partials(batch, ("red", "blue"), "substring")):
            text = io.StringIO()
            with contextlib.redirect_stdout(text):
                partials.explain("codegen")
            sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", text.getvalue())]
            assert sizes and max(sizes) <= 8000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
