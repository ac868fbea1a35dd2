"""Session sizing helpers and the shared checkpoint folder."""

from __future__ import annotations

from bandwise.session import checkpoint_root, scale_settings
from bandwise.sources.tables import bucket_count


def test_scale_settings_grow_with_input():
    small, big = scale_settings(10), scale_settings(100 * 1024 ** 4)  # 100 TB
    assert small["spark.sql.shuffle.partitions"] == "200"
    assert int(big["spark.sql.shuffle.partitions"]) == 200_000  # capped; AQE coalesces
    assert int(scale_settings(1024 ** 4)["spark.sql.shuffle.partitions"]) == 4096
    assert big["spark.sql.files.maxPartitionBytes"] == str(256 * 1024 * 1024)


def test_bucket_count():
    assert bucket_count(1) == 8
    assert bucket_count(1024 ** 4) == 4096


def test_checkpoint_root_is_stable(spark):
    assert checkpoint_root(spark) == checkpoint_root(spark)
