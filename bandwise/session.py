"""Session settings and the shared checkpoint folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

# Runtime re-planning is what absorbs skew in the order-grain join and sizes the
# post-shuffle partitions; static auto-broadcast is turned off because it trusts
# file-size estimates, while every broadcast in this package is behind a
# measured bound (operators.joins). AQE may still turn a join into a broadcast,
# but only from sizes it has measured on the shuffle output.
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "32MB",
    "spark.sql.session.timeZone": "UTC",
}


def scale_settings(input_bytes: int, target_partition_bytes: int = 256 * 1024 * 1024) -> dict[str, str]:
    """Partition sizing for a run over ``input_bytes`` of (compressed) input.

    Initial shuffle partitions ~ input / target, at least 200: the first
    aggregation of order lines shuffles partial aggregates, the order-grain
    join shuffles roughly the input, and AQE coalesces small partitions back
    towards the advisory size, so erring high only costs scheduling while
    erring low spills. Scans split files into ``target`` sized tasks.
    """
    parts = max(200, min(200_000, -(-input_bytes // target_partition_bytes)))
    return {
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes // 2),
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(target_partition_bytes),
    }


def configure(spark: SparkSession, overrides: dict[str, str] | None = None,
              input_bytes: int | None = None) -> SparkSession:
    """Apply the package defaults to an existing session (cluster or local);
    with ``input_bytes``, also size partitions for that much input."""
    sized = scale_settings(input_bytes) if input_bytes else {}
    for key, value in {**_DEFAULTS, **sized, **(overrides or {})}.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app_name: str = "bandwise", conf: dict[str, str] | None = None) -> SparkSession:
    """Local session for tests and the bench; the UI server stays off."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "16g")
    )
    for key, value in {**_DEFAULTS, **(conf or {})}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for lineage cuts and materialised tables.

    The cluster names it in ``spark.checkpoint.dir``. Where that is unset, a
    local session gets a fresh scratch folder; on a cluster it is an error, since
    executors and driver would each write to a disk of their own.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="bandwise-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured
