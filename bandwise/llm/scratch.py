"""Written intermediate tables: lineage cuts that survive lost executors.

Everything goes below the shared folder that the cluster names in
``spark.checkpoint.dir``; nothing is kept on one machine's disk.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from bandwise.session import checkpoint_root

_RECORDS: list[list[str]] = []


@contextmanager
def recording() -> Iterator[list[str]]:
    """The folders that the code inside writes. Whoever has written out what that
    code returned, and only then, may ``delete`` them; nothing else does, so a
    result that is still lazy keeps the tables it reads."""
    made: list[str] = []
    _RECORDS.append(made)
    try:
        yield made
    finally:
        _RECORDS[:] = [m for m in _RECORDS if m is not made]


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{checkpoint_root(spark)}/llm-{name}-{uuid.uuid4().hex}"
    for made in _RECORDS:
        made.append(path)
    return path


def stage_path(spark: SparkSession, name: str) -> str:
    """A folder for a pipeline stage's result; it is not recorded."""
    return f"{checkpoint_root(spark)}/stage-{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut_bucketed(df: DataFrame, key: str, name: str) -> DataFrame:
    """Write ``df`` hashed by ``key`` into as many buckets as there are shuffle
    partitions, so that later groupings by ``key`` read it without a shuffle.

    The table is registered only until it has been resolved; its files stay.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path, table = new_path(spark, name), f"llm_{uuid.uuid4().hex}"
    (df.repartition(n, key).write.option("path", path).option("compression", "zstd")
       .bucketBy(n, key).saveAsTable(table))
    out = spark.table(table)
    spark.sql(f"DROP TABLE {table}")
    return out


def delete(spark: SparkSession, paths: list[str]) -> None:
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    paths.clear()
