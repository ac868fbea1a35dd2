"""Key proofs stored with a table: taken once at load, checked before use.

Whether a dimension's key repeats, and how large the dimension is, decides how the
master joins it. ``prove_key`` counts both with one aggregation when the table is
written and keeps the figures, with the state of the table's files, as a table
property. A report that finds the files unchanged plans from the figures and runs
no job of its own; a table whose files have been added, removed or rewritten has
no proof until it is proven again.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bandwise.operators.joins import Size, row_width

PROPERTY = "bandwise.key_proof"
# Cleaning may lengthen a row by a default or a corrected category.
_SLACK = 32


@dataclass(frozen=True)
class KeyProof:
    """Figures of a table: its rows and their bytes, how many values of ``key``
    (NULL aside) occur more than once, and the bytes of these with their counts."""

    key: str
    rows: int
    bytes: int
    repeated_keys: int
    repeated_bytes: int
    state: str

    @property
    def size(self) -> Size:
        """A bound on the size of any cleaned selection of the table."""
        return Size(self.rows, self.bytes + _SLACK * self.rows)

    @property
    def repeats(self) -> Size:
        """A bound on the size of the repeated keys with their counts."""
        return Size(self.repeated_keys, self.repeated_bytes)


def table_location(spark: SparkSession, table: str) -> str:
    rows = spark.sql(f"DESCRIBE TABLE EXTENDED {table}").filter("col_name = 'Location'").collect()
    return rows[0]["data_type"]


def file_state(spark: SparkSession, location: str) -> str:
    """A digest of the name, length and modification time of every data file
    in the folder, read from the file system's listing (no job)."""
    path = spark._jvm.org.apache.hadoop.fs.Path(location)
    listed = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    files = sorted(f"{s.getPath().getName()} {s.getLen()} {s.getModificationTime()}" for s in listed
                   if not s.getPath().getName().startswith(("_", ".")))
    return hashlib.sha256("\n".join(files).encode()).hexdigest()


def prove_key(spark: SparkSession, table: str, key: str) -> KeyProof:
    """Count the table's rows and repeated keys and store the proof with it."""
    state = file_state(spark, table_location(spark, table))
    df: DataFrame = spark.table(table)
    per_key = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum(row_width(df).cast("long")).alias("b"))
    again = F.col(key).isNotNull() & (F.col("n") > 1)
    row = per_key.agg(F.sum("n").alias("rows"), F.sum("b").alias("bytes"), F.count_if(again).alias("keys"),
                      F.sum(F.when(again, 24 + F.octet_length(F.col(key).cast("string")))).alias("key_bytes")).first()
    proof = KeyProof(key, *(int(row[c] or 0) for c in ("rows", "bytes", "keys", "key_bytes")), state)
    spark.sql(f"ALTER TABLE {table} SET TBLPROPERTIES ('{PROPERTY}' = '{json.dumps(asdict(proof))}')")
    return proof


def stored_proof(spark: SparkSession, table: str, key: str) -> KeyProof | None:
    """The table's proof for ``key``, if it has one and its files are as they were."""
    found = [r["value"] for r in spark.sql(f"SHOW TBLPROPERTIES {table}").collect() if r["key"] == PROPERTY]
    if not found:
        return None
    proof = KeyProof(**json.loads(found[0]))
    if proof.key != key or proof.state != file_state(spark, table_location(spark, table)):
        return None
    return proof
