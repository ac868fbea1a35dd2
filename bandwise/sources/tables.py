"""Keep the five roles as catalog tables, laid out for the order-grain join.

The only join that can be too large to broadcast is order lines ⋈ order
geography on ``order_id``. Storing both tables bucketed and sorted by
``order_id`` with the same bucket count lets every later report read them
already co-partitioned: the sort-merge join runs without shuffling either
side, report after report. The dimensions (buyers, products, competitor
prices) are plain tables; they are broadcast behind a measured bound or,
when large, joined on their own keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from bandwise.sources.bindings import Roles
from bandwise.sources.proofs import prove_key, stored_proof

ROLE_TABLES = {
    "transactions": "transactions",
    "consumers": "consumer_insights",
    "products": "product_metadata",
    "geography": "geography_occasion",
    "competitors": "competitor_pricing",
}
BUCKETED = {"transactions": "order_id", "geography": "order_id"}
# The keys on which the master joins each dimension, by its attribute group.
JOIN_KEYS = {"buyer": ("consumers", "user_id"), "product": ("products", "product_id"),
             "geo": ("geography", "order_id")}


def bucket_count(input_bytes: int, target_bytes: int = 256 * 1024 * 1024) -> int:
    """Buckets so that one bucket of order lines is about ``target_bytes``."""
    return max(8, -(-input_bytes // target_bytes))


def _name(prefix: str, role: str) -> str:
    return f"{prefix}{ROLE_TABLES[role]}"


def save_roles(roles: Roles, prefix: str = "", buckets: int = 64) -> dict[str, str]:
    """Write the roles as tables named ``prefix + role table``; returns
    role -> table name. Existing tables are replaced. Each dimension's key proof
    is taken and stored with its table (``sources.proofs``)."""
    names = {}
    for role in ROLE_TABLES:
        df: DataFrame = getattr(roles, role)
        writer = df.write.mode("overwrite").format("parquet")
        if role in BUCKETED:
            key = BUCKETED[role]
            writer = writer.bucketBy(buckets, key).sortBy(key)
        name = _name(prefix, role)
        writer.saveAsTable(name)
        names[role] = name
    for role, key in JOIN_KEYS.values():
        prove_key(roles.transactions.sparkSession, names[role], key)
    return names


def table_roles(spark: SparkSession, prefix: str = "") -> Roles:
    """Roles read from the tables written by ``save_roles``, with the key proofs
    that still hold."""
    roles = Roles(**{role: (lambda n=_name(prefix, role): spark.table(n)) for role in ROLE_TABLES})
    for part, (role, key) in JOIN_KEYS.items():
        proof = stored_proof(spark, _name(prefix, role), key)
        if proof is not None:
            roles.proofs[part] = proof
    return roles
