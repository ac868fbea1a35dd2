"""Bind the driver's parquet tables to the five input roles.

Two bindings share the buyer, product, geography and competitor roles and
differ in where order lines come from; a third varies them all:

* ``a`` -- order lines from ``events`` (price = value, product = props.k)
* ``b`` -- order lines from ``lineitem`` joined to ``orders``
* ``c`` -- as ``b``, prices by product line, repeated and NULL dimension keys

Dirt (negative prices, blank or padded personas, category typos, missing
tiers, NULL competitor prices) is injected by key arithmetic, so every
cleaning rule has rows to act on and any engine sees the same rows. Keys keep
their source type (bigint): joins hash and compare 8-byte keys, and the
order-key join in binding ``b`` keeps the partitioning of the lineitem/orders
join. Only the needed columns are selected, so each scan reads just those.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bandwise.functions.money import money_sql
from bandwise.functions.text import NA_TOKENS
from bandwise.operators.joins import bounded_broadcast

# Fixed values of the bindings (test-data conventions, not reference data).
CLAIM_TAGS_ALL = ("red", "blue", "hot", "cold", "widget", "gear", "bolt", "plate",
                  "ring", "old", "new")
CLAIM_TAGS_PREMIUM = ("red", "blue", "hot", "cold", "widget", "gear")
AGE_GROUPS = ("18-24", "25-34", "35-44", "45-54", "55+")
GENDERS = ("female", "male", "non-binary")
DIETS = ("none", "vegetarian", "NA", "vegan", "None", "halal")


class Roles:
    """The five role tables of one data set. Each is given as a DataFrame or
    as a zero-argument builder that is called on first use, so a report plans
    only the roles it reads."""

    _NAMES = ("transactions", "consumers", "products", "geography", "competitors")

    def __init__(self, **roles):
        missing = set(Roles._NAMES) - set(roles)
        if missing:
            raise ValueError(f"missing roles {sorted(missing)}")
        self._builders = roles
        self._built: dict[str, DataFrame] = {}
        # stored key proofs by attribute group (``sources.proofs``)
        self.proofs: dict = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name not in Roles._NAMES:
            raise AttributeError(name)
        if name not in self._built:
            role = self._builders[name]
            self._built[name] = role if isinstance(role, DataFrame) else role()
        return self._built[name]

    def replaced(self, **roles) -> "Roles":
        """These roles with some given anew; proofs of the others stay."""
        out = Roles(**{**self._builders, **roles})
        out.proofs = {part: p for part, p in self.proofs.items() if _ROLE_OF_PART[part] not in roles}
        return out


_ROLE_OF_PART = {"buyer": "consumers", "product": "products", "geo": "geography"}


# Columns each binding reads, with their types as written in the test tables.
# Declaring them skips footer-based schema inference on every open (costly
# over many files) and makes the projection explicit.
TABLE_COLUMNS = {
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
              "value double, props string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_quantity double, "
                "l_extendedprice double, l_shipdate timestamp_ntz",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_orderpriority string",
    "customer": "c_custkey bigint, c_nationkey int, c_acctbal double, c_mktsegment string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int",
    "nation": "n_nationkey int, n_name string",
}


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    if name in TABLE_COLUMNS:
        return spark.read.schema(TABLE_COLUMNS[name]).parquet(path)
    return spark.read.parquet(path)


def _sql_list(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def _pick(values: tuple[str, ...], key: str) -> str:
    """SQL: the value at position key mod len(values)."""
    return f"element_at(array({_sql_list(values)}), CAST({key} % {len(values)} AS INT) + 1)"


def unit_price(extended: str = "l_extendedprice", quantity: str = "l_quantity") -> Column:
    """Per-unit price scaled into the consumer range: ext / qty / 50, in cents."""
    return money_sql(f"try_divide(try_divide({extended}, {quantity}), 50.0)")


def _refund(key: str) -> Column:
    """-1 for every forty-seventh key, else 1. A factor, so that the price is not
    written out once for either sign."""
    return F.when(F.col(key) % 47 == 0, -1.0).otherwise(1.0)


def transactions_a(spark: SparkSession, sf_dir: str, reader=None) -> DataFrame:
    read = reader or _read
    return read(spark, sf_dir, "events").selectExpr(
        "event_id AS order_id",
        "user_id",
        "try_cast(get_json_object(props, '$.k') AS BIGINT) AS product_id",
        "CASE WHEN event_id % 47 = 0 THEN -value ELSE value END AS price",
        "CAST(1 + event_id % 5 AS INT) AS quantity",
        "CAST(ts AS STRING) AS `timestamp`",
        "event_type AS channel",
    )


def transactions_b(spark: SparkSession, sf_dir: str, reader=None) -> DataFrame:
    read = reader or _read
    li = read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_shipdate")
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    # orders joins lineitem 1:n; broadcast only when measured small enough,
    # otherwise both sides shuffle on the order key (which the order-grain
    # geography join of the master then reuses)
    orders, _ = bounded_broadcast(orders)
    lines = li.join(orders, li.l_orderkey == orders.o_orderkey, "inner")
    up = unit_price()
    return lines.select(
        F.col("l_orderkey").alias("order_id"),
        F.col("o_custkey").alias("user_id"),
        F.col("l_partkey").alias("product_id"),
        (up * _refund("l_orderkey")).alias("price"),
        F.col("l_quantity").cast("int").alias("quantity"),
        F.col("l_shipdate").cast("string").alias("timestamp"),
        F.col("o_orderpriority").alias("channel"),
    )


def consumers(spark: SparkSession, sf_dir: str, reader=None) -> DataFrame:
    read = reader or _read
    diet = _pick(DIETS, "c_custkey")
    return read(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS user_id",
        "CASE WHEN c_custkey % 19 = 0 THEN NULL"
        " WHEN c_custkey % 18 = 0 THEN '  '"
        " WHEN c_custkey % 7 = 0 THEN concat(' ', c_mktsegment, ' ')"
        " ELSE c_mktsegment END AS persona",
        "concat('trend_', CAST(c_nationkey % 5 AS STRING)) AS trend_affinity",
        f"{_pick(AGE_GROUPS, 'c_custkey')} AS age_group",
        f"{_pick(GENDERS, 'c_custkey')} AS gender_identity",
        "CASE WHEN c_acctbal < 2000 THEN 'low' WHEN c_acctbal < 6000 THEN 'middle'"
        " ELSE 'high' END AS income_bracket",
        f"CASE WHEN {diet} IN ({_sql_list(NA_TOKENS)}) THEN NULL ELSE {diet} END"
        " AS dietary_restriction",
    )


def products(spark: SparkSession, sf_dir: str, reader=None) -> DataFrame:
    read = reader or _read
    return read(spark, sf_dir, "part").selectExpr(
        "p_partkey AS product_id",
        "CASE WHEN p_partkey % 23 = 0 THEN NULL"
        " WHEN p_partkey % 29 = 0 THEN ''"
        " WHEN p_partkey % 11 = 0 THEN 'Proten Shake'"
        " WHEN p_partkey % 13 = 0 THEN 'Protein bar '"
        " ELSE p_type END AS category",
        "CASE WHEN p_partkey % 31 = 0 THEN NULL WHEN p_partkey % 3 = 0 THEN upper(p_name)"
        " ELSE p_name END AS claims",
        "CASE WHEN p_partkey % 9 = 0 THEN ' ' ELSE p_brand END AS ingredient_tags",
        "CASE WHEN p_size <= 10 THEN 'single' WHEN p_size <= 30 THEN '4-pack'"
        " ELSE '12-pack' END AS pack_size",
    )


def geography(spark: SparkSession, sf_dir: str, reader=None) -> DataFrame:
    read = reader or _read
    orders = read(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    cust = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = read(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    cust, _ = bounded_broadcast(cust)
    located = (
        orders.join(cust, F.col("o_custkey") == F.col("c_custkey"), "left")
        # nation has 25 rows at every scale factor (fixed by the schema's
        # definition), so it is broadcast; customer grows with the data and is
        # broadcast only within the measured bound.
        .join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    )
    return located.selectExpr(
        # every twentieth order's key matches no order line
        "IF(o_orderkey % 20 = 3, -o_orderkey, o_orderkey) AS order_id",
        "n_name AS state",
        "CASE WHEN o_orderkey % 10 = 0 THEN 'Unknown'"
        " WHEN o_orderkey % 11 = 0 THEN NULL"
        " WHEN o_orderstatus = 'F' THEN 'Tier 1'"
        " WHEN o_orderstatus = 'O' THEN 'Tier 2'"
        " WHEN o_orderstatus = 'P' THEN 'Tier 3' END AS city_tier",
        "o_orderpriority AS occasion",
    )


def competitors(spark: SparkSession, sf_dir: str, reader=None) -> DataFrame:
    read = reader or _read
    li = read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    up = unit_price()
    return li.select(
        F.col("l_suppkey").alias("competitor_product_id"),
        F.when(F.col("l_orderkey") % 13 == 0, F.lit(None).cast("double")).otherwise(up).alias("price"),
        F.col("l_shipdate").cast("string").alias("timestamp"),
    )


# Binding c: the lines of b with prices spread over 40 product lines, so that cheap
# and dear categories, every competitor position and verdict and low-band winners
# occur; and dimensions with repeated and NULL join keys.

def transactions_c(spark: SparkSession, sf_dir: str, reader=None) -> DataFrame:
    read = reader or _read
    li = read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_shipdate")
    orders, _ = bounded_broadcast(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority"))
    lines = li.join(orders, li.l_orderkey == orders.o_orderkey, "inner")
    # product line 20 sells at the competitors' mean
    price = F.when(F.col("l_partkey") % 40 == 20, 60.0).otherwise(
        money_sql("try_divide(l_extendedprice, l_quantity) / 50.0D * (1 + l_partkey % 40) / 8.0D"))
    return lines.select(
        F.col("l_orderkey").alias("order_id"),
        F.col("o_custkey").alias("user_id"),
        F.col("l_partkey").alias("product_id"),
        (price * _refund("l_orderkey")).alias("price"),
        F.expr("CAST(l_quantity * IF(o_custkey % 2 = 0 AND l_partkey % 40 < 4, 60, 1) AS INT)").alias("quantity"),
        F.col("l_shipdate").cast("string").alias("timestamp"),
        F.col("o_orderpriority").alias("channel"),
    )


def _copies(key: str, twice: int, keyless: int) -> str:
    """SQL: 0 for every row; 1 more for a second row of the same key, 2 for one
    without a key."""
    return (f"explode(CASE WHEN {key} % {twice} = 0 THEN array(0, 1) WHEN {key} % {keyless} = 0 THEN array(0, 2)"
            f" ELSE array(0) END) AS copy")


def consumers_c(spark: SparkSession, sf_dir: str, reader=None) -> DataFrame:
    base = consumers(spark, sf_dir, reader)
    return base.selectExpr("*", _copies("user_id", 17, 23)).selectExpr(
        "IF(copy = 2, NULL, user_id) AS user_id",
        "concat(persona, ' ', CAST(user_id % 6 AS STRING), IF(copy = 1, ' again', '')) AS persona",
        *[c for c in base.columns if c not in ("user_id", "persona")])


def products_c(spark: SparkSession, sf_dir: str, reader=None) -> DataFrame:
    base = products(spark, sf_dir, reader)
    return base.selectExpr("*", _copies("product_id", 13, 31)).selectExpr(
        "IF(copy = 2, NULL, product_id) AS product_id",
        "IF(category IS NULL OR category LIKE 'Prot%', category, concat('Line ', CAST(product_id % 40 AS STRING))) AS category",
        "CASE WHEN copy = 1 THEN concat('gear, ', claims) WHEN product_id % 40 < 8 THEN 'Cold blue'"
        " WHEN product_id % 40 >= 32 THEN 'RED hot' ELSE claims END AS claims",
        "ingredient_tags", "pack_size")


def geography_c(spark: SparkSession, sf_dir: str, reader=None) -> DataFrame:
    base = geography(spark, sf_dir, reader)
    return base.selectExpr("*", _copies("order_id", 19, 29)).selectExpr(
        "IF(copy = 2, NULL, order_id) AS order_id", "state", "city_tier",
        "IF(copy = 1, 'festive', occasion) AS occasion")


def competitors_c(spark: SparkSession, sf_dir: str, reader=None) -> DataFrame:
    return competitors(spark, sf_dir, reader).selectExpr(
        "competitor_product_id", "IF(price IS NULL, NULL, IF(competitor_product_id % 2 = 0, 70.0D, 50.0D)) AS price",
        "`timestamp`")


BINDINGS = {
    "a": (transactions_a, consumers, products, geography, competitors),
    "b": (transactions_b, consumers, products, geography, competitors),
    "c": (transactions_c, consumers_c, products_c, geography_c, competitors_c),
}


class _Tables:
    """Parquet tables under one folder, each opened once."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self._open = spark, sf_dir, {}

    def __call__(self, spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
        if name not in self._open:
            self._open[name] = _read(spark, sf_dir, name)
        return self._open[name]


def bind(spark: SparkSession, sf_dir: str, binding: str = "a") -> Roles:
    """All five roles for one binding of the tables under ``sf_dir``."""
    tables = _Tables(spark, sf_dir)

    def lazy(fn):
        return lambda: fn(spark, sf_dir, reader=tables)

    tx, cons, prods, geo, comp = BINDINGS[binding]
    return Roles(
        transactions=lazy(tx),
        consumers=lazy(cons),
        products=lazy(prods),
        geography=lazy(geo),
        competitors=lazy(comp),
    )
