"""The report queries (Q01-Q23) and the notebook variants, as DataFrames.

Every report reads the order-line master of an ``OrderLines`` context and
names the attribute groups it reads (``buyer``, ``product``, ``geo``); the
master builder joins just those and keeps the others' row multiplicity
without shuffling the order lines for them. Grouped reports ask
``summarize`` for named measures over key columns; the partial aggregates
behind them come from one groupBy of the master, or -- after
``plans.suite.group_all`` -- from the suite's single GROUPING SETS pass.
Grouping is on small ordinals and low-cardinality attributes, with partial
aggregation before every shuffle; windows and final sorts run on grouped
rows only.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Sequence
from functools import cached_property
from typing import Union

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandwise.functions.buckets import (
    INCOME_TIERS,
    LAUNCH_BANDS,
    PRICE_BUCKETS,
    PRICE_WALL_BUCKETS,
    Buckets,
)
from bandwise.functions.money import from_parts, money_round, price_parts, rows
from bandwise.operators.aggregates import lag_change, share_of_total, threshold_names
from bandwise.operators.audit import join_key_audit, quality_audit
from bandwise.operators.baseline import (
    FINDINGS_VERDICTS,
    NOTEBOOK_VERDICTS,
    lift_vs_baseline,
    with_baseline,
)
from bandwise.operators.benchmark import benchmark_gap
from bandwise.operators.cleaning import (
    clean_consumers,
    clean_geography,
    clean_products,
    clean_transactions,
    competitor_summary,
    known_tier,
)
from bandwise.operators.joins import bounded_broadcast
from bandwise.operators.master import ALL_PARTS, build_master, row_count
from bandwise.operators.measures import finish, partial, partials_for
from bandwise.operators.ranking import best_band
from bandwise.operators.tags import (
    CLAIM_TAGS,
    PREMIUM_CLAIM_TAGS,
    explode_weighted,
    finish_tags,
    tag_partials,
    tag_weights,
)
from bandwise.session import checkpoint_root
from bandwise.sources.bindings import Roles
from bandwise.sources.csv import DIALECT, load_report, load_table, replace_table

P, Q, REV, OID = "price", "quantity", "line_revenue", "order_id"


Key = Union[str, Buckets]


def key_name(key: Key) -> str:
    """Column name of a grouping key: the column itself, or for price
    buckets an ordinal named after its edges (so two label sets over the
    same edges share one grouping)."""
    if isinstance(key, str):
        return key
    return "_o_" + "_".join(f"{e:g}".replace(".", "p").replace("-", "m") for e in key.edges)


def key_column(key: Key):
    return F.col(key) if isinstance(key, str) else key.ordinal(P).alias(key_name(key))


def _present(*cols: str):
    cond = None
    for c in cols:
        c_ok = F.col(c).isNotNull()
        cond = c_ok if cond is None else cond & c_ok
    return cond


class OrderLines:
    """Cleaned roles of one data set and the master built from them."""

    def __init__(self, roles: Roles):
        self.raw = roles
        self._table: DataFrame | None = None
        self._groups: DataFrame | None = None
        self._group_sets: dict[tuple[str, ...], int] = {}
        self._group_partials: frozenset[str] = frozenset()
        self._tags: tuple[DataFrame, frozenset[str], str] | None = None

    # each cleaned role is planned on first use, so a report plans only the
    # tables it reads
    @cached_property
    def transactions(self) -> DataFrame:
        return clean_transactions(self.raw.transactions)

    @cached_property
    def consumers(self) -> DataFrame:
        return clean_consumers(self.raw.consumers)

    @cached_property
    def products(self) -> DataFrame:
        return clean_products(self.raw.products)

    @property
    def geography(self) -> DataFrame:
        return self.raw.geography

    @property
    def competitors(self) -> DataFrame:
        return self.raw.competitors

    def master(self, *parts: str) -> DataFrame:
        """Master with the named attribute groups (all of them if materialised)."""
        if self._table is not None:
            return self._table
        return build_master(self.transactions, self.consumers, self.products, self.geography,
                            need=parts, proofs=self.raw.proofs)

    def use_groups(self, table: DataFrame, sets: dict[tuple[str, ...], int],
                   partials: Iterable[str]) -> None:
        """Serve grouped partials from a GROUPING SETS table (``plans.suite``)."""
        self._groups, self._group_sets = table, dict(sets)
        self._group_partials = frozenset(partials)

    def grouped(self, parts: Sequence[str], keys: Sequence[Key], partials: Sequence[str],
                where=None) -> DataFrame:
        """Partial aggregates per key combination: from the suite's grouping
        table when it holds this key set, else one groupBy over the master
        (with only the needed attribute groups joined). ``where`` may refer to
        string keys only, so filtering before or after grouping is the same."""
        names = tuple(key_name(k) for k in keys)
        if (self._groups is not None and names in self._group_sets
                and set(partials) <= self._group_partials):
            g = self._groups.filter(F.col("_gid") == self._group_sets[names]).select(*names, *partials)
            return g if where is None else g.filter(where)
        m = self.master(*parts)
        if where is not None:
            m = m.filter(where)
        return m.groupBy(*[key_column(k) for k in keys]).agg(*[partial(p) for p in partials])

    def use_tags(self, partials: DataFrame, tags: Iterable[str], match: str) -> None:
        """Serve tag figures from stored partials (``plans.suite``)."""
        self._tags = (partials, frozenset(tags), match)

    def has_tags(self, tags: Sequence[str], match: str) -> bool:
        return self._tags is not None and set(tags) <= self._tags[1] and match == self._tags[2]

    def tag_figures(self, tags: Sequence[str], match: str, total: bool = False) -> DataFrame:
        """Per claim tag its distinct orders and sums (``operators.tags``), from
        the suite's partials where they hold these tags, else from the master in
        one pass. With ``total`` also a row with a NULL tag over all lines."""
        if self.has_tags(tags, match):
            out = finish_tags(self._tags[0].filter(F.col("claim_tag").isin(*tags)))
            if total:
                every = self.grouped((), [PRICE_BUCKETS], ["_n", "_sc", "_sr"])
                out = out.unionByName(every.agg(*[F.sum(c).alias(c) for c in ("_n", "_sc", "_sr")]),
                                      allowMissingColumns=True)
            return out
        weights, _ = bounded_broadcast(tag_weights(self.products, tags, match))
        lines = self.master().select(OID, "product_id", P, Q, REV)
        joined = lines.join(weights, "product_id", "left" if total else "inner")
        return finish_tags(tag_partials(explode_weighted(joined, total)))

    def materialize(self, path: str | None = None) -> DataFrame:
        """Write the full master once as parquet in the shared checkpoint
        folder and let every later report read that table. This cuts the
        lineage (a lost executor re-reads files instead of re-running the
        joins) and runs the order-grain join once for all reports."""
        spark = self.transactions.sparkSession
        if path is None:
            path = f"{checkpoint_root(spark).rstrip('/')}/master-{uuid.uuid4().hex}"
        build_master(self.transactions, self.consumers, self.products, self.geography,
                     need=ALL_PARTS, proofs=self.raw.proofs).write.mode("overwrite").parquet(path)
        self._table = spark.read.parquet(path)
        return self._table


def summarize(lines: OrderLines, parts: Sequence[str], keys: Sequence[Key],
              measures: dict[str, str], where=None) -> DataFrame:
    """Keys plus the named measures (``operators.measures``) per key group."""
    g = lines.grouped(parts, keys, partials_for(measures.values()), where)
    return g.select(*[key_name(k) for k in keys], *finish(measures))


def _ordered(df: DataFrame, buckets: Buckets, label: str, cols: Sequence[str],
             lead: Sequence[str] = ()) -> DataFrame:
    """Attach the bucket label, project, and sort by (lead, bucket ordinal)."""
    b = key_name(buckets)
    out = df.select(*lead, buckets.label(b).alias(label), *cols, b)
    return out.orderBy(*lead, b).drop(b)


# ---------------------------------------------------------------- work list A

def csv_round_trip(lines: OrderLines, role: str = "transactions") -> DataFrame:
    """W01 on the given tables: the role is written as headed CSV text to the
    shared checkpoint folder and read back with the loader (all-text read,
    missing tokens, ``try_cast`` numbers), as the reference loads its CSVs."""
    spark = lines.raw.transactions.sparkSession
    path = f"{checkpoint_root(spark).rstrip('/')}/csv-{role}-{uuid.uuid4().hex}"
    lines.raw.transactions.write.options(**DIALECT).csv(path)
    return load_table(spark, path, role)


def hard_cells(df: DataFrame, key: str, numbers: Sequence[str] = ()) -> DataFrame:
    """The rows as CSV lines whose cells are hard to read, by key arithmetic: text
    with separators, quotes and line breaks, missing-value tokens, padded cells;
    numbers with suffixes, currency signs, exponents and blanks. Every cell is
    quoted here in plain string functions, not by the CSV writer."""
    cells = [F.col(key).cast("string")]
    for place, c in enumerate([*numbers, *[c for c in df.columns if c != key and c not in numbers]], 1):
        cell = F.coalesce(F.col(c).cast("string"), F.lit(""))
        m = F.pmod(F.col(key) + place, F.lit(7 if c in numbers else 9))
        if c in numbers:
            cell = (F.when(m == 0, F.concat(cell, F.lit("d"))).when(m == 1, F.concat(F.lit("$"), cell))
                    .when(m == 2, F.concat(F.lit(" "), cell, F.lit(" ")))
                    .when((m == 3) & (cell != "") & ~F.contains(cell, F.lit("E")), F.concat(cell, F.lit("e0")))
                    .when(m == 4, F.lit("NaN")).otherwise(cell))
        else:
            cell = (F.when(m == 0, F.concat(cell, F.lit(', "'), cell, F.lit('"')))
                    .when(m == 1, F.concat(cell, F.lit("\nmore"))).when(m == 2, F.lit("NA"))
                    .when(m == 3, F.concat(F.lit('"'), cell)).when(m == 4, F.concat(F.lit(" "), cell, F.lit(" ")))
                    .when(m == 5, F.lit("")).otherwise(cell))
        cells.append(F.concat(F.lit('"'), F.replace(cell, F.lit('"'), F.lit('""')), F.lit('"')))
    return df.select(F.concat_ws(",", *cells).alias("value"))


# role attribute -> (CSV role, key, number columns)
_CSV_ROLES = {
    "consumers": ("consumer_insights", "user_id", ()),
    "products": ("product_metadata", "product_id", ()),
    "geography": ("geography_occasion", "order_id", ()),
    "competitors": ("competitor_pricing", "competitor_product_id", ("price",)),
}


def csv_hard_load(lines: OrderLines, role: str) -> DataFrame:
    """W01 on a role whose CSV cells are hard to read (``hard_cells``)."""
    name, key, numbers = _CSV_ROLES[role]
    df: DataFrame = getattr(lines.raw, role)
    path = f"{checkpoint_root(df.sparkSession).rstrip('/')}/csv-{name}-{uuid.uuid4().hex}"
    hard_cells(df, key, numbers).write.text(path)
    return load_table(df.sparkSession, path, name, header=False)


def csv_load_report(lines: OrderLines, files: int = 16) -> DataFrame:
    """What the loader reports of product files in which rows lack cells, have
    too many, hold line breaks, or (the last of each file) never close a quote."""
    products = lines.raw.products
    spark = products.sparkSession
    path = f"{checkpoint_root(spark).rstrip('/')}/csv-report-{uuid.uuid4().hex}"
    file = F.pmod("product_id", F.lit(files)).alias("file")
    last = F.broadcast(products.groupBy(file).agg(F.max("product_id").alias("last")))  # one row per file
    quoted = [F.concat(F.lit('"'), F.coalesce(F.col(c), F.lit("")), F.lit('"')) for c in products.columns[1:]]
    key, kind = F.col("product_id").cast("string"), F.col("product_id") % 10
    whole = F.concat_ws(",", key, *quoted)
    line = (F.when(F.col("product_id") == F.col("last"), F.concat(key, F.lit(',"never closed')))
            .when(kind == 1, F.concat_ws(",", key, *quoted[:2]))
            .when(kind == 2, F.concat(whole, F.lit(",more,cells")))
            .when(kind == 3, F.concat_ws(",", key, F.lit('"two\nlines"'), *quoted[1:])).otherwise(whole))
    rows_of = products.select("*", file).join(last, "file")
    (rows_of.select("file", (F.col("product_id") == F.col("last")).alias("end"), line.alias("value"))
     .repartition(files, "file").sortWithinPartitions("file", "end").select("file", "value")
     .write.partitionBy("file").text(path))
    report = load_report(spark, f"{path}/file=*", "product_metadata", header=False)
    return report.groupBy("outcome").agg(F.sum("records").alias("records"), F.sum("lines").alias("lines"))


def table_replaced(lines: OrderLines) -> DataFrame:
    """The raw order lines kept as a table, then replaced by the cleaned ones,
    which are read from the table that they replace."""
    raw = lines.raw.transactions
    spark = raw.sparkSession
    table, folder = f"replaced_{uuid.uuid4().hex}", checkpoint_root(spark)
    replace_table(raw, table, folder)
    replace_table(clean_transactions(spark.table(table)), table, folder)
    files = spark.table(table).inputFiles()
    schema = spark.table(table).schema
    spark.sql(f"DROP TABLE {table}")  # its files stay
    return spark.read.schema(schema).parquet(*files)


def cleaned_transactions(lines: OrderLines) -> DataFrame:
    return lines.transactions


def cleaned_consumers(lines: OrderLines) -> DataFrame:
    return lines.consumers


def cleaned_products(lines: OrderLines) -> DataFrame:
    return lines.products


def cleaned_geography(lines: OrderLines) -> DataFrame:
    return clean_geography(lines.geography)


def competitor_prices(lines: OrderLines) -> DataFrame:
    return competitor_summary(lines.competitors)


def master_table(lines: OrderLines) -> DataFrame:
    return lines.master(*ALL_PARTS)


def master_row_count(lines: OrderLines) -> DataFrame:
    return row_count(lines.master())


def data_quality_audit(lines: OrderLines) -> DataFrame:
    r = lines.raw
    return quality_audit(r.transactions, r.consumers, r.products, r.geography, r.competitors)


def join_key_duplicates(lines: OrderLines) -> DataFrame:
    return join_key_audit(lines.consumers, lines.products, lines.geography)


# ---------------------------------------------------------- phase 1: buckets

def price_bucket_distribution(lines: OrderLines, buckets: Buckets = PRICE_BUCKETS,
                              notebook: bool = False) -> DataFrame:
    """Q01 (N1 with ``notebook=True``): orders, units, revenue, mean price and
    share of all orders per price bucket."""
    g = summarize(lines, (), [buckets], {"order_count": "count", "units_sold": "units",
                                        "total_revenue": "revenue", "avg_price": "mean_price"})
    g = share_of_total(g, "order_count", "pct_of_orders")
    cols = (["order_count", "pct_of_orders", "total_revenue"] if notebook else
            ["order_count", "units_sold", "total_revenue", "avg_price", "pct_of_orders"])
    return _ordered(g, buckets, "price_bucket", cols)


def bucket_counts(lines: OrderLines, buckets: Buckets) -> DataFrame:
    return summarize(lines, (), [buckets], {"order_count": "count"})


def demand_cliff(lines: OrderLines, buckets: Buckets = PRICE_BUCKETS, drop_pct: float = -20.0,
                 flag_text: str = "threshold here", with_prev: bool = True) -> DataFrame:
    """Q02 (N2 with notebook labels, no previous count, other flag text):
    change in orders against the previous non-empty bucket; flag a drop
    below ``drop_pct`` on the unrounded change; first bucket dropped."""
    g = lag_change(bucket_counts(lines, buckets), key_name(buckets), "order_count",
                   prev_col="prev_bucket_count" if with_prev else None,
                   flag_col="flag", drop_pct=drop_pct, flag_text=flag_text)
    cols = ["order_count"] + (["prev_bucket_count"] if with_prev else []) + ["pct_change", "flag"]
    return _ordered(g, buckets, "price_bucket", cols)


def price_wall(lines: OrderLines, buckets: Buckets = PRICE_WALL_BUCKETS,
               drop_pct: float = -20.0) -> DataFrame:
    """Q19: share of orders per bucket and a note where the *rounded* change
    against the previous bucket is below ``drop_pct``; first bucket kept."""
    g = share_of_total(bucket_counts(lines, buckets), "order_count", "pct_of_orders")
    g = lag_change(g, key_name(buckets), "order_count", prev_col=None, flag_col="note",
                   drop_pct=drop_pct, compare_rounded=True, keep_first=True,
                   flag_text="demand drops here")
    return _ordered(g, buckets, "price_bucket", ["order_count", "pct_of_orders", "note"])


def segment_bucket_share(lines: OrderLines, buckets: Buckets = PRICE_BUCKETS) -> DataFrame:
    """Q03: per persona and bucket, with the bucket's share within the persona."""
    g = summarize(lines, ("buyer",), ["persona", buckets],
                  {"order_count": "count", "avg_price_paid": "mean_price", "total_revenue": "revenue"},
                  where=_present("persona"))
    g = share_of_total(g, "order_count", "pct_within_persona", within=["persona"])
    return _ordered(g, buckets, "price_bucket",
                    ["order_count", "avg_price_paid", "total_revenue", "pct_within_persona"],
                    lead=["persona"])


def segment_price_summary(lines: OrderLines, notebook: bool = False) -> DataFrame:
    """Q04 (N3 with ``notebook=True``: no variance, count named ``orders``)."""
    measures = {("orders" if notebook else "total_orders"): "count", "min_price": "min_price",
                "avg_price": "mean_price", "max_price": "max_price", "total_revenue": "revenue"}
    if not notebook:
        measures["price_variance_pct"] = "variance_pct"
    out = summarize(lines, ("buyer",), ["persona"], measures, where=_present("persona"))
    if notebook:
        out = out.select("persona", "orders", "avg_price", "min_price", "max_price", "total_revenue")
    return out.orderBy(F.desc("avg_price"), "persona")


def price_threshold_split(lines: OrderLines, threshold: float = 20) -> DataFrame:
    """Q05: orders below / at-or-above a price per persona."""
    under, plus, share = threshold_names(threshold)
    t = f"{threshold:g}"
    out = summarize(lines, ("buyer",), ["persona"],
                    {under: f"below_{t}", plus: f"at_or_above_{t}", "total_orders": "count",
                     share: f"share_at_or_above_{t}"}, where=_present("persona"))
    return out.orderBy(F.desc(share), "persona")


def segment_channel(lines: OrderLines) -> DataFrame:
    """Q06: persona x channel."""
    return summarize(lines, ("buyer",), ["persona", "channel"], {"order_count": "count", "avg_price": "mean_price", "total_revenue": "revenue"},
                     where=_present("persona", "channel")).orderBy(
        "persona", F.desc("avg_price"), "channel")


def income_price_tier(lines: OrderLines, tiers: Buckets = INCOME_TIERS) -> DataFrame:
    """Q07: income bracket x three price tiers."""
    g = summarize(lines, ("buyer",), ["income_bracket", tiers], {"order_count": "count", "avg_price": "mean_price", "total_revenue": "revenue"},
                  where=_present("income_bracket"))
    return _ordered(g, tiers, "price_tier", ["order_count", "avg_price", "total_revenue"],
                    lead=["income_bracket"])


# ------------------------------------------------------ phase 2: context cuts

def tag_performance(lines: OrderLines, tags: Sequence[str] = CLAIM_TAGS,
                    match: str = "substring") -> DataFrame:
    """Q08: distinct orders, mean price, revenue, mean units per claim tag. A
    line counts once per listing of its product that carries the tag."""
    out = lines.tag_figures(tags, match).select(
        "claim_tag",
        F.col("_orders").alias("order_count"),
        money_round(from_parts("_sc", "_sr") / F.col("_n")).alias("avg_price"),
        (F.col("_rc") / F.lit(100.0)).alias("total_revenue"),
        money_round(F.col("_q") / F.col("_n")).alias("avg_units_per_order"),
    )
    return out.orderBy(F.desc("avg_price"), "claim_tag")


def category_summary(lines: OrderLines) -> DataFrame:
    """Q09."""
    return summarize(
        lines, ("product",), ["category"],
        {"order_count": "count", "avg_price": "mean_price", "min_price": "min_price",
         "max_price": "max_price", "total_revenue": "revenue", "total_units": "units_total"},
        where=_present("category")).orderBy(F.desc("avg_price"), "category")


def pack_size_mix(lines: OrderLines) -> DataFrame:
    """Q10: share is of the rows with a pack size."""
    g = summarize(lines, ("product",), ["pack_size"],
                  {"order_count": "count", "avg_price_per_order": "mean_price",
                   "avg_units_ordered": "mean_units", "total_revenue": "revenue"},
                  where=_present("pack_size"))
    return share_of_total(g, "order_count", "pct_of_all_orders").orderBy(
        F.desc("avg_price_per_order"), "pack_size")


def state_top_price(lines: OrderLines, limit: int = 20) -> DataFrame:
    """Q11: the ``limit`` states with the highest mean price (ties by state)."""
    return summarize(lines, ("geo",), ["state"],
                     {"order_count": "count", "avg_price": "mean_price", "total_revenue": "revenue",
                      "total_units": "units_total"},
                     where=_present("state")).orderBy(F.desc("avg_price"), "state").limit(limit)


def city_tier_mix(lines: OrderLines) -> DataFrame:
    """Q12: known tiers; share is of the rows with a known tier."""
    g = summarize(lines, ("geo",), ["city_tier"],
                  {"order_count": "count", "avg_price": "mean_price", "total_revenue": "revenue",
                   "total_units": "units_total"}, where=known_tier())
    return share_of_total(g, "order_count", "pct_of_orders").orderBy(F.desc("avg_price"), "city_tier")


def occasion_summary(lines: OrderLines) -> DataFrame:
    """Q13."""
    return summarize(lines, ("geo",), ["occasion"],
                     {"order_count": "count", "avg_price": "mean_price", "total_revenue": "revenue",
                      "avg_units_per_order": "mean_units"},
                     where=_present("occasion")).orderBy(F.desc("avg_price"), "occasion")


def segment_occasion_top(lines: OrderLines, limit: int = 30) -> DataFrame:
    """Q14: top ``limit`` persona x occasion pairs by mean price."""
    return summarize(lines, ("buyer", "geo"), ["persona", "occasion"], {"order_count": "count", "avg_price": "mean_price", "total_revenue": "revenue"},
                     where=_present("persona", "occasion")).orderBy(
        F.desc("avg_price"), "persona", "occasion").limit(limit)


def tier_segment_yield(lines: OrderLines) -> DataFrame:
    """Q15: revenue per order by known tier x persona."""
    return summarize(lines, ("buyer", "geo"), ["city_tier", "persona"],
                     {"order_count": "count", "avg_price": "mean_price", "total_revenue": "revenue",
                      "revenue_per_order": "revenue_per_order"},
                     where=known_tier() & _present("persona")).orderBy(
        "city_tier", F.desc("revenue_per_order"), "persona")


def competitor_gap(lines: OrderLines) -> DataFrame:
    """Q16: category mean price against the competitor range."""
    ours = summarize(lines, ("product",), ["category"],
                     {"our_avg_price": "mean_price"},
                     where=_present("category"))
    out = benchmark_gap(ours, competitor_summary(lines.competitors))
    return out.orderBy(F.desc("gap_vs_competitor"), "category")


def affinity_summary(lines: OrderLines) -> DataFrame:
    """Q17."""
    return summarize(lines, ("buyer",), ["trend_affinity"],
                     {"order_count": "count", "avg_price": "mean_price", "total_revenue": "revenue",
                      "avg_basket_size": "mean_units"},
                     where=_present("trend_affinity")).orderBy(F.desc("avg_price"), "trend_affinity")


def launch_band(lines: OrderLines, bands: Buckets = LAUNCH_BANDS,
                label: str = "recommended_launch_range", count_name: str = "order_count") -> DataFrame:
    """Q18 (N8 with notebook bands / names): per persona and known tier, the
    price band with the highest revenue per order (exact ratio; ties to the
    lower band)."""
    g = summarize(lines, ("buyer", "geo"), ["persona", "city_tier", bands],
                  {count_name: "count", "_score": "raw_revenue_per_order"},
                  where=_present("persona") & known_tier())
    best = best_band(g, ["persona", "city_tier"], F.col("_score"), key_name(bands))
    return best.select(
        "persona", "city_tier", bands.label(key_name(bands)).alias(label), count_name,
        money_round("_score").alias("revenue_per_order"),
    ).orderBy("persona", "city_tier")


# ------------------------------------------------------------- key findings

def segment_income(lines: OrderLines) -> DataFrame:
    """Q20 (= N4)."""
    return summarize(lines, ("buyer",), ["persona", "income_bracket"],
                     {"orders": "count", "avg_price": "mean_price"},
                     where=_present("persona", "income_bracket")).orderBy(
        "persona", F.desc("avg_price"), "income_bracket")


def tag_premium(lines: OrderLines, tags: Sequence[str] = PREMIUM_CLAIM_TAGS,
                match: str = "substring") -> DataFrame:
    """Q21: mean price per claim tag against the overall mean.

    From the suite's tag partials where they are there. Else one pass over the
    order lines: they are reduced to (product, sums, count), each product row is
    repeated once per tag it carries plus once under a NULL tag, and one
    aggregation, weighted by the tag's listings, gives every tag's mean and --
    under the NULL tag -- the overall mean over all order lines (unknown products
    included). Only product-level rows are fanned out.
    """
    if lines.has_tags(tags, match):
        by_tag = lines.tag_figures(tags, match, total=True)
    else:
        whole, rest = price_parts(P)
        per_product = lines.master().groupBy("product_id").agg(
            F.sum(whole).alias("_sc"), F.sum(rest).alias("_sr"), rows().alias("_n"))
        weights, _ = bounded_broadcast(tag_weights(lines.products, tags, match))
        fanned = explode_weighted(per_product.join(weights, "product_id", "left"), total=True)
        by_tag = fanned.groupBy("claim_tag").agg(
            *[F.sum(F.col("copies") * F.col(c)).alias(c) for c in ("_sc", "_sr", "_n")])
    by_tag = with_baseline(by_tag, "_sc", "_sr", "_n", total_row=F.col("claim_tag").isNull())
    out = lift_vs_baseline(by_tag.filter(F.col("claim_tag").isNotNull()),
                           from_parts("_sc", "_sr") / F.col("_n"), F.col("_baseline"), labels=FINDINGS_VERDICTS)
    return out.select("claim_tag", "avg_price", "vs_overall_avg", "verdict").orderBy(
        F.desc("avg_price"), "claim_tag")


def tag_premium_orders(lines: OrderLines, tags: Sequence[str] = PREMIUM_CLAIM_TAGS,
                       match: str = "substring") -> DataFrame:
    """N5: Q21 plus distinct orders per tag, notebook verdict wording and
    ``vs_market_avg``. Distinct counting rules out the product-level
    pre-aggregation, so order lines are fanned out per tag, plus a NULL total
    row that counts no orders."""
    by_tag = lines.tag_figures(tags, match, total=True)
    by_tag = with_baseline(by_tag, "_sc", "_sr", "_n", total_row=F.col("claim_tag").isNull())
    out = lift_vs_baseline(by_tag.filter(F.col("claim_tag").isNotNull()),
                           from_parts("_sc", "_sr") / F.col("_n"), F.col("_baseline"),
                           diff_col="vs_market_avg", labels=NOTEBOOK_VERDICTS)
    return out.select("claim_tag", F.col("_orders").alias("orders"), "avg_price", "vs_market_avg", "verdict").orderBy(
        F.desc("avg_price"), "claim_tag")


def city_tier_yield(lines: OrderLines) -> DataFrame:
    """Q22 (= N6)."""
    return summarize(lines, ("geo",), ["city_tier"],
                     {"orders": "count", "avg_price": "mean_price", "total_revenue": "revenue",
                      "revenue_per_order": "revenue_per_order"},
                     where=known_tier()).orderBy(F.desc("revenue_per_order"), "city_tier")


def occasion_vs_baseline(lines: OrderLines) -> DataFrame:
    """Q23 (= N7): mean price per occasion against the overall mean of all
    order lines (NULL occasion included). One pass: per-occasion sums with
    the NULL group, baseline from those rows, then the NULL group dropped."""
    per = summarize(lines, ("geo",), ["occasion"], {"orders": "count", "_sc": "price_cents", "_sr": "price_rest"})
    per = with_baseline(per, "_sc", "_sr", "orders")
    raw = from_parts("_sc", "_sr") / F.col("orders")
    out = per.filter(_present("occasion")).select(
        "occasion", "orders", money_round(raw).alias("avg_price"),
        money_round(raw - F.col("_baseline")).alias("vs_overall_avg"))
    return out.orderBy(F.desc("avg_price"), "occasion")


