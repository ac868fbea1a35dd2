"""CSV ingest of a role table (W01): reading, a report of what was not sound,
appending and replacing tables."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bandwise.functions.text import NA_TOKENS, na_to_null
from bandwise.sources.schemas import NUMERIC_COLUMNS, ROLE_SCHEMAS


_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
# Quoted cells may hold separators, doubled quotes and line breaks.
DIALECT = {"header": True, "quote": '"', "escape": '"'}
CORRUPT, FILE = "_corrupt_record", "_file"


def text_schema(schema: T.StructType) -> T.StructType:
    """The same columns, all read as text."""
    return T.StructType([T.StructField(f.name, T.StringType(), True) for f in schema])


def coerce(raw: DataFrame, schema: T.StructType, numeric_cols: Sequence[str] = (),
           na_tokens: Sequence[str] = NA_TOKENS) -> DataFrame:
    """Text columns -> declared types, the way the reference's loader does it.

    Missing-value tokens become NULL; a numeric column keeps what is written as
    a plain decimal number (no type suffixes, no currency signs), so bad text
    becomes NULL instead of failing the job, and an integer column keeps a value
    only when it is whole. A pure projection, so it works on batch and streaming
    frames alike.
    """
    out = []
    for field in schema:
        text = na_to_null(F.col(field.name), na_tokens)
        if field.name in numeric_cols:
            number = F.expr(f"try_cast(`{field.name}` AS double)")
            number = F.when(text.isNotNull() & F.trim(F.col(field.name)).rlike(_NUMBER), number)
            if isinstance(field.dataType, (T.IntegerType, T.LongType)):
                number = F.when(number == F.floor(number), number.cast(field.dataType))
            col = number.cast(field.dataType)
        else:
            col = text.cast(field.dataType)
        out.append(col.alias(field.name))
    return raw.select(*out)


def role_schema(role: str | None, schema: T.StructType | None,
                numeric_cols: Sequence[str] | None) -> tuple[T.StructType, Sequence[str]]:
    if schema is None:
        if role is None:
            raise ValueError("give a role name or a schema")
        schema = ROLE_SCHEMAS[role]
    if numeric_cols is None:
        numeric_cols = NUMERIC_COLUMNS.get(role, ()) if role else ()
    return schema, numeric_cols


def _urls_to_paths(urls: Sequence[str]) -> list[str]:
    return [unquote(u) for u in urls]


def spanning_files(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """(file, lines, open_lines) of every CSV file: how many of its lines do not
    hold whole cells only.

    A line holds whole cells if taking away doubled quotes and then every quoted
    cell that reaches from one separator (or line end) to the next leaves no quote.
    A file without other lines has no cell with a line break, so it can be read
    split by lines. One scan as text, two numbers per file.
    """
    bare = F.regexp_replace(F.replace(F.col("value"), F.lit('""'), F.lit("")), '(^|,)"[^"]*"(?=,|$)', "$1")
    return (spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.contains(bare, F.lit('"')).alias("open"))
            .groupBy("file").agg(F.count(F.lit(1)).alias("lines"), F.count_if("open").alias("open_lines")))


def _read(spark: SparkSession, path: str | Sequence[str], schema: T.StructType, multi_line: bool,
          header: bool) -> DataFrame:
    """All columns as text, ``_corrupt_record`` (the record's text where it has not
    as many cells as there are columns) and ``_file``."""
    text = text_schema(schema).add(CORRUPT, T.StringType())
    return (spark.read.options(**DIALECT).option("header", header)
            .option("multiLine", multi_line).option("mode", "PERMISSIVE").option("enforceSchema", not header)
            .option("columnNameOfCorruptRecord", CORRUPT).option("columnPruning", False)
            .schema(text).csv(path).select("*", F.col("_metadata.file_path").alias(FILE)))


def read_records(spark: SparkSession, path: str | Sequence[str], schema: T.StructType,
                 multi_line: bool | None = None, header: bool = True) -> DataFrame:
    """The records of CSV files as text, with ``_corrupt_record`` and ``_file``.

    ``multi_line`` None: every file is scanned once for cells with line breaks
    (``spanning_files``); the files without any, however large, are read split by
    lines, the others one task each. True or False says so for all files.
    """
    if multi_line is not None:
        return _read(spark, path, schema, multi_line, header)
    seen = spanning_files(spark, path).select("file", (F.col("open_lines") > 0).alias("spans")).collect()
    whole = _urls_to_paths(sorted(r["file"] for r in seen if r["spans"]))
    split = _urls_to_paths(sorted(r["file"] for r in seen if not r["spans"]))
    if not whole or not split:
        return _read(spark, path, schema, bool(whole), header)
    return _read(spark, split, schema, False, header).unionAll(_read(spark, whole, schema, True, header))


def reject_reason(width: int) -> Column:
    """Why a record was not read cell by cell: ``unbalanced`` (a quote that is
    never closed), ``short`` or ``long``; NULL for a sound record."""
    record = F.replace(F.col(CORRUPT), F.lit('""'), F.lit(""))
    bare = F.regexp_replace(record, '(^|,)"[^"]*"(?=,|$)', "$1")
    cells = F.size(F.split(bare, ",", -1))
    return (F.when(F.col(CORRUPT).isNull(), F.lit(None).cast("string"))
            .when(F.contains(bare, F.lit('"')), F.lit("unbalanced"))
            .when(cells < width, F.lit("short")).otherwise(F.lit("long")))


def load_table(
    spark: SparkSession,
    path: str | Sequence[str],
    role: str | None = None,
    schema: T.StructType | None = None,
    numeric_cols: Sequence[str] | None = None,
    na_tokens: Sequence[str] = NA_TOKENS,
    multi_line: bool | None = None,
    header: bool = True,
) -> DataFrame:
    """Read a headed CSV as one role table (W01).

    Every column is read as text (no inference, so ids stay text and a missing
    id cannot turn ``1`` into ``1.0``), then coerced by ``coerce``. A quoted cell
    may hold line breaks; only files that have such cells are read whole
    (``read_records``). Cells that a short record lacks are NULL, as in the
    reference's loader. Records with too many cells or an unclosed quote, at which
    that loader stops, are left out here; ``load_report`` counts them.
    """
    schema, numeric_cols = role_schema(role, schema, numeric_cols)
    records = read_records(spark, path, schema, multi_line, header)
    sound = F.coalesce(reject_reason(len(schema)), F.lit("short")) == "short"
    # Spark refuses to read the corrupt record alone, so a cell is always asked for
    some_cell = F.coalesce(F.length(schema[0].name), F.lit(0)) >= 0
    return coerce(records.filter(sound & some_cell), schema, numeric_cols, na_tokens)


def load_report(
    spark: SparkSession,
    path: str | Sequence[str],
    role: str | None = None,
    schema: T.StructType | None = None,
    multi_line: bool | None = None,
    header: bool = True,
) -> DataFrame:
    """(file, outcome, records, lines) of a load: ``loaded`` records, ``short`` ones
    (loaded, lacking cells), ``long`` and ``unbalanced`` ones (left out), and the
    lines of text they take. An unclosed quote swallows what follows it in its
    file; those lines are counted with it, so none is lost unseen."""
    schema, _ = role_schema(role, schema, ())
    records = read_records(spark, path, schema, multi_line, header)
    outcome = F.coalesce(reject_reason(len(schema)), F.lit("loaded"))
    breaks = [F.coalesce(F.length(F.col(f.name)) - F.length(F.replace(F.col(f.name), F.lit("\n"), F.lit(""))), F.lit(0))
              for f in schema]
    in_cells = sum(breaks[1:], breaks[0]) + 1
    in_record = F.size(F.split(F.rtrim(F.col(CORRUPT), F.lit("\n")), "\n", -1))
    return records.select(
        F.col(FILE).alias("file"), outcome.alias("outcome"),
        F.when(F.col(CORRUPT).isNull(), in_cells).otherwise(in_record).alias("lines"),
    ).groupBy("file", "outcome").agg(F.count(F.lit(1)).alias("records"), F.sum("lines").alias("lines"))


def append_table(df: DataFrame, path: str) -> None:
    """Append the loaded rows to a parquet table (the reference's INSERT)."""
    df.write.mode("append").parquet(path)


_PREVIOUS = "bandwise.previous"


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _location(spark: SparkSession, table: str) -> str:
    rows = spark.sql(f"DESCRIBE TABLE EXTENDED {table}").filter("col_name = 'Location'").collect()
    return rows[0]["data_type"]


def replace_table(df: DataFrame, table: str, folder: str) -> DataFrame:
    """Replace a catalog table by these rows (the reference's drop and re-create
    before a full reload); returns the table.

    The rows are first written to a new folder below ``folder``; then the table is
    pointed there. A job that fails while writing leaves the table as it was, and
    ``df`` may read the table that it replaces. The folder before is kept until the
    next replacement, for readers that still use it. Columns may change.
    """
    spark = df.sparkSession
    new = f"{folder.rstrip('/')}/{table.split('.')[-1]}-{uuid.uuid4().hex}"
    df.write.parquet(new)
    old = before = None
    if spark.catalog.tableExists(table):
        old = _location(spark, table)
        shown = spark.sql(f"SHOW TBLPROPERTIES {table}").filter(F.col("key") == _PREVIOUS).collect()
        before = shown[0]["value"] if shown else None
        if spark.table(table).schema == df.schema:
            spark.sql(f"ALTER TABLE {table} SET LOCATION '{new}'")
        else:
            spark.sql(f"DROP TABLE {table}")
            spark.catalog.createTable(table, path=new, source="parquet", schema=df.schema)
        spark.sql(f"ALTER TABLE {table} SET TBLPROPERTIES ('{_PREVIOUS}' = '{old}')")
        spark.catalog.refreshTable(table)
    else:
        spark.catalog.createTable(table, path=new, source="parquet", schema=df.schema)
    if before:
        _delete(spark, before)
    return spark.table(table)
