"""Inputs: role schemas, CSV ingest, bindings of parquet tables to roles."""

from bandwise.sources.bindings import Roles, bind
from bandwise.sources.csv import append_table, load_report, load_table, replace_table, spanning_files
from bandwise.sources.schemas import MASTER_COLUMNS, NUMERIC_COLUMNS, ROLE_SCHEMAS
from bandwise.sources.tables import bucket_count, save_roles, table_roles

__all__ = ["Roles", "bind", "load_table", "load_report", "spanning_files", "append_table", "replace_table", "MASTER_COLUMNS",
           "NUMERIC_COLUMNS", "ROLE_SCHEMAS", "bucket_count", "save_roles", "table_roles"]
