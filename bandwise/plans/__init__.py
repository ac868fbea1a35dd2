"""Report queries, their registry, and the DuckDB oracle text."""

from bandwise.plans.catalog import ENTRIES, oracle_registry, order_lines, registry
from bandwise.plans.reports import OrderLines
from bandwise.plans.suite import group_all
from bandwise.plans.views import register_views

__all__ = ["ENTRIES", "OrderLines", "group_all", "oracle_registry", "order_lines", "register_views",
           "registry"]
