"""bandwise: retail price-band analytics as Spark DataFrame plans.

Layout
------
``functions``  column-level helpers (money rounding, bucketing, tag matching)
``sources``    role schemas, CSV ingest, bindings of parquet tables to roles
``operators``  DataFrame -> DataFrame building blocks (cleaning, master join,
               grouped summaries, shares, lag change, tag fan-out, baselines,
               ranking, competitor gap, audit, exact quantile)
``plans``      the report queries composed from the operators, plus the
               registry used by ``__spark_entry__`` and the DuckDB oracle text
``streaming``  the stateless cleaning steps and the bucket counts applied to a
               streaming source
"""

from bandwise.session import checkpoint_root, configure, local_session

__all__ = ["checkpoint_root", "configure", "local_session"]
