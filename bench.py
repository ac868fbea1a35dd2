"""Benchmark: wall time of the report queries on one scale factor.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_RUNS (timed runs per query after one warm-up, default 3),
BENCH_ONLY (comma-separated substrings of query keys to run).

Each query runs end to end from the parquet tables (binding, cleaning,
master join, report) and is executed with the no-op sink, so the whole plan
runs without shipping rows to the driver. Reported per query: the median of
the timed runs. A second figure, ``suite_sec``, is the shape of a
production run over binding b: the master is written once as parquet in the
checkpoint folder, two passes over it compute the partials of every report
(four grains; claim tags with order bitmaps), and all 23 reports finish from
those. ``audit`` times the quality audit (W08), which is not in the sum.

Prints ONE JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from bandwise.plans.catalog import ENTRIES, order_lines  # noqa: E402
from bandwise.plans.suite import group_all  # noqa: E402
from bandwise.session import local_session  # noqa: E402
from bandwise.sources.bindings import CLAIM_TAGS_ALL  # noqa: E402


def run_noop(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    only = [s for s in os.environ.get("BENCH_ONLY", "").split(",") if s]
    spark = local_session(cpus, max(cpus, 8), app_name="bandwise-bench")

    picked = [(e, b) for e in ENTRIES if e.qid.startswith("q") for b in ("a", "b")
              if not only or any(o in e.key(b) for o in only)]
    # warm the JVM (class loading, code generation) once before any timing
    for entry, binding in picked[:2]:
        run_noop(entry.build(order_lines(spark, sf_dir, binding)))
    def median(entry, binding) -> float:
        samples = []
        for i in range(runs + 1):
            t0 = time.perf_counter()
            run_noop(entry.build(order_lines(spark, sf_dir, binding)))
            if i:
                samples.append(time.perf_counter() - t0)
        return round(statistics.median(samples), 3)

    timings = {entry.key(binding): median(entry, binding) for entry, binding in picked}
    audit = {} if only else {e.key(b): median(e, b) for e in ENTRIES if e.qid == "w08" for b in ("a", "b")}

    suite, suite_parts = None, {}
    if not only:
        t0 = time.perf_counter()
        lines = order_lines(spark, sf_dir, "b")
        lines.materialize()
        suite_parts["materialize_master"] = round(time.perf_counter() - t0, 3)
        t1 = time.perf_counter()
        group_all(lines, tags=CLAIM_TAGS_ALL)
        suite_parts["partials"] = round(time.perf_counter() - t1, 3)
        for entry in ENTRIES:
            if entry.qid.startswith("q"):
                t1 = time.perf_counter()
                run_noop(entry.build(lines))
                suite_parts[entry.qid] = round(time.perf_counter() - t1, 3)
        suite = round(time.perf_counter() - t0, 3)

    sf = os.path.basename(sf_dir).replace("sf", "")
    print(json.dumps({
        "metric": "sum_median_query_sec",
        "value": round(sum(timings.values()), 3),
        "unit": "sec",
        "queries": timings,
        "audit": audit,
        "suite_sec": suite,
        "suite_parts": suite_parts,
        "sf": sf,
        "cpus": cpus,
        "runs": runs,
        "spark": spark.version,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
