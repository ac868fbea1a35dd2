"""Summarise the executed (AQE final) physical plan of every report.

Usage: python tools/plan_summary.py [--sf-dir DIR] [--binding b] > PLANS.md

Per query: tables scanned, join operators, shuffle exchanges (hash / range /
single partition), broadcasts, windows and top-k operators -- the numbers to
look at when asking whether a plan would hold at 1000x the data.
"""

from __future__ import annotations

import argparse
import os
import re
import sys
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from bandwise.plans.catalog import ENTRIES, order_lines  # noqa: E402
from bandwise.session import local_session  # noqa: E402


def final_plan(df) -> str:
    df.write.format("noop").mode("overwrite").save()
    text = df._jdf.queryExecution().executedPlan().toString()
    return text.split("+- == Initial Plan ==")[0]


def summarise(text: str) -> dict[str, str]:
    scans = sorted(set(re.findall(r"/([a-z_]+)\.parquet", text))
                   | {f"{m} (written)" for m in re.findall(r"/(groups|master)-[0-9a-f]{8}", text)})
    joins = Counter(m for m in re.findall(r"(BroadcastHashJoin|SortMergeJoin|ShuffledHashJoin|"
                                          r"BroadcastNestedLoopJoin|CartesianProduct)", text))
    join_types = Counter(re.findall(r"(?:BroadcastHashJoin|SortMergeJoin|ShuffledHashJoin)[^\n]*?"
                                    r"(Inner|LeftOuter|LeftSemi|LeftAnti|FullOuter)", text))
    exchanges = Counter()
    for kind in re.findall(r"Exchange (hashpartitioning|rangepartitioning|SinglePartition)", text):
        exchanges[kind] += 1
    reused = text.count("ReusedExchange")
    windows = text.count("Window [") + text.count("WindowGroupLimit")
    topk = text.count("TakeOrderedAndProject")
    return {
        "scans": ", ".join(scans),
        "joins": ", ".join(f"{k}×{v}" for k, v in sorted(joins.items())) or "none",
        "join kinds": ", ".join(f"{k}×{v}" for k, v in sorted(join_types.items())) or "-",
        "shuffles": ", ".join(f"{k.replace('partitioning', '')}×{v}" for k, v in sorted(exchanges.items()))
                    + (f", reused×{reused}" if reused else ""),
        "windows/top-k": f"{windows}/{topk}",
    }


def main() -> None:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf-dir", default="/root/testdata/sf0.1")
    ap.add_argument("--binding", default="b")
    ap.add_argument("--no-broadcast", action="store_true",
                    help="plan as if no dimension fit the broadcast bound (the 100 TB shape)")
    ap.add_argument("--suite", action="store_true",
                    help="materialize the master and finish grouped reports from one GROUPING SETS pass")
    args = ap.parse_args()
    spark = local_session(8, 8, conf={"spark.sql.maxMetadataStringLength": "10000"})
    if args.no_broadcast:
        from bandwise.operators import joins
        joins.DEFAULT_MAX_ROWS = 0
        spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    cols = ["scans", "joins", "join kinds", "shuffles", "windows/top-k"]
    shape = ("suite: written master + one GROUPING SETS pass" if args.suite else
             "no dimension broadcast (at-scale shape)" if args.no_broadcast else "measured broadcasts")
    suite_lines = None
    if args.suite:
        from bandwise.plans.suite import group_all
        from bandwise.sources.bindings import CLAIM_TAGS_ALL
        suite_lines = order_lines(spark, args.sf_dir, args.binding)
        suite_lines.materialize()
        table = group_all(suite_lines, tags=CLAIM_TAGS_ALL)
    print(f"## Binding {args.binding}, {os.path.basename(args.sf_dir)}, {shape}\n")
    print("Generated by `tools/plan_summary.py` from the AQE final plans. Scans list the")
    print("parquet tables read; `hash` shuffles include the partial-aggregate exchanges")
    print("(one row per group per task), `range` is the final ORDER BY, `Single` a")
    print("global aggregate of already-grouped rows.\n")
    print("| query | " + " | ".join(cols) + " |")
    print("|---|" + "---|" * len(cols))
    for e in ENTRIES:
        if args.binding not in e.bindings:
            continue
        if suite_lines is not None and not e.qid.startswith("q"):
            continue
        df = e.build(suite_lines if suite_lines is not None else order_lines(spark, args.sf_dir, args.binding))
        s = summarise(final_plan(df))
        print(f"| {e.key(args.binding)} | " + " | ".join(s[c] for c in cols) + " |", flush=True)


if __name__ == "__main__":
    main()
