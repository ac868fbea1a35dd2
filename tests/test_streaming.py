"""Streaming ingest and running bucket counts equal their batch forms."""

from __future__ import annotations

import os
import subprocess
import sys

from fixture_data import TRANSACTIONS, fixture_lines, rows

from bandwise.plans import reports as r
from bandwise.streaming import ingest_role, run_bucket_counts


def _split_csv(text: str, folder: str, parts: int) -> None:
    head, *body = text.strip().splitlines()
    os.makedirs(folder, exist_ok=True)
    for i in range(parts):
        chunk = body[i::parts]
        with open(os.path.join(folder, f"part-{i}.csv"), "w") as fh:
            fh.write("\n".join([head, *chunk]) + "\n")


def test_ingest_appends_each_file_once(spark, scratch):
    landing, table = os.path.join(scratch, "landing"), os.path.join(scratch, "table")
    ckpt = os.path.join(scratch, "ckpt")
    _split_csv(TRANSACTIONS, landing, 3)
    ingest_role(spark, landing, "transactions", table, checkpoint=ckpt).awaitTermination()
    ingest_role(spark, landing, "transactions", table, checkpoint=ckpt).awaitTermination()  # no-op
    got = spark.read.parquet(table)
    assert got.count() == 12
    assert dict(rows(got, "order_id", "price"))["o10"] is None


def test_running_bucket_counts_equal_batch_report(spark, scratch):
    landing = os.path.join(scratch, "landing")
    _split_csv(TRANSACTIONS, landing, 4)
    q = run_bucket_counts(spark, landing, "bucket_counts_test",
                          checkpoint=os.path.join(scratch, "ckpt2"))
    q.awaitTermination()
    streamed = rows(spark.sql("SELECT * FROM bucket_counts_test ORDER BY _b"),
                    "price_bucket", "order_count")
    batch = rows(r.price_bucket_distribution(fixture_lines(spark, scratch)),
                 "price_bucket", "order_count")
    assert streamed == batch


_RUN = """
import sys
from bandwise.session import local_session
from bandwise.streaming import ingest_role
landing, table, checkpoint = sys.argv[1:]
ingest_role(local_session(2, 2), landing, "transactions", table, checkpoint).awaitTermination()
"""


def test_two_applications_ingest_every_file_once(spark, scratch):
    landing, table, ckpt = (os.path.join(scratch, x) for x in ("landing3", "table3", "ckpt3"))
    head, *body = TRANSACTIONS.strip().splitlines()
    os.makedirs(landing)
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for i in range(2):
        with open(os.path.join(landing, f"new-{i}.csv"), "w") as fh:
            fh.write("\n".join([head, *body[i::2]]) + "\n")
        subprocess.run([sys.executable, "-c", _RUN, landing, table, ckpt], check=True, timeout=240,
                       env=os.environ | {"PYTHONPATH": root})
    ids = [r[0] for r in spark.read.parquet(table).select("order_id").collect()]
    assert len(ids) == len(body) and spark.read.parquet(table).count() == 12
