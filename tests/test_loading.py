"""Loading: files proven to be splittable, malformed records, staged replacement."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from bandwise.sources.csv import load_report, load_table, read_records, replace_table, spanning_files
from bandwise.sources.schemas import PRODUCTS

HEAD = "product_id,category,claims,ingredient_tags,pack_size\n"


def write(folder, name, text):
    path = os.path.join(folder, name)
    with open(path, "w", encoding="utf-8", newline="") as fh:
        fh.write(text)
    return path


@pytest.fixture()
def folder(scratch):
    """Three files: plain, quoted on one line, and with a cell over two lines."""
    write(scratch, "plain.csv", HEAD + "".join(f"p{i},bar,keto,whey,single\n" for i in range(5000)))
    write(scratch, "quoted.csv", HEAD + 'q1,bar,"a, ""b"", c",whey,"x"\nq2,"",,"""",y"z\n')
    write(scratch, "spans.csv", HEAD + 'r1,bar,"one\ntwo",whey,single\nr2,bar,"x",whey,single\n')
    return scratch


def test_only_files_with_open_lines_are_read_whole(spark, folder):
    seen = {os.path.basename(r.file): (r.lines, r.open_lines) for r in spanning_files(spark, folder).collect()}
    assert seen["plain.csv"] == (5001, 0)
    assert seen["quoted.csv"] == (3, 1)  # y"z is not quoted, so its file is not proven
    assert seen["spans.csv"] == (4, 2)


def test_split_and_whole_reading_agree(spark, folder):
    proven = sorted(map(tuple, load_table(spark, folder, "product_metadata").collect()), key=repr)
    whole = sorted(map(tuple, load_table(spark, folder, "product_metadata", multi_line=True).collect()), key=repr)
    assert proven == whole and len(proven) == 5004
    assert ("r1", "bar", "one\ntwo", "whey", "single") in proven
    assert ("q1", "bar", 'a, "b", c', "whey", "x") in proven


def test_a_proven_file_is_several_tasks(spark, folder):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    path = os.path.join(folder, "plain.csv")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
        assert read_records(spark, path, PRODUCTS).rdd.getNumPartitions() > 4
        assert read_records(spark, path, PRODUCTS, multi_line=True).rdd.getNumPartitions() == 1
        assert load_table(spark, path, "product_metadata").count() == 5000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_paths_with_blanks_and_signs(spark, scratch):
    folder = os.path.join(scratch, "in put%20")
    os.mkdir(folder)
    write(folder, "a b.csv", HEAD + "p1,bar,keto,whey,single\n")
    write(folder, "c%.csv", HEAD + 'p2,bar,"x\ny",whey,single\n')
    assert load_table(spark, folder, "product_metadata").count() == 2


def report(spark, path):
    return {(os.path.basename(r.file), r.outcome): (r.records, r.lines) for r in load_report(spark, path, "product_metadata").collect()}


def test_malformed_records_are_reported(spark, scratch):
    write(scratch, "a.csv", HEAD + 'p1,bar,keto,whey,single\np2,bar\np3,bar,keto,whey,single,more\n'
                                   'p4,"a, b",keto,whey,single,"x,y"\np5,bar,"two\nlines",whey,single\n')
    write(scratch, "b.csv", HEAD + 'p6,bar,keto,whey,single\np7,bar,"never closed,whey,single\np8,bar,keto,whey,single\n'
                                   "p9,bar,keto,whey,single\n")
    assert report(spark, scratch) == {
        ("a.csv", "loaded"): (2, 3), ("a.csv", "short"): (1, 1), ("a.csv", "long"): (2, 2),
        ("b.csv", "loaded"): (1, 1), ("b.csv", "unbalanced"): (1, 3)}
    got = {r.product_id: tuple(r)[1:] for r in load_table(spark, scratch, "product_metadata").collect()}
    assert got == {"p1": ("bar", "keto", "whey", "single"), "p2": ("bar", None, None, None),
                   "p5": ("bar", "two\nlines", "whey", "single"), "p6": ("bar", "keto", "whey", "single")}


def test_sound_files_report_only_loaded(spark, folder):
    assert {k[1] for k in report(spark, folder)} == {"loaded"}
    assert sum(v[0] for v in report(spark, folder).values()) == 5004


def test_replace_keeps_the_old_rows_when_the_write_fails(spark, scratch):
    table = "replace_me"
    replace_table(spark.range(3), table, scratch)
    bad = spark.range(10).select(F.when(F.col("id") < 5, F.col("id")).otherwise(F.raise_error(F.lit("no")).cast("long")).alias("id"))
    with pytest.raises(Exception, match="no"):
        replace_table(bad, table, scratch)
    spark.catalog.refreshTable(table)
    assert sorted(r.id for r in spark.table(table).collect()) == [0, 1, 2]


def test_replace_by_a_frame_that_reads_the_table(spark, scratch):
    table = "replace_self"
    replace_table(spark.range(5), table, scratch)
    replace_table(spark.table(table).filter("id > 2"), table, scratch)
    assert sorted(r.id for r in spark.table(table).collect()) == [3, 4]
    out = replace_table(spark.table(table).selectExpr("id * 10 AS id", "'x' AS kind"), table, scratch)
    assert sorted(map(tuple, out.collect())) == [(30, "x"), (40, "x")]
    folders = [f for f in os.listdir(scratch) if f.startswith(table)]
    assert len(folders) == 2  # the current one and the one before
