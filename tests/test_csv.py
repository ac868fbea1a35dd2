"""CSV dialect and number rules of the loader; in-place rewrites are noticed."""

from __future__ import annotations

import os

from bandwise.operators.joins import measure
from bandwise.sources.csv import load_table


def test_quoted_cells_keep_their_columns(spark, scratch):
    path = os.path.join(scratch, "p.csv")
    with open(path, "w") as fh:
        fh.write('product_id,category,claims,ingredient_tags,pack_size\n'
                 'p1,bar,"keto, ""clean"" label, vegan",whey,4-pack\n'
                 'p2,bar,"line one\nline two",NA,single\n')
    got = [tuple(r) for r in load_table(spark, path, "product_metadata").orderBy("product_id").collect()]
    assert got == [("p1", "bar", 'keto, "clean" label, vegan', "whey", "4-pack"),
                   ("p2", "bar", "line one\nline two", None, "single")]


def test_only_plain_numbers_and_fractions_kept(spark, scratch):
    path = os.path.join(scratch, "t.csv")
    prices = ["12d", "12f", "$5", "1.5", " 2e1 ", "", "NA"]
    with open(path, "w") as fh:
        fh.write("order_id,user_id,product_id,price,quantity,timestamp,channel\n")
        fh.writelines(f"o{i},u,p,{p},1.5,t,web\n" for i, p in enumerate(prices))
    got = load_table(spark, path, "transactions").orderBy("order_id").collect()
    assert [r.price for r in got] == [None, None, None, 1.5, 20.0, None, None]
    assert {r.quantity for r in got} == {1.5}


def test_a_file_rewritten_in_place_is_measured_anew(spark, scratch):
    import pandas as pd

    path = os.path.join(scratch, "one.parquet")
    pd.DataFrame({"k": ["a", "b"]}).to_parquet(path)
    assert measure(spark.read.parquet(path)).rows == 2
    pd.DataFrame({"k": ["a", "a", "a", "b"]}).to_parquet(path)
    assert measure(spark.read.parquet(path)).rows == 4
