"""SQL over the registered views gives the same rows as the DataFrame reports."""

from __future__ import annotations

from fixture_data import fixture_lines

from bandwise.plans import reports as r
from bandwise.plans.views import register_views


def test_views_are_registered_and_consistent(spark, scratch):
    lines = fixture_lines(spark, scratch)
    views = register_views(lines, prefix="t_")
    assert set(views) >= {"transactions", "clean_transactions", "master_view",
                          "clean_competitor_pricing", "clean_geography"}
    assert spark.sql("SELECT COUNT(*) AS n FROM t_master_view").first()["n"] == 7
    assert spark.sql("SELECT COUNT(*) AS n FROM t_transactions").first()["n"] == 12


def test_sql_report_matches_dataframe_report(spark, scratch):
    lines = fixture_lines(spark, scratch)
    register_views(lines, prefix="u_")
    sql = spark.sql("""
        SELECT occasion, COUNT(*) AS order_count,
               CAST(ROUND(CAST(AVG(price) AS DECIMAL(38,10)), 2) AS DOUBLE) AS avg_price
        FROM u_master_view WHERE occasion IS NOT NULL
        GROUP BY occasion ORDER BY avg_price DESC""")
    frame = r.occasion_summary(lines).select("occasion", "order_count", "avg_price")
    assert [tuple(x) for x in sql.collect()] == [tuple(x) for x in frame.collect()]


def test_append_table(spark, scratch):
    from bandwise.sources.csv import append_table
    path = f"{scratch}/t.parquet"
    df = spark.range(3)
    append_table(df, path)
    append_table(df, path)
    assert spark.read.parquet(path).count() == 6
