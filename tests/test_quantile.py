"""Exact percentile against numpy's linear interpolation."""

from __future__ import annotations

import re

import numpy as np
import pytest

from pyspark.sql import functions as F

from bandwise.operators.quantile import exact_percentile, percentile_with


def _run(spark, values, q, accuracy=100):
    df = spark.createDataFrame([(v,) for v in values], "price double")
    return exact_percentile(df, "price", q, accuracy=accuracy).first()["value"]


@pytest.mark.parametrize("q", [0.0, 0.01, 0.5, 0.9, 0.99, 1.0])
def test_matches_numpy_on_random_values(spark, q):
    rng = np.random.default_rng(7)
    values = [float(v) for v in np.round(rng.gamma(2.0, 20.0, 3000), 2)]
    assert _run(spark, values, q) == pytest.approx(float(np.percentile(values, q * 100)), abs=1e-9)


def test_hot_value_holding_a_third_of_rows(spark):
    rng = np.random.default_rng(3)
    values = [float(v) for v in np.round(rng.uniform(0, 100, 2000), 2)] + [42.0] * 1000
    for q in (0.3, 0.5, 0.99):
        assert _run(spark, values, q) == pytest.approx(float(np.percentile(values, q * 100)))


def test_nulls_ignored_and_empty_gives_null(spark):
    assert _run(spark, [1.0, None, 3.0], 0.5) == 2.0
    assert _run(spark, [None], 0.5) is None


def test_single_value(spark):
    assert _run(spark, [7.5], 0.99) == 7.5


@pytest.mark.parametrize("accuracy", [5, 50, 10_000])
def test_narrow_and_wide_brackets(spark, accuracy):
    rng = np.random.default_rng(11)
    values = [float(v) for v in np.round(rng.lognormal(3, 1, 4000), 3)]
    df = spark.createDataFrame([(v,) for v in values], "price double").repartition(16)
    for q in (0.0, 0.37, 0.99, 1.0):
        got = exact_percentile(df, "price", q, accuracy=accuracy).first()["value"]
        assert got == pytest.approx(float(np.percentile(values, q * 100)), abs=1e-9)


@pytest.mark.parametrize("n", [2, 3, 9, 11, 12, 101, 399, 400, 1000])
def test_few_rows_and_every_remainder(spark, n):
    values = [float(v * v) for v in range(n)]
    for q in (0.01, 0.99):
        assert _run(spark, values, q, accuracy=200) == pytest.approx(float(np.percentile(values, q * 100)))


def test_sorted_input_and_few_distinct_values(spark):
    values = [float(v // 500) for v in range(5000)]
    for q in (0.1, 0.5, 0.95):
        assert _run(spark, values, q) == pytest.approx(float(np.percentile(values, q * 100)))


def test_only_the_bracket_is_sorted(spark):
    """Rows below the bracket are one group, those above are filtered away."""
    df = spark.range(100_000).selectExpr("CAST(id AS DOUBLE) AS price").repartition(4)
    out = percentile_with(df, "price", 0.99, {"n": F.count(F.lit(1))})
    assert [tuple(r) for r in out.collect()] == [(pytest.approx(98999.01), 100_000)]
    final = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert len(set(re.findall(r"subquery#(\d+)", final))) == 1, "one bracketing pass, reused"
    assert sum(1 for line in final.splitlines() if " Window [" in line) == 1
