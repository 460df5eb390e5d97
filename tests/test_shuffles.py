"""What is shuffled: rows are dealt out by stock and by date, never once they are one for each variant, horizon, fold or method."""

import os
import re

import pytest
from pyspark.sql import functions as F

from quantloom.operators import quantile, walkforward
from quantloom.plans import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")


def exchanges(df):
    """The keys of every hash exchange of df's plan."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return {tuple(k.split("#")[0].strip() for k in keys.split(",")[:-1]) for keys in re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)}


def test_low_volatility_grid_shuffles_stocks_and_dates(spark):
    assert exchanges(catalog.QUERIES["robustness_grid_low_vol"](spark, SF)) == {("stock",), ("date",), ("factor_name", "variant", "period")}


def test_momentum_grid_shuffles_stocks_and_dates(spark):
    assert exchanges(catalog.QUERIES["robustness_grid_momentum"](spark, SF)) == {("stock",), ("date",), ("factor_name", "variant", "period")}


def test_in_sample_portfolios_shuffle_stocks_rows(spark):
    assert exchanges(catalog.QUERIES["in_sample_metrics"](spark, SF)) <= {("date",), ("fold", "method"), ("fold",), ("fold", "method", "factor_name")}


def test_group_percentiles_are_exact(spark):
    rows = [("a", float(i * i % 97)) for i in range(500)] + [("a", None), ("one", 3.5), ("same", 2.0), ("same", 2.0), ("far", -1e9), ("far", 0.1), ("far", 0.2), ("far", 1e9)]
    df = spark.createDataFrame(rows, "k string, v double")
    want = df.groupBy("k").agg(F.percentile("v", 0.01).alias("p0"), F.percentile("v", 0.99).alias("p1"), F.percentile("v", 0.5).alias("p2"))
    assert sorted(quantile.group_percentiles(df, "v", (0.01, 0.99, 0.5), "k", bins=8).collect()) == sorted(want.collect())


def test_scores_sum_the_factors_that_are_there(spark):
    day = "2020-01-01"
    df = spark.createDataFrame([(day, "a", "f", 1.0, 0.1), (day, "a", "g", 3.0, 0.1), (day, "b", "f", 5.0, 0.2), (day, "b", "g", None, 0.2), (day, "c", "h", 9.0, 0.3)], "date string, stock string, factor_name string, directed_value double, forward_return_1d double")
    rows = walkforward.stock_rows(df, ("f", "g", "h"))
    days = spark.createDataFrame([(day, 0)], "date string, fold int")
    weights = spark.createDataFrame([(0, "m", "f", 0.5), (0, "m", "g", 0.5)], "fold int, method string, factor_name string, weight double")
    got = walkforward.portfolio(rows, days, weights, ("f", "g", "h"), top=0.5).first()
    assert (got.gross, got.benchmark) == pytest.approx((0.2, 0.15))  # scores 2.0 and 2.5; no weight of c's only factor
