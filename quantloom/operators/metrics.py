"""Performance metrics of dated return series. The three Sharpe definitions are kept apart by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.stats import ratio

YEAR = 252
TINY = 1e-12


def with_drawdown(df: DataFrame, r: str, *keys: str) -> DataFrame:
    """Adds equity (running product of 1 + r) and drawdown (equity over its running maximum, minus 1; the starting wealth is no peak)."""
    over = Window.partitionBy(*keys).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("equity", F.product(1 + F.col(r)).over(over))
    return df.withColumn("drawdown", ratio("equity", F.max("equity").over(over)) - 1)


def total_return(r: str) -> Column:
    return F.product(1 + F.col(r)) - 1


def annual_return(r: str) -> Column:
    """Growth to the power of 252 / n, minus 1; -1 once wealth is gone."""
    growth = F.product(1 + F.col(r))
    return F.when(growth <= 0, -1.0).otherwise(F.pow(growth, F.lit(float(YEAR)) / F.count(r)) - 1)


def sharpe(r: str) -> Column:
    """Mean over deviation, times the root of 252; 0 without deviation."""
    s = F.stddev_samp(r)
    return F.when(s > TINY, F.avg(r) / s * F.sqrt(F.lit(float(YEAR)))).otherwise(0.0)


def geometric_sharpe(r: str) -> Column:
    """Annualized return over annualized volatility."""
    v = F.stddev_samp(r) * F.sqrt(F.lit(float(YEAR)))
    return F.when(v > TINY, annual_return(r) / v).otherwise(0.0)


def win_rate(r: str) -> Column:
    return F.avg((F.col(r) > 0).cast("double"))


def information_ratio(r: str, b: str) -> Column:
    e = F.col(r) - F.col(b)
    s = F.stddev_samp(e)
    return F.when(s > TINY, F.avg(e) / s * F.sqrt(F.lit(float(YEAR)))).otherwise(0.0)


def backtest_metrics(df: DataFrame, r: str, b: str, *keys: str) -> DataFrame:
    """The bundle of a backtest by keys; alpha is the simple difference of total returns."""
    return with_drawdown(df, r, *keys).groupBy(*keys).agg(
        total_return(r).alias("total_return"), total_return(b).alias("benchmark_return"), (total_return(r) - total_return(b)).alias("alpha"), annual_return(r).alias("annual_return"), sharpe(r).alias("sharpe_ratio"), F.min("drawdown").alias("max_drawdown"), win_rate(r).alias("win_rate"), information_ratio(r, b).alias("information_ratio")
    )


def relative_metrics(df: DataFrame, r: str, b: str, *keys: str) -> DataFrame:
    """beta, Jensen alpha, tracking error, annualized excess return and information ratio against a benchmark."""
    ok = df.where(F.col(r).isNotNull() & F.col(b).isNotNull())
    beta = F.when(F.var_samp(b) > 1e-16, F.covar_samp(r, b) / F.var_samp(b))
    e = F.col(r) - F.col(b)
    return ok.groupBy(*keys).agg(beta.alias("beta"), ((F.avg(r) - beta * F.avg(b)) * YEAR).alias("jensen_alpha"), (F.stddev_samp(e) * F.sqrt(F.lit(float(YEAR)))).alias("tracking_error"), (F.avg(e) * YEAR).alias("annualized_excess_return"), information_ratio(r, b).alias("information_ratio"))


def walk_forward_metrics(df: DataFrame, *keys: str, r: str = "net", b: str = "benchmark") -> DataFrame:
    """The bundle of a walk-forward period by keys, from date, net, benchmark, turnover and cost."""
    df = df.withColumn("_b", F.coalesce(F.col(b), F.lit(0.0)))
    v = F.stddev_samp(r) * F.sqrt(F.lit(float(YEAR)))
    return with_drawdown(df, r, *keys).groupBy(*keys).agg(
        annual_return(r).alias("annualized_return"), F.coalesce(v, F.lit(0.0)).alias("volatility"), geometric_sharpe(r).alias("sharpe"), F.min("drawdown").alias("max_drawdown"), information_ratio(r, "_b").alias("information_ratio"),
        F.sum("turnover").alias("turnover"), F.sum("cost").alias("transaction_cost"), (F.sum(r) - F.sum("_b")).alias("benchmark_excess_return"),
    )


__all__ = ["annual_return", "backtest_metrics", "geometric_sharpe", "information_ratio", "relative_metrics", "sharpe", "total_return", "walk_forward_metrics", "win_rate", "with_drawdown"]
