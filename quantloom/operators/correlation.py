"""Correlations between factors and orthogonalized factors."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.stats import average_rank, ratio, safe_corr


def daily_factor_correlation(df: DataFrame, factors: Sequence[str], value: str = "factor_value") -> DataFrame:
    """date, factor_a, factor_b, n, pearson, spearman over securities that have both of the named factors.

    One pivot to a row a (date, stock) and an unpivot to factor pairs, so the table is shuffled once and never joined to itself.
    """
    names = sorted(set(factors))
    wide = df.groupBy("date", "stock").pivot("factor_name", names).agg(F.avg(value))
    pairs = F.array(*(F.struct(F.lit(a).alias("factor_a"), F.lit(b).alias("factor_b"), F.col(f"`{a}`").alias("x"), F.col(f"`{b}`").alias("y")) for a, b in combinations(names, 2)))
    long = wide.select("date", "stock", F.inline(pairs)).where("x is not null and y is not null")
    keys = ("date", "factor_a", "factor_b")
    ranked = long.withColumns({"rx": average_rank("x", *keys), "ry": average_rank("y", *keys)})
    return ranked.groupBy(*keys).agg(F.count("*").alias("n"), safe_corr("x", "y").alias("pearson"), safe_corr("rx", "ry").alias("spearman"))


def average_factor_correlation(daily: DataFrame) -> DataFrame:
    """Means over all days, undefined days as 0; redundant: above 0.8 in size."""
    out = daily.groupBy("factor_a", "factor_b").agg(F.avg(F.coalesce("pearson", F.lit(0.0))).alias("mean_pearson"), F.avg(F.coalesce("spearman", F.lit(0.0))).alias("mean_spearman"), F.count("*").alias("days"))
    return out.withColumn("redundant", F.abs("mean_spearman") > 0.8)


def tail_factor_correlation(daily: DataFrame) -> DataFrame:
    """Means over defined days and the 95th percentile of the size of the rank correlation."""
    out = daily.groupBy("factor_a", "factor_b").agg(F.avg("spearman").alias("mean_spearman"), F.percentile(F.abs("spearman"), 0.95).alias("p95_abs_spearman"))
    return out.withColumn("flagged", F.col("p95_abs_spearman") > 0.8)


def orthogonalize(df: DataFrame, target: str, control: str, value: str = "directed_value") -> DataFrame:
    """date, stock, directed_value: the residual of a daily regression of one factor on another."""
    wide = df.where(F.col("factor_name").isin(target, control)).groupBy("date", "stock").agg(F.avg(F.when(F.col("factor_name") == target, F.col(value))).alias("y"), F.avg(F.when(F.col("factor_name") == control, F.col(value))).alias("x")).where("x is not null and y is not null")
    day = Window.partitionBy("date")
    slope = F.coalesce(ratio(F.covar_pop("x", "y").over(day), F.var_pop("x").over(day)), F.lit(0.0))
    residual = (F.col("y") - F.avg("y").over(day)) - slope * (F.col("x") - F.avg("x").over(day))
    return wide.select("date", "stock", F.round(residual, 12).alias("directed_value"))
