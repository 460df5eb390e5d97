"""Factor combination: static, equal and rolling IC weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.stats import ratio

METHODS = ("rolling_ic", "rolling_icir")


def normalize_weights(weights: dict[str, float]) -> dict[str, float]:
    """Weights over the sum of their sizes."""
    total = sum(abs(w) for w in weights.values())
    if total <= 0:
        raise ValueError("the weights' absolute sum must be positive")
    return {k: w / total for k, w in weights.items()}


def combine_static(df: DataFrame, weights: dict[str, float], value: str = "directed_value") -> DataFrame:
    """date, stock, score: weighted mean of the factors that are there, weights renormalised over them."""
    items = sorted(normalize_weights(weights).items())
    w = F.create_map(*(x for k, v in items for x in (F.lit(k), F.lit(v))))
    named = df.where(F.col("factor_name").isin([k for k, _ in items])).withColumn("_w", F.element_at(w, F.col("factor_name")))
    there = F.when(F.col(value).isNotNull(), F.col("_w"))
    return named.groupBy("date", "stock").agg(ratio(F.sum(there * F.col(value)), F.sum(F.abs(there))).alias("score"))


def combine_equal(df: DataFrame, value: str = "directed_value") -> DataFrame:
    return df.groupBy("date", "stock").agg(F.avg(value).alias("score"))


def rolling_weights(ic: DataFrame, factors: Sequence[str], method: str = "rolling_ic", lookback: int = 252, min_history: int = 60, value: str = "ic") -> DataFrame:
    """date, factor_name, weight of the named factors from IC values before the date. The grid of dates and factors is made dense first, so a window counts dates, not observations."""
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}")
    if not 0 < min_history <= lookback:
        raise ValueError("require 0 < min_history <= lookback")
    names = sorted(set(factors))
    dense = ic.groupBy("date").agg(F.map_from_entries(F.collect_list(F.struct("factor_name", value))).alias("m"))
    grid = dense.select("date", F.explode(F.array(*map(F.lit, names))).alias("factor_name"), "m").withColumn("v", F.try_element_at("m", F.col("factor_name"))).drop("m")
    past = Window.partitionBy("factor_name").orderBy("date").rowsBetween(-lookback, -1)
    mean = F.when(F.count("v").over(past) >= min_history, F.avg("v").over(past))
    if method == "rolling_icir":
        spread = F.stddev_samp("v").over(past)
        mean = F.when(spread > 1e-12, mean / spread)
    day = Window.partitionBy("date")
    signals = grid.withColumn("s", mean)
    total = F.sum(F.abs("s")).over(day)
    weight = F.when((F.count("s").over(day) == 0) | (total == 0), F.lit(1.0 / max(1, len(names)))).otherwise(F.coalesce(ratio("s", total), F.lit(0.0)))
    return signals.select("date", "factor_name", weight.alias("weight"))
