"""Neutralization of a cross-section against size and industry, in closed form.

By the Frisch-Waugh theorem the regression on an intercept, log size and industry dummies leaves the residual of the
within-industry demeaned value on the within-industry demeaned log size, so unordered windows do it without a UDF.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.stats import ratio, safe_corr
from quantloom.operators.preprocess import TINY
from quantloom.schema import require_columns


@dataclass(frozen=True)
class NeutralizationConfig:
    enabled: bool = True
    use_size: bool = True
    use_industry: bool = True
    min_observations: int = 5
    rezscore: bool = True


def neutralize(df: DataFrame, value: str = "normalized_value", config: NeutralizationConfig = NeutralizationConfig()) -> DataFrame:
    """Adds neutralized_value and neutralization_status. A missing industry counts as the base category."""
    if not config.enabled:
        return df.withColumns({"neutralized_value": F.col(value), "neutralization_status": F.lit("disabled")})
    require_columns(df, ["date", "factor_name", value], "factor data")
    size, industry = config.use_size and "market_cap" in df.columns, config.use_industry and "industry" in df.columns
    group = Window.partitionBy("date", "factor_name")
    kinds = F.size(F.collect_set(F.col("industry")).over(group)) if industry else F.lit(0)
    df = df.withColumns({
        "_kinds": kinds, "_i": F.coalesce(F.col("industry").cast("string"), F.min(F.col("industry").cast("string")).over(group)) if industry else F.lit("all"),
        "_c": F.when(F.col("market_cap") > 0, F.ln(F.when(F.col("market_cap") > 0, F.col("market_cap")))) if size else F.lit(0.0),
    })
    valid = F.col(value).isNotNull() & (F.col("_c").isNotNull() if size else F.lit(True))
    df = df.withColumn("_ok", valid).withColumns({"_n": F.sum(F.col("_ok").cast("int")).over(group), "_y": F.when(F.col("_ok"), F.col(value)), "_x": F.when(F.col("_ok"), F.col("_c"))})
    within = Window.partitionBy("date", "factor_name", "_i")
    df = df.withColumns({"_y": F.col("_y") - F.avg("_y").over(within), "_x": F.col("_x") - F.avg("_x").over(within)})
    xx = F.sum(F.col("_x") * F.col("_x")).over(group)
    beta = F.when(xx > TINY, F.sum(F.col("_x") * F.col("_y")).over(group) / xx).otherwise(0.0) if size else F.lit(0.0)
    df = df.withColumn("_r", F.col("_y") - beta * F.col("_x"))
    if config.rezscore:
        spread = F.stddev_pop("_r").over(group)
        df = df.withColumn("_r", F.when(F.col("_r").isNotNull(), F.when(spread > TINY, (F.col("_r") - F.avg("_r").over(group)) / spread).otherwise(0.0)))
    parameters = 1 + int(size) + (F.greatest(F.col("_kinds") - 1, F.lit(0)) if industry else F.lit(0))
    nothing = (F.lit(not size) & (F.col("_kinds") <= 1)) if industry else F.lit(not size)
    few = F.col("_n") < F.greatest(F.lit(config.min_observations), parameters + 1)
    status = F.when(nothing, "missing_requested_exposures").when(few, "insufficient_sample_fallback").when(F.col("_ok"), "neutralized").otherwise("missing_exposure_fallback")
    out = df.withColumn("neutralization_status", status).withColumn("neutralized_value", F.when(F.col("neutralization_status") == "neutralized", F.col("_r")).otherwise(F.col(value)))
    return out.drop("_kinds", "_i", "_c", "_ok", "_n", "_y", "_x", "_r")


def industry_r2(df: DataFrame, value: str) -> DataFrame:
    """date, factor_name, r2: share of the variance between industries; NULL for fewer than three values or two industries, 0 without variance."""
    ok = df.where(F.col(value).isNotNull() & F.col("industry").isNotNull())
    by = ok.groupBy("date", "factor_name", "industry").agg(F.count("*").alias("n"), F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("ss"))
    total = F.sum("ss") - F.sum("s") * F.sum("s") / F.sum("n")
    between = F.sum(F.col("s") * F.col("s") / F.col("n")) - F.sum("s") * F.sum("s") / F.sum("n")
    r2 = F.when(total > TINY, between / total).otherwise(0.0)
    return by.groupBy("date", "factor_name").agg(F.when((F.sum("n") >= 3) & (F.count("*") >= 2), r2).alias("r2"))


def diagnostics(df: DataFrame, before: str = "normalized_value", after: str = "neutralized_value") -> DataFrame:
    """By factor: mean daily correlation with log size and mean industry R2, before and after."""
    cap = F.when(F.col("market_cap") > 0, F.ln(F.when(F.col("market_cap") > 0, F.col("market_cap"))))
    daily = df.withColumn("_c", cap).groupBy("date", "factor_name").agg(safe_corr(before, "_c").alias("b"), safe_corr(after, "_c").alias("a"))
    for name, c in (("before_industry_r2", before), ("after_industry_r2", after)):
        daily = daily.join(industry_r2(df, c).withColumnRenamed("r2", name), ["date", "factor_name"], "left")
    return daily.groupBy("factor_name").agg(F.avg("b").alias("before_size_corr"), F.avg("a").alias("after_size_corr"), F.avg("before_industry_r2").alias("before_industry_r2"), F.avg("after_industry_r2").alias("after_industry_r2"))


__all__ = ["NeutralizationConfig", "diagnostics", "industry_r2", "neutralize", "ratio"]
