"""Factor scores, ratings and stock scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.stats import percentile_rank, ratio
from quantloom.operators.asof import asof_join
from quantloom.operators.factors import quality_factor, value_factors
from quantloom.operators.ic import daily_ic
from quantloom.operators.metrics import sharpe, win_rate, with_drawdown
from quantloom.operators.preprocess import preprocess_factors, with_direction
from quantloom.operators.quantile import group_returns

#: Weights of the scores.
TECHNICAL_WEIGHTS = {"momentum_score": 0.4, "volatility_score": 0.2, "volume_score": 0.2}
MULTIFACTOR_WEIGHTS = {"technical_score": 0.4, "value_score": 0.3, "quality_score": 0.3}


def factor_summary(df: DataFrame, value: str = "factor_value", horizon: int = 5) -> DataFrame:
    """By factor: ic_mean, icir, rank_ic_mean, long_short_return, sharpe_ratio, max_drawdown, win_rate."""
    ic = daily_ic(df, value, (horizon,), guarded=False).groupBy("factor_name").agg(F.avg("ic").alias("ic_mean"), ratio(F.avg("ic"), F.stddev_samp("ic")).alias("icir"), F.avg("rank_ic").alias("rank_ic_mean"))
    ls = with_drawdown(group_returns(df, value, f"forward_return_{horizon}d"), "long_short", "factor_name")
    perf = ls.groupBy("factor_name").agg(F.avg("long_short").alias("long_short_return"), sharpe("long_short").alias("sharpe_ratio"), F.min("drawdown").alias("max_drawdown"), win_rate("long_short").alias("win_rate"))
    return ic.join(perf, "factor_name")


def factor_score(df: DataFrame) -> DataFrame:
    """Adds factor_score (0 to 100) and rating to a factor summary. Sizes count, whatever the sign; what is missing counts as 0."""
    size = lambda c: F.abs(F.coalesce(F.nanvl(F.col(c), F.lit(0.0)), F.lit(0.0)))
    unit = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    rate = F.abs(F.coalesce(F.col("win_rate"), F.lit(0.0)) - 0.5)
    score = unit(size("icir") / 0.5) * 30 + unit(size("long_short_return") * 252 / 0.20) * 30 + unit(size("sharpe_ratio") / 2.0) * 20 + unit(rate / 0.15) * 10 + unit(1 - size("max_drawdown") / 0.3) * 10
    return df.withColumn("factor_score", F.round(score, 2)).withColumn("rating", rating("factor_score"))


def rating(c: str) -> Column:
    return F.when(F.col(c) >= 90, "Excellent").when(F.col(c) >= 75, "Good").when(F.col(c) >= 60, "Average").otherwise("Weak")


def weighted(scores: dict[str, float]) -> Column:
    """The weighted mean of the named columns that are not NULL."""
    total = sum((F.when(F.col(k).isNotNull(), F.lit(w)).otherwise(0.0) for k, w in scores.items()), F.lit(0.0))
    return ratio(sum((F.coalesce(F.col(k), F.lit(0.0)) * w for k, w in scores.items()), F.lit(0.0)), total)


def _shown(df: DataFrame, normalization: str) -> DataFrame:
    done = with_direction(preprocess_factors(df, normalization))
    return done.withColumn("score_value", percentile_rank("directed_value", "date", "factor_name") * 100 if normalization == "cross_sectional_zscore" else F.col("directed_value"))


def stock_scores(long: DataFrame, normalization: str = "cross_sectional_zscore") -> DataFrame:
    """stock, momentum_score, volatility_score, volume_score, final_score for all stocks of the latest date."""
    if normalization == "time_series_percentile":
        target = F.when(F.col("factor_name") == "volume_change_20", -F.abs(F.col("factor_value") - 1.2)).when(F.col("factor_name").startswith("volatility"), -F.col("factor_value")).otherwise(F.col("factor_value"))
        ranked = long.withColumn("_v", target).withColumn("score_value", percentile_rank("_v", "stock", "factor_name") * 100)
        last = Window.partitionBy("stock", "factor_name").orderBy(F.desc("date"))
        shown = ranked.withColumn("_n", F.row_number().over(last)).where("_n = 1")
    else:
        latest = long.agg(F.max("date").alias("date"))  # one row
        shown = _shown(long.join(F.broadcast(latest), "date"), normalization)
    mean = lambda *names: F.avg(F.when(F.col("factor_name").isin(*names), F.col("score_value")))
    out = shown.groupBy("stock").agg(mean("momentum_20", "momentum_60").alias("momentum_score"), mean("volatility_20", "volatility_60").alias("volatility_score"), mean("volume_change_20").alias("volume_score"))
    return out.select("stock", *(F.round(c, 2).alias(c) for c in TECHNICAL_WEIGHTS), F.round(weighted(TECHNICAL_WEIGHTS), 2).alias("final_score"))


def multifactor_scores(long: DataFrame, fundamentals: DataFrame, normalization: str = "cross_sectional_zscore") -> DataFrame:
    """stock_scores with value_score, quality_score and the combined multifactor_score; each stock's latest fundamentals count."""
    last = Window.partitionBy("stock").orderBy(F.desc("date"))
    latest = quality_factor(value_factors(fundamentals)).withColumn("_n", F.row_number().over(last)).where("_n = 1")
    names = ["pe_factor", "pb_factor", "roe_factor"]
    wide = latest.select("stock", *names).unpivot(["stock"], names, "factor_name", "factor_value").withColumn("date", F.lit("1970-01-01").cast("date"))
    shown = _shown(wide, normalization)
    mean = lambda *n: F.avg(F.when(F.col("factor_name").isin(*n), F.col("score_value")))
    financial = shown.groupBy("stock").agg(mean("pe_factor", "pb_factor").alias("value_score"), mean("roe_factor").alias("quality_score"))
    out = stock_scores(long, normalization).withColumnRenamed("final_score", "technical_score").join(financial, "stock")
    return out.select("stock", "technical_score", F.round("value_score", 2).alias("value_score"), F.round("quality_score", 2).alias("quality_score"), F.round(weighted(MULTIFACTOR_WEIGHTS), 2).alias("multifactor_score"))


def multifactor_scores_at(long: DataFrame, fundamentals: DataFrame, candidates: DataFrame) -> DataFrame:
    """date, stock, score: multifactor scores as of each date, from what was known on it; all dates in one plan.

    candidates: date, stock (the universe of each date). A stock needs a factor row and fundamentals up to the date. The
    technical cross-section is that of the latest factor date of the date's candidates; stocks without a row on it have no
    technical score. Fundamentals are each stock's latest.
    """
    ids = candidates.select("date", "stock").distinct()
    known = asof_join(ids, long.select("stock", F.col("date").alias("_on")).distinct(), "date", "_on").where("_on is not null")
    money = quality_factor(value_factors(fundamentals.select("stock", F.col("date").alias("_as_of"), "pe", "pb", "roe")))
    known = asof_join(known, money, "date", "_as_of").where("_as_of is not null")
    known = known.withColumn("_last", F.max("_on").over(Window.partitionBy("date")))
    rows = known.where("_on = _last").select(F.col("date").alias("_d"), "stock", F.col("_last").alias("date")).join(long.select("date", "stock", "factor_name", "factor_value"), ["date", "stock"])
    technical = _shown(rows.drop("date").withColumnRenamed("_d", "date"), "cross_sectional_zscore")
    mean = lambda *names: F.avg(F.when(F.col("factor_name").isin(*names), F.col("score_value")))
    first = technical.groupBy("date", "stock").agg(mean("momentum_20", "momentum_60").alias("momentum_score"), mean("volatility_20", "volatility_60").alias("volatility_score"), mean("volume_change_20").alias("volume_score"))
    first = first.select("date", "stock", F.round(weighted(TECHNICAL_WEIGHTS), 2).alias("technical_score"))
    names = ["pe_factor", "pb_factor", "roe_factor"]
    financial = _shown(known.select("date", "stock", *names).unpivot(["date", "stock"], names, "factor_name", "factor_value"), "cross_sectional_zscore")
    second = financial.groupBy("date", "stock").agg(mean("pe_factor", "pb_factor").alias("value_score"), mean("roe_factor").alias("quality_score"))
    return known.select("date", "stock").join(first, ["date", "stock"], "left").join(second, ["date", "stock"], "left").select("date", "stock", F.round(weighted(MULTIFACTOR_WEIGHTS), 2).alias("score"))
