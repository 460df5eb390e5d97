"""Cross-sectional preprocessing: winsorizing, z-scores and percentiles. Missing values stay missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.stats import clip, col, percentile_rank
from quantloom.operators.factors import directed
from quantloom.schema import require_columns

METHODS = ("cross_sectional_zscore", "cross_sectional_percentile", "time_series_percentile")
KEYS = ("date", "factor_name")
TINY = 1e-12


def winsorize(df: DataFrame, value: str, out: str, method: str = "percentile", low: float = 0.01, high: float = 0.99, k: float = 3.0, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Adds `out`: value held between two percentiles, or within k median deviations (unscaled) of the median."""
    over = Window.partitionBy(*keys)
    if method == "none":
        return df.withColumn(out, F.col(value))
    if method == "percentile":
        if not 0 <= low <= high <= 1:
            raise ValueError("percentile bounds must lie in order between 0 and 1")
        return df.withColumn(out, clip(value, F.percentile(value, low).over(over), F.percentile(value, high).over(over)))
    if method == "mad":
        if k < 0:
            raise ValueError("k must not be negative")
        df = df.withColumn("_m", F.median(value).over(over)).withColumn("_d", F.abs(F.col(value) - F.col("_m")))
        df = df.withColumn("_d", F.median("_d").over(over))
        return df.withColumn(out, clip(value, F.col("_m") - k * F.col("_d"), F.col("_m") + k * F.col("_d"))).drop("_m", "_d")
    raise ValueError(f"unknown winsor method: {method}")


def zscore(value: str | Column, *keys: str) -> Column:
    """Population z-score within keys; 0 where the cross-section does not vary. Rounded to twelve places, so that ties do not hang on the order of summation."""
    v, over = col(value), Window.partitionBy(*keys)
    spread = F.stddev_pop(v).over(over)
    return F.when(v.isNotNull(), F.when(spread > TINY, F.round((v - F.avg(v).over(over)) / spread, 12)).otherwise(0.0))


def preprocess_factors(df: DataFrame, normalization: str = "cross_sectional_zscore", winsor: str = "percentile", value: str = "factor_value", **options) -> DataFrame:
    """Adds winsorized_value and normalized_value. The time-series method ranks a security's whole history (look-ahead by design) on raw values."""
    if normalization not in METHODS:
        raise ValueError(f"unknown normalization method: {normalization}")
    require_columns(df, ["date", "factor_name", value], "factor data")
    df = winsorize(df, value, "winsorized_value", winsor, **options)
    if normalization == "cross_sectional_zscore":
        out = zscore("winsorized_value", *KEYS)
    elif normalization == "cross_sectional_percentile":
        out = percentile_rank("winsorized_value", *KEYS) * 100
    else:
        out = percentile_rank(value, "stock", "factor_name") * 100
    return df.withColumn("normalized_value", out)


def with_direction(df: DataFrame, value: str = "normalized_value") -> DataFrame:
    """Adds directed_value."""
    return df.withColumn("directed_value", directed(value))
