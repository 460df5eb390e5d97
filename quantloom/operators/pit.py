"""Point-in-time fundamentals: a report counts from its announcement on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.operators.asof import asof_join

FLAGGED, POINT_IN_TIME = "ANNOUNCEMENT_DATE_MISSING", "POINT_IN_TIME"


def align_fundamentals(panel: DataFrame, reports: DataFrame, by: str = "stock") -> DataFrame:
    """panel with each report's columns as known on the day, available_date, factor_date, point_in_time_available and data_quality."""
    if "announcement_date" not in reports.columns:
        return panel.withColumns({"available_date": F.lit(None).cast("date"), "factor_date": F.col("date"), "point_in_time_available": F.lit(False), "data_quality": F.lit(FLAGGED)})
    joined = asof_join(panel, reports, "date", "announcement_date", by)
    return joined.withColumns({"available_date": F.col("announcement_date"), "factor_date": F.col("date"), "point_in_time_available": F.col("announcement_date").isNotNull(), "data_quality": F.lit(POINT_IN_TIME)})


def fundamental_panel(panel: DataFrame, valuation: DataFrame, reports: DataFrame) -> DataFrame:
    """panel left-joined with daily valuation by (date, stock) and with the reports known on the day."""
    return align_fundamentals(panel.join(valuation, ["date", "stock"], "left"), reports)


def coverage(df: DataFrame, *measures: str) -> DataFrame:
    """One row a measure: share of missing values and the last date that has one."""
    long = df.select("date", *(F.col(m).cast("double").alias(m) for m in measures)).unpivot(["date"], list(measures), "measure", "value")
    return long.groupBy("measure").agg(F.avg(F.col("value").isNull().cast("double")).alias("missing_ratio"), F.max(F.when(F.col("value").isNotNull(), F.col("date"))).alias("latest_valid_date"))


def exposures(panel: DataFrame, industries: DataFrame | None = None) -> DataFrame:
    """panel with market_cap (its own, else close times shares_outstanding, else NULL) and the industry in force on the day."""
    if "market_cap" not in panel.columns:
        cap = F.col("close") * F.col("shares_outstanding") if "shares_outstanding" in panel.columns else F.lit(None)
        panel = panel.withColumn("market_cap", cap.cast("double"))
    if industries is None:
        return panel if "industry" in panel.columns else panel.withColumn("industry", F.lit(None).cast("string"))
    return asof_join(panel.drop("industry"), industries.select("stock", "effective_date", "industry"), "date", "effective_date")
