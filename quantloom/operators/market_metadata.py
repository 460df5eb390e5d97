"""Trading metadata: amount, special treatment, suspension and price limits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.functions.codes import is_special_treatment, limit_rate
from quantloom.schema import by_stock


def enrich(df: DataFrame, rounding=F.bround) -> DataFrame:
    """Adds amount, is_st, is_suspended, limit_up_price, limit_down_price, limit_up and limit_down where they are absent. Limit prices are rounded half to even."""
    if "amount" not in df.columns:
        df = df.withColumn("amount", F.col("close") * F.col("volume"))
    if "is_st" not in df.columns:
        name = F.col("stock_name") if "stock_name" in df.columns else F.lit(None).cast("string")
        df = df.withColumn("is_st", is_special_treatment(name))
    else:
        df = df.withColumn("is_st", F.coalesce(F.col("is_st").cast("boolean"), F.lit(False)))
    if "is_suspended" not in df.columns:
        none = F.col("open").isNull() & F.col("high").isNull() & F.col("low").isNull() & F.col("close").isNull()
        df = df.withColumn("is_suspended", (F.coalesce("volume", F.lit(0.0)) == 0) & (F.coalesce("amount", F.lit(0.0)) == 0) & none)
    before, rate = F.lag("close").over(by_stock()), limit_rate(F.col("stock"), F.col("is_st"))
    df = df.withColumn("_b", before).withColumns({"limit_up_price": rounding(F.col("_b") * (1 + rate), 2), "limit_down_price": rounding(F.col("_b") * (1 - rate), 2)}).drop("_b")
    one_price = F.col("high") == F.col("low")
    return df.withColumns({"limit_up": F.coalesce(one_price & (F.col("close") >= F.col("limit_up_price") - 1e-9), F.lit(False)), "limit_down": F.coalesce(one_price & (F.col("close") <= F.col("limit_down_price") + 1e-9), F.lit(False))})
