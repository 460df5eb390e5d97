"""As-of joins: each left row with the latest right row at or before its date."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, left_on: str, right_on: str, by: str | None = "stock") -> DataFrame:
    """left with right's other columns; exact matches count; of equal right dates the row with the largest values.

    Both sides go through one window over (by, date): right rows come first on equal dates and travel as one struct, so a
    NULL field of the latest row does not let an older value through, and nothing is joined.
    """
    keys = [by] if by else []
    cols = [c for c in right.columns if c not in keys]
    row = F.struct(*cols)
    l = left.select(*(F.col(c) for c in keys), F.col(left_on).alias("_d"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_left"), F.lit(None).cast(right.select(row.alias("r")).schema[0].dataType).alias("_right"))
    r = right.where(F.col(right_on).isNotNull()).select(*keys, F.col(right_on).alias("_d"), F.lit(0).alias("_side"), F.lit(None).cast(left.select(F.struct(*left.columns).alias("l")).schema[0].dataType).alias("_left"), row.alias("_right"))
    over = Window.partitionBy(*keys).orderBy("_d", "_side", "_right").rowsBetween(Window.unboundedPreceding, 0)
    seen = l.unionByName(r).withColumn("_right", F.last("_right", ignorenulls=True).over(over)).where("_side = 1")
    return seen.select("_left.*", *(F.col(f"_right.{c}").alias(c) for c in cols if c not in left.columns))
