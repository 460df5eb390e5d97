"""Column contracts and missing values."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

PRICE_COLUMNS = ["date", "stock", "open", "high", "low", "close", "volume"]
PRICE_SCHEMA = T.StructType([T.StructField("date", T.DateType()), T.StructField("stock", T.StringType()), *(T.StructField(c, T.DoubleType()) for c in PRICE_COLUMNS[2:])])
FACTOR_COLUMNS = ["date", "stock", "factor_name", "factor_value", "return"]
HORIZONS = (1, 5, 10, 20, 40)


def by_stock() -> WindowSpec:
    """The window over one security's history."""
    return Window.partitionBy("stock").orderBy("date")


def require_columns(df: DataFrame, names: Iterable[str], what: str = "data") -> DataFrame:
    """df, or a ValueError that names the missing columns in order."""
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"{what} is missing columns: {missing}")
    return df


def missing_to_null(df: DataFrame) -> DataFrame:
    """Floating-point NaN becomes NULL, the only missing value in this library."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, T.DoubleType | T.FloatType)]
    return df.withColumns({c: F.nanvl(F.col(c), F.lit(None).cast("double")) for c in floats}) if floats else df


def number(c: str | Column, strict: bool = True) -> Column:
    """A column as double: strict fails on what is no number, else it becomes NULL."""
    c = F.col(c) if isinstance(c, str) else c
    return c.cast("double") if strict else c.try_cast("double")


def forward_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.startswith("forward_return_")]
