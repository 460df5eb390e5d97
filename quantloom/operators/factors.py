"""Technical, value and quality factors, forward returns, the long factor table and factor directions.

All columns keyed by security are computed over one window, so a plan has one exchange by stock before the unpivot.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.functions.stats import ratio, rolling
from quantloom.schema import HORIZONS, by_stock, require_columns

TECHNICAL = ("momentum_20", "momentum_60", "volatility_20", "volatility_60", "volume_change_20")


@dataclass(frozen=True)
class FactorInfo:
    name: str
    category: str
    higher_is_better: bool = True
    weight: float = 1.0


_REGISTRY: dict[str, FactorInfo] = {}


def register_factor(info: FactorInfo) -> None:
    """Adds or replaces a factor's description."""
    _REGISTRY[info.name] = info


for _name in ("momentum", "momentum_20", "momentum_60", "momentum_120"):
    register_factor(FactorInfo(_name, "momentum"))
for _name in ("volatility", "volatility_10", "volatility_20", "volatility_40", "volatility_60"):
    register_factor(FactorInfo(_name, "volatility", higher_is_better=False))
for _name in ("volume_factor", "volume_change_20"):
    register_factor(FactorInfo(_name, "volume"))
for _name in ("pe_factor", "pb_factor"):
    register_factor(FactorInfo(_name, "value"))
register_factor(FactorInfo("roe_factor", "quality"))


def factor_info(name: str) -> FactorInfo:
    """A factor's description; unknown factors count as better when higher."""
    return _REGISTRY.get(name, FactorInfo(name, "other"))


def lower_is_better() -> list[str]:
    return sorted(n for n, i in _REGISTRY.items() if not i.higher_is_better)


def momentum(n: int) -> Column:
    return ratio("close", F.lag("close", n).over(by_stock())) - 1


def daily_return() -> Column:
    return ratio("close", F.lag("close").over(by_stock())) - 1


def forward_return(n: int) -> Column:
    if not isinstance(n, int) or n <= 0:
        raise ValueError("period must be a positive integer")
    return ratio(F.lead("close", n).over(by_stock()), "close") - 1


def with_volatility(df: DataFrame, *sizes: int) -> DataFrame:
    """Adds volatility_n for each n: the sample deviation of n daily returns."""
    df = df.withColumn("_r", daily_return())
    return df.withColumns({f"volatility_{n}": rolling(F.stddev_samp, "_r", by_stock(), n) for n in sizes}).drop("_r")


def volume_change(n: int) -> Column:
    return ratio("volume", rolling(F.avg, "volume", by_stock(), n))


def technical_factors(prices: DataFrame, horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    """prices with the five technical factors and forward returns."""
    require_columns(prices, ["date", "stock", "close", "volume"], "prices")
    wide = prices.withColumns({"momentum_20": momentum(20), "momentum_60": momentum(60), "volume_change_20": volume_change(20), **{f"forward_return_{h}d": forward_return(h) for h in horizons}})
    return with_volatility(wide, 20, 60)


def legacy_factors(prices: DataFrame) -> DataFrame:
    """The three factors of the first table format: momentum, volatility, volume_factor, and the next period's return."""
    df = prices.withColumns({"momentum": momentum(20), "volume_factor": volume_change(20) - 1, "return": forward_return(1)})
    return with_volatility(df, 20).withColumnRenamed("volatility_20", "volatility")


def value_factors(df: DataFrame) -> DataFrame:
    """pe_factor and pb_factor: reciprocals where positive."""
    return df.withColumns({f"{c}_factor": F.when(F.col(c) > 0, ratio(F.lit(1.0), c)) for c in ("pe", "pb")})


def quality_factor(df: DataFrame) -> DataFrame:
    return df.withColumn("roe_factor", F.col("roe").cast("double"))


def to_long(wide: DataFrame, factors: tuple[str, ...] = TECHNICAL, target: str = "forward_return_5d", extra: tuple[str, ...] = ()) -> DataFrame:
    """One row a (date, stock, factor), with the columns of extra: rows without a value or without the target return go. By a generator, which keeps the partitions of wide; an unpivot would hide them."""
    ids = [c for c in wide.columns if c in ("date", "stock", *extra) or c.startswith("forward_return_")]
    pairs = F.array(*(F.struct(F.lit(f).alias("factor_name"), F.col(f).alias("factor_value")) for f in factors))
    long = wide.select(*ids, F.inline(pairs))
    return long.where(F.col("factor_value").isNotNull() & F.col(target).isNotNull()).withColumn("return", F.col(target))


def directed(value: str = "normalized_value", name: str = "factor_name") -> Column:
    """A factor's value with its sign turned so that higher is better."""
    return F.when(F.col(name).isin(lower_is_better()), -F.col(value)).otherwise(F.col(value))
