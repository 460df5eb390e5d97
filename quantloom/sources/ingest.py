"""Readers and checks of price and factor tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantloom.functions.codes import normalize_code
from quantloom.schema import PRICE_COLUMNS, missing_to_null, require_columns

#: Column names of a raw daily-history source.
RAW_NAMES = {"日期": "date", "开盘": "open", "最高": "high", "最低": "low", "收盘": "close", "成交量": "volume", "成交额": "amount"}
MEASURES = PRICE_COLUMNS[2:]


def read_prices(spark: SparkSession, path: str, format: str = "csv", strict: bool = True) -> DataFrame:
    """Prices with typed columns; strict: bad numbers, dates, codes, duplicate keys and prices that are not positive raise."""
    raw = spark.read.option("header", True).csv(path) if format == "csv" else spark.read.format(format).load(path)
    prices = standardize(require_columns(raw, PRICE_COLUMNS, "price data"), strict)
    return check_prices(prices) if strict else prices


def standardize(raw: DataFrame, strict: bool = True) -> DataFrame:
    """The price columns (and amount, if there) as date, six-digit code and doubles."""
    raw = raw.withColumnsRenamed({k: v for k, v in RAW_NAMES.items() if k in raw.columns})
    kind = lambda c, t: F.col(c).cast(t) if strict else F.col(c).try_cast(t)
    extra = ["amount"] if "amount" in raw.columns else []
    return missing_to_null(raw.select(kind("date", "date").alias("date"), normalize_code(F.col("stock")).alias("stock"), *(kind(c, "double").alias(c) for c in [*MEASURES, *extra])))


def validation_report(prices: DataFrame) -> DataFrame:
    """One row: rows, repeated keys, closes that are not positive, negative volumes and rows with missing values. One pass with a partial aggregate by key."""
    missing = F.greatest(*(F.col(c).isNull().cast("int") for c in MEASURES))
    keys = prices.groupBy("date", "stock").agg(F.count("*").alias("n"), F.count_if(F.col("close") <= 0).alias("c"), F.count_if(F.col("volume") < 0).alias("v"), F.sum(missing).alias("m"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return keys.agg(total("n").alias("n_rows"), total(F.col("n") - 1).alias("duplicate_keys"), total("c").alias("bad_close"), total("v").alias("bad_volume"), total("m").alias("missing"))


def check_prices(prices: DataFrame) -> DataFrame:
    """prices, or a ValueError for an empty table, repeated keys, closes that are not positive or negative volumes."""
    r = validation_report(prices).first()
    if not r.n_rows:
        raise ValueError("price data must not be empty")
    for n, what in ((r.duplicate_keys, "duplicate (date, stock) keys"), (r.bad_close, "close prices that are not positive"), (r.bad_volume, "negative volumes")):
        if n:
            raise ValueError(f"price data holds {n} {what}")
    return prices


def remove_invalid(prices: DataFrame) -> DataFrame:
    """Rows with all prices and the volume, a positive close and no negative volume."""
    whole = F.lit(True)
    for c in MEASURES:
        whole = whole & F.col(c).isNotNull()
    return prices.where(whole & (F.col("close") > 0) & (F.col("volume") >= 0))


def keep_last(df: DataFrame, keys: Sequence[str], *order: str) -> DataFrame:
    """The last row of each key by `order`."""
    over = Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in order))
    return df.withColumn("_n", F.row_number().over(over)).where("_n = 1").drop("_n")


def coverage(prices: DataFrame, start: str, end: str, slack: int = 7, least: int = 2, late_least: int | None = None) -> DataFrame:
    """By stock: rows, first and last date, and whether they cover the range up to `slack` days. late_least: a stock with as many rows may begin later (it was listed after the start); leave it out for imported tables."""
    lo, hi = F.date_add(F.lit(start).cast("date"), slack), F.date_sub(F.lit(end).cast("date"), slack)
    out = prices.groupBy("stock").agg(F.count("*").alias("n"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))
    begun = F.col("first_date") <= lo
    if late_least is not None:
        begun = begun | (F.col("n") >= late_least)
    return out.withColumn("covered", (F.col("n") >= least) & begun & (F.col("last_date") >= hi))


#: Fixed value: rows that a download must have to pass for a late listing.
LATE_LISTING_ROWS = 161


def with_amount(prices: DataFrame) -> DataFrame:
    """prices with amount = close * volume where the source has none."""
    product = F.col("close") * F.col("volume")
    return prices.withColumn("amount", F.coalesce("amount", product) if "amount" in prices.columns else product)


def read_cached(spark: SparkSession, path: str) -> DataFrame:
    """A price cache with its sidecar, which Spark reads as well (path with .json in place of its suffix): refused unless the sidecar names a real source."""
    side = spark.read.option("multiLine", True).json(path.rsplit(".", 1)[0] + ".json").first()
    require_real(side.asDict())
    return read_prices(spark, path)


def read_factors(spark: SparkSession, path: str, factors: Sequence[str] | None = None) -> DataFrame:
    """A factor table in any of the three formats as (date, stock, factor_name, factor_value, return, ...); an absent factor raises."""
    raw = spark.read.option("header", True).csv(path)
    if "factor" in raw.columns and "factor_value" not in raw.columns:
        raw = raw.withColumnRenamed("factor", "factor_value").withColumn("factor_name", F.lit("factor"))
    require_columns(raw, ["date", "stock", "factor_name", "factor_value", "return"], "factor data")
    numbers = ["factor_value", "return", *(c for c in raw.columns if c.startswith("forward_return_"))]
    df = missing_to_null(raw.select(F.col("date").cast("date").alias("date"), normalize_code(F.col("stock")).alias("stock"), "factor_name", *(F.col(c).try_cast("double").alias(c) for c in numbers)))
    if factors is not None:
        df = df.where(F.col("factor_name").isin(*factors))
        absent = sorted(set(factors) - {r[0] for r in df.select("factor_name").distinct().collect()})
        if absent:
            raise ValueError(f"factors not found: {absent}")
    return df


def require_real(metadata: dict) -> None:
    """Refuses a cache whose sidecar does not name a real source."""
    if metadata.get("is_real_data") is not True or metadata.get("source") == "mock":
        raise ValueError("the cache does not come from a real source")


def load_with_fallback(loaders: Sequence[tuple[str, Callable[[], DataFrame]]]) -> DataFrame:
    """The first loader's frame that works, with its name in data_source; all errors are told if none does."""
    failed = []
    for name, load in loaders:
        try:
            df = load()
            if not df.isEmpty():
                return df.withColumn("data_source", F.lit(name))
            failed.append(f"{name}: empty")
        except Exception as e:  # noqa: BLE001 the next source may work
            failed.append(f"{name}: {e}")
    raise RuntimeError("no source gave data: " + "; ".join(failed))


def load_prices(loaders: Sequence[tuple[str, Callable[[], DataFrame]]], mock: Callable[[], DataFrame] | None) -> DataFrame:
    """load_with_fallback with mock data as the last resort; mock=None: an error instead."""
    return load_with_fallback([*loaders, ("mock", mock)] if mock is not None else loaders)


def _business_days(start, end):
    return F.filter(F.sequence(start, end), lambda d: F.weekday(d) < 5)


#: The generator of mock prices (multiplier, increment, modulus) and its ranges.
MOCK_STEP, MOCK_ADD, MOCK_RANGE = 1664525, 1013904223, 2**32


def mock_prices(codes: DataFrame, start: str, end: str) -> DataFrame:
    """Repeatable prices of business days for each stock of codes: five draws of a linear congruential generator a day, run as one array fold a stock. For demonstrations and tests."""
    lit = F.lit
    seed = F.conv(F.substring(F.sha2(F.col("stock").cast("binary"), 256), 1, 8), 16, 10).cast("long")
    numbers = "struct<date:date,open:double,high:double,low:double,close:double,volume:double>"
    first = F.struct(F.greatest(seed, lit(1)).cast("long").alias("s"), (lit(20.0) + (seed % 8000) / 100.0).alias("p"), F.array().cast(f"array<{numbers}>").alias("out"))

    def day(acc, d):
        states = [acc["s"]]
        for _ in range(5):
            states.append((states[-1] * MOCK_STEP + MOCK_ADD) % MOCK_RANGE)
        u = [x / float(MOCK_RANGE) for x in states[1:]]
        open_, close = acc["p"] * (1 + (u[1] - 0.5) * 0.012), acc["p"] * (1 + (u[0] - 0.49) * 0.04)
        high, low = F.greatest(open_, close) * (1 + u[2] * 0.012), F.least(open_, close) * (1 - u[3] * 0.012)
        volume = F.floor(500_000 + u[4] * 9_500_000).cast("double")
        row = F.struct(d.alias("date"), *(F.bround(c, 2).alias(n) for c, n in ((open_, "open"), (high, "high"), (low, "low"), (close, "close"))), volume.alias("volume"))
        return F.struct(states[5].cast("long").alias("s"), close.alias("p"), F.concat(acc["out"], F.array(row)).alias("out"))

    days = _business_days(lit(start).cast("date"), lit(end).cast("date"))
    made = codes.select("stock", F.aggregate(days, first, day, lambda acc: acc["out"]).alias("rows"))
    return made.select("stock", F.inline("rows")).select("date", "stock", "open", "high", "low", "close", "volume", lit("mock").alias("data_source"))


#: Level, seed's divisor, swing and period of the mock fundamentals.
MOCK_FUNDAMENTALS = {"pe": (12.0, 10.0, 3.0, 23.0), "pb": (1.5, 100.0, 0.4, 31.0), "roe": (8.0, 12.0, 2.0, 63.0)}


def mock_fundamentals(codes: DataFrame, end: str, days: int = 252) -> DataFrame:
    """Repeatable pe, pb and roe of each stock over the last business days; nothing was ever announced, so nothing is point in time."""
    last = F.lit(end).cast("date")
    calendar = F.slice(_business_days(F.date_sub(last, 2 * days), last), F.lit(-days), F.lit(days))
    rows = codes.select("stock", F.posexplode(calendar).alias("i", "date"))
    seed = F.col("stock").cast("long") % 97
    values = [F.bround(level + seed / part + swing * F.sin(F.col("i") / period), 4).alias(n) for n, (level, part, swing, period) in MOCK_FUNDAMENTALS.items()]
    none = [F.lit(None).cast("date").alias(n) for n in ("report_period", "announcement_date", "available_date")]
    return rows.select("date", "stock", *values, *none, F.col("date").alias("factor_date"), F.lit(False).alias("point_in_time_available"), F.lit("synthetic_no_announcement_date").alias("data_quality"), F.lit("mock").alias("data_source"))
