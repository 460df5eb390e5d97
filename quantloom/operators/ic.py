"""Information coefficients: daily series, summaries, decay over horizons, stability and HAC significance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.stats import average_rank, ratio, rolling, safe_corr

TINY = 1e-12


def stack_horizons(df: DataFrame, value: str, horizons: tuple[int, ...], extra: tuple[str, ...] = ()) -> DataFrame:
    """date, stock, factor_name, extra, x (the value), period, y (that horizon's forward return); pairs with a missing side go."""
    ids = ["date", "stock", "factor_name", *extra, value]
    cols = {f"forward_return_{h}d": h for h in horizons}
    long = df.select(*ids, *cols).unpivot(ids, list(cols), "_h", "y").where(F.col(value).isNotNull() & F.col("y").isNotNull())
    return long.select("date", "stock", "factor_name", *extra, F.col(value).alias("x"), F.regexp_extract("_h", r"(\d+)", 1).cast("int").alias("period"), "y")


def daily_ic(df: DataFrame, value: str = "factor_value", horizons: tuple[int, ...] = (5,), extra: tuple[str, ...] = (), guarded: bool = True, ranks: bool = True) -> DataFrame:
    """date, factor_name, period, extra, n, ic and, unless ranks is false, rank_ic (which costs two sorts).

    Guarded: days need two pairs and two distinct values on either side, others go. Values are rounded to twelve places: a
    sign must not hang on the order of summation.
    """
    pairs = stack_horizons(df, value, horizons, extra)
    keys = ("date", "factor_name", "period", *extra)
    names = ["ic"]
    columns = [F.count("*").alias("n"), F.round(safe_corr("x", "y"), 12).alias("ic")]
    if ranks:
        pairs = pairs.withColumns({"rx": average_rank("x", *keys), "ry": average_rank("y", *keys)})
        columns.append(F.round(safe_corr("rx", "ry"), 12).alias("rank_ic"))
        names.append("rank_ic")
    out = pairs.groupBy(*keys).agg(*columns, F.max("x").alias("_hx"), F.min("x").alias("_lx"), F.max("y").alias("_hy"), F.min("y").alias("_ly"))
    if guarded:  # two distinct values: the extremes differ
        out = out.where("n >= 2 and _hx > _lx and _hy > _ly").dropna(subset=names)
    return out.drop("_hx", "_lx", "_hy", "_ly")


def daily_columns() -> list[Column]:
    """What daily_ic() sums of the ranked pairs (x, y, rx, ry) of a day, as one set of aggregates; _guarded: two pairs and two distinct values on either side."""
    two = (F.count("*") >= 2) & (F.max("x") > F.min("x")) & (F.max("y") > F.min("y"))
    return [F.round(safe_corr("x", "y"), 12).alias("ic"), F.round(safe_corr("rx", "ry"), 12).alias("rank_ic"), two.alias("_guarded")]


def summary_columns(ic: str = "ic", rank_ic: str = "rank_ic") -> list[Column]:
    n, r = F.count(rank_ic), F.col(rank_ic)
    spread = F.stddev_samp(r)
    return [
        F.avg(ic).alias("mean_ic"), F.avg(r).alias("mean_rank_ic"), F.stddev_samp(ic).alias("ic_std"), spread.alias("rank_ic_std"),
        F.when(F.stddev_samp(ic) > TINY, F.avg(ic) / F.stddev_samp(ic)).otherwise(0.0).alias("icir"), F.when(spread > TINY, F.avg(r) / spread).otherwise(0.0).alias("rank_icir"),
        F.avg((r > 0).cast("double")).alias("positive_ic_ratio"), F.when(spread > TINY, F.avg(r) / (spread / F.sqrt(n))).otherwise(0.0).alias("t_stat"), n.alias("observations"),
    ]


def ic_summary(ic: DataFrame, *keys: str) -> DataFrame:
    return ic.groupBy(*keys).agg(*summary_columns())


def ic_decay(df: DataFrame, value: str, horizons: tuple[int, ...]) -> DataFrame:
    """The summary of each (factor, horizon) in one pass over the stacked horizons."""
    return ic_summary(daily_ic(df, value, horizons), "factor_name", "period")


def yearly_ic(df: DataFrame, value: str, horizon: int = 5) -> DataFrame:
    """The summary by (factor, year) with trading days and the average cross-section."""
    daily = daily_ic(df, value, (horizon,)).withColumn("year", F.year("date"))
    return daily.groupBy("factor_name", "year").agg(*summary_columns(), F.count_distinct("date").alias("effective_trading_days"), F.avg("n").alias("average_cross_section_size"))


def stability(yearly: DataFrame, full: DataFrame) -> DataFrame:
    """By factor: share of years with the full period's sign, best and worst year, spread over years, and stability score."""
    joined = yearly.select("factor_name", "year", "mean_rank_ic").join(full.select("factor_name", F.col("mean_rank_ic").alias("full_ic")), "factor_name")
    same = (F.signum("mean_rank_ic") == F.signum("full_ic")).cast("double")
    out = joined.groupBy("factor_name").agg(F.max("full_ic").alias("full_ic"), F.avg(same).alias("same_sign_ratio"), F.max_by("year", F.struct("mean_rank_ic", -F.col("year"))).alias("best_year"), F.min_by("year", F.struct("mean_rank_ic", "year")).alias("worst_year"), F.stddev_samp("mean_rank_ic").alias("yearly_std"))
    return out.withColumn("stability_score", F.col("same_sign_ratio") * ratio(F.abs("full_ic"), "yearly_std"))


def ic_ranking(df: DataFrame, value: str = "factor_value", horizon: int = 5) -> DataFrame:
    """Factors with at least two securities by size of ICIR, ties by name, with their place."""
    several = df.where(F.col(value).isNotNull()).groupBy("factor_name").agg(F.min("stock").alias("a"), F.max("stock").alias("b")).where("a < b").select("factor_name")
    s = ic_summary(daily_ic(df.join(F.broadcast(several), "factor_name"), value, (horizon,)), "factor_name")  # one row a factor
    place = F.row_number().over(Window.orderBy(F.abs("icir").desc(), "factor_name"))
    return s.select(place.cast("long").alias("place"), "factor_name", "mean_ic", "ic_std", "icir", "mean_rank_ic", "observations")


def rolling_rank_ic(ic: DataFrame, sizes: tuple[int, ...] = (60, 120), least: int | None = None) -> DataFrame:
    """ic with rolling means of rank_ic by factor and the share of days in each window with a positive sign."""
    over = Window.partitionBy("factor_name").orderBy("date")
    return ic.withColumns({**{f"rolling_{n}": rolling(F.avg, "rank_ic", over, n, least) for n in sizes}, **{f"positive_{n}": rolling(F.avg, (F.col("rank_ic") > 0).cast("double"), over, n, least) for n in sizes}})


def hac_mean(ic: DataFrame, value: str, lag: str | int, *keys: str) -> DataFrame:
    """The mean of a dated series by keys and its Newey-West t statistic (Bartlett weights up to `lag`), without a self-join: a series is at most one number a day."""
    m = ic.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("date", F.col(value).alias("v")))), lambda s: s.v).alias("s"), F.avg(value).alias("mean"))
    m = m.withColumn("n", F.size("s")).withColumn("u", F.transform("s", lambda v: v - F.col("mean"))).withColumn("_lag", F.least((F.col(lag) if isinstance(lag, str) else F.lit(lag)).cast("int"), F.col("n") - 1))
    zero = F.lit(0.0)

    def auto(k: Column) -> Column:
        products = F.zip_with(F.slice("u", k + 1, F.col("n") - k), F.slice("u", F.lit(1), F.col("n") - k), lambda a, b: a * b)
        return F.aggregate(products, zero, lambda a, x: a + x) / F.col("n")

    gamma0 = F.aggregate(F.transform("u", lambda x: x * x), zero, lambda a, x: a + x) / F.col("n")
    weighted = F.when(F.col("_lag") >= 1, F.aggregate(F.transform(F.sequence(F.lit(1), F.greatest("_lag", F.lit(1))), lambda k: 2 * (1 - k / (F.col("_lag") + 1)) * auto(k)), zero, lambda a, x: a + x)).otherwise(zero)
    m = m.withColumn("long_run", F.greatest(gamma0 + weighted, zero))
    return m.select(*keys, F.col("n").cast("long").alias("observations"), "mean", F.when(F.col("long_run") > 0, F.col("mean") / F.sqrt(F.col("long_run") / F.col("n"))).otherwise(0.0).alias("hac_t_stat"))
