"""Walk-forward evaluation: folds, weights from training days only, portfolios of test days, all folds and methods in one plan.

Daily ICs are computed once for each (date, factor); folds meet that small series, not the panel, to give weights. A
panel row belongs to one test fold, so test portfolios replicate nothing but the methods.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.operators.ic import TINY, daily_ic
from quantloom.operators.metrics import walk_forward_metrics
from quantloom.sources.store import dealt, materialize

METHODS = ("equal_weight", "static_weight", "rolling_ic_weight", "rolling_icir_weight")


@dataclass(frozen=True)
class WalkForwardConfig:
    train_window: int = 756
    test_window: int = 126
    min_train: int = 252
    transaction_cost: float = 0.001
    mode: str = "rolling"


def folds(df: DataFrame, config: WalkForwardConfig, by: tuple[str, ...] = ()) -> DataFrame:
    """by, fold, train_start, train_end, test_start, test_end; strictly non-overlapping test periods. df: by and date, whose distinct rows are the calendar (one row a date)."""
    if config.mode not in ("rolling", "expanding"):
        raise ValueError("mode must be 'rolling' or 'expanding'")
    days = df.select(*by, "date").where("date is not null").distinct()
    calendar = days.select(*by, "date", (F.row_number().over(Window.partitionBy(*by).orderBy("date")) - 1).alias("i"))
    fold = F.floor((F.col("i") - config.min_train) / config.test_window).cast("int")
    tests = calendar.where(F.col("i") >= config.min_train).groupBy(*by, fold.alias("fold")).agg(F.min("date").alias("test_start"), F.max("date").alias("test_end"), F.min("i").alias("first"))
    start = F.lit(0) if config.mode == "expanding" else F.greatest(F.lit(0), F.col("first") - config.train_window)
    spans = tests.withColumns({"_a": start, "_b": F.col("first") - 1})
    for place, name in (("_a", "train_start"), ("_b", "train_end")):
        spans = spans.join(F.broadcast(calendar.select(*by, F.col("i").alias(place), F.col("date").alias(name))), [*by, place])  # one row a date
    return spans.where(F.col("_b") - F.col("_a") + 1 >= config.min_train).select(*by, "fold", "train_start", "train_end", "test_start", "test_end")


def fold_days(days: DataFrame, fold_table: DataFrame, part: str = "test", by: tuple[str, ...] = ()) -> DataFrame:
    """by, date, fold: the days of each fold's test or training period. Both sides are small (a row a date, a row a fold); what is longer meets the result by equality."""
    f = fold_table.select(*by, "fold", F.col(f"{part}_start").alias("_a"), F.col(f"{part}_end").alias("_b"))
    inside = F.col("date").between(F.col("_a"), F.col("_b"))
    days = days.select(*by, "date").distinct()
    met = days.join(F.broadcast(f), list(by)).where(inside) if by else days.join(F.broadcast(f), inside)
    return met.drop("_a", "_b")


def fold_weights(ic: DataFrame, fold_table: DataFrame, methods: tuple[str, ...] = METHODS, static: dict[str, float] | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """by, fold, method, factor_name, weight: signed mean or mean over deviation of the training days' ICs, over the sum of sizes; equal weights if all are nothing."""
    train = ic.join(F.broadcast(fold_days(ic, fold_table, "train", by)), [*by, "date"])  # one row a fold and training day
    s = train.groupBy(*by, "fold", "factor_name").agg(F.avg("ic").alias("m"), F.stddev_samp("ic").alias("d"))
    given = F.lit(1.0)
    if static:
        given = F.coalesce(F.element_at(F.create_map(*(x for k, v in sorted(static.items()) for x in (F.lit(k), F.lit(float(v))))), F.col("factor_name")), F.lit(0.0))
    signal = {"equal_weight": F.lit(1.0), "static_weight": given, "rolling_ic_weight": F.coalesce("m", F.lit(0.0)), "rolling_icir_weight": F.when(F.col("d") > TINY, F.coalesce(F.col("m") / F.col("d"), F.lit(0.0))).otherwise(0.0)}
    long = s.select(*by, "fold", "factor_name", F.inline(F.array(*(F.struct(F.lit(m).alias("method"), signal[m].alias("s")) for m in methods))))
    over = Window.partitionBy(*by, "fold", "method")
    total = F.sum(F.abs("s")).over(over)
    return long.select(*by, "fold", "method", "factor_name", F.when(total <= TINY, 1.0 / F.count("*").over(over)).otherwise(F.col("s") / total).alias("weight"))


def stock_rows(df: DataFrame, factors: tuple[str, ...], value: str = "directed_value", target: str = "forward_return_1d", by: tuple[str, ...] = ()) -> DataFrame:
    """by, date, stock, _v0, _v1, ... (the factors' values) and r: one row for all factors of a (date, stock), whose target is the same."""
    each = (F.sum(F.when(F.col("factor_name") == f, F.col(value))).alias(f"_v{i}") for i, f in enumerate(factors))
    return df.groupBy(*by, "date", "stock").agg(*each, F.max(target).alias("r"))


def portfolio(rows: DataFrame, days: DataFrame, weights: DataFrame, factors: tuple[str, ...], by: tuple[str, ...] = (), top: float | tuple[float, ...] = 0.2, cost_rate: float = 0.001) -> DataFrame:
    """by, fold, method, date, gross, benchmark, turnover, cost, net of the stocks whose score is at or above the day's (1 - top) quantile. rows: of stock_rows(); days: by, date, fold; weights: by, fold, method, factor_name, weight (both small). Several tops give a row each, with the column top: scores and quantiles are made once.

    A stock's row is dealt out by date before it becomes one for each fold and method, so those are never shuffled."""
    keys = (*by, "fold", "method")
    known = weights.groupBy(*keys).agg(*(F.max(F.when(F.col("factor_name") == f, F.col("weight"))).alias(f"_w{i}") for i, f in enumerate(factors)))
    met = dealt(rows, *by, "date").join(F.broadcast(days), [*by, "date"]).join(F.broadcast(known), [*by, "fold"])  # a row a fold and day, and a fold and method
    parts = [F.col(f"_w{i}") * F.col(f"_v{i}") for i in range(len(factors))]
    score = F.when(F.coalesce(*parts).isNotNull(), sum((F.coalesce(p, F.lit(0.0)) for p in parts[1:]), F.coalesce(parts[0], F.lit(0.0)))) if parts else F.lit(None).cast("double")
    scored = met.select(*keys, "date", "stock", score.alias("score"), "r").where("score is not null and r is not null")
    day = Window.partitionBy(*keys, "date")
    if isinstance(top, tuple):
        marked = scored.withColumn("_cuts", F.percentile("score", [1 - t for t in top]).over(day))
        marked = marked.select("*", F.inline(F.array(*(F.struct(F.lit(t).alias("top"), F.col("_cuts")[i].alias("_cut")) for i, t in enumerate(top)))))
        keys = (*keys, "top")
    else:
        marked = scored.withColumn("_cut", F.percentile("score", 1 - top).over(day))
    held = marked.withColumn("held", F.col("score") >= F.col("_cut"))
    daily = held.groupBy(*keys, "date").agg(F.avg(F.when(F.col("held"), F.col("r"))).alias("gross"), F.avg("r").alias("benchmark"), F.collect_set(F.when(F.col("held"), F.col("stock"))).alias("holding"))
    order = Window.partitionBy(*keys).orderBy("date")
    before = F.lag("holding").over(order)
    changed = (F.size(F.array_except("holding", before)) + F.size(F.array_except(before, "holding"))) / F.greatest(F.size("holding") + F.size(before), F.lit(1))
    daily = daily.withColumn("turnover", F.when(before.isNull(), 1.0).otherwise(changed))
    return daily.withColumn("cost", F.col("turnover") * cost_rate).withColumn("net", F.col("gross") - F.col("cost")).drop("holding")


def walk_forward(df: DataFrame, config: WalkForwardConfig = WalkForwardConfig(), methods: tuple[str, ...] = METHODS, value: str = "directed_value", target: str = "forward_return_1d", in_sample: bool = False, static: dict[str, float] | None = None, top: float | tuple[float, ...] = 0.2, by: tuple[str, ...] = (), ic: DataFrame | None = None, factors: tuple[str, ...] | None = None) -> DataFrame:
    """by, fold, method, date, gross, benchmark, turnover, cost, net of the test days (or, in_sample, of the training days).

    df has one row a (by, date, stock, factor). Without by it is read once, to store stock_rows() (a plan whose rows are dealt
    out by date is stored without a shuffle of its own), and once before for the factors' names unless they are given; with
    by pass a stored table. by: keys of independent walks in one plan, such as models; ic: daily ICs by them, where they need
    not be made of df.
    """
    horizon = int(target.removeprefix("forward_return_").removesuffix("d"))
    names = tuple(sorted(r.factor_name for r in df.select("factor_name").where("factor_name is not null").distinct().collect())) if factors is None else factors  # one row a factor
    rows = stock_rows(df, names, value, target, by)
    rows = rows if by else materialize(rows, "stocks")
    days = materialize(rows.select(*by, "date").distinct(), "calendar")
    table = folds(days, config, by)
    if ic is None:
        each = F.array(*(F.struct(F.lit(f).alias("factor_name"), F.col(f"_v{i}").alias(value)) for i, f in enumerate(names)))
        ic = daily_ic(rows.select(*by, "date", "stock", F.col("r").alias(target), F.inline(each)), value, (horizon,), by, ranks=False) if names else daily_ic(df, value, (horizon,), by, ranks=False)
    weights = materialize(fold_weights(ic, table, methods, static, by), "weights")
    return portfolio(rows, fold_days(days, table, "train" if in_sample else "test", by), weights, names, by, top, config.transaction_cost)


def summarize(daily: DataFrame, *keys: str) -> DataFrame:
    return walk_forward_metrics(daily, *keys)


__all__ = ["METHODS", "WalkForwardConfig", "fold_days", "fold_weights", "folds", "portfolio", "stock_rows", "summarize", "walk_forward"]
