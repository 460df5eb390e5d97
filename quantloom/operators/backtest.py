"""Portfolio backtest: rebalancing, trade constraints, costs and benchmark.

Everything is set-based but the constraints' recursion: what a stock holds after a rebalance depends on what it held
before. That runs as one array fold over a stock's rebalances, which are as many as the calendar has, not as the panel.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.operators.factors import daily_return
from quantloom.operators.universe import executed
from quantloom.sources.store import materialize

FLAGS = ("is_suspended", "limit_up", "limit_down", "is_st")


def target_weights(scores: DataFrame, top: float = 0.2, mode: str = "long_only") -> DataFrame:
    """date, stock, weight: the best max(1, ceil(n * top)) stocks of each date in equal parts, ties by code."""
    if mode == "long_short":
        raise NotImplementedError("long_short portfolios are not available")
    if mode != "long_only":
        raise ValueError("mode must be 'long_only' or 'long_short'")
    if not 0 < top <= 1:
        raise ValueError("the top fraction must lie in (0, 1]")
    ok = scores.where("score is not null")
    day = Window.partitionBy("date")
    ranked = ok.withColumns({"_i": F.row_number().over(day.orderBy(F.desc("score"), "stock")), "_k": F.greatest(F.lit(1), F.ceil(F.count("*").over(day) * F.lit(top)))})
    return ranked.where("_i <= _k").select("date", "stock", (1.0 / F.col("_k")).alias("weight"))


def rebalance_dates(prices: DataFrame, warm_up: int = 65, period: int = 20) -> DataFrame:
    """date, i: every period-th date of the calendar (one row a date) after warm_up dates."""
    days = prices.select("date").distinct().select("date", (F.row_number().over(Window.orderBy("date")) - 1).alias("i"))
    return days.where((F.col("i") >= warm_up) & ((F.col("i") - warm_up) % period == 0))


def executed_weights(targets: DataFrame, dates: DataFrame, state: DataFrame) -> DataFrame:
    """date, stock, weight after each rebalance under the trade constraints; state: date, stock and whichever of FLAGS and volume there are."""
    stocks = targets.select("stock").distinct()
    flags = [F.coalesce(F.col(f).cast("boolean"), F.lit(False)).alias(f) if f in state.columns else F.lit(False).alias(f) for f in FLAGS]
    halted = (F.coalesce(F.col("volume"), F.lit(0.0)) <= 0) if "volume" in state.columns else F.lit(False)
    known = state.select("date", "stock", *flags, halted.alias("_h")).withColumn("is_suspended", F.col("is_suspended") | F.col("_h")).drop("_h")
    grid = stocks.join(F.broadcast(dates.select("date")))  # a calendar, one row a rebalance
    rows = grid.join(targets, ["date", "stock"], "left").join(known, ["date", "stock"], "left").na.fill({"weight": 0.0, **dict.fromkeys(FLAGS, False)})
    steps = rows.groupBy("stock").agg(F.array_sort(F.collect_list(F.struct("date", F.col("weight").alias("t"), *FLAGS))).alias("s"))
    start = F.struct(F.lit(0.0).alias("p"), F.array().cast("array<struct<date:date,weight:double>>").alias("out"))

    def step(acc, x):
        w = executed(acc["p"], x["t"], x["is_suspended"], x["limit_up"], x["limit_down"], x["is_st"])
        return F.struct(w.alias("p"), F.concat(acc["out"], F.array(F.struct(x["date"].alias("date"), w.alias("weight")))).alias("out"))

    return steps.select("stock", F.inline(F.aggregate("s", start, step, lambda acc: acc["out"]))).select("date", "stock", "weight")


def backtest(prices: DataFrame, scores: DataFrame, benchmark: DataFrame | None = None, top: float = 0.2, period: int = 20, warm_up: int = 65, cost_rate: float = 0.001, constrained: bool = True) -> DataFrame:
    """date, gross, turnover, cost, portfolio_return, benchmark_return of the invested days.

    Weights of a rebalance hold from the next date until the one after the next rebalance, without drift; turnover counts
    both sides. prices is read twice or three times: pass a stored table.
    """
    days = materialize(prices.select("date").distinct(), "calendar")
    dates = rebalance_dates(days, warm_up, period)
    scored = scores.join(F.broadcast(dates.select("date")), "date")  # one row a rebalance
    held = materialize(target_weights(scored, top), "targets")
    used = held.select("date").distinct()
    if constrained:
        held = materialize(executed_weights(held, used, prices), "held")
    calendar = days.withColumn("next", F.lead("date").over(Window.orderBy("date")))  # one row a date
    spans = used.join(calendar, "date").withColumn("until", F.lead("next").over(Window.orderBy("date")))
    returns = prices.withColumn("r", daily_return()).select("date", "stock", "r")
    spans = spans.select(F.col("date").alias("set_on"), F.col("next").alias("from"), "until").where("from is not null")
    days = calendar.select("date").join(F.broadcast(spans), (F.col("date") >= F.col("from")) & (F.col("until").isNull() | (F.col("date") < F.col("until"))))
    daily = days.join(held.withColumnRenamed("date", "set_on"), "set_on").join(returns, ["date", "stock"], "left")
    gross = daily.groupBy("date", "set_on").agg(F.coalesce(F.sum(F.col("weight") * F.col("r")), F.lit(0.0)).alias("gross"), F.sum("weight").alias("invested"))
    order = Window.partitionBy("stock").orderBy("i")
    place = used.select("date", F.row_number().over(Window.orderBy("date")).alias("i"))
    dense = held.select("stock").distinct().join(F.broadcast(place)).join(held, ["date", "stock"], "left").na.fill({"weight": 0.0})
    moved = dense.withColumn("d", F.abs(F.col("weight") - F.lag("weight", 1, 0.0).over(order))).groupBy(F.col("date").alias("set_on")).agg(F.sum("d").alias("moved"))
    first = spans.select(F.col("set_on"), F.col("from").alias("date")).join(moved, "set_on").select("date", "moved")
    out = gross.join(first, "date", "left").withColumn("turnover", F.coalesce("moved", F.lit(0.0))).withColumn("cost", F.col("turnover") * cost_rate)
    out = out.where("invested > 0").select("date", "gross", "turnover", "cost", (F.col("gross") - F.col("cost")).alias("portfolio_return"))
    if benchmark is None:
        return out
    return out.join(benchmark.select("date", "benchmark_return").where("benchmark_return is not null"), "date")
