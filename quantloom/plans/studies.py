"""Studies over whole factor tables: robustness grids, model sweeps, ablations, ratings and the research pipeline."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.stats import percentile_rank, ratio, rolling
from quantloom.operators import factors as fa
from quantloom.operators import backtest, guards, ic, metrics, neutralize, preprocess, quantile, scoring, universe, walkforward
from quantloom.schema import HORIZONS, by_stock
from quantloom.sources.store import dealt, materialize

#: The model sets of the final study.
MODELS = {
    "Model_A": ("volatility_20", "volume_change_20"),
    "Model_B": ("volatility_20",),
    "Model_C": ("volatility_20", "volatility_60", "volume_change_20"),
    "Model_D": ("momentum_20", "momentum_60", "volatility_20", "volatility_60", "volume_change_20"),
    "Model_E": ("volatility_20", "volume_change_20", "momentum_20"),
}
#: The factor sets of the ablation.
ABLATIONS = {
    "raw_five": fa.TECHNICAL,
    "drop_volatility_60": ("momentum_20", "momentum_60", "volatility_20", "volume_change_20"),
    "drop_momentum": ("volatility_20", "volatility_60", "volume_change_20"),
    "low_correlation_core": ("volatility_20", "momentum_20", "volume_change_20"),
}
METHODS = ("equal_weight", "rolling_ic_weight", "rolling_icir_weight")
MOMENTUM = ("momentum_20", "momentum_60")
REDUNDANT = ("Model_C", "Model_D")


def metric_grid(df: DataFrame, horizons: tuple[int, ...] = HORIZONS, value: str = "directed_value", variant: str = "variant") -> DataFrame:
    """factor_name, variant, period: IC summary, mean spread and monotonicity, for all variants and horizons in one plan."""
    keys = ("factor_name", variant, "period")
    summary = ic.ic_summary(ic.daily_ic(df, value, horizons, (variant,)), *keys)
    pairs = ic.stack_horizons(df, value, horizons, (variant,))
    q = quantile.quantile_monotonicity(quantile.quantile_returns(pairs, "x", "y", 5, ("date", *keys)), 5, *keys)
    return summary.join(q.select(*keys, "spread", "monotonicity"), list(keys))


def variant_grid(df: DataFrame, variants: tuple[str, ...], horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    """metric_grid() of variants that are columns of one row a (date, stock, factor); null where a variant lacks the row.

    Ranks and places of all horizons come from one sort by variant, and those of all variants from one by horizon: they count
    the pairs with both sides up to a row. A row becomes one a variant and horizon only when all is ready to be summed, so
    what is dealt out by date (see store.dealt) meets no further shuffle.
    """
    day = Window.partitionBy("date", "factor_name")
    past, ties = (Window.unboundedPreceding, Window.currentRow), (Window.currentRow, Window.currentRow)
    y = {h: F.col(f"forward_return_{h}d") for h in horizons}
    pair = {(v, h): F.when(F.col(v).isNotNull(), y[h]) for v in variants for h in horizons}
    name = {k: f"_{i}" for i, k in enumerate(pair)}

    def ranks(side: str, order: Column, keys: list) -> dict[str, Column]:
        over = day.orderBy(order)
        return {f"{side}{name[k]}": F.count(pair[k]).over(over.rangeBetween(*past)) - (F.count(pair[k]).over(over.rangeBetween(*ties)) - 1) / 2.0 for k in keys}

    for v in variants:
        keys, order = [(v, h) for h in horizons], F.col(v).asc_nulls_last()
        df = df.withColumns({f"q{name[k]}": F.count(pair[k]).over(day.orderBy(order, "stock").rowsBetween(*past)) for k in keys}).withColumns(ranks("rx", order, keys))
    for h in horizons:
        df = df.withColumns(ranks("ry", y[h].asc_nulls_last(), [(v, h) for v in variants]))
    df = df.withColumns({f"n{name[k]}": F.count(pair[k]).over(day) for k in pair})
    # by variant, then by horizon: one generator of all cells would be a method too long for the JVM to compile
    sides = ("q", "rx", "ry", "n")
    wide = [F.struct(F.lit(v).alias("variant"), F.col(v).alias("x"), *(F.col(f"{s}{name[v, h]}").alias(f"{s}{h}") for h in horizons for s in sides)) for v in variants]
    df = df.select("date", "factor_name", *(c.alias(f"y{h}") for h, c in y.items()), F.inline(F.array(*wide))).where("x is not null")
    cells = [F.struct(F.lit(h).alias("period"), *(F.col(f"{s}{h}").alias(s) for s in ("y", *sides))) for h in horizons]
    cell = df.select("date", "factor_name", "variant", "x", F.inline(F.array(*cells))).where("y is not null")
    cell = cell.withColumn("_q", F.greatest(F.lit(1), F.least(F.lit(5), F.ceil(ratio("q", "n") * 5))).cast("int"))
    keys = ("factor_name", "variant", "period")
    daily = cell.groupBy("date", *keys).agg(*ic.daily_columns(), *(F.avg(F.when(F.col("_q") == i, F.col("y"))).alias(f"q{i}") for i in range(1, 6)))
    valid = F.col("_guarded") & F.col("ic").isNotNull() & F.col("rank_ic").isNotNull()
    daily = daily.withColumns({"ic": F.when(valid, F.col("ic")), "rank_ic": F.when(valid, F.col("rank_ic")), "spread": F.col("q5") - F.col("q1")})
    means = daily.groupBy(*keys).agg(*ic.summary_columns(), *(F.avg(c).alias(c) for c in ("q1", "q2", "q3", "q4", "q5", "spread"))).where("observations > 0")
    return quantile.with_monotonicity(means).drop("q1", "q2", "q3", "q4", "q5", "is_monotonic")


def low_volatility_grid(prices: DataFrame) -> DataFrame:
    """Four windows by three preparations by five horizons."""
    forward, factors = [f"forward_return_{h}d" for h in HORIZONS], ("volatility_10", "volatility_20", "volatility_40", "volatility_60")
    wide = fa.with_volatility(prices.withColumns({f"forward_return_{h}d": fa.forward_return(h) for h in HORIZONS}), 10, 20, 40, 60)
    long = fa.to_long(dealt(wide.select("date", "stock", *forward, *factors), "date"), factors)
    df = preprocess.winsorize(long, "factor_value", "w_mad", "mad")
    df = preprocess.winsorize(df, "factor_value", "w_pct", "percentile")
    df = df.withColumns({"mad_zscore": -preprocess.zscore("w_mad", *preprocess.KEYS), "percentile_zscore": -preprocess.zscore("w_pct", *preprocess.KEYS), "percentile_rank": -percentile_rank("factor_value", *preprocess.KEYS) * 100})
    variants = ("mad_zscore", "percentile_zscore", "percentile_rank")
    return variant_grid(df.select("date", "stock", "factor_name", *forward, *variants), variants)


def with_liquidity(df: DataFrame, prices: DataFrame) -> DataFrame:
    """Adds liq_pct: the day's percentile of the 20-row mean amount (at least 10 rows)."""
    return ranked_liquidity(df.join(adv20(prices).select("date", "stock", "adv20"), ["date", "stock"], "left"))


def adv20(prices: DataFrame) -> DataFrame:
    return prices.withColumn("adv20", rolling(F.avg, "amount", by_stock(), 20, 10))


def ranked_liquidity(df: DataFrame) -> DataFrame:
    return df.withColumn("liq_pct", percentile_rank("adv20", "date", "factor_name"))


def low_volatility_liquidity(prepared: DataFrame, prices: DataFrame) -> DataFrame:
    """The metric grid of volatility_20 at five days without the least liquid tenth and fifth of a day."""
    base = with_liquidity(prepared.where("factor_name = 'volatility_20'"), prices)
    kept = F.array(*(F.when(F.col("liq_pct") > cut / 100, f"remove_bottom_{cut}pct_ADV20") for cut in (10, 20)))
    return metric_grid(base.withColumn("variant", F.explode(F.filter(kept, lambda x: x.isNotNull()))), (5,))


def low_volatility_robustness(prepared: DataFrame, prices: DataFrame) -> DataFrame:
    """robustness() of volatility_20 over its three preparations and its two liquidity filters."""
    return robustness(low_volatility_grid(prices).where("factor_name = 'volatility_20'").unionByName(low_volatility_liquidity(prepared, prices)))


def momentum_grid(prepared: DataFrame, prices: DataFrame) -> DataFrame:
    """Momentum as it is, without the least liquid fifth of a day, and without the outer percents of the whole sample."""
    return liquidity_grid(with_liquidity(prepared.where(F.col("factor_name").isin(*MOMENTUM)), prices))


def momentum_grid_of(prices: DataFrame) -> DataFrame:
    """momentum_grid() from prices alone: the mean amount travels with the factors, so that a plan shuffles by stock and by date only."""
    wide = adv20(prices.withColumns({"momentum_20": fa.momentum(20), "momentum_60": fa.momentum(60), **{f"forward_return_{h}d": fa.forward_return(h) for h in HORIZONS}}))
    wide = dealt(wide.select("date", "stock", "adv20", *(f"forward_return_{h}d" for h in HORIZONS), *MOMENTUM), "date")
    return liquidity_grid(ranked_liquidity(preprocess.with_direction(preprocess.preprocess_factors(fa.to_long(wide, MOMENTUM, extra=("adv20",))))))


def liquidity_grid(base: DataFrame) -> DataFrame:
    """base: factor rows with directed_value and liq_pct. The bounds over the whole sample are made first, of a stored table of two columns."""
    values = materialize(base.select("factor_name", "directed_value"), "values")
    bounds = quantile.group_percentiles(values, "directed_value", (0.01, 0.99), "factor_name")
    base = base.join(F.broadcast(materialize(bounds, "bounds")), "factor_name")  # one row a factor
    x = F.col("directed_value")
    kept = {"raw": x, "remove_bottom_20pct_ADV20": F.when(F.col("liq_pct") > 0.2, x), "remove_extreme_1pct_each_tail": F.when(x.between(F.col("p0"), F.col("p1")), x)}
    return variant_grid(base.select("date", "stock", "factor_name", *(f"forward_return_{h}d" for h in HORIZONS), *(c.alias(v) for v, c in kept.items())), tuple(kept))


def momentum_scopes(prepared: DataFrame, prices: DataFrame) -> DataFrame:
    """What the momentum grid lacks: momentum_120 at all horizons, and momentum_20 and momentum_60 as they are by year at five days."""
    wide = prices.withColumns({"momentum_120": fa.momentum(120), **{f"forward_return_{h}d": fa.forward_return(h) for h in HORIZONS}})
    longest = preprocess.with_direction(preprocess.preprocess_factors(fa.to_long(wide, ("momentum_120",))))
    years = prepared.where(F.col("factor_name").isin("momentum_20", "momentum_60")).withColumn("scope", F.year("date").cast("string"))
    return metric_grid(longest.withColumn("scope", F.lit("full")), variant="scope").unionByName(metric_grid(years, (5,), variant="scope"))


def momentum_reversal(prepared: DataFrame, prices: DataFrame) -> DataFrame:
    """The class over all variants and horizons of the momentum grid, momentum_120 and the years."""
    return guards.reversal_class(momentum_grid(prepared, prices).select("mean_rank_ic").unionByName(momentum_scopes(prepared, prices).select("mean_rank_ic")))


def robustness(grid: DataFrame) -> DataFrame:
    """By factor: the least five-day rank IC over variants, the share of positive ones and the class."""
    out = grid.where("period = 5").groupBy("factor_name").agg(F.min("mean_rank_ic").alias("min_ic"), F.avg((F.col("mean_rank_ic") > 0).cast("double")).alias("positive_share"))
    return out.withColumn("robustness", guards.robustness_class(F.col("min_ic"), F.col("positive_share")))


def subsamples(prepared: DataFrame, parts: dict[str, tuple[int, int]]) -> DataFrame:
    """The metric grid at five days for ranges of years."""
    year = F.year("date")
    named = F.filter(F.array(*(F.when(year.between(a, b), F.lit(n)) for n, (a, b) in parts.items())), lambda x: x.isNotNull())
    return metric_grid(prepared.withColumn("variant", F.explode(named)), (5,))


def model_sweep(prepared: DataFrame, config: walkforward.WalkForwardConfig, models: dict[str, tuple[str, ...]] = MODELS, methods: tuple[str, ...] = METHODS, top: float = 0.2) -> DataFrame:
    """Daily walk-forward rows of each model and method, all in one plan with the model as a key. Each model has its own calendar: the dates on which one of its factors is there. A factor's ICs are made once for all models."""
    pairs = prepared.sparkSession.createDataFrame([(m, f) for m, names in models.items() for f in names], "model string, factor_name string")
    rows = prepared.join(F.broadcast(pairs), "factor_name")  # a row a model and factor
    daily = ic.daily_ic(prepared, "directed_value", (1,), ranks=False).join(F.broadcast(pairs), "factor_name")
    return materialize(walkforward.walk_forward(rows, config, methods, top=top, by=("model",), ic=daily), "sweep")


def leave_one_out(prepared: DataFrame, config: walkforward.WalkForwardConfig, factors: tuple[str, ...], method: str) -> DataFrame:
    """The model without each of its factors: factor_name, status, annualized_return and the delta to the whole model; a model of one factor leaves nothing to run."""
    sets = {"": factors} | {f: tuple(x for x in factors if x != f) for f in factors}
    ran = compare(model_sweep(prepared, config, {k: v for k, v in sets.items() if v}, (method,)), "model", "method").select("model", "annualized_return")
    whole = ran.where("model = ''").select(F.col("annualized_return").alias("_whole"))  # one row
    names = prepared.sparkSession.createDataFrame([(f,) for f in factors], "factor_name string")
    out = names.join(ran, F.col("factor_name") == F.col("model"), "left").join(F.broadcast(whole))
    return out.select("factor_name", F.when(F.col("model").isNull(), "NOT_APPLICABLE_EMPTY_MODEL").otherwise("OK").alias("status"), "annualized_return", (F.col("_whole") - F.col("annualized_return")).alias("annualized_return_delta"))


def compare(daily: DataFrame, *keys: str) -> DataFrame:
    """Total and annual return, volatility, arithmetic Sharpe, drawdown, turnover, cost and the metrics relative to the benchmark."""
    d = metrics.with_drawdown(daily, "net", *keys)
    own = d.groupBy(*keys).agg(metrics.total_return("net").alias("oos_return"), metrics.annual_return("net").alias("annualized_return"), (F.stddev_samp("net") * F.sqrt(F.lit(252.0))).alias("volatility"), metrics.sharpe("net").alias("sharpe"), F.min("drawdown").alias("max_drawdown"), F.sum("turnover").alias("turnover"), F.sum("cost").alias("transaction_cost"))
    return own.join(metrics.relative_metrics(daily, "net", "benchmark", *keys), list(keys))


def ratings(comparison: DataFrame, yearly: DataFrame, redundant: tuple[str, ...] = REDUNDANT) -> DataFrame:
    """model, method, score and rating: percentile ranks, plus the share of years with excess return, less a redundancy penalty; quarters by the edges of the ranks."""
    ranked = {c: F.round(F.col(c), 9) for c in ("sharpe", "annualized_excess_return", "max_drawdown")} | {"turnover": F.round(-F.col("turnover"), 9)}
    x = comparison.withColumns({f"_{c}": e for c, e in ranked.items()})  # equal results tie whatever the order of summation
    places = [percentile_rank(f"_{c}") for c in ranked]
    x = x.withColumn("score", places[0] + places[1] + places[2] + places[3])
    years = yearly.groupBy("model", "method").agg(F.avg((F.col("excess_return") > 0).cast("double")).alias("positive_years"))
    x = x.join(years, ["model", "method"], "left").withColumn("score", F.col("score") + F.coalesce("positive_years", F.lit(0.0)) - F.when(F.col("model").isin(*redundant), 0.5).otherwise(0.0))
    n, place = F.count("*").over(Window.partitionBy()), F.row_number().over(Window.orderBy("score", "model", "method"))
    x = x.withColumns({"_n": n, "_r": place})
    edge = lambda k: 1 + (F.col("_n") - 1) * k / 4
    label = F.when(F.col("_r") <= edge(1), "REJECT").when(F.col("_r") <= edge(2), "WEAK").when(F.col("_r") <= edge(3), "ACCEPTABLE").otherwise("STRONGEST")
    return x.select("model", "method", "score", "positive_years", label.alias("rating"))


def yearly_excess(daily: DataFrame) -> DataFrame:
    return daily.withColumn("year", F.year("date")).groupBy("model", "method", "year").agg((metrics.total_return("net") - metrics.total_return("benchmark")).alias("excess_return"))


def attribution(weights: DataFrame) -> DataFrame:
    """By factor: mean size and mean of its fold weights, and its share of all sizes."""
    out = weights.groupBy("factor_name").agg(F.avg(F.abs("weight")).alias("average_absolute_weight"), F.avg("weight").alias("average_signed_weight"))
    return out.withColumn("share", F.col("average_absolute_weight") / F.sum("average_absolute_weight").over(Window.partitionBy()))


def cost_label(annual_highest, annual_base):
    """How a strategy bears costs: annual returns at the highest and at the base rate."""
    loss = 1 - annual_highest / annual_base
    return F.when((annual_highest > 0) & (loss < 0.4), "ROBUST_TO_COST").when(annual_highest > 0, "MODERATELY_SENSITIVE").otherwise("HIGHLY_SENSITIVE")


def cost_sweep(daily: DataFrame, points: tuple[int, ...] = (0, 5, 10, 20, 30), base: int = 10) -> DataFrame:
    """method, bp: compare() of walk-forward rows at each single-sided cost, and by method how the highest cost compares with the base."""
    swept = daily.withColumn("bp", F.explode(F.array(*map(F.lit, points)))).withColumn("cost", F.col("turnover") * F.col("bp") / 10000.0).withColumn("net", F.col("gross") - F.col("cost"))
    out = compare(swept, "method", "bp")
    at = lambda bp: F.max(F.when(F.col("bp") == bp, F.col("annualized_return")))
    status = out.groupBy("method").agg(at(max(points)).alias("_high"), at(base).alias("_base")).select("method", cost_label(F.col("_high"), F.nullif("_base", F.lit(0.0))).alias("cost_status"))
    return out.join(status, "method")


def low_volatility_diagnostic(prepared: DataFrame) -> DataFrame:
    """The metric grid of volatility_20 and volatility_60 over the whole sample at all horizons and by year at five days."""
    base = prepared.where(F.col("factor_name").isin("volatility_20", "volatility_60"))
    full, years = base.withColumn("scope", F.lit("full")), base.withColumn("scope", F.year("date").cast("string"))
    return metric_grid(full, variant="scope").unionByName(metric_grid(years, (5,), variant="scope"))


def research(prices: DataFrame, factors: DataFrame, exposures: DataFrame | None = None, provider: universe.UniverseProvider | None = None, horizons: tuple[int, ...] = HORIZONS) -> dict[str, DataFrame]:
    """The research pipeline: eligible rows, preparation, neutralization, ICs, quantiles and guards, as named frames."""
    df = factors
    if provider is not None:
        df = df.join(provider.universe(prices).select("date", "stock").distinct(), ["date", "stock"], "left_semi")
    df = preprocess.with_direction(preprocess.preprocess_factors(df))
    if exposures is not None:
        df = neutralize.neutralize(df.join(exposures.dropDuplicates(["stock"]), "stock", "left"), "directed_value")
    value = "neutralized_value" if exposures is not None else "directed_value"
    df = materialize(df, "research")
    daily = ic.daily_ic(df, value, horizons)
    out = {"factors": df, "decay": ic.ic_summary(daily, "factor_name", "period"), "yearly": ic.yearly_ic(df, value), "quantiles": quantile.quantile_returns(df, value, "forward_return_5d"), "sample": guards.sample_guard(df)}
    if exposures is not None:
        out["neutralization"] = neutralize.diagnostics(df, "directed_value", "neutralized_value")
    return out


def survivorship_rerun(prepared: DataFrame, panel: DataFrame, master: DataFrame, model: tuple[str, ...], method: str, config: walkforward.WalkForwardConfig) -> DataFrame:
    """A frozen model's daily rows on securities in their listed life alone."""
    alive = universe.seasoned(panel.select("date", "stock"), master)
    rows = materialize(prepared.where(F.col("factor_name").isin(*model)).join(alive, ["date", "stock"], "left_semi"), "alive")
    return walkforward.walk_forward(rows, config, (method,))


#: The default stock pool.
STOCK_POOL = ("600519", "000001", "300750", "601318", "600036", "000858", "000333", "600276", "601166", "600887", "002594", "601888", "000651", "600030", "601012")


def stock_pool(codes: Sequence[str] | None = None) -> list[str]:
    """The given codes, or the default ones, as six digits without repeats; bad or no codes raise."""
    found = list(dict.fromkeys(str(c).strip().zfill(6) for c in (STOCK_POOL if codes is None else codes)))
    bad = [c for c in found if not re.fullmatch(r"[0-9]{6}", c)]
    if bad or not found:
        raise ValueError(f"no stock codes: {bad}" if bad else "the stock pool must not be empty")
    return found


def configured_backtest(prices: DataFrame, fundamentals: DataFrame, benchmark: DataFrame, codes: Sequence[str] | None = None, provider: universe.UniverseProvider | None = None, dynamic: bool = True, top: float = 0.2, period: int = 20, warm_up: int = 65, cost_rate: float = 0.001) -> DataFrame:
    """The backtest of a stock pool on multifactor scores that are made on each rebalance date. dynamic: candidates are what the provider (by default the price history) finds eligible; a date without any keeps the whole pool."""
    if period <= 0 or cost_rate < 0:
        raise ValueError("the rebalance period must be positive, the cost not negative")
    prices = materialize(prices.where(F.col("stock").isin(stock_pool(codes))), "pool")
    if prices.select("date").distinct().count() <= warm_up:
        raise ValueError(f"a backtest needs more than {warm_up} trading days")
    long = materialize(fa.to_long(fa.technical_factors(prices)), "factors")
    candidates = universe.eligible_or_all(prices, provider or universe.HistoricalUniverse()) if dynamic else prices
    dates = backtest.rebalance_dates(prices, warm_up, period).select("date")
    scores = scoring.multifactor_scores_at(long, fundamentals, candidates.join(F.broadcast(dates), "date"))  # one row a rebalance
    return backtest.backtest(prices, scores, benchmark, top, period, warm_up, cost_rate)


def evaluate_stock(code: str, prices: DataFrame, fundamentals: DataFrame | None = None) -> dict:
    """One stock's scores in the cross-section of prices, with the sources of its data; a ValueError if its history is too short."""
    (code,) = stock_pool([code])
    long = fa.to_long(fa.technical_factors(prices))
    table = scoring.stock_scores(long) if fundamentals is None else scoring.multifactor_scores(long, fundamentals).join(scoring.stock_scores(long).drop("final_score"), "stock").withColumnRenamed("multifactor_score", "final_score")
    found = table.where(F.col("stock") == code).first()
    if found is None:
        raise ValueError("insufficient market history to score the stock")
    source = lambda df: (df.select("data_source").first() or ["unknown"])[0] if "data_source" in df.columns else "unknown"
    out = found.asDict() | {"data_source": source(prices)}
    return out if fundamentals is None else out | {"financial_data_source": source(fundamentals)}


def data_quality(factors: DataFrame, provider: universe.UniverseProvider, trading_warnings: Sequence[str] = (), exposures_point_in_time: bool = False) -> dict:
    """What a research run tells of its data: universe, sample, neutralization and warnings; small enough for JSON."""
    m = provider.metadata
    sample = guards.sample_guard(factors).first()
    status = {r[0]: r[1] for r in factors.groupBy("neutralization_status").count().collect()} if "neutralization_status" in factors.columns else {}
    return {"universe": {"name": m.name, "source": m.source, "point_in_time": m.point_in_time, "warnings": list(m.warnings)}, "sample_size": sample.asDict(), "neutralization_status": status, "exposures_point_in_time": exposures_point_in_time, "survivorship_bias_status": "RESOLVED" if m.point_in_time else "UNRESOLVED", "fallback_warnings": list(dict.fromkeys([*m.warnings, *trading_warnings]))}
