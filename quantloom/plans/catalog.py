"""Every operator as a registered query: name -> (Spark form, SQL form). Doubles are rounded to six places at the very end."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantloom.functions.codes import exchange_prefix, exchange_suffix, is_code, normalize_code
from quantloom.operators import asof, backtest, combine, correlation, guards, ic, market_metadata, metrics, neutralize, pit, preprocess, quantile, scoring, universe, walkforward
from quantloom.operators import factors as fa
from quantloom.plans import studies
from quantloom.plans.sql import CTE, HORIZONS, SUMMARY, ic as ic_sql, rank, with_
from quantloom.sources import fixtures, ingest
from quantloom.sources.store import dealt, materialize

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
WF = walkforward.WalkForwardConfig(train_window=156, test_window=26, min_train=104)


def query(name: str, sql: str | None = None):
    def keep(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return shown(f(spark, sf_dir))

        QUERIES[name] = run
        if sql is not None:
            SQL[name] = with_(sql)
        return f

    return keep


def shown(df: DataFrame) -> DataFrame:
    """df with doubles rounded and integers as long, as results are compared."""
    out = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DoubleType | T.FloatType | T.DecimalType):
            c = F.round(c.cast("double"), 6) + F.lit(0.0)
        elif isinstance(f.dataType, T.IntegerType | T.ShortType):
            c = c.cast("long")
        out.append(c.alias(f.name))
    return df.select(*out)


def R(names: str, source: str, others: str = "", tail: str = "") -> str:
    """The SQL form of shown(): names are doubles."""
    cols = [f"round({n}, 6) + 0.0 AS {n}" for n in names.split()]
    return f"SELECT {', '.join([*others.split(), *cols])} FROM {source}{tail}"


def exact(names: str, source: str) -> str:
    """The SQL form of floored()."""
    return "SELECT date, stock, " + ", ".join(f"floor({n} * 1000000 + 0.5) / 1000000 AS {n}" for n in names.split()) + f" FROM {source}"


def floored(df: DataFrame) -> DataFrame:
    """Prices at six places by multiplication and floor alone, which all engines do alike even halfway between."""
    return df.select(*((F.floor(F.col(f.name) * 1000000 + 0.5).cast("double") / 1000000).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name) for f in df.schema))


def tech(spark, d):
    return fa.technical_factors(fixtures.panel(spark, d))


def long(spark, d):
    return fa.to_long(tech(spark, d))


def prep(spark, d, **options):
    return preprocess.with_direction(preprocess.preprocess_factors(long(spark, d), **options))


def held(spark, d):
    """prep(), stored once for plans that read it several times."""
    return materialize(prep(spark, d), "prepared")


def walk(spark, d, **options):
    target = options.get("target", "forward_return_1d")
    wide = tech(spark, d).select("date", "stock", *fa.TECHNICAL, *{target, "forward_return_5d"})
    rows = preprocess.with_direction(preprocess.preprocess_factors(fa.to_long(dealt(wide, "date"))))
    return walkforward.walk_forward(rows, WF, factors=fa.TECHNICAL, **options)


def ics(spark, d, horizons=HORIZONS):
    return ic.daily_ic(prep(spark, d), "directed_value", horizons)


# --- sources and panels ---------------------------------------------------------------------------------------------


@query("price_panel", exact("open high low close volume amount", "panel"))
def _(spark, d):
    return floored(fixtures.panel(spark, d))


@query("price_validation", "SELECT count(*) AS n_rows, count(*) - count(DISTINCT (date, stock)) AS duplicate_keys, count(*) FILTER (WHERE close <= 0) AS bad_close, count(*) FILTER (WHERE volume < 0) AS bad_volume, CAST(count(*) FILTER (WHERE open IS NULL OR high IS NULL OR low IS NULL OR close IS NULL OR volume IS NULL) AS BIGINT) AS missing FROM panel")
def _(spark, d):
    return ingest.validation_report(fixtures.panel(spark, d))


@query("invalid_rows_removed", exact("close volume", "panel WHERE open IS NOT NULL AND high IS NOT NULL AND low IS NOT NULL AND close > 0 AND volume >= 0"))
def _(spark, d):
    return floored(ingest.remove_invalid(fixtures.panel(spark, d)).select("date", "stock", "close", "volume"))


@query("deduplicated_events", "SELECT user_id, CAST(ts AS DATE) AS date, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY ALL")
def _(spark, d):
    e = fixtures.table(spark, d, "events").select("user_id", F.to_date("ts").alias("date"), "ts", "event_id")
    return ingest.keep_last(e, ["user_id", "date"], "ts", "event_id").select("user_id", "date", "event_id")


@query("security_codes", "SELECT o_orderkey, code, CAST(regexp_matches(code, '^[0-9]{6}$') AS BOOLEAN) AS valid, CASE WHEN regexp_matches(code, '^[569]') THEN 'sh' ELSE 'sz' END AS prefix, CASE WHEN regexp_matches(code, '^[569]') THEN code || '.SH' ELSE code || '.SZ' END AS symbol FROM (SELECT o_orderkey, lpad(CAST(o_orderkey % 1000000 AS VARCHAR), 6, '0') AS code FROM orders)")
def _(spark, d):
    code = normalize_code(F.concat((F.col("o_orderkey") % 1000000).cast("string"), F.lit(".0")))
    return fixtures.table(spark, d, "orders").select("o_orderkey", code.alias("code")).withColumns({"valid": is_code(F.col("code")), "prefix": exchange_prefix(F.col("code")), "symbol": exchange_suffix(F.col("code"))})


@query("benchmark_returns", R("benchmark_return", "bench", "date"))
def _(spark, d):
    return fixtures.benchmark(fixtures.panel(spark, d))


@query("cache_coverage", "SELECT stock, count(*) AS n, min(date) AS first_date, max(date) AS last_date, count(*) >= 2 AND min(date) <= DATE '1995-01-02' + 7 AND max(date) >= DATE '2001-10-29' - 7 AS covered FROM panel GROUP BY stock")
def _(spark, d):
    return ingest.coverage(fixtures.panel(spark, d), "1995-01-02", "2001-10-29")


# --- factors --------------------------------------------------------------------------------------------------------

for _name, _cols in {"momentum": "momentum_20 momentum_60", "volatility": "volatility_20 volatility_60", "volume_change": "volume_change_20", "forward_returns": " ".join(f"forward_return_{h}d" for h in HORIZONS)}.items():
    query(_name, R(_cols, "tech", "date stock"))(lambda spark, d, cols=_cols: tech(spark, d).select("date", "stock", *cols.split()))


@query("legacy_factors", "SELECT date, stock, round(momentum_20, 6) + 0.0 AS momentum, round(volatility_20, 6) + 0.0 AS volatility, round(volume_change_20 - 1, 6) + 0.0 AS volume_factor, round(forward_return_1d, 6) + 0.0 AS \"return\" FROM tech")
def _(spark, d):
    return fa.legacy_factors(fixtures.panel(spark, d)).select("date", "stock", "momentum", "volatility", "volume_factor", "return")


@query("factor_long", R("factor_value forward_return_1d forward_return_5d forward_return_10d forward_return_20d forward_return_40d", "long", "date stock factor_name"))
def _(spark, d):
    return long(spark, d).drop("return")


@query("value_quality_factors", "SELECT stock, report_period, round(CASE WHEN pe > 0 THEN 1.0 / pe END, 6) + 0.0 AS pe_factor, round(CASE WHEN pb > 0 THEN 1.0 / pb END, 6) + 0.0 AS pb_factor, round(roe, 6) + 0.0 AS roe_factor FROM reports")
def _(spark, d):
    return fa.quality_factor(fa.value_factors(fixtures.reports(spark, d))).select("stock", "report_period", "pe_factor", "pb_factor", "roe_factor")


@query("directed_factors", R("directed_value", "prep", "date stock factor_name"))
def _(spark, d):
    return prep(spark, d).select("date", "stock", "factor_name", "directed_value")


# --- preprocessing --------------------------------------------------------------------------------------------------


@query("winsor_percentile", R("winsorized_value", "winsor", "date stock factor_name"))
def _(spark, d):
    return preprocess.winsorize(long(spark, d), "factor_value", "winsorized_value").select("date", "stock", "factor_name", "winsorized_value")


@query("winsor_mad", """SELECT date, stock, factor_name, round(least(greatest(factor_value, m - 3 * mad), m + 3 * mad), 6) + 0.0 AS winsorized_value FROM (
  SELECT *, median(abs(factor_value - m)) OVER (PARTITION BY date, factor_name) AS mad FROM (SELECT *, median(factor_value) OVER (PARTITION BY date, factor_name) AS m FROM long))""")
def _(spark, d):
    return preprocess.winsorize(long(spark, d), "factor_value", "winsorized_value", "mad").select("date", "stock", "factor_name", "winsorized_value")


@query("zscore_cs", R("normalized_value", "prep", "date stock factor_name"))
def _(spark, d):
    return prep(spark, d).select("date", "stock", "factor_name", "normalized_value")


@query("pctrank_cs", f"SELECT date, stock, factor_name, round({rank('winsorized_value', 'date, factor_name')} / count(*) OVER (PARTITION BY date, factor_name) * 100, 6) + 0.0 AS normalized_value FROM winsor")
def _(spark, d):
    return preprocess.preprocess_factors(long(spark, d), "cross_sectional_percentile").select("date", "stock", "factor_name", "normalized_value")


@query("pctrank_ts", f"SELECT date, stock, factor_name, round({rank('factor_value', 'stock, factor_name')} / count(*) OVER (PARTITION BY stock, factor_name) * 100, 6) + 0.0 AS normalized_value FROM long")
def _(spark, d):
    return preprocess.preprocess_factors(long(spark, d), "time_series_percentile").select("date", "stock", "factor_name", "normalized_value")


# --- information coefficients ---------------------------------------------------------------------------------------


@query("daily_ic", R("ic", "raw_ics", "date factor_name n", " WHERE period = 5"))
def _(spark, d):
    return ic.daily_ic(long(spark, d)).select("date", "factor_name", "n", "ic")


@query("daily_rank_ic", R("rank_ic", "raw_ics", "date factor_name n", " WHERE period = 5"))
def _(spark, d):
    return ic.daily_ic(long(spark, d)).select("date", "factor_name", "n", "rank_ic")


_SUM = "mean_ic mean_rank_ic ic_std rank_ic_std icir rank_icir positive_ic_ratio t_stat"


@query("ic_summary", R(_SUM, f"(SELECT factor_name, {SUMMARY} FROM ics WHERE period = 5 GROUP BY factor_name)", "factor_name observations"))
def _(spark, d):
    return ic.ic_summary(ics(spark, d, (5,)), "factor_name")


@query("ic_decay", R(_SUM, f"(SELECT factor_name, CAST(period AS BIGINT) AS period, {SUMMARY} FROM ics GROUP BY factor_name, period)", "factor_name period observations"))
def _(spark, d):
    return ic.ic_decay(prep(spark, d), "directed_value", HORIZONS)


_YEARLY = f"(SELECT factor_name, year(date) AS year, {SUMMARY}, count(DISTINCT date) AS effective_trading_days, avg(n) AS average_cross_section_size FROM ics WHERE period = 5 GROUP BY factor_name, year(date))"


@query("yearly_ic", R(_SUM + " average_cross_section_size", _YEARLY, "factor_name year observations effective_trading_days"))
def _(spark, d):
    return ic.yearly_ic(prep(spark, d), "directed_value")


@query("ic_stability", R("full_ic same_sign_ratio yearly_std stability_score", f"""(SELECT factor_name, max(f) AS full_ic, avg(CASE WHEN sign(mean_rank_ic) = sign(f) THEN 1.0 ELSE 0.0 END) AS same_sign_ratio, arg_max(year, (mean_rank_ic, -year)) AS best_year, arg_min(year, (mean_rank_ic, year)) AS worst_year, stddev_samp(mean_rank_ic) AS yearly_std,
  avg(CASE WHEN sign(mean_rank_ic) = sign(f) THEN 1.0 ELSE 0.0 END) * abs(max(f)) / nullif(stddev_samp(mean_rank_ic), 0) AS stability_score FROM {_YEARLY} y JOIN (SELECT factor_name AS fn, avg(rank_ic) AS f FROM ics WHERE period = 5 GROUP BY factor_name) ON fn = factor_name GROUP BY factor_name)""", "factor_name best_year worst_year"))
def _(spark, d):
    p = held(spark, d)
    return ic.stability(ic.yearly_ic(p, "directed_value"), ic.ic_summary(ic.daily_ic(p, "directed_value"), "factor_name"))


@query("ic_ranking", R("mean_ic ic_std icir mean_rank_ic", f"(SELECT row_number() OVER (ORDER BY abs(icir) DESC, factor_name) AS place, * FROM (SELECT factor_name, {SUMMARY} FROM raw_ics WHERE period = 5 GROUP BY factor_name))", "place factor_name observations"))
def _(spark, d):
    return ic.ic_ranking(long(spark, d))


_ROLL = "(SELECT date, factor_name, rank_ic, " + ", ".join(f"CASE WHEN count(rank_ic) OVER v{n} >= {n} THEN avg(rank_ic) OVER v{n} END AS rolling_{n}, CASE WHEN count(rank_ic) OVER v{n} >= {n} THEN avg(CASE WHEN rank_ic > 0 THEN 1.0 ELSE 0.0 END) OVER v{n} END AS positive_{n}" for n in (60, 120)) + " FROM ics WHERE period = 5 WINDOW v60 AS (PARTITION BY factor_name ORDER BY date ROWS 59 PRECEDING), v120 AS (PARTITION BY factor_name ORDER BY date ROWS 119 PRECEDING))"


@query("rolling_rank_ic", R("rank_ic rolling_60 positive_60 rolling_120 positive_120", _ROLL, "date factor_name"))
def _(spark, d):
    return ic.rolling_rank_ic(ics(spark, d, (5,))).select("date", "factor_name", "rank_ic", "rolling_60", "positive_60", "rolling_120", "positive_120")


@query("hac_ic", """WITH s AS (SELECT factor_name, period, date, rank_ic - avg(rank_ic) OVER (PARTITION BY factor_name, period) AS u, rank_ic AS v, row_number() OVER (PARTITION BY factor_name, period ORDER BY date) AS i FROM ics WHERE period > 1),
g AS (SELECT a.factor_name, a.period, a.i - b.i AS k, sum(a.u * b.u) AS c FROM s a JOIN s b ON a.factor_name = b.factor_name AND a.period = b.period AND a.i - b.i BETWEEN 0 AND a.period - 1 GROUP BY ALL),
n AS (SELECT factor_name, period, count(*) AS n, avg(v) AS mean FROM s GROUP BY ALL)
SELECT factor_name, CAST(period AS BIGINT) AS period, n AS observations, round(mean, 6) + 0.0 AS mean, round(CASE WHEN v > 0 THEN mean / sqrt(v / n) ELSE 0.0 END, 6) + 0.0 AS hac_t_stat FROM (
  SELECT factor_name, period, any_value(n) AS n, any_value(mean) AS mean, greatest(0.0, sum(c * CASE WHEN k = 0 THEN 1.0 ELSE 2 * (1 - CAST(k AS DOUBLE) / period) END) / any_value(n)) AS v FROM g JOIN n USING (factor_name, period) GROUP BY factor_name, period)""")
def _(spark, d):
    s = ics(spark, d, (5, 10, 20, 40)).withColumn("lag", F.col("period") - 1)
    return ic.hac_mean(s, "rank_ic", "lag", "factor_name", "period", "lag").drop("lag")


# --- quantiles and groups -------------------------------------------------------------------------------------------

_Q = "q1 q2 q3 q4 q5 spread"


@query("quantile_returns", R(_Q, "quant", "date factor_name"))
def _(spark, d):
    return quantile.quantile_returns(prep(spark, d), "directed_value", "forward_return_5d")


@query("quantile_monotonicity", f"SELECT factor_name, {', '.join(f'round({c}, 6) + 0.0 AS {c}' for c in _Q.split())}, round((CAST(q2 > q1 AS INTEGER) + CAST(q3 > q2 AS INTEGER) + CAST(q4 > q3 AS INTEGER) + CAST(q5 > q4 AS INTEGER)) / 4.0, 6) + 0.0 AS monotonicity, NOT (q2 < q1 OR q3 < q2 OR q4 < q3 OR q5 < q4) AS is_monotonic FROM (SELECT factor_name, {', '.join(f'avg({c}) AS {c}' for c in _Q.split())} FROM quant GROUP BY factor_name)")
def _(spark, d):
    return quantile.quantile_monotonicity(quantile.quantile_returns(prep(spark, d), "directed_value", "forward_return_5d"), 5, "factor_name")


@query("group_return", R("top_return bottom_return long_short", "groups", "date factor_name"))
def _(spark, d):
    return quantile.group_returns(long(spark, d))


# --- correlation ----------------------------------------------------------------------------------------------------


@query("factor_correlation", "SELECT factor_a, factor_b, round(avg(coalesce(pearson, 0.0)), 6) + 0.0 AS mean_pearson, round(avg(coalesce(spearman, 0.0)), 6) + 0.0 AS mean_spearman, count(*) AS days, abs(avg(coalesce(spearman, 0.0))) > 0.8 AS redundant FROM fcorr GROUP BY factor_a, factor_b")
def _(spark, d):
    return correlation.average_factor_correlation(correlation.daily_factor_correlation(long(spark, d), fa.TECHNICAL))


@query("factor_correlation_p95", "SELECT factor_a, factor_b, round(avg(spearman), 6) + 0.0 AS mean_spearman, round(quantile_cont(abs(spearman), 0.95), 6) + 0.0 AS p95_abs_spearman, quantile_cont(abs(spearman), 0.95) > 0.8 AS flagged FROM fcorr GROUP BY factor_a, factor_b")
def _(spark, d):
    return correlation.tail_factor_correlation(correlation.daily_factor_correlation(long(spark, d), fa.TECHNICAL))


_ORTH = """(SELECT date, stock, 'volatility_60' AS factor_name, round((y - avg(y) OVER w) - coalesce(covar_pop(x, y) OVER w / nullif(var_pop(x) OVER w, 0), 0.0) * (x - avg(x) OVER w), 12) AS x, y5 AS y, 5 AS period FROM (
  SELECT a.date, a.stock, a.directed_value AS y, b.directed_value AS x, a.forward_return_5d AS y5 FROM prep a JOIN prep b ON a.date = b.date AND a.stock = b.stock AND a.factor_name = 'volatility_60' AND b.factor_name = 'volatility_20') WINDOW w AS (PARTITION BY date))"""


@query("orthogonalized_ic", R(_SUM, f"(SELECT factor_name, {SUMMARY} FROM ({ic_sql(_ORTH)}) GROUP BY factor_name)", "factor_name observations"))
def _(spark, d):
    p = prep(spark, d)
    residual = correlation.orthogonalize(p, "volatility_60", "volatility_20")
    target = p.where("factor_name = 'volatility_60'").select("date", "stock", "factor_name", "forward_return_5d")
    return ic.ic_summary(ic.daily_ic(residual.join(target, ["date", "stock"]), "directed_value"), "factor_name")


# --- factor evaluation ----------------------------------------------------------------------------------------------

_FS = "ic_mean icir rank_ic_mean long_short_return sharpe_ratio max_drawdown win_rate"
_FSUM = f"""(SELECT * FROM (SELECT factor_name, avg(ic) AS ic_mean, avg(ic) / nullif(stddev_samp(ic), 0) AS icir, avg(rank_ic) AS rank_ic_mean FROM raw_ics WHERE period = 5 GROUP BY factor_name) JOIN (
  SELECT factor_name, avg(long_short) AS long_short_return, CASE WHEN stddev_samp(long_short) > 1e-12 THEN avg(long_short) / stddev_samp(long_short) * sqrt(252.0) ELSE 0.0 END AS sharpe_ratio, min(dd) AS max_drawdown, avg(CASE WHEN long_short > 0 THEN 1.0 ELSE 0.0 END) AS win_rate FROM (
    SELECT *, e / max(e) OVER (PARTITION BY factor_name ORDER BY date) - 1 AS dd FROM (SELECT *, product(1 + long_short) OVER (PARTITION BY factor_name ORDER BY date) AS e FROM groups)) GROUP BY factor_name) USING (factor_name))"""


@query("factor_summary", R(_FS, _FSUM, "factor_name"))
def _(spark, d):
    return scoring.factor_summary(long(spark, d))


@query("factor_score", f"""SELECT factor_name, factor_score, CASE WHEN factor_score >= 90 THEN 'Excellent' WHEN factor_score >= 75 THEN 'Good' WHEN factor_score >= 60 THEN 'Average' ELSE 'Weak' END AS rating FROM (
  SELECT factor_name, round(least(greatest(abs(icir) / 0.5, 0.0), 1.0) * 30 + least(greatest(abs(long_short_return) * 252 / 0.20, 0.0), 1.0) * 30 + least(greatest(abs(sharpe_ratio) / 2.0, 0.0), 1.0) * 20 + least(greatest(abs(win_rate - 0.5) / 0.15, 0.0), 1.0) * 10 + least(greatest(1 - abs(max_drawdown) / 0.3, 0.0), 1.0) * 10, 2) + 0.0 AS factor_score FROM {_FSUM})""")
def _(spark, d):
    return scoring.factor_score(scoring.factor_summary(long(spark, d))).select("factor_name", "factor_score", "rating")


# --- universes, joins, metadata -------------------------------------------------------------------------------------

_UC = universe.UniverseConfig(min_adv20=20000.0)


@query("universe_filter", R("adv20", "universe", "date stock trading_age"))
def _(spark, d):
    return universe.eligible(fixtures.panel(spark, d), _UC).select("date", "stock", "trading_age", "adv20")


@query("pit_universe", "SELECT u.date, u.stock FROM universe u JOIN master m ON u.stock = m.stock AND u.date >= listing_date AND (delisting_date IS NULL OR delisting_date > u.date)")
def _(spark, d):
    return universe.SecurityMasterUniverse(fixtures.master(spark, d), _UC).universe(fixtures.panel(spark, d)).select("date", "stock")


@query("index_membership", "SELECT DISTINCT u.date, u.stock FROM universe u JOIN membership m ON u.stock = m.stock AND u.date >= effective_date AND (end_date IS NULL OR u.date <= end_date)")
def _(spark, d):
    return universe.IndexUniverse(fixtures.membership(spark, d), _UC).universe(fixtures.panel(spark, d), "INDEX").select("date", "stock")


@query("seasoned_universe", "SELECT p.date, p.stock FROM panel p JOIN master m ON p.stock = m.stock AND p.date >= listing_date + 120 AND (delisting_date IS NULL OR p.date < delisting_date)")
def _(spark, d):
    return universe.seasoned(fixtures.panel(spark, d), fixtures.master(spark, d)).select("date", "stock")


@query("asof_fundamentals", "SELECT p.date, p.stock, report_period, announcement_date AS available_date, announcement_date IS NOT NULL AS point_in_time_available, round(roe, 6) + 0.0 AS roe FROM panel p ASOF LEFT JOIN reports r ON p.stock = r.stock AND p.date >= r.announcement_date")
def _(spark, d):
    return pit.align_fundamentals(fixtures.panel(spark, d).select("date", "stock"), fixtures.reports(spark, d)).select("date", "stock", "report_period", "available_date", "point_in_time_available", "roe")


@query("pit_panel_quality", " UNION ALL ".join(f"SELECT '{m}' AS measure, round(avg(CASE WHEN {m} IS NULL THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS missing_ratio, max(CASE WHEN {m} IS NOT NULL THEN date END) AS latest_valid_date FROM panel p ASOF LEFT JOIN reports r ON p.stock = r.stock AND p.date >= r.announcement_date" for m in ("pe", "pb", "roe")))
def _(spark, d):
    return pit.coverage(pit.align_fundamentals(fixtures.panel(spark, d).select("date", "stock"), fixtures.reports(spark, d)), "pe", "pb", "roe")


_RATE = "CASE WHEN regexp_matches(stock, '^(300|301|688)') THEN CAST(0.2 AS DOUBLE) WHEN regexp_matches(stock, '^[84]') THEN CAST(0.3 AS DOUBLE) ELSE CAST(0.1 AS DOUBLE) END"


@query("market_metadata", f"""SELECT date, stock, round(amount, 6) + 0.0 AS amount, FALSE AS is_st, FALSE AS is_suspended, round(limit_up_price, 6) + 0.0 AS limit_up_price, round(limit_down_price, 6) + 0.0 AS limit_down_price, coalesce(high = low AND close >= limit_up_price - 1e-9, FALSE) AS limit_up, coalesce(high = low AND close <= limit_down_price + 1e-9, FALSE) AS limit_down FROM (
  SELECT *, floor(b * (1 + {_RATE}) * 100 + 0.5) / 100 AS limit_up_price, floor(b * (1 - {_RATE}) * 100 + 0.5) / 100 AS limit_down_price FROM (SELECT *, lag(close) OVER (PARTITION BY stock ORDER BY date) AS b FROM panel))""")
def _(spark, d):
    done = market_metadata.enrich(fixtures.panel(spark, d), rounding=lambda c, n: F.floor(c * 100 + 0.5) / 100)  # as SQL can say it
    return done.select("date", "stock", "amount", "is_st", "is_suspended", "limit_up_price", "limit_down_price", "limit_up", "limit_down")


@query("exposures", "SELECT date, p.stock, industry, round(market_cap, 6) + 0.0 AS market_cap FROM panel p LEFT JOIN expo e ON p.stock = e.stock")
def _(spark, d):
    e = fixtures.supplier_exposures(spark, d)
    p = fixtures.panel(spark, d).select("date", "stock").join(e.select("stock", "market_cap"), "stock", "left")
    dated = e.select("stock", F.lit("1990-01-01").cast("date").alias("effective_date"), "industry")
    return pit.exposures(p, dated).select("date", "stock", "industry", "market_cap")


@query("asof_prices", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, round(close, 6) + 0.0 AS close FROM (SELECT *, lpad(CAST(o_custkey % 10 + 1 AS VARCHAR), 6, '0') AS stock, CAST(o_orderdate AS DATE) AS od FROM orders) o ASOF LEFT JOIN panel p ON o.stock = p.stock AND o.od >= p.date")
def _(spark, d):
    o = fixtures.table(spark, d, "orders").select("o_orderkey", F.lpad((F.col("o_custkey") % 10 + 1).cast("string"), 6, "0").alias("stock"), F.to_date("o_orderdate").alias("day"))
    return asof.asof_join(o, fixtures.panel(spark, d).select("stock", "date", "close"), "day", "date").select("o_orderkey", "day", "close")


# --- neutralization and combination ---------------------------------------------------------------------------------


def _neutral_sql(size: bool, industry: bool) -> str:
    cap = "CASE WHEN market_cap > 0 THEN ln(CASE WHEN market_cap > 0 THEN market_cap END) END" if size else "0.0"
    ind = "industry" if industry else "'all'"
    least = f"greatest(5, 1 + {int(size)} + {'greatest(kinds - 1, 0)' if industry else 0} + 1)"
    return f"""(SELECT date, stock, factor_name, normalized_value, market_cap, industry, status AS neutralization_status, CASE WHEN status = 'neutralized' THEN z ELSE normalized_value END AS neutralized_value FROM (
  SELECT *, CASE WHEN res IS NULL THEN NULL WHEN stddev_pop(res) OVER g > 1e-12 THEN (res - avg(res) OVER g) / stddev_pop(res) OVER g ELSE 0.0 END AS z, CASE WHEN nn < {least} THEN 'insufficient_sample_fallback' WHEN ok THEN 'neutralized' ELSE 'missing_exposure_fallback' END AS status FROM (
    SELECT *, yy - {"CASE WHEN sum(xx * xx) OVER g > 1e-12 THEN sum(xx * yy) OVER g / sum(xx * xx) OVER g ELSE 0.0 END" if size else "0.0"} * xx AS res FROM (
      SELECT *, count(y) OVER g AS nn, y - avg(y) OVER i AS yy, x - avg(x) OVER i AS xx FROM (
        SELECT *, CASE WHEN ok THEN normalized_value END AS y, CASE WHEN ok THEN c END AS x FROM (
          SELECT *, normalized_value IS NOT NULL AND c IS NOT NULL AS ok, k.kinds FROM (SELECT prep.*, market_cap, industry, {cap} AS c, {ind} AS grp FROM prep LEFT JOIN expo USING (stock)) JOIN (SELECT date, factor_name, count(DISTINCT industry) AS kinds FROM prep LEFT JOIN expo USING (stock) GROUP BY date, factor_name) k USING (date, factor_name)))
      WINDOW g AS (PARTITION BY date, factor_name), i AS (PARTITION BY date, factor_name, grp)) WINDOW g AS (PARTITION BY date, factor_name)) WINDOW g AS (PARTITION BY date, factor_name)))"""


def _exposed(spark, d):
    return prep(spark, d).join(fixtures.supplier_exposures(spark, d), "stock", "left")


@query("neutralize_size", R("neutralized_value", _neutral_sql(True, False), "date stock factor_name neutralization_status"))
def _(spark, d):
    return neutralize.neutralize(_exposed(spark, d), config=neutralize.NeutralizationConfig(use_industry=False)).select("date", "stock", "factor_name", "neutralization_status", "neutralized_value")


@query("neutralize_industry_size", R("neutralized_value", _neutral_sql(True, True), "date stock factor_name neutralization_status"))
def _(spark, d):
    return neutralize.neutralize(_exposed(spark, d)).select("date", "stock", "factor_name", "neutralization_status", "neutralized_value")


@query("neutralization_status", f"SELECT factor_name, neutralization_status, count(*) AS n FROM {_neutral_sql(True, True)} GROUP BY factor_name, neutralization_status")
def _(spark, d):
    return neutralize.neutralize(_exposed(spark, d)).groupBy("factor_name", "neutralization_status").agg(F.count("*").alias("n"))


def _r2(c: str) -> str:
    return f"(SELECT date, factor_name, CASE WHEN sum(n) >= 3 AND count(*) >= 2 THEN CASE WHEN sum(ss) - sum(s) * sum(s) / sum(n) > 1e-12 THEN (sum(s * s / n) - sum(s) * sum(s) / sum(n)) / (sum(ss) - sum(s) * sum(s) / sum(n)) ELSE 0.0 END END AS r2 FROM (SELECT date, factor_name, industry, count(*) AS n, sum({c}) AS s, sum({c} * {c}) AS ss FROM neutral WHERE {c} IS NOT NULL AND industry IS NOT NULL GROUP BY date, factor_name, industry) GROUP BY date, factor_name)"


CTE["neutral"] = f"SELECT * FROM {_neutral_sql(True, True)}"
_CAP = "CASE WHEN market_cap > 0 THEN ln(CASE WHEN market_cap > 0 THEN market_cap END) END"


@query("neutralization_diag", f"""SELECT factor_name, round(avg(b), 6) + 0.0 AS before_size_corr, round(avg(a), 6) + 0.0 AS after_size_corr, round(avg(rb), 6) + 0.0 AS before_industry_r2, round(avg(ra), 6) + 0.0 AS after_industry_r2 FROM (
  SELECT date, factor_name, covar_pop(normalized_value, c) / nullif(stddev_pop(CASE WHEN c IS NOT NULL THEN normalized_value END) * stddev_pop(CASE WHEN normalized_value IS NOT NULL THEN c END), 0) AS b, covar_pop(neutralized_value, c) / nullif(stddev_pop(CASE WHEN c IS NOT NULL THEN neutralized_value END) * stddev_pop(CASE WHEN neutralized_value IS NOT NULL THEN c END), 0) AS a FROM (SELECT *, {_CAP} AS c FROM neutral) GROUP BY date, factor_name) x
  LEFT JOIN (SELECT date, factor_name, r2 AS rb FROM {_r2("normalized_value")}) USING (date, factor_name) LEFT JOIN (SELECT date, factor_name, r2 AS ra FROM {_r2("neutralized_value")}) USING (date, factor_name) GROUP BY factor_name""")
def _(spark, d):
    return neutralize.diagnostics(neutralize.neutralize(_exposed(spark, d)))


_W = {"momentum_20": 0.3, "momentum_60": 0.3, "volatility_20": 0.2, "volume_change_20": 0.2}


@query("combine_static", "SELECT date, stock, round(sum(w * directed_value) / nullif(sum(abs(w)), 0), 6) + 0.0 AS score FROM prep JOIN (VALUES ('momentum_20', CAST(0.3 AS DOUBLE)), ('momentum_60', CAST(0.3 AS DOUBLE)), ('volatility_20', CAST(0.2 AS DOUBLE)), ('volume_change_20', CAST(0.2 AS DOUBLE))) t(factor_name, w) USING (factor_name) WHERE directed_value IS NOT NULL GROUP BY date, stock")
def _(spark, d):
    return combine.combine_static(prep(spark, d), _W)


@query("combine_equal", "SELECT date, stock, round(avg(directed_value), 6) + 0.0 AS score FROM prep GROUP BY date, stock")
def _(spark, d):
    return combine.combine_equal(prep(spark, d))


def _roll_sql(icir: bool) -> str:
    sig = "CASE WHEN count(ic) OVER w >= 30 THEN avg(ic) OVER w END"
    sig = f"CASE WHEN stddev_samp(ic) OVER w > 1e-12 THEN {sig} / stddev_samp(ic) OVER w END" if icir else sig
    return f"""SELECT date, factor_name, round(CASE WHEN count(s) OVER d = 0 OR sum(abs(s)) OVER d = 0 THEN 1.0 / (SELECT count(DISTINCT factor_name) FROM ics) ELSE coalesce(s / sum(abs(s)) OVER d, 0.0) END, 6) + 0.0 AS weight FROM (
  SELECT g.date, g.factor_name, {sig} AS s FROM (SELECT * FROM (SELECT DISTINCT date FROM ics WHERE period = 1) CROSS JOIN (SELECT DISTINCT factor_name FROM ics WHERE period = 1)) g LEFT JOIN (SELECT date, factor_name, ic FROM ics WHERE period = 1) i ON g.date = i.date AND g.factor_name = i.factor_name
  WINDOW w AS (PARTITION BY g.factor_name ORDER BY g.date ROWS BETWEEN 120 PRECEDING AND 1 PRECEDING)) WINDOW d AS (PARTITION BY date)"""


@query("rolling_ic_weights", _roll_sql(False))
def _(spark, d):
    return combine.rolling_weights(ic.daily_ic(prep(spark, d), "directed_value", (1,), ranks=False), fa.TECHNICAL, "rolling_ic", 120, 30)


@query("rolling_icir_weights", _roll_sql(True))
def _(spark, d):
    return combine.rolling_weights(ic.daily_ic(prep(spark, d), "directed_value", (1,), ranks=False), fa.TECHNICAL, "rolling_icir", 120, 30)


# --- walk-forward ---------------------------------------------------------------------------------------------------


@query("walk_forward_folds", "SELECT CAST(fold AS BIGINT) AS fold, train_start, train_end, test_start, test_end FROM folds")
def _(spark, d):
    return walkforward.folds(long(spark, d), WF)


@query("wf_weights", R("weight", "(SELECT CAST(fold AS BIGINT) AS fold, method, factor_name, weight FROM fold_weights)", "fold method factor_name"))
def _(spark, d):
    p = held(spark, d)
    return walkforward.fold_weights(ic.daily_ic(p, "directed_value", (1,), ranks=False), walkforward.folds(p, WF))


@query("wf_daily", R("gross benchmark turnover cost net", "(SELECT * REPLACE (CAST(fold AS BIGINT) AS fold) FROM wf_daily)", "fold method date"))
def _(spark, d):
    return walk(spark, d).select("fold", "method", "date", "gross", "benchmark", "turnover", "cost", "net")


_WFM = "annualized_return volatility sharpe max_drawdown information_ratio turnover transaction_cost benchmark_excess_return"


def _wf_sql(source: str, keys: str) -> str:
    annual = "CASE WHEN product(1 + net) <= 0 THEN -1.0 ELSE power(product(1 + net), 252.0 / count(net)) - 1 END"
    vol = "stddev_samp(net) * sqrt(252.0)"
    return f"""(SELECT {keys}, {annual} AS annualized_return, coalesce({vol}, 0.0) AS volatility, CASE WHEN {vol} > 1e-12 THEN {annual} / ({vol}) ELSE 0.0 END AS sharpe, min(drawdown) AS max_drawdown, CASE WHEN stddev_samp(net - benchmark) > 1e-12 THEN avg(net - benchmark) / stddev_samp(net - benchmark) * sqrt(252.0) ELSE 0.0 END AS information_ratio, sum(turnover) AS turnover, sum(cost) AS transaction_cost, sum(net) - sum(benchmark) AS benchmark_excess_return FROM {source} GROUP BY {keys})"""


@query("wf_summary", R(_WFM, _wf_sql("wf_curve", "fold, method").replace("SELECT fold, method", "SELECT CAST(fold AS BIGINT) AS fold, method", 1), "fold method"))
def _(spark, d):
    return walkforward.summarize(walk(spark, d), "fold", "method")


@query("wf_strategies", R(_WFM, _wf_sql("(SELECT *, e / max(e) OVER (PARTITION BY method ORDER BY date) - 1 AS drawdown FROM (SELECT *, product(1 + net) OVER (PARTITION BY method ORDER BY date) AS e FROM wf_daily))", "method"), "method"))
def _(spark, d):
    return walkforward.summarize(walk(spark, d), "method")


@query("turnover", R("turnover", "(SELECT method, CAST(fold AS BIGINT) AS fold, sum(turnover) AS turnover FROM wf_daily GROUP BY method, fold)", "method fold"))
def _(spark, d):
    return walk(spark, d).groupBy("method", "fold").agg(F.sum("turnover").alias("turnover"))


@query("drawdown_curve", R("equity drawdown", "(SELECT method, CAST(fold AS BIGINT) AS fold, date, equity, drawdown FROM wf_curve)", "method fold date"))
def _(spark, d):
    return metrics.with_drawdown(walk(spark, d), "net", "fold", "method").select("method", "fold", "date", "equity", "drawdown")


@query("relative_metrics", """SELECT method, round(beta, 6) + 0.0 AS beta, round((m - beta * mb) * 252, 6) + 0.0 AS jensen_alpha, round(te, 6) + 0.0 AS tracking_error, round(me * 252, 6) + 0.0 AS annualized_excess_return, round(ir, 6) + 0.0 AS information_ratio FROM (
  SELECT method, CASE WHEN var_samp(benchmark) > 1e-16 THEN covar_samp(net, benchmark) / var_samp(benchmark) END AS beta, avg(net) AS m, avg(benchmark) AS mb, stddev_samp(net - benchmark) * sqrt(252.0) AS te, avg(net - benchmark) AS me, CASE WHEN stddev_samp(net - benchmark) > 1e-12 THEN avg(net - benchmark) / stddev_samp(net - benchmark) * sqrt(252.0) ELSE 0.0 END AS ir FROM wf_daily GROUP BY method)""")
def _(spark, d):
    return metrics.relative_metrics(walk(spark, d), "net", "benchmark", "method")


@query("yearly_oos", "SELECT method, year(date) AS year, round(product(1 + net) - 1, 6) + 0.0 AS strategy_return, round(product(1 + benchmark) - 1, 6) + 0.0 AS benchmark_return, round(avg(CASE WHEN net > benchmark THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS excess_win_rate, round(sum(turnover), 6) + 0.0 AS turnover, round(sum(cost), 6) + 0.0 AS transaction_cost FROM wf_daily GROUP BY method, year(date)")
def _(spark, d):
    daily = walk(spark, d).withColumn("year", F.year("date"))
    return daily.groupBy("method", "year").agg(metrics.total_return("net").alias("strategy_return"), metrics.total_return("benchmark").alias("benchmark_return"), F.avg((F.col("net") > F.col("benchmark")).cast("double")).alias("excess_win_rate"), F.sum("turnover").alias("turnover"), F.sum("cost").alias("transaction_cost"))


@query("cost_sensitivity", "SELECT method, CAST(bp AS BIGINT) AS bp, round(product(1 + gross - turnover * bp / 10000.0) - 1, 6) + 0.0 AS total_return FROM wf_daily CROSS JOIN (VALUES (0), (5), (10), (20), (30)) t(bp) GROUP BY method, bp")
def _(spark, d):
    daily = walk(spark, d).select("method", "gross", "turnover", F.explode(F.array(*map(F.lit, (0, 5, 10, 20, 30)))).alias("bp"))
    return daily.withColumn("net", F.col("gross") - F.col("turnover") * F.col("bp") / 10000.0).groupBy("method", "bp").agg(metrics.total_return("net").alias("total_return"))


@query("top_sensitivity", "SELECT round(top, 6) + 0.0 AS top, round(product(1 + gross) - 1, 6) + 0.0 AS total_return FROM (SELECT fold, date, top, avg(CASE WHEN score >= cut THEN r END) AS gross FROM (SELECT *, CASE top WHEN CAST(0.1 AS DOUBLE) THEN quantile_cont(score, 0.9) OVER w WHEN CAST(0.2 AS DOUBLE) THEN quantile_cont(score, 0.8) OVER w ELSE quantile_cont(score, 0.7) OVER w END AS cut FROM wf_scored CROSS JOIN (VALUES (CAST(0.1 AS DOUBLE)), (CAST(0.2 AS DOUBLE)), (CAST(0.3 AS DOUBLE))) t(top) WHERE method = 'equal_weight' WINDOW w AS (PARTITION BY fold, date, top)) GROUP BY fold, date, top) GROUP BY top")
def _(spark, d):
    return walk(spark, d, methods=("equal_weight",), top=(0.1, 0.2, 0.3)).groupBy("top").agg(metrics.total_return("gross").alias("total_return"))


# --- scores and backtest --------------------------------------------------------------------------------------------


def _pick(names: str) -> str:
    return f"avg(CASE WHEN factor_name IN ({names}) THEN s END)"


def _weigh(cols: dict[str, float]) -> str:
    return "(" + " + ".join(f"coalesce({c}, 0.0) * CAST({w} AS DOUBLE)" for c, w in cols.items()) + ") / nullif(" + " + ".join(f"CASE WHEN {c} IS NULL THEN 0.0 ELSE CAST({w} AS DOUBLE) END" for c, w in cols.items()) + ", 0)"


_STOCK = f"(SELECT stock, round(m, 2) AS momentum_score, round(v, 2) AS volatility_score, round(u, 2) AS volume_score, round({_weigh({'m': 0.4, 'v': 0.2, 'u': 0.2})}, 2) AS final_score FROM (SELECT stock, {_pick(chr(39) + 'momentum_20' + chr(39) + ', ' + chr(39) + 'momentum_60' + chr(39))} AS m, {_pick(chr(39) + 'volatility_20' + chr(39) + ', ' + chr(39) + 'volatility_60' + chr(39))} AS v, {_pick(chr(39) + 'volume_change_20' + chr(39))} AS u FROM (SELECT stock, factor_name, {rank('directed_value', 'factor_name')} / count(*) OVER (PARTITION BY factor_name) * 100 AS s FROM prep WHERE date = (SELECT max(date) FROM prep)) GROUP BY stock))"


@query("stock_scores", R("momentum_score volatility_score volume_score final_score", _STOCK, "stock"))
def _(spark, d):
    return scoring.stock_scores(long(spark, d))


CTE["ts_scores"] = f"SELECT * FROM (SELECT stock, factor_name, {rank('v', 'stock, factor_name')} / count(*) OVER (PARTITION BY stock, factor_name) * 100 AS s, row_number() OVER (PARTITION BY stock, factor_name ORDER BY date DESC) AS i FROM (SELECT *, CASE WHEN factor_name = 'volume_change_20' THEN -abs(factor_value - CAST(1.2 AS DOUBLE)) WHEN factor_name LIKE 'volatility%' THEN -factor_value ELSE factor_value END AS v FROM long)) WHERE i = 1"
_STOCK_TS = _STOCK[: _STOCK.index("FROM (SELECT stock, factor_name, (rank()")] + "FROM ts_scores GROUP BY stock))"


@query("stock_scores_ts", R("momentum_score volatility_score volume_score final_score", _STOCK_TS, "stock"))
def _(spark, d):
    return scoring.stock_scores(long(spark, d), "time_series_percentile")


CTE["mf_latest"] = "SELECT * FROM (SELECT p.stock, pe, pb, roe, row_number() OVER (PARTITION BY p.stock ORDER BY p.date DESC) AS i FROM panel p ASOF LEFT JOIN reports r ON p.stock = r.stock AND p.date >= r.announcement_date WHERE pe IS NOT NULL) WHERE i = 1"
CTE["mf_long"] = "SELECT stock, 'pe_factor' AS factor_name, CASE WHEN pe > 0 THEN 1.0 / pe END AS v FROM mf_latest UNION ALL SELECT stock, 'pb_factor', CASE WHEN pb > 0 THEN 1.0 / pb END FROM mf_latest UNION ALL SELECT stock, 'roe_factor', roe FROM mf_latest"
CTE["mf_w"] = "SELECT *, least(greatest(v, quantile_cont(v, 0.01) OVER k), quantile_cont(v, 0.99) OVER k) AS w FROM (SELECT * FROM mf_long WHERE v IS NOT NULL) WINDOW k AS (PARTITION BY factor_name)"
CTE["mf_z"] = "SELECT *, CASE WHEN stddev_pop(w) OVER k > 1e-12 THEN round((w - avg(w) OVER k) / stddev_pop(w) OVER k, 12) ELSE 0.0 END AS z FROM mf_w WINDOW k AS (PARTITION BY factor_name)"
CTE["mf_scores"] = f"SELECT stock, avg(s) FILTER (WHERE factor_name <> 'roe_factor') AS value_score, avg(s) FILTER (WHERE factor_name = 'roe_factor') AS quality_score FROM (SELECT *, {rank('z', 'factor_name')} / count(*) OVER (PARTITION BY factor_name) * 100 AS s FROM mf_z) GROUP BY stock"
_MULTI = f"(SELECT stock, technical_score, round(value_score, 2) AS value_score, round(quality_score, 2) AS quality_score, round({_weigh({'technical_score': 0.4, 'value_score': 0.3, 'quality_score': 0.3})}, 2) AS multifactor_score FROM (SELECT stock, final_score AS technical_score FROM {_STOCK}) JOIN mf_scores USING (stock))"


@query("multifactor_scores", R("technical_score value_score quality_score multifactor_score", _MULTI, "stock"))
def _(spark, d):
    f = pit.align_fundamentals(fixtures.panel(spark, d).select("date", "stock"), fixtures.reports(spark, d)).where("pe is not null")
    return scoring.multifactor_scores(long(spark, d), f)


def _backtest(spark, d, constrained):
    p = materialize(fixtures.panel(spark, d), "panel")
    scores = combine.combine_equal(preprocess.with_direction(preprocess.preprocess_factors(fa.to_long(fa.technical_factors(p)))))
    market = materialize(market_metadata.enrich(p), "market") if constrained else p
    return backtest.backtest(market, scores, fixtures.benchmark(p), constrained=constrained)


_BT = """WITH cal AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i, lead(date) OVER (ORDER BY date) AS nxt FROM (SELECT DISTINCT date FROM panel)),
sc AS (SELECT p.date, p.stock, avg(directed_value) AS score FROM prep p JOIN cal ON p.date = cal.date WHERE i >= 65 AND (i - 65) % 20 = 0 GROUP BY ALL),
tw AS (SELECT date, stock, 1.0 / k AS weight FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY score DESC, stock) AS rn, greatest(1, ceil(count(*) OVER (PARTITION BY date) * CAST(0.2 AS DOUBLE))) AS k FROM sc) WHERE rn <= k),
sp AS (SELECT u.date AS set_on, c.nxt AS a, lead(c.nxt) OVER (ORDER BY u.date) AS b, row_number() OVER (ORDER BY u.date) AS j FROM (SELECT DISTINCT date FROM tw) u JOIN cal c ON u.date = c.date),
dy AS (SELECT cal.date, sp.set_on, sp.a FROM cal JOIN sp ON cal.date >= sp.a AND (sp.b IS NULL OR cal.date < sp.b)),
gr AS (SELECT dy.date, dy.set_on, any_value(dy.a) AS a, coalesce(sum(weight * r), 0.0) AS gross, sum(weight) AS inv FROM dy JOIN tw ON tw.date = dy.set_on LEFT JOIN returns q ON q.date = dy.date AND q.stock = tw.stock GROUP BY dy.date, dy.set_on),
mv AS (SELECT j, sum(abs(w - pw)) AS moved FROM (SELECT j, stock, w, lag(w, 1, 0.0) OVER (PARTITION BY stock ORDER BY j) AS pw FROM (SELECT sp.j, s.stock, coalesce(tw.weight, 0.0) AS w FROM sp CROSS JOIN (SELECT DISTINCT stock FROM tw) s LEFT JOIN tw ON tw.date = sp.set_on AND tw.stock = s.stock)) GROUP BY j),
bt AS (SELECT gr.date, gross, t AS turnover, t * 0.001 AS cost, gross - t * 0.001 AS portfolio_return, benchmark_return FROM (
  SELECT gr.*, CASE WHEN gr.date = gr.a THEN coalesce(mv.moved, 0.0) ELSE 0.0 END AS t FROM gr JOIN sp ON sp.set_on = gr.set_on LEFT JOIN mv ON mv.j = sp.j WHERE inv > 0) gr JOIN bench ON bench.date = gr.date WHERE benchmark_return IS NOT NULL)"""
_BT_COLS = "gross turnover cost portfolio_return benchmark_return"


@query("backtest_daily", _BT + " " + R(_BT_COLS, "bt", "date"))
def _(spark, d):
    return _backtest(spark, d, False)


@query("backtest_constrained")
def _(spark, d):
    return _backtest(spark, d, True)


_PERF = "total_return benchmark_return alpha annual_return sharpe_ratio max_drawdown win_rate information_ratio"
_PERF_SQL = """(SELECT 'equal_weight' AS strategy, product(1 + portfolio_return) - 1 AS total_return, product(1 + benchmark_return) - 1 AS benchmark_return, product(1 + portfolio_return) - product(1 + benchmark_return) AS alpha, CASE WHEN product(1 + portfolio_return) <= 0 THEN -1.0 ELSE power(product(1 + portfolio_return), 252.0 / count(portfolio_return)) - 1 END AS annual_return,
  CASE WHEN stddev_samp(portfolio_return) > 1e-12 THEN avg(portfolio_return) / stddev_samp(portfolio_return) * sqrt(252.0) ELSE 0.0 END AS sharpe_ratio, min(drawdown) AS max_drawdown, avg(CASE WHEN portfolio_return > 0 THEN 1.0 ELSE 0.0 END) AS win_rate, CASE WHEN stddev_samp(portfolio_return - benchmark_return) > 1e-12 THEN avg(portfolio_return - benchmark_return) / stddev_samp(portfolio_return - benchmark_return) * sqrt(252.0) ELSE 0.0 END AS information_ratio
  FROM (SELECT *, e / max(e) OVER (ORDER BY date) - 1 AS drawdown FROM (SELECT *, product(1 + portfolio_return) OVER (ORDER BY date) AS e FROM bt)))"""


@query("perf_metrics", _BT + " " + R(_PERF, _PERF_SQL, "strategy"))
def _(spark, d):
    return metrics.backtest_metrics(_backtest(spark, d, False).withColumn("strategy", F.lit("equal_weight")), "portfolio_return", "benchmark_return", "strategy")


# --- guards ---------------------------------------------------------------------------------------------------------


@query("sample_guard", "SELECT round(m, 6) + 0.0 AS median_size, mn AS min_size, round(av, 6) + 0.0 AS mean_size, dates, CASE WHEN m < 30 THEN 'ENGINEERING_SMOKE_TEST' WHEN m < 100 THEN 'SMALL_SAMPLE_RESEARCH' ELSE 'VALID_CROSS_SECTIONAL_RESEARCH' END AS sample_class, mn >= 5 AS quintile_available FROM (SELECT median(n) AS m, min(n) AS mn, avg(n) AS av, count(*) AS dates FROM (SELECT date, count(DISTINCT stock) AS n FROM long GROUP BY date))")
def _(spark, d):
    return guards.sample_guard(long(spark, d))


@query("formal_guard", "SELECT s AS stocks, round(y, 6) + 0.0 AS years, s >= 100 AND y >= 5 AS formal FROM (SELECT count(DISTINCT stock) AS s, date_diff('day', min(date), max(date)) / CAST(365.2425 AS DOUBLE) AS y FROM long)")
def _(spark, d):
    return guards.formal_guard(long(spark, d))


@query("survivorship_audit", """SELECT year, round(a, 6) + 0.0 AS average_universe_size, c AS delisted_contributors, delisted, w AS delisted_with_prices, round(CASE WHEN delisted > 0 THEN w * 1.0 / delisted ELSE 0.0 END, 6) + 0.0 AS coverage, CASE WHEN w > 0 THEN 'PARTIAL' ELSE 'UNRESOLVED' END AS survivorship FROM (
  SELECT year, avg(n) AS a FROM (SELECT year(date) AS year, date, count(DISTINCT stock) AS n FROM panel GROUP BY ALL) GROUP BY year) JOIN (SELECT year(date) AS year, count(DISTINCT CASE WHEN m.delisting_date IS NOT NULL THEN p.stock END) AS c FROM panel p LEFT JOIN master m ON p.stock = m.stock GROUP BY 1) USING (year)
  CROSS JOIN (SELECT count(*) AS delisted, CAST(count(*) FILTER (WHERE m.stock IN (SELECT stock FROM panel)) AS BIGINT) AS w FROM master m WHERE delisting_date IS NOT NULL)""")
def _(spark, d):
    return guards.survivorship_audit(fixtures.panel(spark, d), fixtures.master(spark, d))


@query("stable_sample", "SELECT stock, sha256('20240911:' || stock) AS key FROM (SELECT DISTINCT stock FROM panel) ORDER BY key LIMIT 25")
def _(spark, d):
    return guards.stable_sample(fixtures.panel(spark, d), 25, 20240911)


def _diagnosis_sql(where: str = "") -> str:
    return f"SELECT factor_name, CASE WHEN count(*) FILTER (WHERE period IN (1, 5) AND m < 0) = 2 AND count(*) FILTER (WHERE period IN (20, 40) AND m > 0) > 0 THEN 'short-term reversal pattern' WHEN bool_and(coalesce(m < 0, FALSE)) THEN 'momentum broadly ineffective in this sample' ELSE 'sample noise / regime dependence' END AS diagnosis FROM (SELECT factor_name, period, avg(rank_ic) AS m FROM ics{where} GROUP BY factor_name, period) GROUP BY factor_name"


@query("momentum_diagnosis", _diagnosis_sql())
def _(spark, d):
    return guards.momentum_diagnosis(ic.ic_decay(prep(spark, d), "directed_value", HORIZONS))


# --- studies --------------------------------------------------------------------------------------------------------

_VOL = ("volatility_10", "volatility_20", "volatility_40", "volatility_60")
CTE["lv_tech"] = "SELECT date, stock, close, " + ", ".join(f"CASE WHEN count(r) OVER v{n} = {n} THEN stddev_samp(r) OVER v{n} END AS volatility_{n}" for n in (10, 20, 40, 60)) + ", " + ", ".join(f"lead(close, {h}) OVER w / close - 1 AS forward_return_{h}d" for h in HORIZONS) + " FROM returns WINDOW w AS (PARTITION BY stock ORDER BY date), " + ", ".join(f"v{n} AS (PARTITION BY stock ORDER BY date ROWS {n - 1} PRECEDING)" for n in (10, 20, 40, 60))
CTE["lv_long"] = " UNION ALL ".join(f"SELECT date, stock, '{f}' AS factor_name, {f} AS v, " + ", ".join(f"forward_return_{h}d" for h in HORIZONS) + f" FROM lv_tech WHERE {f} IS NOT NULL AND forward_return_5d IS NOT NULL" for f in _VOL)
CTE["lv_bounds"] = "SELECT date, factor_name, any_value(lo) AS lo, any_value(hi) AS hi, any_value(m) AS m, median(abs(v - m)) AS mad FROM (SELECT date, factor_name, v, quantile_cont(v, 0.01) OVER k AS lo, quantile_cont(v, 0.99) OVER k AS hi, median(v) OVER k AS m FROM lv_long WINDOW k AS (PARTITION BY date, factor_name)) GROUP BY date, factor_name"
CTE["lv_w"] = f"SELECT lv_long.*, least(greatest(v, m - 3 * mad), m + 3 * mad) AS w1, least(greatest(v, lo), hi) AS w2, {rank('v', 'date, factor_name')} / count(*) OVER (PARTITION BY date, factor_name) AS p FROM lv_long JOIN lv_bounds USING (date, factor_name)"
CTE["lv_z"] = "SELECT *, " + ", ".join(f"-(CASE WHEN stddev_pop(w{i}) OVER k > 1e-12 THEN round((w{i} - avg(w{i}) OVER k) / stddev_pop(w{i}) OVER k, 12) ELSE 0.0 END) AS z{i}" for i in (1, 2)) + ", -p * 100 AS z3 FROM lv_w WINDOW k AS (PARTITION BY date, factor_name)"
CTE["lv_pairs"] = " UNION ALL ".join(f"SELECT date, stock, factor_name, '{n}' AS variant, {z} AS x, {h} AS period, forward_return_{h}d AS y FROM lv_z WHERE forward_return_{h}d IS NOT NULL" for n, z in (("mad_zscore", "z1"), ("percentile_zscore", "z2"), ("percentile_rank", "z3")) for h in HORIZONS)


def _grid_sql(pairs: str) -> str:
    q = f"""SELECT factor_name, variant, period, avg(q1) AS q1, avg(q2) AS q2, avg(q3) AS q3, avg(q4) AS q4, avg(q5) AS q5, avg(q5 - q1) AS spread FROM (
      SELECT date, factor_name, variant, period, avg(CASE WHEN q = 1 THEN y END) AS q1, avg(CASE WHEN q = 2 THEN y END) AS q2, avg(CASE WHEN q = 3 THEN y END) AS q3, avg(CASE WHEN q = 4 THEN y END) AS q4, avg(CASE WHEN q = 5 THEN y END) AS q5 FROM (
        SELECT *, CAST(greatest(1, least(5, ceil(row_number() OVER (PARTITION BY date, factor_name, variant, period ORDER BY x, stock) * 1.0 / count(*) OVER (PARTITION BY date, factor_name, variant, period) * 5))) AS INTEGER) AS q FROM {pairs}) GROUP BY ALL) GROUP BY ALL"""
    return R(_SUM + " spread monotonicity", f"""(SELECT factor_name, variant, CAST(period AS BIGINT) AS period, s.* EXCLUDE (factor_name, variant, period), spread, (CAST(q2 > q1 AS INTEGER) + CAST(q3 > q2 AS INTEGER) + CAST(q4 > q3 AS INTEGER) + CAST(q5 > q4 AS INTEGER)) / 4.0 AS monotonicity FROM (SELECT factor_name, variant, period, {SUMMARY} FROM ({ic_sql(pairs, ", variant")}) GROUP BY ALL) s JOIN ({q}) q USING (factor_name, variant, period))""", "factor_name variant period observations")


@query("robustness_grid_low_vol", _grid_sql("lv_pairs"))
def _(spark, d):
    return studies.low_volatility_grid(fixtures.panel(spark, d))


CTE["mo_adv"] = "SELECT date, stock, CASE WHEN count(amount) OVER v >= 10 THEN avg(amount) OVER v END AS adv20 FROM panel WINDOW v AS (PARTITION BY stock ORDER BY date ROWS 19 PRECEDING)"
CTE["mo_base"] = f"SELECT *, {rank('adv20', 'date, factor_name')} / count(adv20) OVER (PARTITION BY date, factor_name) AS liq, quantile_cont(directed_value, 0.01) OVER (PARTITION BY factor_name) AS lo, quantile_cont(directed_value, 0.99) OVER (PARTITION BY factor_name) AS hi FROM prep LEFT JOIN mo_adv USING (date, stock) WHERE factor_name IN ('momentum_20', 'momentum_60')"
CTE["mo_pairs"] = " UNION ALL ".join(f"SELECT date, stock, factor_name, '{n}' AS variant, directed_value AS x, {h} AS period, forward_return_{h}d AS y FROM mo_base WHERE forward_return_{h}d IS NOT NULL AND {c}" for n, c in (("raw", "TRUE"), ("remove_bottom_20pct_ADV20", "liq > CAST(0.2 AS DOUBLE)"), ("remove_extreme_1pct_each_tail", "directed_value BETWEEN lo AND hi")) for h in HORIZONS)


@query("robustness_grid_momentum", _grid_sql("mo_pairs"))
def _(spark, d):
    return studies.momentum_grid_of(fixtures.panel(spark, d))


@query("robustness_class", f"SELECT factor_name, round(min(m), 6) + 0.0 AS min_ic, round(avg(CASE WHEN m > 0 THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS positive_share, CASE WHEN avg(CASE WHEN m > 0 THEN 1.0 ELSE 0.0 END) = 1 AND min(m) > 0.03 THEN 'ROBUST' WHEN avg(CASE WHEN m > 0 THEN 1.0 ELSE 0.0 END) >= 0.75 THEN 'PARTIALLY_ROBUST' ELSE 'NOT_ROBUST' END AS robustness FROM (SELECT factor_name, variant, avg(rank_ic) AS m FROM ({ic_sql('lv_pairs', ', variant')}) WHERE period = 5 GROUP BY factor_name, variant) GROUP BY factor_name")
def _(spark, d):
    return studies.robustness(studies.low_volatility_grid(fixtures.panel(spark, d)))


CTE["m120_long"] = "SELECT * FROM (SELECT date, stock, 'momentum_120' AS factor_name, close / lag(close, 120) OVER w - 1 AS v, " + ", ".join(f"lead(close, {h}) OVER w / close - 1 AS forward_return_{h}d" for h in HORIZONS) + " FROM panel WINDOW w AS (PARTITION BY stock ORDER BY date)) WHERE v IS NOT NULL AND forward_return_5d IS NOT NULL"
CTE["m120_bounds"] = "SELECT date, quantile_cont(v, 0.01) AS lo, quantile_cont(v, 0.99) AS hi FROM m120_long GROUP BY date"
CTE["m120_z"] = "SELECT *, CASE WHEN stddev_pop(b) OVER k > 1e-12 THEN round((b - avg(b) OVER k) / stddev_pop(b) OVER k, 12) ELSE 0.0 END AS z FROM (SELECT m120_long.*, least(greatest(v, lo), hi) AS b FROM m120_long JOIN m120_bounds USING (date)) WINDOW k AS (PARTITION BY date)"
CTE["ms_pairs"] = " UNION ALL ".join([*(f"SELECT date, stock, factor_name, 'full' AS variant, z AS x, {h} AS period, forward_return_{h}d AS y FROM m120_z WHERE forward_return_{h}d IS NOT NULL" for h in HORIZONS), "SELECT date, stock, factor_name, CAST(year(date) AS VARCHAR) AS variant, directed_value AS x, 5 AS period, forward_return_5d AS y FROM prep WHERE factor_name IN ('momentum_20', 'momentum_60') AND forward_return_5d IS NOT NULL"])
CTE["mr_pairs"] = "SELECT * FROM mo_pairs UNION ALL SELECT * FROM ms_pairs"


@query("robustness_momentum_scopes", "SELECT * RENAME (variant AS scope) FROM (" + _grid_sql("ms_pairs") + ")")
def _(spark, d):
    return studies.momentum_scopes(held(spark, d), materialize(fixtures.panel(spark, d), "panel"))


@query("momentum_reversal", f"SELECT CASE WHEN bool_and(coalesce(m < 0, FALSE)) THEN 'PERSISTENT_REVERSAL' ELSE 'REGIME_DEPENDENT' END AS diagnosis FROM (SELECT avg(rank_ic) AS m FROM ({ic_sql('mr_pairs', ', variant')}) GROUP BY factor_name, variant, period)")
def _(spark, d):
    return studies.momentum_reversal(held(spark, d), materialize(fixtures.panel(spark, d), "panel"))


@query("momentum_short_term", _diagnosis_sql(" WHERE factor_name IN ('momentum_20', 'momentum_60')"))
def _(spark, d):
    p = prep(spark, d).where(F.col("factor_name").isin("momentum_20", "momentum_60"))
    return guards.momentum_diagnosis(ic.ic_decay(p, "directed_value", HORIZONS))


CTE["ld_pairs"] = " UNION ALL ".join([*(f"SELECT date, stock, factor_name, 'full' AS variant, directed_value AS x, {h} AS period, forward_return_{h}d AS y FROM prep WHERE factor_name IN ('volatility_20', 'volatility_60') AND forward_return_{h}d IS NOT NULL" for h in HORIZONS), "SELECT date, stock, factor_name, CAST(year(date) AS VARCHAR) AS variant, directed_value AS x, 5 AS period, forward_return_5d AS y FROM prep WHERE factor_name IN ('volatility_20', 'volatility_60') AND forward_return_5d IS NOT NULL"])


@query("low_volatility_diagnostic", "SELECT * RENAME (variant AS scope) FROM (" + _grid_sql("ld_pairs") + ")")
def _(spark, d):
    return studies.low_volatility_diagnostic(held(spark, d))


CTE["lq_base"] = f"SELECT *, {rank('adv20', 'date, factor_name')} / count(adv20) OVER (PARTITION BY date, factor_name) AS liq FROM prep LEFT JOIN mo_adv USING (date, stock) WHERE factor_name = 'volatility_20'"
CTE["lq_pairs"] = " UNION ALL ".join(f"SELECT date, stock, factor_name, 'remove_bottom_{c}pct_ADV20' AS variant, directed_value AS x, 5 AS period, forward_return_5d AS y FROM lq_base WHERE forward_return_5d IS NOT NULL AND adv20 IS NOT NULL AND liq > CAST({c / 100} AS DOUBLE)" for c in (10, 20))
CTE["core_pairs"] = "SELECT * FROM lv_pairs WHERE factor_name = 'volatility_20' AND period = 5 UNION ALL SELECT * FROM lq_pairs"


@query("robustness_liquidity_low_vol", _grid_sql("lq_pairs"))
def _(spark, d):
    return studies.low_volatility_liquidity(held(spark, d), materialize(fixtures.panel(spark, d), "panel"))


@query("robustness_class_low_vol", f"SELECT factor_name, round(min(m), 6) + 0.0 AS min_ic, round(avg(CASE WHEN m > 0 THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS positive_share, CASE WHEN avg(CASE WHEN m > 0 THEN 1.0 ELSE 0.0 END) = 1 AND min(m) > 0.03 THEN 'ROBUST' WHEN avg(CASE WHEN m > 0 THEN 1.0 ELSE 0.0 END) >= 0.75 THEN 'PARTIALLY_ROBUST' ELSE 'NOT_ROBUST' END AS robustness FROM (SELECT factor_name, variant, avg(rank_ic) AS m FROM ({ic_sql('core_pairs', ', variant')}) GROUP BY factor_name, variant) GROUP BY factor_name")
def _(spark, d):
    return studies.low_volatility_robustness(held(spark, d), materialize(fixtures.panel(spark, d), "panel"))


def _sweep_sql(sets: dict[str, tuple[str, ...]], methods: tuple[str, ...]) -> None:
    """Relations of a model sweep: each model has its own calendar, folds and weights."""
    dim = ", ".join(f"('{m}', '{f}')" for m, names in sets.items() for f in names)
    CTE["sw_rows"] = f"SELECT model, prep.* FROM prep JOIN (VALUES {dim}) t(model, factor_name) USING (factor_name)"
    CTE["sw_cal"] = "SELECT model, date, row_number() OVER (PARTITION BY model ORDER BY date) - 1 AS i FROM (SELECT DISTINCT model, date FROM sw_rows)"
    CTE["sw_folds"] = """SELECT f.model, f.fold, a.date AS train_start, b.date AS train_end, f.test_start, f.test_end FROM (
      SELECT model, CAST(floor((i - 104) / 26.0) AS INTEGER) AS fold, min(date) AS test_start, max(date) AS test_end, min(i) AS first FROM sw_cal WHERE i >= 104 GROUP BY 1, 2) f
      JOIN sw_cal a ON a.model = f.model AND a.i = greatest(0, f.first - 156) JOIN sw_cal b ON b.model = f.model AND b.i = f.first - 1 WHERE b.i - a.i + 1 >= 104"""
    CTE["sw_weights"] = f"""SELECT model, fold, method, factor_name, CASE WHEN sum(abs(s)) OVER k <= 1e-12 THEN 1.0 / count(*) OVER k ELSE s / sum(abs(s)) OVER k END AS weight FROM (
      SELECT model, fold, factor_name, method, CASE method WHEN 'equal_weight' THEN 1.0 WHEN 'rolling_ic_weight' THEN coalesce(m, 0.0) ELSE CASE WHEN d > 1e-12 THEN coalesce(m / d, 0.0) ELSE 0.0 END END AS s FROM (
        SELECT f.model, f.fold, ics.factor_name, avg(ic) AS m, stddev_samp(ic) AS d FROM ics JOIN (VALUES {dim}) t(model, factor_name) USING (factor_name) JOIN sw_folds f ON f.model = t.model AND date BETWEEN train_start AND train_end WHERE period = 1 GROUP BY ALL)
      CROSS JOIN (VALUES {", ".join(f"('{m}')" for m in methods)}) t(method)) WINDOW k AS (PARTITION BY model, fold, method)"""
    CTE["sw_scored"] = "SELECT w.model, w.fold, w.method, p.date, p.stock, sum(w.weight * p.directed_value) AS score, max(p.forward_return_1d) AS r FROM sw_rows p JOIN sw_folds f ON f.model = p.model AND p.date BETWEEN test_start AND test_end JOIN sw_weights w ON w.model = p.model AND w.fold = f.fold AND w.factor_name = p.factor_name GROUP BY ALL HAVING score IS NOT NULL AND r IS NOT NULL"
    CTE["sw_days"] = "SELECT model, fold, method, date, avg(CASE WHEN held THEN r END) AS gross, avg(r) AS benchmark, list(stock) FILTER (WHERE held) AS holding FROM (SELECT *, score >= quantile_cont(score, 0.8) OVER (PARTITION BY model, fold, method, date) AS held FROM sw_scored) GROUP BY model, fold, method, date"
    CTE["sw_daily"] = """SELECT model, fold, method, date, gross, benchmark, turnover, turnover * 0.001 AS cost, gross - turnover * 0.001 AS net FROM (SELECT *, CASE WHEN p IS NULL THEN 1.0 ELSE CAST(len(holding) + len(p) - 2 * len(list_intersect(holding, p)) AS DOUBLE) / greatest(len(holding) + len(p), 1) END AS turnover FROM (
      SELECT *, lag(holding) OVER (PARTITION BY model, fold, method ORDER BY date) AS p FROM sw_days))"""
    CTE["sw_curve"] = "SELECT *, e / max(e) OVER (PARTITION BY model, method ORDER BY date) - 1 AS drawdown FROM (SELECT *, product(1 + net) OVER (PARTITION BY model, method ORDER BY date) AS e FROM sw_daily)"


_CMP = "oos_return annualized_return volatility sharpe max_drawdown turnover transaction_cost beta jensen_alpha tracking_error annualized_excess_return information_ratio"
_CMP_SQL = """(SELECT *, (m - beta * mb) * 252 AS jensen_alpha FROM (SELECT model, method, product(1 + net) - 1 AS oos_return, CASE WHEN product(1 + net) <= 0 THEN -1.0 ELSE power(product(1 + net), 252.0 / count(net)) - 1 END AS annualized_return, stddev_samp(net) * sqrt(252.0) AS volatility, CASE WHEN stddev_samp(net) > 1e-12 THEN avg(net) / stddev_samp(net) * sqrt(252.0) ELSE 0.0 END AS sharpe, min(drawdown) AS max_drawdown, sum(turnover) AS turnover, sum(cost) AS transaction_cost,
  CASE WHEN var_samp(benchmark) > 1e-16 THEN covar_samp(net, benchmark) / var_samp(benchmark) END AS beta, avg(net) AS m, avg(benchmark) AS mb, stddev_samp(net - benchmark) * sqrt(252.0) AS tracking_error, avg(net - benchmark) * 252 AS annualized_excess_return, CASE WHEN stddev_samp(net - benchmark) > 1e-12 THEN avg(net - benchmark) / stddev_samp(net - benchmark) * sqrt(252.0) ELSE 0.0 END AS information_ratio FROM sw_curve GROUP BY model, method))"""

CTE["cs_daily"] = "SELECT method, CAST(bp AS BIGINT) AS bp, date, benchmark, turnover, turnover * bp / 10000.0 AS cost, gross - turnover * bp / 10000.0 AS net FROM wf_daily CROSS JOIN (VALUES (0), (5), (10), (20), (30)) t(bp)"
CTE["cs_curve"] = "SELECT *, e / max(e) OVER (PARTITION BY method, bp ORDER BY date) - 1 AS drawdown FROM (SELECT *, product(1 + net) OVER (PARTITION BY method, bp ORDER BY date) AS e FROM cs_daily)"
_CS_SQL = _CMP_SQL.replace("sw_curve", "cs_curve").replace("model, method", "method, bp")


@query("cost_metrics", R(_CMP, f"(SELECT *, CASE WHEN h > 0 AND 1 - h / nullif(b, 0) < 0.4 THEN 'ROBUST_TO_COST' WHEN h > 0 THEN 'MODERATELY_SENSITIVE' ELSE 'HIGHLY_SENSITIVE' END AS cost_status FROM (SELECT *, max(CASE WHEN bp = 30 THEN annualized_return END) OVER (PARTITION BY method) AS h, max(CASE WHEN bp = 10 THEN annualized_return END) OVER (PARTITION BY method) AS b FROM {_CS_SQL}))", "method bp cost_status"))
def _(spark, d):
    return studies.cost_sweep(walk(spark, d))


_sweep_sql(studies.MODELS, studies.METHODS)


@query("wf_models", R(_CMP, _CMP_SQL, "model method"))
def _(spark, d):
    return studies.compare(studies.model_sweep(held(spark, d), WF), "model", "method")


_RATED = """SELECT model, method, round(score, 6) + 0.0 AS score, round(py, 6) + 0.0 AS positive_years, CASE WHEN r <= 1 + (n - 1) / 4.0 THEN 'REJECT' WHEN r <= 1 + (n - 1) * 2 / 4.0 THEN 'WEAK' WHEN r <= 1 + (n - 1) * 3 / 4.0 THEN 'ACCEPTABLE' ELSE 'STRONGEST' END AS rating FROM (
  SELECT *, row_number() OVER (ORDER BY score, model, method) AS r, count(*) OVER () AS n FROM (SELECT model, method, py, """ + " + ".join(f"(rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0) / count(*) OVER ()" for c in ("round(sharpe, 9)", "round(annualized_excess_return, 9)", "round(max_drawdown, 9)", "round(-turnover, 9)")) + f""" + py - CASE WHEN model IN ('Model_C', 'Model_D') THEN 0.5 ELSE 0.0 END AS score FROM {_CMP_SQL} JOIN (SELECT model, method, avg(CASE WHEN x > 0 THEN 1.0 ELSE 0.0 END) AS py FROM (SELECT model, method, year(date) AS y, product(1 + net) - product(1 + benchmark) AS x FROM sw_daily GROUP BY ALL) GROUP BY ALL) USING (model, method)))"""


@query("model_ratings", _RATED)
def _(spark, d):
    daily = studies.model_sweep(held(spark, d), WF)
    return studies.ratings(studies.compare(daily, "model", "method"), studies.yearly_excess(daily))


_sweep_sql(studies.ABLATIONS, ("rolling_icir_weight",))


@query("ablation", R(_CMP, _CMP_SQL, "model method"))
def _(spark, d):
    return studies.compare(studies.model_sweep(held(spark, d), WF, studies.ABLATIONS, ("rolling_icir_weight",)), "model", "method")


_LOO = ("volatility_20", "volume_change_20", "momentum_20")
_sweep_sql({"": _LOO, **{f: tuple(x for x in _LOO if x != f) for f in _LOO}}, ("rolling_icir_weight",))


@query("leave_one_out", R("annualized_return annualized_return_delta", f"(SELECT a.model AS factor_name, 'OK' AS status, a.annualized_return, b.annualized_return - a.annualized_return AS annualized_return_delta FROM {_CMP_SQL} a CROSS JOIN (SELECT annualized_return FROM {_CMP_SQL} WHERE model = '') b WHERE a.model <> '')", "factor_name status"))
def _(spark, d):
    return studies.leave_one_out(held(spark, d), WF, _LOO, "rolling_icir_weight")


@query("factor_attribution", "SELECT factor_name, round(a, 6) + 0.0 AS average_absolute_weight, round(s, 6) + 0.0 AS average_signed_weight, round(a / sum(a) OVER (), 6) + 0.0 AS share FROM (SELECT factor_name, avg(abs(weight)) AS a, avg(weight) AS s FROM fold_weights WHERE method = 'rolling_icir_weight' GROUP BY factor_name)")
def _(spark, d):
    p = held(spark, d)
    return studies.attribution(walkforward.fold_weights(ic.daily_ic(p, "directed_value", (1,), ranks=False), walkforward.folds(p, WF), ("rolling_icir_weight",)))


@query("subsamples", R(_SUM, f"(SELECT factor_name, CASE WHEN year(date) <= 1998 THEN '1995-1998' ELSE '1999-2001' END AS variant, {SUMMARY} FROM ics WHERE period = 5 GROUP BY ALL)", "factor_name variant observations"))
def _(spark, d):
    return studies.subsamples(held(spark, d), {"1995-1998": (1995, 1998), "1999-2001": (1999, 2001)}).drop("period", "spread", "monotonicity")


_DAILY = "gross benchmark turnover cost net"
CTE["rr_rows"] = "SELECT p.* FROM prep p JOIN master m ON p.stock = m.stock AND p.date >= listing_date + 120 AND (delisting_date IS NULL OR p.date < delisting_date) WHERE factor_name = 'volatility_20'"
CTE["rr_pairs"] = "SELECT date, stock, factor_name, directed_value AS x, 1 AS period, forward_return_1d AS y FROM rr_rows WHERE directed_value IS NOT NULL AND forward_return_1d IS NOT NULL"
CTE["rr_ics"] = ic_sql("rr_pairs")
CTE["rr_calendar"] = "SELECT date, row_number() OVER (ORDER BY date) - 1 AS i FROM (SELECT DISTINCT date FROM rr_rows)"
for _name in ("folds", "fold_weights", "wf_scored", "wf_held", "wf_days", "wf_daily"):
    _sql = CTE[_name]
    for _other in ("calendar", "folds", "fold_weights", "ics", "prep", "wf_scored", "wf_held", "wf_days"):
        _sql = re.sub(rf"\b(FROM|JOIN) {_other}\b", rf"\1 rr_{'rows' if _other == 'prep' else _other}", _sql)
    CTE[f"rr_{_name}"] = _sql.replace("prep.*", "rr_rows.*").replace("ics.factor_name", "rr_ics.factor_name")


@query("survivorship_rerun", R(_DAILY, "(SELECT * REPLACE (CAST(fold AS BIGINT) AS fold) FROM rr_wf_daily WHERE method = 'equal_weight')", "fold method date"))
def _(spark, d):
    p = materialize(fixtures.panel(spark, d), "panel")
    return studies.survivorship_rerun(held(spark, d), p, fixtures.master(spark, d), studies.MODELS["Model_B"], "equal_weight", WF).select("fold", "method", "date", *_DAILY.split())


for _name in ("wf_scored", "wf_held", "wf_days", "wf_daily", "wf_equity", "wf_curve"):
    CTE[f"is_{_name}"] = re.sub(r"\b(FROM|JOIN) wf_", r"\1 is_wf_", CTE[_name]).replace("test_start AND test_end", "train_start AND train_end")


@query("in_sample_metrics", R(_WFM, _wf_sql("is_wf_curve", "fold, method").replace("SELECT fold, method", "SELECT CAST(fold AS BIGINT) AS fold, method", 1), "fold method"))
def _(spark, d):
    return walkforward.summarize(walk(spark, d, in_sample=True), "fold", "method")
