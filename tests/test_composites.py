import datetime as dt
import hashlib
import json
import math

import pytest
from pyspark.sql import functions as F

from quantloom.operators import factors, scoring, universe
from quantloom.plans import report, studies
from quantloom.sources import ingest

START, END = "2023-01-02", "2024-01-31"


@pytest.fixture(scope="module")
def prices(spark):
    codes = spark.createDataFrame([(c,) for c in studies.STOCK_POOL[:8]], "stock string")
    return ingest.mock_prices(codes, START, END).cache()


@pytest.fixture(scope="module")
def fundamentals(spark):
    codes = spark.createDataFrame([(c,) for c in studies.STOCK_POOL[:8]], "stock string")
    return ingest.mock_fundamentals(codes, END, 400).cache()


def test_mock_prices_by_a_plain_loop(prices):
    for code in studies.STOCK_POOL[:2]:
        seed = state = int(hashlib.sha256(code.encode()).hexdigest()[:8], 16)
        before, want, day = 20 + seed % 8000 / 100, [], dt.date.fromisoformat(START)
        while day <= dt.date.fromisoformat(END):
            if day.weekday() < 5:
                u = []
                for _ in range(5):
                    state = (1664525 * state + 1013904223) % 2**32
                    u.append(state / 2**32)
                close, first = before * (1 + (u[0] - 0.49) * 0.04), before * (1 + (u[1] - 0.5) * 0.012)
                want.append((day, first, max(first, close) * (1 + u[2] * 0.012), min(first, close) * (1 - u[3] * 0.012), close, int(500_000 + u[4] * 9_500_000)))
                before = close
            day += dt.timedelta(1)
        got = prices.where(F.col("stock") == code).orderBy("date").collect()
        assert [r.date for r in got] == [x[0] for x in want] and [r.volume for r in got] == [x[5] for x in want]
        assert all(abs(a - b) <= 0.00501 for r, x in zip(got, want) for a, b in zip((r.open, r.high, r.low, r.close), x[1:5]))


def test_mock_fundamentals(fundamentals):
    rows = fundamentals.where("stock = '000001'").orderBy("date").collect()
    assert len(rows) == 400 and rows[-1].date == dt.date(2024, 1, 31) and not rows[0].point_in_time_available and rows[0].announcement_date is None
    assert all(math.isclose(r.pe, 12 + 1 / 10 + 3 * math.sin(i / 23), abs_tol=1e-4) and math.isclose(r.roe, 8 + 1 / 12 + 2 * math.sin(i / 63), abs_tol=1e-4) for i, r in enumerate(rows))


def test_coverage_of_late_listings(spark, prices):
    late = prices.where("stock <> '600519' or date >= '2023-05-01'")
    strict = {r.stock: r.covered for r in ingest.coverage(late, START, END).collect()}
    kind = {r.stock: r.covered for r in ingest.coverage(late, START, END, late_least=ingest.LATE_LISTING_ROWS).collect()}
    few = {r.stock: r.covered for r in ingest.coverage(prices.where("stock <> '600519' or date >= '2023-12-01'"), START, END, late_least=ingest.LATE_LISTING_ROWS).collect()}
    assert not strict["600519"] and kind["600519"] and not few["600519"] and all(v for k, v in strict.items() if k != "600519")
    assert ingest.with_amount(prices).where("amount <> close * volume").isEmpty()


def test_cached_prices_need_a_real_source(spark, tmp_path):
    (tmp_path / "p.csv").write_text("date,stock,open,high,low,close,volume\n2024-01-02,1,1,1,1,1,5\n")
    for side, good in (({"is_real_data": True, "source": "exchange"}, True), ({"is_real_data": True, "source": "mock"}, False), ({"is_real_data": False, "source": "x"}, False)):
        (tmp_path / "p.json").write_text(json.dumps(side))
        if good:
            assert ingest.read_cached(spark, str(tmp_path / "p.csv")).count() == 1
        else:
            with pytest.raises(ValueError):
                ingest.read_cached(spark, str(tmp_path / "p.csv"))


def test_scores_at_dates_know_nothing_later(spark, prices, fundamentals):
    long = factors.to_long(factors.technical_factors(prices))
    dates = [dt.date(2023, 6, 1), dt.date(2023, 10, 2), dt.date(2024, 1, 31)]
    pairs = prices.where(F.col("date").isin(dates)).select("date", "stock")
    got = {(r.date, r.stock): r.score for r in scoring.multifactor_scores_at(long, fundamentals, pairs).collect()}
    assert len(got) == 24
    for d in dates:
        alone = scoring.multifactor_scores(long.where(F.col("date") <= d), fundamentals.where(F.col("date") <= d))
        want = {r.stock: r.multifactor_score for r in alone.collect()}
        assert {s: v for (x, s), v in got.items() if x == d} == pytest.approx(want)


def test_configured_backtest(spark, prices, fundamentals):
    benchmark = prices.groupBy("date").agg(F.avg(F.col("close") / F.col("open") - 1).alias("benchmark_return"))
    fixed = studies.configured_backtest(prices, fundamentals, benchmark, dynamic=False).collect()
    assert min(r.date for r in fixed) > dt.date(2023, 4, 1) and all(math.isclose(r.portfolio_return, r.gross - r.cost) for r in fixed)
    every = universe.HistoricalUniverse(universe.UniverseConfig(min_listing_days=1))
    assert len(studies.configured_backtest(prices, fundamentals, benchmark, studies.STOCK_POOL[:5], every).collect()) > 100
    for bad in ({"period": 0}, {"codes": ["60051x"]}, {"codes": []}):
        with pytest.raises(ValueError):
            studies.configured_backtest(prices, fundamentals, benchmark, **bad)
    with pytest.raises(ValueError, match="trading days"):
        studies.configured_backtest(prices.where("date < '2023-02-01'"), fundamentals, benchmark)
    assert studies.stock_pool() == list(studies.STOCK_POOL) and studies.stock_pool(["1", "000001"]) == ["000001"]


def test_one_stock_and_its_report(prices, fundamentals):
    got = studies.evaluate_stock("600519", prices, fundamentals)
    assert got["stock"] == "600519" and 0 <= got["final_score"] <= 100 and got["data_source"] == got["financial_data_source"] == "mock"
    text = report.stock_report(got)
    assert "600519" in text and "technical_score" in text and f"**{got['final_score']:.2f} / 100**" in text
    plain = studies.evaluate_stock("600519", prices)
    assert "momentum_score" in report.stock_report(plain) and "financial_data_source" not in plain
    with pytest.raises(ValueError):
        studies.evaluate_stock("600519", prices.where("date < '2023-02-01'"))


def test_quality_and_backtest_reports(prices):
    df = factors.to_long(factors.technical_factors(prices)).withColumn("neutralization_status", F.lit("neutralized"))
    found = json.loads(report.quality_json(studies.data_quality(df, universe.HistoricalUniverse(), ("no limits",))))
    assert found["sample_size"]["sample_class"] == "ENGINEERING_SMOKE_TEST" and found["survivorship_bias_status"] == "UNRESOLVED" and "no limits" in found["fallback_warnings"] and found["neutralization_status"]["neutralized"] == df.count()
    values = dict.fromkeys(("total_return", "benchmark_return", "alpha", "annual_return", "win_rate", "sharpe_ratio", "max_drawdown", "information_ratio"), 0.25)
    assert "total_return: 25.00%" in report.backtest_report(values, {"top": 0.2}) and "sharpe_ratio: 0.2500" in report.backtest_report(values, {})
