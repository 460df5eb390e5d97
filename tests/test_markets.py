import datetime as dt
import json
import math

import pytest
from pyspark.sql import functions as F

from quantloom import cli
from quantloom.operators import asof, backtest, market_metadata, metrics, pit, universe
from quantloom.plans import catalog, report
from quantloom.sources import ingest
from quantloom.streaming import daily as streaming

DAY = dt.date(2024, 1, 1)


def day(i):
    return DAY + dt.timedelta(i)


def panel(spark, stocks=("000001", "000002"), n=150, listed=None):
    rows = [(day(i), s, 10.0 + i * 0.1, 1000.0) for s in stocks for i in range((listed or {}).get(s, 0), n)]
    return spark.createDataFrame(rows, "date date, stock string, close double, volume double")


def test_asof_takes_the_latest_row_whole(spark):
    left = spark.createDataFrame([(day(i), s) for s in "AB" for i in range(5)], "date date, stock string")
    right = spark.createDataFrame([("A", day(1), 1.0, "x"), ("A", day(3), None, "y"), ("B", day(9), 5.0, "z"), ("A", None, 7.0, "w")], "stock string, seen date, v double, tag string")
    got = {(r.stock, r.date): (r.v, r.tag) for r in asof.asof_join(left, right, "date", "seen").collect()}
    assert [got["A", day(i)] for i in range(5)] == [(None, None), (1.0, "x"), (1.0, "x"), (None, "y"), (None, "y")]
    assert all(got["B", day(i)] == (None, None) for i in range(5)) and len(got) == 10


def test_reports_count_from_their_announcement(spark):
    left = spark.createDataFrame([(day(i), "A") for i in (0, 40, 50)], "date date, stock string")
    reports = spark.createDataFrame([("A", day(-10), day(45), 9.0)], "stock string, report_period date, announcement_date date, roe double")
    got = pit.align_fundamentals(left, reports).orderBy("date").collect()
    assert [(r.roe, r.point_in_time_available) for r in got] == [(None, False), (None, False), (9.0, True)]
    flagged = pit.align_fundamentals(left, reports.drop("announcement_date")).first()
    assert flagged.data_quality == pit.FLAGGED and not flagged.point_in_time_available
    cover = pit.coverage(pit.align_fundamentals(left, reports), "roe").first()
    assert math.isclose(cover.missing_ratio, 2 / 3) and cover.latest_valid_date == day(50)


def test_exposures(spark):
    p = panel(spark, n=3).withColumn("shares_outstanding", F.lit(2.0))
    dated = spark.createDataFrame([("000001", day(1), "bank")], "stock string, effective_date date, industry string")
    got = {(r.stock, r.date): (r.market_cap, r.industry) for r in pit.exposures(p, dated).collect()}
    assert got["000001", day(0)] == (20.0, None) and got["000001", day(2)][1] == "bank" and got["000002", day(2)][1] is None


def test_market_metadata(spark):
    rows = [(day(0), "600001", 10.0, 10.0, 10.0, 10.0, 5.0, "x"), (day(1), "600001", 11.0, 11.0, 11.0, 11.0, 5.0, "x"), (day(2), "600001", None, None, None, None, 0.0, "x"), (day(0), "300001", 10.0, 10.0, 10.0, 10.0, 1.0, "*ST y"), (day(1), "300001", 9.5, 9.5, 9.5, 9.5, 1.0, "*ST y")]
    df = spark.createDataFrame(rows, "date date, stock string, open double, high double, low double, close double, volume double, stock_name string")
    got = {(r.stock, r.date): r for r in market_metadata.enrich(df).collect()}
    a = got["600001", day(1)]
    assert (a.limit_up_price, a.limit_down_price, a.limit_up, a.limit_down, a.amount) == (11.0, 9.0, True, False, 55.0)
    assert got["600001", day(2)].is_suspended and not a.is_suspended
    b = got["300001", day(1)]
    assert b.is_st and b.limit_down and b.limit_down_price == 9.5


def test_universe_over_time(spark):
    p = panel(spark, listed={"000002": 50})
    e = universe.eligible(p)
    days = {s: [r.date for r in e.where(F.col("stock") == s).orderBy("date").collect()] for s in ("000001", "000002")}
    assert days["000001"][0] == day(119) and days["000002"] == []
    flagged = p.withColumn("is_st", F.col("stock") == "000001")
    assert universe.eligible(flagged, universe.UniverseConfig(min_listing_days=1)).where("stock = '000001'").count() == 0
    adv = universe.eligible(p, universe.UniverseConfig(min_listing_days=1, min_adv20=1.0)).where("stock = '000001'")
    assert adv.agg(F.min("date")).first()[0] == day(19)
    with pytest.raises(ValueError, match="volume"):
        universe.eligible(p.drop("volume"))


def test_providers(spark):
    p = panel(spark, n=6)
    config = universe.UniverseConfig(min_listing_days=1)
    master = spark.createDataFrame([("000001", day(1), day(3)), ("000002", day(0), None)], "stock_code string, listing_date date, delisting_date date")
    got = universe.SecurityMasterUniverse(master, config).universe(p)
    assert [r.date for r in got.where("stock = '000001'").orderBy("date").collect()] == [day(1), day(2)]
    assert universe.active(p, master, end_inclusive=True).where("stock = '000001'").count() == 3
    m = spark.createDataFrame([("000001", "I", day(1), day(2)), ("000001", "I", day(2), None), ("000002", "J", day(0), None)], "stock string, universe_name string, effective_date date, end_date date")
    assert universe.IndexUniverse(m, config).universe(p, "I").count() == 5
    for call in (lambda: universe.IndexUniverse(m).universe(p, "ALL_A"), lambda: universe.HistoricalUniverse().universe(p, "I")):
        with pytest.raises(ValueError):
            call()
    with pytest.raises(NotImplementedError):
        universe.RemoteUniverse().universe(p)
    with pytest.warns(UserWarning):
        whole = universe.eligible_or_all(p, universe.SecurityMasterUniverse(master.where("stock_code = '000001'"), config))
    assert {r.date: r.n for r in whole.groupBy("date").agg(F.count("*").alias("n")).collect()} == {day(0): 2, day(1): 1, day(2): 1, day(3): 2, day(4): 2, day(5): 2}
    assert universe.seasoned(panel(spark), master.withColumn("delisting_date", F.lit(None).cast("date"))).where("stock = '000001'").agg(F.min("date")).first()[0] == day(121)


def test_master_normalisation(spark):
    raw = spark.createDataFrame([("600000", "A share", "1999-11-10"), ("900901", "B share", "1992-02-21"), ("600001", "late", None)], "code string, name string, listing_date string")
    got = {r.stock_code: r for r in universe.normalize_master(raw, "SSE", "test").collect()}
    assert set(got) == {"600000", "600001"} and got["600000"].data_quality == "HIGH" and got["600001"].data_quality == "LOW"
    gone = raw.where("code = '600000'").withColumn("delisting_date", F.lit("2020-01-01"))
    both = universe.merge_master(universe.normalize_master(raw, "SSE", "a"), universe.normalize_master(gone, "SSE", "b"))
    assert {r.stock_code: r.status for r in both.collect()} == {"600000": "DELISTED", "600001": "LISTED"}


def test_trade_constraints(spark):
    previous = spark.createDataFrame([("A", 0.5), ("B", 0.5)], "stock string, weight double")
    target = spark.createDataFrame([("B", 0.2), ("C", 0.8)], "stock string, weight double")
    state = spark.createDataFrame([("A", 0.0, False, False), ("B", 1.0, False, True), ("C", 1.0, True, False)], "stock string, volume double, limit_up boolean, limit_down boolean")
    assert {r.stock: r.weight for r in universe.constrain_trades(previous, target, state).collect()} == {"A": 0.5, "B": 0.5, "C": 0.0}
    free = state.withColumns({"volume": F.lit(1.0), "limit_up": F.lit(False), "limit_down": F.lit(False)})
    assert {r.stock: r.weight for r in universe.constrain_trades(previous, target, free).collect()} == {"A": 0.0, "B": 0.2, "C": 0.8}


def test_metrics_closed_form(spark):
    df = spark.createDataFrame([(day(0), 0.10, 0.05), (day(1), -0.05, 0.01)], "date date, r double, b double")
    m = metrics.backtest_metrics(df.withColumn("k", F.lit(1)), "r", "b", "k").first()
    assert math.isclose(m.total_return, 0.045) and math.isclose(m.max_drawdown, -0.05) and m.win_rate == 0.5
    assert math.isclose(m.annual_return, 1.045**126 - 1) and math.isclose(m.alpha, 0.045 - (1.05 * 1.01 - 1))
    gone = spark.createDataFrame([(day(0), -1.0, 0.0), (day(1), 0.1, 0.0)], df.schema)
    assert metrics.backtest_metrics(gone.withColumn("k", F.lit(1)), "r", "b", "k").first().annual_return == -1.0
    rows = [(day(i), 2 * b + 0.001, b) for i, b in enumerate([0.01, -0.01, 0.02, -0.02] * 20)]
    x = metrics.relative_metrics(spark.createDataFrame(rows, df.schema), "r", "b").first()
    assert math.isclose(x.beta, 2.0) and math.isclose(x.jensen_alpha, 0.252)


def test_backtest_against_loops(spark):
    stocks = [f"{i:06d}" for i in range(6)]
    closes = {s: [100.0 + (i * (k + 3) % 11) + k for i in range(60)] for k, s in enumerate(stocks)}
    prices = spark.createDataFrame([(day(i), s, closes[s][i]) for s in stocks for i in range(60)], "date date, stock string, close double")
    scores = spark.createDataFrame([(day(i), s, float((i * 7 + k * 5) % 13)) for i in range(60) for k, s in enumerate(stocks)], "date date, stock string, score double")
    got = {r.date: r for r in backtest.backtest(prices, scores, top=0.34, period=9, warm_up=5, cost_rate=0.01, constrained=False).collect()}
    held, effective, before = {}, {}, {}
    for i in range(60):
        effective, fresh = dict(held), effective
        if i >= 5 and (i - 5) % 9 == 0:
            order = sorted(range(6), key=lambda k: (-float((i * 7 + k * 5) % 13), k))[:3]
            held = {stocks[k]: 1 / 3 for k in order}
        if effective:
            gross = sum(w * (closes[s][i] / closes[s][i - 1] - 1) for s, w in effective.items())
            turn = sum(abs(effective.get(s, 0) - before.get(s, 0)) for s in stocks)
            assert math.isclose(got[day(i)].gross, gross, abs_tol=1e-12) and math.isclose(got[day(i)].turnover, turn, abs_tol=1e-12)
            assert math.isclose(got[day(i)].portfolio_return, gross - 0.01 * turn, abs_tol=1e-12)
        before = dict(effective)
        del fresh
    assert len(got) == 54
    for bad in ("long_short", "other"):
        with pytest.raises((NotImplementedError, ValueError)):
            backtest.target_weights(scores, mode=bad)


def test_constrained_rebalances_are_a_recursion(spark):
    targets = spark.createDataFrame([(day(0), "A", 1.0), (day(1), "B", 1.0), (day(2), "B", 1.0)], "date date, stock string, weight double")
    dates = targets.select("date").distinct()
    state = spark.createDataFrame([(day(1), "A", False, True), (day(1), "B", True, False), (day(2), "A", False, True)], "date date, stock string, limit_up boolean, limit_down boolean")
    got = {(r.date, r.stock): r.weight for r in backtest.executed_weights(targets, dates, state).collect()}
    assert [got[day(i), "A"] for i in range(3)] == [1.0, 1.0, 1.0] and [got[day(i), "B"] for i in range(3)] == [0.0, 0.0, 1.0]


def test_ingest(spark, tmp_path):
    (tmp_path / "p.csv").write_text("date,stock,open,high,low,close,volume\n2024-01-02,1,1,1,1,1,5\n2024-01-03,000001,1,2,1,2,6\n")
    df = ingest.read_prices(spark, str(tmp_path / "p.csv"))
    assert [(r.stock, r.close) for r in df.orderBy("date").collect()] == [("000001", 1.0), ("000001", 2.0)]
    for bad in ("2024-01-02,1,1,1,1,0,5\n", "2024-01-02,1,1,1,1,1,5\n2024-01-02,1,1,1,1,1,5\n", ""):
        (tmp_path / "b.csv").write_text("date,stock,open,high,low,close,volume\n" + bad)
        with pytest.raises(ValueError):
            ingest.read_prices(spark, str(tmp_path / "b.csv"))
    (tmp_path / "c.csv").write_text("date,stock,close\n")
    with pytest.raises(ValueError, match="high"):
        ingest.read_prices(spark, str(tmp_path / "c.csv"))
    codes = spark.createDataFrame([("600519",), ("000001",)], "stock string")
    a, b = (ingest.mock_prices(codes, "2024-01-01", "2024-03-01") for _ in range(2))
    assert sorted(a.collect()) == sorted(b.collect()) and ingest.validation_report(a).first().bad_close == 0
    assert ingest.mock_fundamentals(codes, "2024-03-01", 20).count() == 40
    used = ingest.load_with_fallback([("remote", lambda: 1 / 0), ("mock", lambda: a.drop("data_source"))])
    assert used.first().data_source == "mock"
    with pytest.raises(RuntimeError, match="remote"):
        ingest.load_with_fallback([("remote", lambda: 1 / 0)])
    with pytest.raises(ValueError):
        ingest.require_real({"source": "mock", "is_real_data": True})


def test_cli_and_reports(spark, tmp_path):
    lines = ["date,stock,factor_name,factor_value,return"]
    for d in range(3):
        for s, (v, r) in enumerate(((1.0, -0.02), (2.0, 0.02), (3.0 + d / 10, 0.05))):
            lines += [f"2024-01-0{d + 1},{s + 1},momentum,{v},{r}", f"2024-01-0{d + 1},{s + 1},value,{-v * v},{r}"]
    (tmp_path / "f.csv").write_text("\n".join(lines) + "\n")
    assert cli.main(["evaluate", str(tmp_path / "f.csv"), str(tmp_path / "out")], spark) == 0
    found = json.loads((tmp_path / "out/factor_summary.json").read_text())
    assert [x["rank"] for x in found] == [1, 2] and {x["rank_ic_mean"] for x in found} == {1.0, -1.0}
    assert math.isclose(found[0]["long_short_return"] if found[0]["factor_name"] == "momentum" else found[1]["long_short_return"], 0.07, abs_tol=1e-4)
    text = report.report_text(str(tmp_path / "out/factor_report.md"))
    assert "| momentum |" in text and "p_value" in text and report.report_text(str(tmp_path / "none.md")) == ""
    with pytest.raises(ValueError, match="nobody"):
        ingest.read_factors(spark, str(tmp_path / "f.csv"), ["nobody"])
    assert report.metrics_from_markdown("- Sharpe Ratio: 0.75\n| Annual Return | 12.5% |\n") == {"Sharpe Ratio": 0.75, "Annual Return": 0.125}
    assert [report.strength(x) for x in (0.6, -0.3, None)] == ["Strong", "Medium", "Weak"]


def test_streaming_replay_changes_nothing(spark, tmp_path):
    src, store = str(tmp_path / "in"), str(tmp_path / "store")
    df = ingest.mock_prices(spark.createDataFrame([("600519",)], "stock string"), "2024-01-01", "2024-02-15").drop("data_source")
    df.write.parquet(src)
    for round_ in range(2):
        streaming.ingest(spark, src, store, str(tmp_path / f"check{round_}")).awaitTermination()
        got = spark.read.parquet(store)
        assert got.count() == df.count() and got.select("date", "stock").distinct().count() == df.count()


def test_catalog_has_an_oracle_for_nearly_all():
    without = sorted(set(catalog.QUERIES) - set(catalog.SQL))
    assert set(catalog.SQL) <= set(catalog.QUERIES) and without == ["backtest_constrained"]
