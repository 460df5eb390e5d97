import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.operators import combine, correlation, guards, ic, neutralize, quantile, scoring, walkforward
from quantloom.plans import studies

START = dt.date(2020, 1, 6)


def table(spark, days=30, stocks=12, names=("a", "b"), seed=1):
    r = random.Random(seed)
    rows = []
    for d in range(days):
        for s in range(stocks):
            y = r.gauss(0, 0.02)
            for k, f in enumerate(names):
                rows.append((START + dt.timedelta(d), f"{s:06d}", f, y * (k + 1) + r.gauss(0, 0.02), y, y / 2 + r.gauss(0, 0.01)))
    return spark.createDataFrame(rows, "date date, stock string, factor_name string, directed_value double, forward_return_1d double, forward_return_5d double")


def spearman(x, y):
    rank = lambda v: np.array([(np.sum(v < a) + np.sum(v <= a) + 1) / 2 for a in v])
    return np.corrcoef(rank(np.array(x)), rank(np.array(y)))[0, 1]


def test_daily_ic_against_numpy(spark):
    df = table(spark)
    rows = df.collect()
    for r in ic.daily_ic(df, "directed_value", (1, 5)).collect():
        own = [(x.directed_value, x[f"forward_return_{r.period}d"]) for x in rows if x.date == r.date and x.factor_name == r.factor_name]
        x, y = zip(*own, strict=True)
        assert math.isclose(r.ic, np.corrcoef(x, y)[0, 1], abs_tol=1e-9) and math.isclose(r.rank_ic, spearman(x, y), abs_tol=1e-9)


def test_guards_of_daily_ic(spark):
    day = lambda i: START + dt.timedelta(i)
    rows = [(day(0), "A", 1.0, 1.0), (day(0), "B", 2.0, 2.0), (day(1), "A", 1.0, 1.0), (day(1), "B", 1.0, 2.0), (day(2), "A", 1.0, 1.0), (day(3), "A", 1.0, 2.0), (day(3), "B", 2.0, None), (day(4), "A", 1.0, 2.0), (day(4), "B", 3.0, 1.0)]
    df = spark.createDataFrame([(*x[:2], "f", *x[2:]) for x in rows], "date date, stock string, factor_name string, v double, forward_return_5d double")
    got = {r.date: r.rank_ic for r in ic.daily_ic(df, "v").collect()}
    assert got == {day(0): 1.0, day(4): -1.0}
    assert ic.daily_ic(df, "v", guarded=False).count() == 5
    s = ic.ic_summary(ic.daily_ic(df, "v"), "factor_name").first()
    assert s.observations == 2 and s.mean_ic == 0.0 and s.positive_ic_ratio == 0.5


def test_ic_ranking_and_stability(spark):
    df = table(spark, days=400)
    ranked = ic.ic_ranking(df, "directed_value").orderBy("place").collect()
    assert [r.place for r in ranked] == [1, 2] and ranked[0].factor_name == "b"
    st = ic.stability(ic.yearly_ic(df, "directed_value"), ic.ic_summary(ic.daily_ic(df, "directed_value"), "factor_name")).collect()
    assert all(r.same_sign_ratio == 1.0 and r.stability_score > 0 for r in st)


def test_hac(spark):
    s = [0.05, 0.04, 0.06, 0.05, 0.04, 0.06] * 20
    df = spark.createDataFrame([(START + dt.timedelta(i), "f", v) for i, v in enumerate(s)], "date date, factor_name string, rank_ic double")
    for lag in (0, 4, 500):
        x = np.array(s)
        u, n = x - x.mean(), len(x)
        v = u @ u / n + sum(2 * (1 - k / (min(lag, n - 1) + 1)) * (u[k:] @ u[:-k]) / n for k in range(1, min(lag, n - 1) + 1))
        got = ic.hac_mean(df, "rank_ic", lag, "factor_name").first()
        want = x.mean() / math.sqrt(v / n) if v > 1e-18 else None
        assert got.observations == n and (want is None or math.isclose(got.hac_t_stat, want, rel_tol=1e-6))
    assert ic.hac_mean(df, "rank_ic", 4, "factor_name").first().hac_t_stat > 2


def test_quantiles(spark):
    df = spark.createDataFrame([(START, f"{i}", "f", float(v), float(i)) for i, v in enumerate([3, 1, 2])], "date date, stock string, factor_name string, v double, r double")
    got = {r.stock: r.q for r in df.withColumn("q", quantile.assign_quantiles("v", 5, "date")).collect()}
    assert got == {"1": 2, "2": 4, "0": 5}  # three values fall in quantiles 2, 4 and 5
    r = quantile.quantile_returns(df, "v", "r").first()
    assert (r.q1, r.q2, r.q3, r.q4, r.q5, r.spread) == (None, 1.0, None, 2.0, 0.0, None)
    tied = df.withColumn("v", F.lit(1.0))
    assert {r.stock: r.q for r in tied.withColumn("q", quantile.assign_quantiles("v", 3, "date")).collect()} == {"0": 1, "1": 2, "2": 3}


def test_group_returns_count_missing_values_at_the_bottom(spark):
    df = spark.createDataFrame([(START, f"{i}", "f", v, float(i)) for i, v in enumerate([5.0, 4.0, 3.0, None])], "date date, stock string, factor_name string, v double, r double")
    a = quantile.group_returns(df, "v", "r").first()
    assert (a.top_return, a.bottom_return, a.long_short) == (0.5, 2.5, -2.0)
    b = quantile.group_returns(df, "v", "r", drop_null=True).first()
    assert (b.top_return, b.bottom_return) == (0.0, 2.0)


def test_factor_correlation_and_residuals(spark):
    df = table(spark, names=("a", "b", "c"))
    daily = correlation.daily_factor_correlation(df, ("a", "b", "c"), "directed_value")
    assert daily.count() == 90
    rows = df.where(F.col("date") == START).collect()
    x, y = ([r.directed_value for r in sorted(rows, key=lambda r: r.stock) if r.factor_name == f] for f in "ab")
    one = daily.where((F.col("date") == START) & (F.col("factor_a") == "a") & (F.col("factor_b") == "b")).first()
    assert math.isclose(one.pearson, np.corrcoef(x, y)[0, 1], abs_tol=1e-9) and math.isclose(one.spearman, spearman(x, y), abs_tol=1e-9)
    assert correlation.average_factor_correlation(daily).count() == correlation.tail_factor_correlation(daily).count() == 3
    residual = {r.stock: r.directed_value for r in correlation.orthogonalize(df, "b", "a").where(F.col("date") == START).collect()}
    e = [residual[s] for s in sorted(residual)]
    assert abs(sum(e)) < 1e-9 and abs(np.dot(e, x)) < 1e-9


def test_static_and_equal_weights(spark):
    assert combine.normalize_weights({"a": 1, "b": -3}) == {"a": 0.25, "b": -0.75}
    with pytest.raises(ValueError):
        combine.normalize_weights({"a": 0.0})
    df = spark.createDataFrame([(START, "A", "a", 1.0), (START, "A", "b", 3.0), (START, "B", "a", 2.0), (START, "B", "b", None)], "date date, stock string, factor_name string, directed_value double")
    assert {r.stock: r.score for r in combine.combine_static(df, {"a": 1.0, "b": 3.0}).collect()} == {"A": 2.5, "B": 2.0}
    assert {r.stock: r.score for r in combine.combine_equal(df).collect()} == {"A": 2.0, "B": 2.0}


@pytest.mark.parametrize("method", combine.METHODS)
def test_rolling_weights_look_back_only(spark, method):
    rows = [(START + dt.timedelta(i), f, v) for i in range(8) for f, v in (("a", 0.1 + 0.01 * i), ("b", 0.2 - 0.02 * (i % 3)))]
    df = spark.createDataFrame(rows, "date date, factor_name string, ic double")
    moved = spark.createDataFrame([(d, f, 999.0 if d == START + dt.timedelta(7) else v) for d, f, v in rows], df.schema)
    got = sorted(map(tuple, combine.rolling_weights(df, ["a", "b"], method, 4, 2).collect()))
    assert got == sorted(map(tuple, combine.rolling_weights(moved, ["a", "b"], method, 4, 2).collect()))
    assert got[0][2] == 0.5 and all(math.isclose(sum(abs(w) for d, _, w in got if d == day), 1.0) for day in {x[0] for x in got})
    with pytest.raises(ValueError):
        combine.rolling_weights(df, ["a", "b"], method, 4, 5)


def test_neutralization_against_least_squares(spark):
    r = random.Random(4)
    rows = []
    for d in range(3):
        for s in range(40):
            cap = math.exp(10 + r.random() * 5) if s % 9 else (-1.0 if s % 2 else None)
            rows.append((START + dt.timedelta(d), f"{s}", "f", r.gauss(0, 1) + (s % 4), cap, ["x", "y", "z", None][s % 4]))
    df = spark.createDataFrame(rows, "date date, stock string, factor_name string, normalized_value double, market_cap double, industry string")
    got = neutralize.neutralize(df).collect()
    for day in {x[0] for x in rows}:
        own = [x for x in rows if x[0] == day]
        ok = [x for x in own if x[4] is not None and x[4] > 0]
        a = np.array([[1.0, math.log(x[4]), float(x[5] == "y"), float(x[5] == "z")] for x in ok])
        y = np.array([x[3] for x in ok])
        e = y - a @ np.linalg.lstsq(a, y, rcond=None)[0]
        want = dict(zip([x[1] for x in ok], (e - e.mean()) / e.std(), strict=True))
        for g in (x for x in got if x.date == day):
            if g.stock in want:
                assert g.neutralization_status == "neutralized" and math.isclose(g.neutralized_value, want[g.stock], abs_tol=1e-9)
            else:
                assert g.neutralization_status == "missing_exposure_fallback" and g.neutralized_value == g.normalized_value
    status = lambda d, c: {x.neutralization_status for x in neutralize.neutralize(d, config=c).collect()}
    config = neutralize.NeutralizationConfig
    assert status(df, config(enabled=False)) == {"disabled"}
    assert status(df.drop("market_cap", "industry"), config()) == {"missing_requested_exposures"}
    assert status(df.where("stock < '2'").where("date = '2020-01-06'").limit(4), config()) == {"insufficient_sample_fallback"}
    assert set(neutralize.diagnostics(neutralize.neutralize(df)).first().asDict()) == {"factor_name", "before_size_corr", "after_size_corr", "before_industry_r2", "after_industry_r2"}
    only = neutralize.neutralize(df.where("market_cap > 0 and industry is not null"))
    d = neutralize.diagnostics(only).first()
    assert abs(d.after_size_corr) < 1e-9 and abs(d.after_industry_r2) < 1e-9 < d.before_industry_r2


CONFIG = walkforward.WalkForwardConfig(train_window=10, test_window=5, min_train=8)


def test_folds(spark):
    df = table(spark)
    got = walkforward.folds(df, CONFIG).orderBy("fold").collect()
    days = [START + dt.timedelta(i) for i in range(30)]
    want = []
    at = 8
    while at < 30:
        want.append((days[max(0, at - 10)], days[at - 1], days[at], days[min(at + 5, 30) - 1]))
        at += 5
    assert [tuple(r)[1:] for r in got] == want
    wide = walkforward.folds(df, walkforward.WalkForwardConfig(10, 5, 8, mode="expanding")).collect()
    assert {r.train_start for r in wide} == {days[0]}
    with pytest.raises(ValueError):
        walkforward.folds(df, walkforward.WalkForwardConfig(mode="other"))


def test_walk_forward_against_loops(spark):
    df = table(spark)
    rows, folds = df.collect(), walkforward.folds(df, CONFIG).collect()
    got = {(r.fold, r.method, r.date): r for r in walkforward.walk_forward(df, CONFIG).collect()}
    days = sorted({r.date for r in rows})
    daily = {(d, f): np.corrcoef(*zip(*[(r.directed_value, r.forward_return_1d) for r in rows if r.date == d and r.factor_name == f], strict=True))[0, 1] for d in days for f in "ab"}
    for fold in folds:
        train = [d for d in days if fold.train_start <= d <= fold.train_end]
        m = {f: np.mean([daily[d, f] for d in train]) for f in "ab"}
        s = {f: m[f] / np.std([daily[d, f] for d in train], ddof=1) for f in "ab"}
        for method, w in (("equal_weight", {"a": 1, "b": 1}), ("static_weight", {"a": 1, "b": 1}), ("rolling_ic_weight", m), ("rolling_icir_weight", s)):
            total, before = sum(map(abs, w.values())), None
            for d in (d for d in days if fold.test_start <= d <= fold.test_end):
                score, ret = {}, {}
                for r in rows:
                    if r.date == d:
                        score[r.stock] = score.get(r.stock, 0.0) + w[r.factor_name] / total * r.directed_value
                        ret[r.stock] = r.forward_return_1d
                cut = np.quantile(list(score.values()), 0.8)
                held = {k for k, v in score.items() if v >= cut}
                turn = 1.0 if before is None else len(held ^ before) / (len(held) + len(before))
                g = got.pop((fold.fold, method, d))
                assert math.isclose(g.gross, np.mean([ret[k] for k in held]), abs_tol=1e-12) and math.isclose(g.turnover, turn) and math.isclose(g.net, g.gross - 0.001 * turn, abs_tol=1e-12)
                before = held
    assert not got


def test_walk_forward_weights_come_from_training_days(spark):
    df = table(spark)
    fold = walkforward.folds(df, CONFIG)
    first = fold.where("fold = 0").first()
    moved = df.withColumn("directed_value", F.when(F.col("date") > first.train_end, -F.col("directed_value")).otherwise(F.col("directed_value")))
    w = lambda d: sorted(map(tuple, walkforward.fold_weights(ic.daily_ic(d, "directed_value", (1,)), fold).where("fold = 0").collect()))
    assert w(df) == w(moved)
    s = walkforward.summarize(walkforward.walk_forward(df, CONFIG, in_sample=True), "fold", "method")
    assert s.count() == 4 * fold.count()


def test_factor_score_caps_and_signs(spark):
    cols = "factor_name string, icir double, long_short_return double, sharpe_ratio double, max_drawdown double, win_rate double"
    rows = [("top", 9.0, 9.0, 9.0, 0.0, 0.9), ("mirror", -9.0, -9.0, -9.0, 0.0, 0.1), ("floor", 0.0, 0.0, 0.0, -0.5, 0.5), ("none", None, None, None, None, None), ("mid", 0.25, 0.1 / 252, 1.0, -0.15, 0.575)]
    got = {r.factor_name: (r.factor_score, r.rating) for r in scoring.factor_score(spark.createDataFrame(rows, cols)).collect()}
    assert got["top"] == got["mirror"] == (100.0, "Excellent") and got["floor"] == (0.0, "Weak") and got["mid"] == (50.0, "Weak")
    assert got["none"][1] == "Weak"


def test_guards(spark):
    two = spark.createDataFrame([(d, f"{i}") for d in (dt.date(2015, 1, 1), dt.date(2021, 1, 1)) for i in range(100)], "date date, stock string")
    r = guards.formal_guard(two).first()
    assert r.formal and r.stocks == 100 and math.isclose(r.years, 2192 / 365.2425)
    assert not guards.formal_guard(two.where("stock <> '1'")).first().formal
    assert guards.sample_guard(two).first().sample_class == "VALID_CROSS_SECTIONAL_RESEARCH"
    assert guards.sample_guard(two.limit(10)).first().sample_class == "ENGINEERING_SMOKE_TEST"
    a = [r.stock for r in guards.stable_sample(two, 7, 1).collect()]
    assert a == [r.stock for r in guards.stable_sample(two.orderBy(F.desc("stock")), 7, 1).collect()] and a != [r.stock for r in guards.stable_sample(two, 7, 2).collect()]
    kinds = spark.createDataFrame([(0.96, True), (0.96, False), (0.0, True)], "c double, e boolean").select(guards.survivorship_class(F.col("c"), F.col("e")))
    assert [r[0] for r in kinds.collect()] == ["RESOLVED", "PARTIAL", "UNRESOLVED"]
    master = spark.createDataFrame([("1", dt.date(2000, 1, 1), None), ("2", dt.date(2016, 1, 1), dt.date(2017, 1, 1))], "stock_code string, listing_date date, delisting_date date")
    assert sorted(map(tuple, guards.active_bounds(master, "2015-01-01", "2020-12-31").collect())) == [("1", dt.date(2015, 1, 1), dt.date(2020, 12, 31)), ("2", dt.date(2016, 1, 1), dt.date(2016, 12, 31))]


def test_ratings_by_rank_edges(spark):
    n = 15
    rows = [(f"M{i:02d}", "m", float(i), float(i), -1.0 + i / 100, float(n - i)) for i in range(n)]
    comparison = spark.createDataFrame(rows, "model string, method string, sharpe double, annualized_excess_return double, max_drawdown double, turnover double")
    years = spark.createDataFrame([(r[0], "m", 2020, 0.1) for r in rows], "model string, method string, year int, excess_return double")
    got = [r.rating for r in studies.ratings(comparison, years).orderBy("score").collect()]
    assert [got.count(k) for k in ("REJECT", "WEAK", "ACCEPTABLE", "STRONGEST")] == [4, 4, 3, 4]
