import datetime as dt
import math
import statistics

import pytest
from pyspark.sql import functions as F

from quantloom.functions import codes
from quantloom.functions.stats import average_rank, percentile_rank, two_sided_p
from quantloom.operators import factors as fa
from quantloom.operators import preprocess
from quantloom.schema import missing_to_null, require_columns

START = dt.date(2024, 1, 1)


def prices(spark, stocks=("000001", "000002", "000003"), n=140):
    rows = []
    for s in stocks:
        k = int(s)
        for i in range(n):
            close = 50 + k + i * 0.05 * k + (i * (7 + k) % 9) * 0.1
            rows.append((START + dt.timedelta(i), s, close - 0.1, close + 0.2, close - 0.3, close, 1e6 + (i % 20) * 2e4 * k))
    return spark.createDataFrame(rows, "date date, stock string, open double, high double, low double, close double, volume double")


def series(df, name, stock="000002"):
    return [r[0] for r in df.where(F.col("stock") == stock).orderBy("date").select(name).collect()]


def test_technical_factors_follow_their_formulas(spark):
    df = prices(spark)
    wide = fa.technical_factors(df).cache()
    close, volume = series(df, "close"), series(df, "volume")
    returns = [None] + [b / a - 1 for a, b in zip(close, close[1:], strict=False)]
    for n in (20, 60):
        m, v = series(wide, f"momentum_{n}"), series(wide, f"volatility_{n}")
        assert m[:n] == [None] * n and v[:n] == [None] * n
        for i in range(n, len(close)):
            assert math.isclose(m[i], close[i] / close[i - n] - 1)
            assert math.isclose(v[i], statistics.stdev(returns[i - n + 1 : i + 1]), rel_tol=1e-9)
    change = series(wide, "volume_change_20")
    assert change[:19] == [None] * 19
    assert all(math.isclose(change[i], volume[i] / (sum(volume[i - 19 : i + 1]) / 20)) for i in range(19, len(close)))
    for h in (1, 5, 40):
        f = series(wide, f"forward_return_{h}d")
        assert f[-h:] == [None] * h and all(math.isclose(f[i], close[i + h] / close[i] - 1) for i in range(len(close) - h))


def test_forward_return_stays_within_a_stock(spark):
    rows = [(START + dt.timedelta(i), s, float(c)) for s, cs in (("A", (10, 11, 12)), ("B", (20, 18, 21))) for i, c in enumerate(cs)]
    df = spark.createDataFrame(rows, "date date, stock string, close double").withColumn("r", fa.forward_return(1))
    got = {(r.stock, r.date): r.r for r in df.collect()}
    assert got["A", START + dt.timedelta(2)] is None and got["B", START + dt.timedelta(2)] is None
    assert math.isclose(got["A", START], 0.1) and math.isclose(got["B", START], -0.1)
    for bad in (0, -1, 1.5):
        with pytest.raises(ValueError):
            fa.forward_return(bad)


def test_later_prices_change_no_earlier_factor(spark):
    df = prices(spark)
    cut = START + dt.timedelta(100)
    moved = df.withColumn("close", F.when(F.col("date") > cut, F.col("close") * 3).otherwise(F.col("close")))
    names = [*fa.TECHNICAL]
    key = lambda d: sorted(map(tuple, fa.technical_factors(d).where(F.col("date") <= cut).select("stock", "date", *names).collect()), key=repr)
    assert key(df) == key(moved)


def test_long_table(spark):
    long = fa.to_long(fa.technical_factors(prices(spark)))
    assert set(long.columns) >= {"date", "stock", "factor_name", "factor_value", "return", "forward_return_40d"}
    assert {r[0] for r in long.select("factor_name").distinct().collect()} == set(fa.TECHNICAL)
    assert long.where("factor_value is null or return is null").count() == 0
    legacy = fa.legacy_factors(prices(spark)).where("momentum is not null").first()
    assert legacy.volume_factor is not None


def test_value_quality_and_direction(spark):
    df = spark.createDataFrame([(10.0, 2.0, 12.0), (-5.0, 0.0, None)], "pe double, pb double, roe double")
    a, b = fa.quality_factor(fa.value_factors(df)).collect()
    assert (a.pe_factor, a.pb_factor, a.roe_factor) == (0.1, 0.5, 12.0) and (b.pe_factor, b.pb_factor, b.roe_factor) == (None, None, None)
    names = spark.createDataFrame([("volatility_20", 2.0), ("momentum_20", 2.0), ("unknown", 2.0)], "factor_name string, normalized_value double")
    assert [r[0] for r in names.select(fa.directed()).collect()] == [-2.0, 2.0, 2.0]
    fa.register_factor(fa.FactorInfo("mine", "other", higher_is_better=False))
    assert "mine" in fa.lower_is_better() and fa.factor_info("nobody").higher_is_better


def cross(spark, values, day=START):
    return spark.createDataFrame([(day, f"{i:06d}", "f", v) for i, v in enumerate(values)], "date date, stock string, factor_name string, factor_value double")


def values(df, name):
    return [r[0] for r in df.orderBy("stock").select(name).collect()]


def test_winsorize(spark):
    df = cross(spark, [1.0, 2.0, 3.0, 100.0, None])
    assert values(preprocess.winsorize(df, "factor_value", "w", "percentile", 0.0, 0.75), "w") == [1.0, 2.0, 3.0, 27.25, None]
    assert values(preprocess.winsorize(df, "factor_value", "w", "mad", k=2.0), "w") == [1.0, 2.0, 3.0, 4.5, None]
    assert values(preprocess.winsorize(df, "factor_value", "w", "none"), "w") == [1.0, 2.0, 3.0, 100.0, None]
    assert values(preprocess.winsorize(cross(spark, [5.0, 5.0, 5.0, 9.0]), "factor_value", "w", "mad"), "w") == [5.0] * 4
    for bad in ({"method": "other"}, {"low": 0.9, "high": 0.1}, {"method": "mad", "k": -1.0}):
        with pytest.raises(ValueError):
            preprocess.winsorize(df, "factor_value", "w", **bad)


def test_zscore_and_percentiles(spark):
    done = values(preprocess.preprocess_factors(cross(spark, [1.0, 2.0, 3.0, None]), winsor="none"), "normalized_value")
    assert done[3] is None and math.isclose(done[0], -math.sqrt(1.5), rel_tol=1e-9) and done[1] == 0.0
    assert values(preprocess.preprocess_factors(cross(spark, [4.0, 4.0]), winsor="none"), "normalized_value") == [0.0, 0.0]
    assert values(preprocess.preprocess_factors(cross(spark, [1.0, 2.0, 2.0, None]), "cross_sectional_percentile", "none"), "normalized_value") == pytest.approx([100 / 3, 250 / 3, 250 / 3, None])
    two = cross(spark, [1.0, 5.0]).union(cross(spark, [3.0, 4.0], START + dt.timedelta(1)))
    got = {(r.stock, r.date): r.normalized_value for r in preprocess.preprocess_factors(two, "time_series_percentile").collect()}
    assert got["000000", START] == 50.0 and got["000001", START] == 100.0
    with pytest.raises(ValueError):
        preprocess.preprocess_factors(two, "other")


def test_preprocessing_looks_at_its_own_day(spark):
    one = cross(spark, [1.0, 7.0, 9.0])
    for later in ([1.0, 2.0, 3.0], [100.0, -5.0, 1e9]):
        both = preprocess.preprocess_factors(one.union(cross(spark, later, START + dt.timedelta(1)))).where(F.col("date") == START)
        assert values(both, "normalized_value") == values(preprocess.preprocess_factors(one), "normalized_value")


def test_ranks_and_contracts(spark):
    df = cross(spark, [3.0, 1.0, 3.0, None, 2.0])
    assert values(df.withColumn("r", average_rank("factor_value", "date")), "r") == [3.5, 1.0, 3.5, None, 2.0]
    assert values(df.withColumn("r", percentile_rank("factor_value", "date")), "r") == [0.875, 0.25, 0.875, None, 0.5]
    with pytest.raises(ValueError, match=r"\['a', 'b'\]"):
        require_columns(df, ["b", "a", "date"])
    nan = spark.createDataFrame([(float("nan"),), (1.0,)], "x double")
    assert [r.x for r in missing_to_null(nan).collect()] == [None, 1.0]
    assert two_sided_p(0.0) == 1.0 and math.isclose(two_sided_p(1.959964), 0.05, rel_tol=1e-4) and two_sided_p(None) is None


def test_codes(spark):
    df = spark.createDataFrame([("1.0",), (" 600519 ",), ("abc",), ("1234567",), (None,)], "c string")
    assert [r[0] for r in df.select(codes.normalize_code(F.col("c"))).collect()] == ["000001", "600519", None, None, None]
    names = spark.createDataFrame([("600001", "*ST ab"), ("300001", "x"), ("688001", "x"), ("830001", "x"), ("000001", "x"), ("000002", None)], "code string, name string")
    st = codes.is_special_treatment(F.col("name"))
    assert [r[0] for r in names.select(codes.limit_rate(F.col("code"), st)).collect()] == [0.05, 0.2, 0.2, 0.3, 0.1, 0.1]
    assert [r[0] for r in names.select(codes.exchange_prefix(F.col("code"))).collect()] == ["sh", "sz", "sh", "sz", "sz", "sz"]
