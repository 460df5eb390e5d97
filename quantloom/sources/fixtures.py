"""Weekly security panels from the star-schema tables: a supplier is a security, its weekly sales are its prices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantloom.sources.store import dealt


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """date (a week's Monday), stock, open, high, low, close, volume, amount. Prices are 100,000 plus the average price of what was sold: sums are exact integers, divided once. Four columns are shuffled once, by stock: days, weeks and the windows by stock of later steps follow in place."""
    li = table(spark, sf_dir, "lineitem").select(F.lpad(F.col("l_suppkey").cast("string"), 6, "0").alias("stock"), "l_quantity", "l_extendedprice", F.to_date("l_shipdate").alias("day"))
    cents, qty = F.round(F.col("l_extendedprice") * 100).cast("long"), F.round("l_quantity").cast("long")
    days = dealt(li, "stock").groupBy("stock", F.trunc("day", "week").alias("date"), "day").agg(F.sum(cents).alias("c"), F.sum(qty).alias("q"), F.max(F.col("l_extendedprice") / F.col("l_quantity")).alias("h"), F.min(F.col("l_extendedprice") / F.col("l_quantity")).alias("l"))
    price = lambda c, q: F.lit(100000.0) + F.col(c).cast("double") / 100.0 / F.col(q).cast("double")
    weeks = days.groupBy("stock", "date").agg(F.sum("c").alias("c"), F.sum("q").alias("q"), F.max("h").alias("high"), F.min("l").alias("low"), F.min_by("c", "day").alias("oc"), F.min_by("q", "day").alias("oq"))
    return weeks.select("date", "stock", price("oc", "oq").alias("open"), (F.lit(100000.0) + F.col("high")).alias("high"), (F.lit(100000.0) + F.col("low")).alias("low"), price("c", "q").alias("close"), F.col("q").cast("double").alias("volume"), (F.col("c").cast("double") / 100.0).alias("amount"))


def supplier_exposures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """stock, industry, market_cap (some are not positive)."""
    s = table(spark, sf_dir, "supplier")
    return s.select(F.lpad(F.col("s_suppkey").cast("string"), 6, "0").alias("stock"), F.col("s_nationkey").cast("string").alias("industry"), F.col("s_acctbal").alias("market_cap"))


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """stock, report_period, announcement_date (quarter's end + 45 days), pe, pb, roe from quarterly sums."""
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_quantity", "l_extendedprice", "l_discount", F.trunc(F.to_date("l_shipdate"), "quarter").alias("q0"))
    by = li.groupBy(F.lpad(F.col("l_suppkey").cast("string"), 6, "0").alias("stock"), "q0").agg(F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("c"), F.sum(F.round(F.col("l_discount") * 100).cast("long")).alias("d"), F.sum(F.round("l_quantity").cast("long")).alias("q"), F.count("*").alias("n"))
    end = F.date_sub(F.add_months("q0", 3), 1)
    c, d, q, n = (F.col(x).cast("double") for x in ("c", "d", "q", "n"))
    return by.select("stock", end.alias("report_period"), F.date_add(end, 45).alias("announcement_date"), (c / q / 1000.0 - 15.0).alias("pe"), (q / n / 10.0).alias("pb"), (d / n / 100.0).alias("roe"))


def master(spark: SparkSession, sf_dir: str) -> DataFrame:
    """stock_code, listing_date (first week), delisting_date (every seventh supplier, 2,000 days after its first week)."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.min(F.trunc(F.to_date("l_shipdate"), "week")).alias("listing_date"))
    return li.select(F.lpad(F.col("l_suppkey").cast("string"), 6, "0").alias("stock_code"), "listing_date", F.when(F.col("l_suppkey") % 7 == 0, F.date_add("listing_date", 2000)).alias("delisting_date"))


def membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """stock, universe_name, effective_date, end_date: suppliers of even nations for three years, of nations that 3 divides without end."""
    s = table(spark, sf_dir, "supplier").select(F.lpad(F.col("s_suppkey").cast("string"), 6, "0").alias("stock"), F.col("s_nationkey").alias("k"))
    a = s.where("k % 2 = 0").select("stock", F.lit("INDEX").alias("universe_name"), F.lit("1995-06-05").cast("date").alias("effective_date"), F.lit("1998-12-28").cast("date").alias("end_date"))
    b = s.where("k % 3 = 0").select("stock", F.lit("INDEX").alias("universe_name"), F.lit("1999-01-04").cast("date").alias("effective_date"), F.lit(None).cast("date").alias("end_date"))
    return a.unionByName(b)


def benchmark(prices: DataFrame) -> DataFrame:
    """date, benchmark_return: the equal-weight mean of the stocks' returns."""
    over = Window.partitionBy("stock").orderBy("date")
    return prices.withColumn("r", F.col("close") / F.lag("close").over(over) - 1).groupBy("date").agg(F.avg("r").alias("benchmark_return"))
