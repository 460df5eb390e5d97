"""Daily ingest: each micro-batch of prices is merged by key, so a replay changes nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quantloom.schema import PRICE_SCHEMA
from quantloom.sources.ingest import keep_last, remove_invalid


def merge_batch(store: str):
    """A foreachBatch function: months that a batch touches are read, merged (the later batch wins) and replaced as whole partitions."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = remove_invalid(batch).withColumns({"month": F.date_format("date", "yyyy-MM"), "_batch": F.lit(number).cast("long")})
        months = [r[0] for r in fresh.select("month").distinct().collect()]  # the months of one batch
        if not months:
            return
        merged = fresh
        try:
            merged = fresh.unionByName(spark.read.parquet(store).where(F.col("month").isin(months)))
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
        # the new partitions go to a folder of their own first: files that are being read are never replaced
        side = f"{store}__batch{number}"
        keep_last(merged, ["date", "stock"], "_batch").write.mode("overwrite").parquet(side)
        spark.read.parquet(side).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(store)

    return merge


def ingest(spark: SparkSession, source: str, store: str, checkpoint: str) -> StreamingQuery:
    """Reads new parquet files of prices from source and merges them into store."""
    stream = spark.readStream.schema(PRICE_SCHEMA).parquet(source)
    return stream.writeStream.foreachBatch(merge_batch(store)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
