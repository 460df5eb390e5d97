"""Tables that several branches of a plan read, written once to the folder that driver and executors share; rows dealt out by key."""

from __future__ import annotations

import atexit
import tempfile

from pyspark.sql import DataFrame


#: Lets Spark remove the shuffle files of a write when it ends; what was written takes their place.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df with the rows of each key in one partition: aggregations and windows whose keys hold these need no further shuffle, however many rows a plan makes of each. Small partitions, so that sorts of such rows stay in memory."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(n, min(400, 8 * n)), *keys)


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """df written to spark.checkpoint.dir and read back, so that what made it runs once and a lost executor loses nothing.

    Without that setting a local master gets a folder of its own; a cluster raises. The files go when the driver ends.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="quantloom-"))
    jvm, jsc = sc._jvm, sc._jsc
    path = f"{jsc.sc().getCheckpointDir().get()}/{name}-{jvm.java.util.UUID.randomUUID()}"

    def remove() -> None:
        try:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # noqa: BLE001 the session may have ended
            pass

    atexit.register(remove)
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)
