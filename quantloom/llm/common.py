"""What the operators share: where shared state goes, row keys, words, and connected components."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

#: The white space of every contract here: space, tab to carriage return. bytes.split() splits at just these.
SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """The folder in spark.checkpoint.dir; where the setting is missing, one of our own on a local master (as in tests), an error on a cluster."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="quantloom-"))


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut at files that all executors share. Spark removes the files when the result is no longer used."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the driver ends."""
    ensure_checkpoint_dir(spark)
    jvm, sc = spark.sparkContext._jvm, spark.sparkContext._jsc
    path = f"{sc.sc().getCheckpointDir().get()}/{name}-{jvm.java.util.UUID.randomUUID()}"

    def remove() -> None:
        try:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(sc.hadoopConfiguration()).delete(at, True)
        except Exception:  # noqa: BLE001 the session may have ended
            pass

    atexit.register(remove)
    return path


#: Lets Spark remove the shuffle files of a write when it ends; nothing reads them again, since what was written takes their place.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, written and read back. The shuffle files that made it are removed at once."""
    spark = df.sparkSession
    path, before = scratch(spark, name), spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def text_key(text: str = "text") -> Column:
    """64 bits of a text; with doc_id, it tells apart rows that repeat an id."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("\0null")))


def packed(docs: DataFrame, **others: Column) -> DataFrame:
    """docs' columns as one struct `row`, and others beside it: no name of the user's can clash with one of ours."""
    return docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row"), *(c.alias(n) for n, c in others.items()))


def unpacked(df: DataFrame, names: list[str], **replaced: Column) -> DataFrame:
    """The columns of `row` again, some replaced."""
    return df.select(*(replaced.get(c, F.col("row").getField(c)).alias(c) for c in names))


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def utf8(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass") if text else b""


def words_of(text: str | None) -> list[bytes]:
    r"""The words [^\x20\x09-\x0D]+ of a text as UTF-8; none for null."""
    return utf8(text).split()


def few_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """createDataFrame() for rows of the driver, as an Arrow table: without it each executor starts Python workers of another
    kind, which only unpickle these rows and then stay beside those of mapInArrow."""
    kind = StructType.fromDDL(schema)
    columns = zip(*rows, strict=True) if rows else [[] for _ in kind]
    arrays = [pa.array(list(c), to_arrow_type(f.dataType)) for c, f in zip(columns, kind, strict=True)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, names=kind.names), kind)


def give_back() -> None:
    """Gives the system what a task in a Python worker no longer uses. Spark hands tasks to all of its idle workers in turn, so
    that without this each of them would stay as large as the largest task that it had."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, for mapInArrow, with give_back() at a task's end."""

    def task(batches: Iterator) -> Iterator:
        yield from run(batches)
        give_back()

    return task


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, label) for every node of edges (a long, b long); label: the smallest node that can be reached.

    Labels spread over edges and then jump to their label's label, so a chain of n nodes takes O(log n) rounds.
    Every round is an aggregation with partial sums, cut by a checkpoint; nothing is collected but one count.
    """
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("near")).where("node <> near")
    both = cut(both.unionByName(both.select(F.col("near").alias("node"), F.col("node").alias("near"))).distinct())
    labels = cut(both.groupBy("node").agg(F.min("near").alias("m")).select("node", F.least("node", "m").alias("label")))
    for _ in range(max_rounds):
        seen = labels.select(F.col("node").alias("near"), F.col("label").alias("theirs"))
        offered = both.join(seen, "near").groupBy("node").agg(F.min("theirs").alias("offer"))
        spread = labels.join(offered, "node").select("node", F.col("label").alias("old"), F.least("label", "offer").alias("label"))
        # hooks: the old root of a node that found a smaller label takes that label too
        hook = spread.where("label < old").groupBy(F.col("old").alias("node")).agg(F.min("label").alias("hook"))
        spread = cut(spread.join(hook, "node", "left").select("node", "old", F.least("label", F.coalesce("hook", "label")).alias("label")))
        up = spread.select(F.col("node").alias("label"), F.col("label").alias("above"))
        fresh = cut(spread.join(up, "label", "left").select("node", "old", F.least("label", F.coalesce("above", "label")).alias("label")))
        changed = fresh.where("label <> old").limit(1).count()
        labels = fresh.select("node", "label")
        if not changed:
            return labels
    raise RuntimeError("components did not settle")
