"""Sharding by Karmarkar-Karp differencing: near-equal bytes for groups that must not be split.

A group is all documents of one text. Its size is summed with partial aggregation, so one text may hold a third of the
rows. Groups fall into buckets of about `per_bucket` by their digest; each bucket is differenced on its own: the two
partial partitions with the largest spread are combined oppositely ordered until one is left. What a bucket leaves is
again a partial partition (n_shards sums), so the driver goes on in the same way over at most `max_buckets` of them and
the few groups that are large against a shard, a bounded table that is broadcast back as (bucket, part) -> shard.

Defined results: a null text counts as empty; repeated rows stay together and each gets its own slot; an empty table
gives an empty result; columns other than the id and the text are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantloom.llm.common import cut, n_partitions


def difference(parts: list[tuple[list[int], list]]) -> tuple[list[int], list]:
    """Karmarkar-Karp: parts are (sums, members) with n_shards entries each; members nest as lists of two. Returns one such part."""
    heap = []
    for i, (sums, members) in enumerate(parts):
        order = sorted(range(len(sums)), key=lambda j: -sums[j])
        s, m = [sums[j] for j in order], [members[j] for j in order]
        heap.append((s[-1] - s[0], i, s, m))
    heapq.heapify(heap)
    n = len(heap)
    while len(heap) > 1:
        _, _, s1, m1 = heapq.heappop(heap)
        _, _, s2, m2 = heap[0]
        joined = sorted(((a + b, i) for i, (a, b) in enumerate(zip(s1, reversed(s2), strict=True))), key=lambda x: (-x[0], x[1]))
        k = len(s1)
        s = [x[0] for x in joined]
        m = [m1[i] if m2[k - 1 - i] is None else m2[k - 1 - i] if m1[i] is None else (m1[i], m2[k - 1 - i]) for _, i in joined]
        heapq.heapreplace(heap, (s[-1] - s[0], n, s, m))
        n += 1
    return heap[0][2], heap[0][3]


def leaves(tree) -> Iterator:
    """The members below a nested pair."""
    stack = [tree]
    while stack:
        x = stack.pop()
        if isinstance(x, tuple):
            stack.extend(x)
        elif x is not None:
            yield x


def assign_groups(groups: DataFrame, n_shards: int, per_bucket: int = 20_000, max_buckets: int = 65_536, heavy_parts: int = 512) -> DataFrame:
    """groups: (key binary, bytes long). Adds shard int. Groups of at least a heavy_parts-th of a shard's share (at most n_shards * heavy_parts of them) stay whole for the last differencing, so that no bucket is bent by one of them."""
    spark = groups.sparkSession
    n, total = groups.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    n_buckets = max(1, min(max_buckets, -(-n // per_bucket)))
    heavy = F.col("bytes") * (n_shards * heavy_parts) >= total
    large = [(bytes(r.key), r.bytes) for r in groups.where(heavy).collect()]  # at most n_shards * heavy_parts rows
    groups = groups.where(~heavy)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(bucket, found):
            parts = [([size] + [0] * (n_shards - 1), [key] + [None] * (n_shards - 1)) for key, size in sorted(found, key=lambda x: (-x[1], x[0]))]
            sums, members = difference(parts)
            for part in range(n_shards):
                keys = list(leaves(members[part]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([bucket] * (len(keys) + 1), pa.int32()), pa.array([part] * (len(keys) + 1), pa.int32()), pa.array([None, *keys], pa.binary()), pa.array([sums[part]] + [0] * len(keys), pa.int64())], names=["bucket", "part", "key", "bytes"]
                )

        now, found = None, []
        for b in batches:
            for bucket, key, size in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if bucket != now and found:
                    yield from done(now, found)
                    found = []
                now = bucket
                found.append((key, size))
        if found:
            yield from done(now, found)

    bucket = F.pmod(F.xxhash64("key"), F.lit(n_buckets)).cast("int")
    solved = cut(groups.select(bucket.alias("bucket"), "key", "bytes").repartition(min(n_buckets, 4 * n_partitions(spark)), "bucket").sortWithinPartitions("bucket").mapInArrow(solve, "bucket int, part int, key binary, bytes long"))
    sums: dict[int, list[int]] = {}
    for r in solved.where("key is null").collect():  # at most max_buckets * n_shards rows
        sums.setdefault(r.bucket, [0] * n_shards)[r.part] = r.bytes
    parts = [(s, [[b, p] for p in range(n_shards)]) for b, s in sorted(sums.items())]
    parts += [([size] + [0] * (n_shards - 1), [[key]] + [None] * (n_shards - 1)) for key, size in sorted(large, key=lambda x: (-x[1], x[0]))]
    members = difference(parts)[1] if parts else [None] * n_shards
    placed = [(x, shard) for shard in range(n_shards) for x in leaves(members[shard])]
    final = spark.createDataFrame([(*x, shard) for x, shard in placed if len(x) == 2], "bucket int, part int, shard int")
    alone = spark.createDataFrame([(*x, shard) for x, shard in placed if len(x) == 1], "key binary, shard int")
    return solved.where("key is not null").join(F.broadcast(final), ["bucket", "part"]).select("key", "shard").unionByName(alone)


def shard_documents(docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard, slot; documents of one text share a shard, slots are gapless from 0 in each shard."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = cut(docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.md5(text)).alias("key")))
    groups = cut(rows.groupBy("key").agg(F.sum("size").alias("bytes")))
    placed = cut(rows.join(assign_groups(groups, n_shards), "key"))
    # slots: a rank inside each of many chunks of a shard, after the rows of the shard's earlier chunks
    n_chunks = n_partitions(docs.sparkSession)
    placed = placed.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "key"), F.lit(n_chunks)).cast("int"))
    counts = placed.groupBy("shard", "chunk").agg(F.count("*").alias("n"))  # n_shards * n_chunks rows at most
    before = counts.select("shard", "chunk", (F.sum("n").over(Window.partitionBy("shard").orderBy("chunk")) - F.col("n")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("shard", "chunk").orderBy("doc_id", "key"))
    return placed.join(F.broadcast(before), ["shard", "chunk"]).select("doc_id", "size", "text_crc32", "shard", (F.col("before") + inside - 1).alias("slot"))


def query(spark, sf_dir: str) -> DataFrame:
    """op5: all documents in shards 0 to 7 of near-equal bytes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return shard_documents(docs, 8).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
