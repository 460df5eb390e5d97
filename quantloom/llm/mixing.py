"""Mixing sources to target weights: fixed-length blocks, multinomial draws, pseudorandom index permutations, a join by index.

Every source's documents, in the order of a hash of their ids and texts, are one stream of words that is cut into blocks of
`block` words (the last one may be shorter). Each output shard has `shard_slots` slots (the last one the rest) and draws how
many of them each source fills from its own multinomial at the target weights. Slots are numbered by source over the shards;
slot j of a source takes block perm(j mod n) in its pass j div n, where perm is a Feistel network keyed by seed and source,
walked until it falls below n. Slots and the documents' pieces of blocks meet in an equi-join on (source, block).

A last correction bounds the draws' noise: a source whose total lies more than `tolerance` from its target, or above two
passes, loses its last slots, or gets slots in shards of its own after the others, up to that bound. Inside it the draw
decides what is taken.

The result depends on the rows and the seed alone, not on partitions: a shard's draw is keyed by its number, documents are
ordered by their hashes, and the sums of chunks that give word and slot offsets are the same for any number of chunks. The
driver sees a row a source, which bounds the number of sources; draws, offsets and slots are made by executors, at most
`shard_slots` rows a batch.

Defined results: a null text has size 0 and nothing to take; a null source is a source, last in the order; repeated rows
are documents of their own; an empty table gives an empty result; a source without words has target 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.llm.common import SPACE, cut, few_rows, n_partitions

WEIGHTS, SHARE, CAP = (5, 2, 1), 1.5, 2.0


def n_words(text: str = "text"):
    """The number of words of a text, 0 for null: the runs between white space."""
    bare = F.trim(F.coalesce(F.col(text), F.lit("")), F.lit(SPACE))
    return F.when(bare == "", 0).otherwise(F.size(F.split(bare, r"[\x20\x09-\x0D]+", -1))).cast("long")


def targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> list[float]:
    """Shares of share * sum(sizes) by weight; who is above cap * size is held there and the rest is shared again."""
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    held: dict[int, float] = {}
    while True:
        left = share * sum(sizes) - sum(held.values())
        total = sum(w[i] for i in range(len(sizes)) if i not in held)
        now = [held[i] if i in held else left * w[i] / total for i in range(len(sizes))]
        over = [i for i in range(len(sizes)) if i not in held and now[i] > cap * sizes[i]]
        if not over:
            return now
        held |= {i: cap * float(sizes[i]) for i in over}
        if len(held) == len(sizes):
            return [held[i] for i in range(len(sizes))]


def draw(shard: int, weights: np.ndarray, total: int, shard_slots: int, seed: int) -> np.ndarray:
    """How many slots of one output shard each source fills; total: the slots of all shards."""
    rng = np.random.Generator(np.random.Philox(key=np.array([seed, shard], dtype=np.uint64)))
    return rng.multinomial(min(shard_slots, total - shard * shard_slots), weights / weights.sum())


def limits(owed: list[int], blocks: list[int], tolerance: float) -> list[tuple[int, int]]:
    """The least and the most slots of each source: tolerance from what it is owed, and at most two passes."""
    return [(int(np.ceil(n * (1 - tolerance))), min(2 * b, int(n * (1 + tolerance)))) for n, b in zip(owed, blocks, strict=True)]


def _mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permute(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """A keyed pseudorandom permutation of 0..n-1: four Feistel rounds on the next even number of bits, walked back into range."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask, h = np.uint64((1 << half) - 1), np.uint64(half)
    out, walk = index.astype(np.uint64), np.ones(len(index), dtype=bool)
    with np.errstate(over="ignore"):
        while walk.any():
            x = out[walk]
            left, right = x >> h, x & mask
            for r in range(4):
                k = np.uint64((key * 0x9E3779B97F4A7C15 + (r + 1) * 0xD1B54A32D192ED03) % 2**64)
                left, right = right, left ^ (_mix64(right + k) & mask)
            out[walk] = (left << h) | right
            walk[walk] = out[walk] >= n
    return out.astype(np.int64)


def _running(rows: DataFrame, keys: list[str], chunk: str, order: list[str], size: str, out: str) -> DataFrame:
    """rows with the sum of `size` over the rows before each, by keys: sums of chunks, then a running sum inside each chunk."""
    sums = rows.groupBy(*keys, chunk).agg(F.sum(size).alias("_s"))
    before = sums.select(*(F.col(k).alias(f"_b_{k}") for k in keys), F.col(chunk).alias("_b_chunk"), (F.sum("_s").over(Window.partitionBy(*keys).orderBy(chunk)) - F.col("_s")).alias("_before"))
    inside = F.sum(size).over(Window.partitionBy(*keys, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col(size)
    same = F.col(chunk) == F.col("_b_chunk")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_b_{k}"))
    return rows.withColumn("_inside", inside).join(before, same).withColumn(out, F.col("_before") + F.col("_inside")).drop("_inside", "_before", "_b_chunk", *(f"_b_{k}" for k in keys))


def layout(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, _tk, source, size, start: each document's place in its source's stream of words. Chunks are ranges of the hash, so the order is the hash's for any number of them."""
    rows = cut(docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit("\0null"))).alias("_tk"), F.col(source_col).alias("source"), n_words(text_col).alias("size")))
    bits = min(20, max(6, (4 * n_partitions(docs.sparkSession)).bit_length()))
    rows = rows.withColumn("h", F.xxhash64("doc_id", "_tk")).withColumn("chunk", F.shiftright("h", 64 - bits))
    return _running(rows, ["source"], "chunk", ["h", "doc_id"], "size", "start").select("doc_id", "_tk", "source", "size", "start")


def _slots(spark, owed: list[int], blocks: list[int], shard_slots: int, tolerance: float, seed: int) -> DataFrame:
    """shard, slot, src, block: every slot of every output shard with the block that fills it."""
    total, weights = sum(owed), np.array(owed, dtype=np.float64)
    n_shards = -(-total // shard_slots)

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard in b.column(0).to_pylist():
                n = draw(shard, weights, total, shard_slots, seed)
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), shard, np.int64)), pa.array(at.astype(np.int32)), pa.array((np.cumsum(n) - n)[at]), pa.array(n[at])], names=["shard", "src", "at", "n"])

    spread = min(n_partitions(spark), max(1, n_shards))
    drawn = spark.range(n_shards, numPartitions=spread).mapInArrow(counts, "shard long, src int, at long, n long")
    drawn = cut(_running(drawn.withColumn("chunk", F.expr("shard div 1024")), ["src"], "chunk", ["shard"], "n", "first").select("shard", "src", "at", "first", "n"))
    got = {r.src: r.n for r in drawn.groupBy("src").agg(F.sum("n").alias("n")).collect()}  # one row a source
    bounds, more, shard = limits(owed, blocks, tolerance), [], n_shards
    for src, (least, _) in enumerate(bounds):
        for first in range(got.get(src, 0), least, shard_slots):
            more.append((shard, src, 0, first, min(shard_slots, least - first)))
            shard += 1
    dims = few_rows(spark, [(i, b, most) for i, (b, (_, most)) in enumerate(zip(blocks, bounds, strict=True))], "src int, n_blocks long, most long")  # one row a source
    plan = drawn.unionByName(few_rows(spark, more, "shard long, src int, at long, first long, n long"))
    plan = plan.join(F.broadcast(dims), "src").where("first < most").select("shard", "src", "at", "first", F.least("n", F.col("most") - F.col("first")).alias("n"), "n_blocks")

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, src, at, first, n, n_blocks in zip(*(c.to_pylist() for c in b.columns), strict=True):
                size = min(shard_slots, total - shard * shard_slots) if shard < n_shards else n
                slot = permute(np.arange(at, at + n, dtype=np.int64), size, seed * 7_368_787 + shard)
                block = permute(np.arange(first, first + n, dtype=np.int64) % n_blocks, n_blocks, seed * 1_000_003 + src)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, shard, np.int64)), pa.array(slot), pa.array(np.full(n, src, np.int32)), pa.array(block)], names=["shard", "slot", "src", "block"])

    return plan.repartition(spread).mapInArrow(fill, "shard long, slot long, src int, block long")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = 64, shard_slots: int = 4096, tolerance: float = 0.02, seed: int = 9) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, slots, pieces). documents: doc_id, _tk, source, size, start, source_size, target, src. slots: the mix itself:
    shard, slot, src, block. pieces: a document's part of a block and how often the mix takes it: doc_id, _tk, start, first, n
    (words first to first + n of the document), times."""
    spark = docs.sparkSession
    placed = cut(layout(docs, id_col, text_col, source_col))
    totals = [(r.source, r.s) for r in placed.groupBy("source").agg(F.sum("size").alias("s")).collect()]  # one row a source
    totals.sort(key=lambda x: (x[0] is None, str(x[0] or "").encode("utf-8", "surrogatepass")))
    sizes = [s for _, s in totals]
    target = targets(sizes) if totals else []
    blocks = [-(-s // block) for s in sizes]
    owed = [min(2 * b, round(t / s * b)) if s else 0 for t, s, b in zip(target, sizes, blocks, strict=True)]
    slots = _slots(spark, owed, blocks, shard_slots, tolerance, seed) if sum(owed) else few_rows(spark, [], "shard long, slot long, src int, block long")
    dims = few_rows(spark, [(s, z, t, i) for i, ((s, z), t) in enumerate(zip(totals, target, strict=True))], f"source {dict(docs.dtypes)[source_col]}, source_size long, target double, src int")
    documents = placed.alias("r").join(F.broadcast(dims).alias("d"), F.col("r.source").eqNullSafe(F.col("d.source"))).select("r.doc_id", "r._tk", "r.source", "r.size", "r.start", "d.source_size", "d.target", "d.src")
    taken = slots.groupBy("src", "block").agg(F.count("*").alias("times"))
    span = F.sequence(F.expr(f"start div {block}"), F.expr(f"(start + size - 1) div {block}"))
    pieces = documents.where("size > 0").select("doc_id", "_tk", "src", "size", "start", F.explode(span).alias("block"))
    low, high = F.greatest("start", F.col("block") * block), F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block)
    pieces = pieces.join(taken, ["src", "block"]).select("doc_id", "_tk", "start", (low - F.col("start")).alias("first"), (high - low).alias("n"), "times")
    return documents, slots, pieces


def taken_words(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken for every document."""
    documents, _, pieces = mix(docs, **options)
    taken = pieces.groupBy("doc_id", "_tk", "start").agg(F.sum(F.col("n") * F.col("times")).alias("taken"))
    d, t = documents.alias("d"), taken.alias("t")
    same = F.col("d.doc_id").eqNullSafe(F.col("t.doc_id")) & (F.col("d._tk") == F.col("t._tk")) & (F.col("d.start") == F.col("t.start")) & (F.col("d.size") > 0)
    return d.join(t, same, "left").select("d.doc_id", "d.size", "d.source_size", "d.target", F.coalesce("t.taken", F.lit(0)).cast("long").alias("taken"))


def query(spark, sf_dir: str) -> DataFrame:
    """op9: how many words of each document the mix takes."""
    return taken_words(spark.read.parquet(f"{sf_dir}/documents.parquet"))
