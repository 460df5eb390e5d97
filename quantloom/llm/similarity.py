"""Near copies by the Jaccard similarity of their five-word shingles: SimHash links first, then all others, without loss.

Sets that are equal collapse first. Then links are sought in rounds, and each is verified on the two whole shingle sets:

1. SimHash (operator 4): fingerprints over the same shingles, its byte-position index and count filter. It finds most near
   copies at the cost of a fingerprint each, but similar sets may differ in more than its three bits.
2. Prefix filtering, for the rest: in any fixed order of all shingles, two sets of similarity t or more share one of the
   first n - ceil(t * n) + 1 shingles of each (n: the set's size). The order puts shingles that are common in a sample of
   the corpus last, so that lists of a shared passage stay out of the prefixes; the sample decides the cost only, never the
   result. Three bounds drop pairs without a look at their texts: the places of their first common shingle, the bits in
   which two signatures of all shingles differ, and the tally of the shingles that the two prefixes share. Lists are met by
   their smallest and their largest member first, and pairs that earlier links connect are left out, so that a large
   cluster costs about a link a member; then a list's other members meet all of it.

Defined results: words are lower-cased (ASCII); a text of fewer words than the width is one shingle; null and blank texts
are copies of each other; null ids and repeated rows are kept apart by the caller; an empty table gives empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.llm import simhash
from quantloom.llm.common import connected_components, lean, stored, text_key, utf8

WIDTH, PERCENT = 5, 80
#: One text in so many is sampled for common shingles; at most so many of those are kept on the driver.
SAMPLE, COMMON = 64, 100_000
#: Bits of a set's signature: the parities of its shingles by residue.
SIGNATURE = 512


def shingles(text: str | None, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of a text's word shingles, and the distinct ones, sorted."""
    words = utf8(text).lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint64)
    joined, n = b" ".join(words), max(1, len(words) - width + 1)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts, stops = [0, *ends[:-1].tolist()][:n], (ends[min(width, len(words)) - 1 :] - 1).tolist()
    h64 = xxhash.xxh64_intdigest
    every = np.fromiter((h64(joined[a:b], 42) for a, b in zip(starts, stops, strict=True)), dtype=np.uint64, count=n)
    return every, np.unique(every)


def prefix(found: np.ndarray, common: np.ndarray, places: np.ndarray, percent: int) -> tuple[np.ndarray, int]:
    """The first shingles in the order: by hash, common ones (sorted, with their places) last; and how many of them are not common."""
    size = len(found)
    take = size + (-percent * size) // 100 + 1 if size else 0
    if not len(common):
        return found[:take], take
    at = np.minimum(np.searchsorted(common, found), len(common) - 1)
    late = common[at] == found
    rare = found[~late]
    if len(rare) >= take:
        return rare[:take], take
    return np.concatenate([rare, found[late][np.argsort(places[at[late]])]])[:take], len(rare)


def plausible(a: np.ndarray, rare_a: int, size_a: int, b: np.ndarray, rare_b: int, size_b: int, percent: int = PERCENT) -> bool:
    """Whether two sets may be similar, as far as their prefixes tell: up to the earlier end of what is known of both, the
    tally of shared shingles is exact; all that comes after may be shared."""
    known_a, known_b = a[:rare_a], b[:rare_b]
    for known, whole in ((known_a, rare_a < len(a)), (known_b, rare_b < len(b))):
        if not whole:  # rare shingles beyond its end are not known
            end = known[-1] if len(known) else np.uint64(0)
            known_a, known_b = known_a[: np.searchsorted(known_a, end, side="right")], known_b[: np.searchsorted(known_b, end, side="right")]
    most = len(np.intersect1d(known_a, known_b, assume_unique=True)) + min(size_a - len(known_a), size_b - len(known_b))
    return most * (100 + percent) >= percent * (size_a + size_b)


def signature(found: np.ndarray) -> np.ndarray:
    """SIGNATURE bits of a set: whether an odd number of its members has a residue. Two sets' signatures differ in no more bits than there are members of just one."""
    odd = np.bincount((found % np.uint64(SIGNATURE)).astype(np.int64), minlength=SIGNATURE) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def similar(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """Whether two sets of distinct values have a Jaccard similarity of percent or more."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * 100 >= percent * (len(a) + len(b) - both)


def _key(found: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(found.tobytes(), 7) if len(found) else 0


def _signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, dtype=np.uint64).view(np.int64))


def common_shingles(docs: DataFrame, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that stand in several sampled texts, sorted, and the place of each by its count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in b.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(shingles(x.as_py(), width)[1].view(np.int64))], names=["h"])

    sampled = docs.select("text").where(F.pmod(text_key(), F.lit(SAMPLE)) == 0).distinct()
    found = sampled.mapInArrow(run, "h long").groupBy("h").count().where("count > 1").orderBy(F.desc("count"), "h").limit(COMMON).collect()
    values = np.array([r.h for r in reversed(found)], dtype=np.int64).view(np.uint64)
    order = np.argsort(values)
    return values[order], order


def keyed(docs: DataFrame, percent: int = PERCENT, width: int = WIDTH) -> DataFrame:
    """id, tk, fp (key of the shingle set), sim (its fingerprint), size, prefix and rare (see prefix()), sig (see signature()) for every row."""
    common, places = common_shingles(docs, width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 1_000):
                keys, sims, sizes, first, rare, sig, part = [], [], [], [], [], [], b.slice(lo, 1_000)
                for x in part.column(2):
                    every, found = shingles(x.as_py(), width)
                    keys.append(_key(found))
                    sims.append(simhash.majority(every))
                    sizes.append(len(found))
                    head, n = prefix(found, common, places, percent)
                    first.append(head.view(np.int64))
                    rare.append(n)
                    sig.append(signature(found))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), _signed(keys), _signed(sims), pa.array(sizes, pa.int64()), pa.array(first, pa.list_(pa.int64())), pa.array(rare, pa.int32()), pa.array(sig, pa.list_(pa.int64()))], names=["id", "tk", "fp", "sim", "size", "prefix", "rare", "sig"])

    return docs.select(F.col("doc_id").alias("id"), text_key().alias("tk"), "text").mapInArrow(lean(run), f"id {dict(docs.dtypes)['doc_id']}, tk long, fp long, sim long, size long, prefix array<long>, rare int, sig array<long>")


def _plausible(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that pass the tally of their prefixes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            heads = [[np.asarray(x.values).view(np.uint64) for x in b.column(i)] for i in (2, 5)]
            numbers = [b.column(i).to_pylist() for i in (3, 4, 6, 7)]
            ok = [plausible(x, rx, nx, y, ry, ny, percent) for x, y, rx, nx, ry, ny in zip(*heads, *numbers, strict=True)]
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    x = sets.select(F.col("fp").alias("a"), F.col("prefix").alias("x"), F.col("rare").alias("rx"), F.col("size").alias("nx"))
    y = sets.select(F.col("fp").alias("b"), F.col("prefix").alias("y"), F.col("rare").alias("ry"), F.col("size").alias("ny"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "rx", "nx", "y", "ry", "ny").mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, texts: DataFrame, percent: int, width: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar. texts: fp, text, one row a set; pairs of one text arrive together, so its set is made once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own = None, None
        for b in batches:
            ok = []
            for a, x, y in zip(b.column(0).to_pylist(), b.column(2), b.column(3), strict=True):
                if a != now:
                    now, own = a, shingles(x.as_py(), width)[1]
                ok.append(similar(own, shingles(y.as_py(), width)[1], percent))
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    x, y = texts.select(F.col("fp").alias("a"), F.col("text").alias("x")), texts.select(F.col("fp").alias("b"), F.col("text").alias("y"))
    return pairs.join(y, "b").join(x, "a").select("a", "b", "x", "y").mapInArrow(lean(run), "a long, b long")


def _proposed(rows: DataFrame) -> DataFrame:
    """a, b: pairs of sets that SimHash links. Sets of one fingerprint meet the smallest of them, and these each other along the index's links."""
    sets = rows.where("size > 0").select("fp", "sim").distinct()
    least = sets.groupBy("sim").agg(F.min("fp").alias("first"))
    found = simhash.links(least.select(F.col("sim").alias("fp"))).distinct()
    first = lambda sim, name: least.select(F.col("sim").alias(sim), F.col("first").alias(name))
    across = found.join(first("a", "p"), "a").join(first("b", "q"), "b").select("p", "q")
    within = sets.join(least, "sim").where("fp <> first").select(F.col("first").alias("p"), F.col("fp").alias("q"))
    return across.unionByName(within).select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct()


def _pairs(lists: DataFrame, nodes: DataFrame, pivot, percent: int) -> DataFrame:
    """a, b: members of one list that are not yet connected and may be similar: those of the pivot, or all.

    lists: key, fp, at (the place of the shingle in the set's order); nodes: fp, size, sig, label. Similar sets share no
    shingle before their first common one, so there its places bound the overlap; and the bits in which two signatures
    differ are at most the shingles that only one of the sets has. Members of a list's largest component are never
    compared with each other."""
    named = lists.join(nodes, "fp")
    second = [F.col(c).alias(f"{c}2") for c in ("fp", "size", "sig", "label", "at")]
    parts = named.groupBy("key", "label").agg(F.count("*").alias("n"), *([pivot("fp").alias("p")] if pivot else []))
    open_lists = parts.groupBy("key").agg(F.count("*").alias("labels"), *([pivot("p").alias("p")] if pivot else [F.max(F.struct("n", "label")).getField("label").alias("main")])).where("labels > 1").drop("labels")
    if pivot:
        pivots = named.join(open_lists, "key").where("fp = p").select("key", *second)
        met = named.join(pivots, "key")
        unlike = F.col("label") != F.col("label2")
    else:
        outside = named.join(open_lists, "key").where("label <> main")
        met = outside.join(named.select("key", *second), "key")
        unlike = (F.col("label") != F.col("label2")) & ((F.col("label2") == F.col("main")) | (F.col("fp") < F.col("fp2")))
    both = F.col("size") + F.col("size2")
    far = sum((F.bit_count(F.col("sig")[i].bitwiseXOR(F.col("sig2")[i])) for i in range(SIGNATURE // 64)), F.lit(0))
    met = met.where(unlike & (F.least(F.col("size") - F.col("at"), F.col("size2") - F.col("at2")) * (100 + percent) >= both * percent) & (far * (100 + percent) <= both * (100 - percent)))
    return met.select(F.least("fp", "fp2").alias("a"), F.greatest("fp", "fp2").alias("b")).distinct()


def components(docs: DataFrame, rows: DataFrame, percent: int = PERCENT, width: int = WIDTH) -> DataFrame:
    """node, label: components of set keys under similarity of percent or more. rows: the result of keyed(), stored."""
    sets = stored(rows.where("size > 0").groupBy("fp").agg(F.first("size").alias("size"), F.first("prefix").alias("prefix"), F.first("rare").alias("rare"), F.first("sig").alias("sig")), "sets")
    posted = sets.select("fp", F.posexplode("prefix").alias("at", "key"))
    lists = stored(posted.withColumn("n", F.count("*").over(Window.partitionBy("key"))).where("n > 1").drop("n"), "lists")
    proposed = stored(_proposed(rows), "proposed")
    members = lists.select("fp").unionByName(proposed.select(F.col("a").alias("fp"))).unionByName(proposed.select(F.col("b").alias("fp"))).distinct()
    one = rows.join(members, "fp", "left_semi").groupBy("fp").agg(F.min("tk").alias("tk"))
    texts = stored(docs.select("text", text_key().alias("tk")).join(one, "tk").groupBy("fp").agg(F.first("text").alias("text")), "members")
    links = stored(_verified(proposed, texts, percent, width), "links")
    labels = connected_components(links)
    for pivot in (F.min, F.max, None):
        nodes = sets.select("fp", "size", "sig").join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
        pairs = stored(_plausible(stored(_pairs(lists, nodes, pivot, percent), "pairs"), sets, percent), "plausible")
        fresh = stored(_verified(pairs, texts, percent, width), "links")
        links = links.unionByName(fresh)
        labels = connected_components(links)
    return labels
