"""SimHash near-dedup with a byte-position inverted index and count filtering.

Fingerprints of 64 bits that differ in at most 3 bits agree in at least 5 of their 8 bytes: the guaranteed minimum of
shared positional bytes. A posting list of one positional byte would hold a 256th of all fingerprints, so its pairs would
grow with the square of the corpus; the index therefore posts four positional bytes at a time. Its 14 position sets are
those quadruples of {0..7} whose members XOR to zero (the Steiner system S(3,4,8)); every five positions contain one of
them, so each pair with the minimum meets in at least one list, and no cap is needed. Inside a list the shared positional
bytes of pairs are tallied, pairs with five or more are kept and verified by Hamming distance.

Copies collapse before the index (one posting a distinct fingerprint). A list never emits its pairs: it is searched
breadth first and gives a star of links to its components' smallest members, at most one row a posting. Very long lists are split
by a fifth shared byte and, where that is not enough, searched by flipping up to three of the remaining 24 bits, which is
linear in the list.

Defined results: a null or blank text has fingerprint zero and links like any other; a text of one or two words is one
shingle; repeated rows and null ids are kept, a component's id is its smallest id that is not null (null if there is
none); an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import connected_components, cut, n_partitions, utf8

#: Quadruples of byte positions; any five positions hold one of them.
QUADS = [q for q in combinations(range(8), 4) if q[0] ^ q[1] ^ q[2] ^ q[3] == 0]
LONG_LIST = 20_000


def fingerprint(text: str | None, width: int = 3) -> int:
    """The unsigned fingerprint of a text's word shingles: XXH64 with seed 42; a bit is 1 if over half of the hashes set it."""
    words = utf8(text).lower().split()
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:-1].tolist()][:n]
    stops = (ends[min(width, len(words)) - 1 :] - 1).tolist()
    h64 = xxhash.xxh64_intdigest
    return majority(np.fromiter((h64(joined[a:b], 42) for a, b in zip(starts, stops, strict=False)), dtype=np.uint64, count=n))


def majority(hashes: np.ndarray) -> int:
    """The fingerprint of shingle hashes: the bits that over half of them set; 0 for none."""
    counts = np.zeros(64, dtype=np.int64)
    for lo in range(0, len(hashes), 65536):
        counts += np.unpackbits(hashes[lo : lo + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(x.as_py(), width) for x in b.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).alias("doc_id"), text_col).mapInArrow(run, f"doc_id {dict(docs.dtypes)[id_col]}, fp long")


def shared_bytes(x: np.ndarray) -> np.ndarray:
    """The tally: in how many positional bytes two fingerprints agree; x: their XOR."""
    return (np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)


def _near(a: np.uint64, others: np.ndarray, bits: int) -> np.ndarray:
    """Which of the others link to a: the count filter, then the exact distance."""
    x = others ^ a
    kept = np.flatnonzero(shared_bytes(x) >= 8 - bits)
    return kept[np.bitwise_count(x[kept]) <= bits]


def _label(fps: np.ndarray, bits: int) -> np.ndarray:
    """Component labels (indices) of distinct fingerprints, by breadth-first search over those not yet reached."""
    label, rest = np.full(len(fps), -1, dtype=np.int64), np.arange(len(fps))
    while len(rest):
        root, rest, queue = rest[0], rest[1:], [rest[0]]
        label[root] = root
        while queue and len(rest):
            got = _near(fps[queue.pop()], fps[rest], bits)
            if len(got):
                label[rest[got]] = root
                queue.extend(rest[got].tolist())
                rest = np.delete(rest, got)
    return label


def _flips(positions: list[int], bits: int) -> list[np.uint64]:
    at = [8 * p + i for p in positions for i in range(8)]
    return [np.uint64(sum(1 << i for i in c)) for k in range(1, bits + 1) for c in combinations(at, k)]


def _links(fps: np.ndarray, fixed: tuple[int, ...], bits: int, long_list: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links (member, its component's first) among distinct sorted fingerprints that agree in the fixed byte positions."""
    if len(fps) <= long_list:
        label = _label(fps, bits)
        far = np.flatnonzero(label != np.arange(len(fps)))
        if len(far):
            yield fps[far], fps[label[far]]
        return
    rest = [p for p in range(8) if p not in fixed]
    if len(rest) > bits:  # a pair shares at least one of these bytes too
        for p in rest:
            byte = (fps >> np.uint64(8 * p)) & np.uint64(255)
            order = np.argsort(byte, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(byte[order])) + 1):
                if len(part) > 1:
                    yield from _links(np.sort(fps[part]), (*fixed, p), bits, long_list)
        return
    for flip in _flips(rest, bits):
        other = fps ^ flip
        at = np.minimum(np.searchsorted(fps, other), len(fps) - 1)
        hit = (fps[at] == other) & (other < fps)
        if hit.any():
            yield fps[hit], other[hit]


def links(distinct: DataFrame, bits: int = 3, long_list: int = LONG_LIST) -> DataFrame:
    """a, b (signed fingerprints): links that connect just what the pairs at `bits` or fewer differing bits connect. distinct: column fp."""
    if not 0 <= bits <= 3:
        raise ValueError("the index is for 0 to 3 bits")
    byte = [F.shiftrightunsigned("fp", 8 * p).bitwiseAND(F.lit(255)) for p in range(8)]
    keys = [sum((F.shiftleft(byte[p], 8 * i) for i, p in enumerate(q)), F.lit(k << 32)) for k, q in enumerate(QUADS)]
    posted = distinct.select("fp", F.explode(F.array(*keys)).alias("key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(parts, key):
            fps = np.unique(np.concatenate(parts))
            for a, b in _links(fps, QUADS[key >> 32], bits, long_list):
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        held, now = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, fps = np.asarray(batch.column(0)), np.asarray(batch.column(1)).view(np.uint64)
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)]])
            size = np.diff(cuts)
            # lists of one need no search; the first and last of a batch may go on elsewhere
            for r in np.unique(np.concatenate([[0], np.flatnonzero(size > 1), [len(size) - 1]])):
                key, part = int(keys[cuts[r]]), fps[cuts[r] : cuts[r + 1]]
                if key != now:
                    if held and sum(map(len, held)) > 1:
                        yield from flush(held, now)
                    held, now = [], key
                held.append(part)
        if held and sum(map(len, held)) > 1:
            yield from flush(held, now)

    return posted.select("key", "fp").repartition(n_partitions(distinct.sparkSession), "key").sortWithinPartitions("key").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, bits: int = 3, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row."""
    rows = cut(fingerprints(docs, id_col, text_col, width))
    first = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    found = connected_components(links(first.select("fp"), bits).distinct())
    named = first.join(found, first.fp == found.node, "left").select("fp", "first", F.coalesce("label", "fp").alias("label"))
    smallest = named.groupBy("label").agg(F.min("first").alias("component_id"))
    component = named.join(smallest, "label").select("fp", "component_id")
    return rows.join(component, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def query(spark, sf_dir: str) -> DataFrame:
    """op4: fingerprints and components of all documents."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
