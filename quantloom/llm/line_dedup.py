r"""Line dedup: range-partitioned line hashes, streamed in order, give per-document keep bitmaps.

Each line becomes (128-bit hash of its key, document, position). Rows are range-partitioned by hash *and document* and
sorted within partitions by hash, document and position, so a line that a third of all documents share spans many
partitions. A task streams its rows once and holds at most `min_docs` documents of the current key. A key that lies
inside one partition is decided there; of the at most two keys that reach over a partition's edges, the few rows that
are still undecided go to one small aggregation.

Defined results: a null or empty text is one empty line; an empty key is never dropped; rows that repeat an id with
another text count as another document, exact repeats of a row count once and get the same result; a null id is an id of
its own; ids that are no whole numbers are told apart and ordered by their 64-bit hashes; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import SPACE, cut, lean, lower_ascii, n_partitions, packed, text_key, unpacked, utf8

NO_ID = -(2**63)
DROP, OPEN, MARK = 0, 1, 2
_STREAM = "kind int, h1 long, h2 long, _id long, _tk long, pos long"


def id_key(docs: DataFrame, id_col: str):
    """Whole numbers are documents' keys and order; other ids go by their 64-bit hash."""
    whole = dict(docs.dtypes)[id_col] in ("tinyint", "smallint", "int", "bigint")
    return F.coalesce(F.col(id_col).cast("long") if whole else F.when(F.col(id_col).isNotNull(), F.xxhash64(id_col)), F.lit(NO_ID))


def line_keys(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each line with a key: h1, h2 (its key's hashes), _id, _tk (its document), pos."""
    lines = docs.select(
        id_key(docs, id_col).alias("_id"), text_key(text_col).alias("_tk"), F.posexplode(F.split(text_col, "\n", -1)).alias("pos", "line")
    )
    key = lower_ascii(F.trim(F.col("line"), F.lit(SPACE)))
    return lines.select("_id", "_tk", F.col("pos").cast("long").alias("pos"), key.alias("key")).where("key <> ''").select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "_id", "_tk", "pos")


def _decide(min_docs: int, keep_first: bool):
    """Streams a partition's sorted rows; holds the rows of the current key until it is decided."""

    def emit(kind: int | np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
        kinds = np.full(rows.shape[1], kind, dtype=np.int32)
        return pa.RecordBatch.from_arrays([pa.array(kinds), *(pa.array(np.ascontiguousarray(x)) for x in rows)], names=["kind", "h1", "h2", "_id", "_tk", "pos"])

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # undecided rows of the current key
        begun = at_start = hot = False
        n, key, last = 0, None, None

        def feed(part: np.ndarray, docs: int) -> Iterator[pa.RecordBatch]:
            nonlocal n, hot, held
            n += docs
            if hot:
                yield emit(DROP, part)
                return
            held.append(part)
            if n >= min_docs:
                every, held, hot = np.concatenate(held, axis=1), [], True
                yield emit(MARK, every[:, :1])  # whether it is the key's first row anywhere is known at the end
                yield emit(DROP, every[:, 1:])

        def close(at_edge: bool) -> Iterator[pa.RecordBatch]:
            nonlocal n, hot, held
            if at_edge and held:
                yield emit(OPEN, np.concatenate(held, axis=1))
            n, hot, held = 0, False, []

        for batch in batches:
            rows = np.stack([np.asarray(batch.column(i)) for i in range(5)])
            if not rows.shape[1]:
                continue
            fresh = np.ones(rows.shape[1], dtype=bool)
            fresh[1:] = (rows[:2, 1:] != rows[:2, :-1]).any(axis=0)
            fresh[0] = (rows[0, 0], rows[1, 0]) != key
            new_doc = fresh.copy()
            new_doc[1:] |= (rows[2:4, 1:] != rows[2:4, :-1]).any(axis=0)
            new_doc[0] |= (rows[2, 0], rows[3, 0]) != last
            cuts = np.unique(np.concatenate([[0], np.flatnonzero(fresh), [rows.shape[1]]]))
            docs_in, r, end = np.add.reduceat(new_doc, cuts[:-1], dtype=np.int64), 0, len(cuts) - 1
            if not fresh[0]:  # the current key goes on
                yield from feed(rows[:, : cuts[1]], int(docs_in[0]))
                r = 1
            if r < end:
                yield from close(at_start)
                at_start = not begun
                if at_start:  # the partition's first key may have begun in the one before
                    yield from feed(rows[:, cuts[r] : cuts[r + 1]], int(docs_in[r]))
                    r += 1
                    if r < end:
                        yield from close(True)
                        at_start = False
                dropped = np.zeros(end, dtype=bool)
                dropped[r : end - 1] = docs_in[r : end - 1] >= min_docs
                if dropped.any():
                    mask = np.repeat(dropped, np.diff(cuts))
                    if keep_first:
                        mask[cuts[:-1][dropped]] = False
                    yield emit(DROP, rows[:, mask])
                if r < end:
                    yield from feed(rows[:, cuts[-2] :], int(docs_in[-1]))
            begun, key, last = True, (rows[0, -1], rows[1, -1]), (rows[2, -1], rows[3, -1])
        yield from close(True)

    return stream


def dropped_lines(docs: DataFrame, min_docs: int = 10, keep_first: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """_id, _tk, pos of each line whose key stands in min_docs documents or more (all of them, or all but the first occurrence)."""
    spark = docs.sparkSession
    ordered = line_keys(docs, id_col, text_col).repartitionByRange(n_partitions(spark), "h1", "h2", "_id", "_tk").sortWithinPartitions("h1", "h2", "_id", "_tk", "pos")
    streamed = cut(ordered.mapInArrow(lean(_decide(min_docs, keep_first)), _STREAM))
    where = F.struct("_id", "_tk", "pos")
    edge = streamed.where(F.col("kind") > DROP)
    keys = edge.groupBy("h1", "h2").agg(F.count_distinct("_id", "_tk").alias("n"), F.max("kind").alias("k"), F.min(where).alias("first")).where((F.col("n") >= min_docs) | (F.col("k") == MARK))
    edge = edge.join(keys, ["h1", "h2"])
    if keep_first:
        edge = edge.where(where != F.col("first"))
    return streamed.where(F.col("kind") == DROP).select("_id", "_tk", "pos").unionByName(edge.select("_id", "_tk", "pos")).distinct()


def _pack(positions: list[int]) -> bytes:
    """A keep bitmap: whole bytes of a bit for each line up to the last dropped one, 1 to keep, zlib-compressed; later lines are kept."""
    keep = np.ones((max(positions) // 8 + 1) * 8, dtype=bool)
    keep[np.asarray(positions)] = False
    return zlib.compress(np.packbits(keep).tobytes(), 6)


def unpack(bitmap: bytes | None, n_lines: int) -> np.ndarray:
    """Which of n_lines to keep."""
    keep = np.ones(n_lines, dtype=bool)
    if bitmap:
        bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), dtype=np.uint8)).astype(bool)[:n_lines]
        bits = np.concatenate([bits, np.ones(n_lines - len(bits), dtype=bool)])
        return bits
    return keep


def keep_bitmaps(docs: DataFrame, min_docs: int = 10, keep_first: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """_id, _tk, n_dropped, keep_bitmap for each document that loses a line; a document's own lines are the only group that is gathered."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            maps = [_pack(p) for p in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), pa.array(maps, pa.binary())], names=["_id", "_tk", "n_dropped", "keep_bitmap"])

    gathered = dropped_lines(docs, min_docs, keep_first, id_col, text_col).groupBy("_id", "_tk").agg(F.collect_list("pos").alias("p"), F.count("*").alias("n"))
    return gathered.mapInArrow(pack, "_id long, _tk long, n_dropped long, keep_bitmap binary")


def with_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row (a struct of docs' columns), text, keep (null: all lines stay)."""
    keyed = packed(docs, text=F.col(text_col), id=id_key(docs, id_col), tk=text_key(text_col))
    maps = bitmaps.select(F.col("_id").alias("id"), F.col("_tk").alias("tk"), F.col("keep_bitmap").alias("keep"))
    return keyed.join(maps, ["id", "tk"], "left").select("row", "text", "keep")


def _kept(text: str | None, bitmap: bytes | None) -> tuple[int, int, bytes]:
    data = utf8(text)
    if bitmap is None:
        return data.count(b"\n") + 1, 0, data
    lines = data.split(b"\n")
    keep = unpack(bitmap, len(lines))
    return len(lines), int((~keep).sum()), b"\n".join(x for x, k in zip(lines, keep, strict=True) if k)


def rebuild(docs: DataFrame, min_docs: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the dropped lines; all columns stay. A null text stays null."""
    marked = with_bitmaps(docs, keep_bitmaps(docs, min_docs, id_col=id_col, text_col=text_col), id_col, text_col)

    def text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [None if x is None else x if m is None else _kept(x, m)[2].decode("utf-8", "surrogatepass") for x, m in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=["row", "text"])

    made = marked.mapInArrow(lean(text), f"row {marked.schema['row'].dataType.simpleString()}, text string")
    return unpacked(made, docs.columns, **{text_col: F.col("text")})


def query(spark, sf_dir: str) -> DataFrame:
    """op6: doc_id, n_lines, n_dropped, kept_sha256 for all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    marked = with_bitmaps(docs, keep_bitmaps(docs, min_docs=10))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [_kept(x.as_py(), m.as_py()) for x, m in zip(b.column(1), b.column(2), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64()), pa.array([hashlib.sha256(x[2]).hexdigest() for x in found], pa.string())],
                names=["doc_id", "n_lines", "n_dropped", "kept_sha256"],
            )

    return marked.select("row.doc_id", "text", "keep").mapInArrow(digest, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


SQL = r"""
WITH lines AS (
  SELECT doc_id, i, string_split(coalesce(text, ''), chr(10))[i] AS line
  FROM (SELECT doc_id, text, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS i FROM documents)
), keyed AS (
  SELECT doc_id, i, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines
), often AS (SELECT k FROM keyed WHERE k <> '' GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(often.k) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE often.k IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN often ON keyed.k = often.k GROUP BY doc_id
"""
