"""Operators as filters and rewriters of a documents table: each takes and returns its columns, whatever extra ones there are
and whatever type doc_id has. An empty table gives an empty result; each function states what becomes of nulls, blanks and
repeated rows. All read whole texts; none needs rows in an order."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm import line_dedup, mixing, segmentation, similarity, toxicity
from quantloom.llm.common import lean, packed, stored, text_key, unpacked

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """docs without the documents that the toxicity score rejects; a null or blank text has the score of a text without features."""
    return toxicity.score_documents(docs, labels, threshold).where("predicted = 0").select("row.*")


def without_repeated_lines(docs: DataFrame, min_docs: int = 10) -> DataFrame:
    """docs without lines that stand in min_docs documents or more; n_chars follows the text. A null text stays null, a text may become empty."""
    done = line_dedup.rebuild(docs, min_docs)
    return done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*(f"`{c}`" for c in docs.columns)) if "n_chars" in docs.columns else done


def _distinct_rows(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """rows (row, id, tk) with one for each (id, tk): of several the one whose columns have the smallest hash. keys: id, tk of all rows; texts are only shuffled if some row repeats."""
    if keys.groupBy("id", "tk").count().where("count > 1").isEmpty():
        return rows
    return rows.groupBy("id", "tk").agg(F.min_by("row", F.xxhash64("row")).alias("row"))


def without_near_duplicates(docs: DataFrame, percent: int = similarity.PERCENT, width: int = similarity.WIDTH) -> DataFrame:
    """One document of each component of near copies: the one with the smallest id, of several rows with that id the one with
    the smallest text hash. Null ids come last; null and blank texts are copies of each other; of rows that repeat id and
    text one stays.

    Near copies are texts whose sets of `width` words have a Jaccard similarity of `percent` or more. SimHash fingerprints
    of these shingles propose links by the byte-position index; the pairs beyond its three bits come from exact prefix
    filtering; every link is verified on the whole sets (see similarity)."""
    rows = stored(similarity.keyed(docs, percent, width), "keyed")
    found = similarity.components(docs, rows, percent, width)
    labelled = rows.select("id", "tk", "fp").join(found, F.col("fp") == F.col("node"), "left").withColumn("label", F.coalesce("label", "fp"))
    first = labelled.groupBy("label").agg(F.min(F.struct(F.col("id").isNull().alias("n"), "id", "tk")).alias("r")).select("r.id", "r.tk").distinct()
    first = stored(first, "first").select(F.col("id").alias("id1"), F.col("tk").alias("tk1"))
    every = _distinct_rows(packed(docs, id=F.col("doc_id"), tk=text_key()), rows)
    kept = every.join(first, F.col("id").eqNullSafe(F.col("id1")) & (F.col("tk") == F.col("tk1")), "left_semi")
    return unpacked(kept, docs.columns)


def mixed(docs: DataFrame, **options) -> DataFrame:
    """What the mix takes: for each document and pass the text of its blocks that are taken in that pass; n_chars follows the
    text. Documents without words give nothing; of rows that repeat id and text one is cut up for all."""
    documents, _, pieces = mixing.mix(docs, **options)
    taken = pieces.groupBy("doc_id", "_tk", "start").agg(F.sort_array(F.collect_list(F.struct("first", "n", "times"))).alias("pieces"))
    sizes = documents.where("size > 0").select(F.col("doc_id").alias("i"), F.col("_tk").alias("h"), F.col("start").alias("s"), "size")
    taken = taken.join(sizes, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("_tk") == F.col("h")) & (F.col("start") == F.col("s"))).select("i", "h", "size", "pieces")
    every = _distinct_rows(packed(docs, id=F.col("doc_id"), tk=text_key()), documents.select(F.col("doc_id").alias("id"), F.col("_tk").alias("tk")))
    joined = every.join(taken, F.col("id").eqNullSafe(F.col("i")) & (F.col("tk") == F.col("h"))).select("row", F.col("row").getField("text").alias("text"), "size", "pieces")

    def part(text: str, size: int, pieces: list[dict], times: int) -> str | None:
        runs: list[list[int]] = []
        for p in pieces:
            if p["times"] >= times:
                if runs and runs[-1][1] == p["first"]:
                    runs[-1][1] += p["n"]
                else:
                    runs.append([p["first"], p["first"] + p["n"]])
        if not runs:
            return None
        if runs == [[0, size]]:
            return text
        spans = [m.span() for m in WORD.finditer(text)]
        return "\n".join(text[spans[a][0] : spans[b - 1][1]] for a, b in runs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            which, texts = [], []
            for i, (text, size, pieces) in enumerate(zip(*(b.column(c) for c in (1, 2, 3)), strict=True)):
                text, size, pieces = text.as_py(), size.as_py(), pieces.as_py()
                for times in range(1, max(p["times"] for p in pieces) + 1):
                    said = part(text, size, pieces, times)
                    if said is not None:
                        which.append(i)
                        texts.append(said)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(which, pa.int64())), pa.array(texts, pa.string())], names=["row", "text"])

    made = joined.mapInArrow(lean(run), f"row {joined.schema['row'].dataType.simpleString()}, text string")
    counted = {"n_chars": F.length("text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {}
    return unpacked(made, docs.columns, text=F.col("text"), **counted)


def segmented(docs: DataFrame, **options) -> DataFrame:
    """The sampled segmentations of every row: piece ids and inclusion scores (see segmentation.sample_segmentations)."""
    return segmentation.sample_segmentations(docs, **options)
