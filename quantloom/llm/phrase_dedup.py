r"""Substring dedup with sharded phrase automata.

A passage of `window` words recurs if its word sequence starts at two places of the corpus.

1. Anchors. Every window is represented by the one of its `gram`-word grams with the smallest hash (the first of equals).
   Equal windows have equal anchors, and neighbours mostly share one: the windows of a document at one anchor are a segment
   of at most 2 * window - gram words, about one for 2 / (window - gram + 2) words. Segments are the only rows that all
   documents give; those whose anchor stands in one place alone are done with.
2. Confirmation. Segments are counted by 128 bits of their words. All windows of a segment that occurs twice or more recur.
   Windows of the others recur only if they stand in another segment at the same anchor; those of all such segments are
   counted by 128 bits of their words. Each segment or window that recurs is known by one place, in the document with the
   smallest key, and by the shards of documents that hold it (a number a shard, however many copies there are).
3. Passages. Known places that follow each other in a document, for one shard, are one passage: each shard gets the
   passages that its documents hold, every text once, whatever the number of its copies.
4. Automata. A shard compiles its passages into an Aho-Corasick automaton (pyahocorasick; a word is one symbol of two letters) and streams
   all its documents, whole, through it. Patterns are each passage's blocks of (window + 1) / 2 words: every window of a
   passage holds one. A hit is extended to both sides on the words themselves, and `window` words or more are an occurrence.
   A block that stands in more than MANY places of passages gives way to the whole windows around it.

Only the automaton says where a document loses words: what is counted before names passages by one place each. An
occurrence in a document is always found, since its windows route a passage that holds them to the document's shard.

Bounds: a shard is about `shard_words` words of documents; an automaton takes at most AUTOMATON_WORDS words of passages and a
shard with more makes several, through which its documents are streamed one after the other.

Defined results: a null text has no words; texts shorter than a window lose nothing; a row that repeats id and text is
another place, so both lose all their windows; null ids are kept; an empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import lean, n_partitions, stored, text_key, words_of

WINDOW, GRAM = 35, 8
MANY, AUTOMATON_WORDS = 16, 1_000_000
_BASE = 0x9E3779B97F4A7C15
_SYMBOLS = np.uint64(1_000_000)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    """128 bits a word, as two columns."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), dtype=np.uint64).reshape(-1, 2)


def gram_hashes(words: np.ndarray, gram: int) -> np.ndarray:
    """A hash of each run of `gram` words, built by doubling."""
    out, have, done = None, words, 1
    with np.errstate(over="ignore"):
        offset, left = 0, gram
        while left:
            if left & 1:
                n = len(words) - gram + 1
                part = have[offset : offset + n]
                out = part.copy() if out is None else out * np.uint64(pow(_BASE, done, 2**64)) + part
                offset += done
            left >>= 1
            if left:
                have, done = have[:-done] * np.uint64(pow(_BASE, done, 2**64)) + have[done:], done * 2
        return _mix(out)


def anchors(hashes: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """For each window of a text the place of its anchor gram; and the hashes of all grams. hashes: one number a word."""
    if len(hashes) < window:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    g = gram_hashes(hashes, gram)
    at, width, done = np.arange(len(g)), window - gram + 1, 1
    while done < width:
        step = min(done, width - done)
        a, b = at[:-step], at[step:]
        at = np.where(g[a] <= g[b], a, b)
        done += step
    return at, g


def _documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    keyed = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), text_key(text_col).alias("tk"))
    return keyed.select("doc_id", "text", F.xxhash64("doc_id", "tk").alias("dk"))


def _segments(window: int, gram: int):
    """h, s, dk, pos, n: the segments of every document: 64 bits of the anchor's words and 64 of all words, the first window and how many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[] for _ in range(5)]
            for dk, text in zip(np.asarray(b.column(0)), b.column(1), strict=True):
                words = words_of(text.as_py())
                if len(words) < window:
                    continue
                hashes = word_hashes(words)
                at, g = anchors(np.ascontiguousarray(hashes[:, 0]), window, gram)
                w = gram_hashes(np.ascontiguousarray(hashes[:, 1]), window)
                first = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1])
                n = np.diff(np.concatenate([first, [len(at)]]))
                with np.errstate(over="ignore"):  # the first and the last window hold all words between them
                    s = _mix(w[first] * np.uint64(_BASE) + _mix(w[first + n - 1]) + n.astype(np.uint64))
                for c, v in zip(cols, (g[at[first]].view(np.int64), s.view(np.int64), np.full(len(first), dk), first.astype(np.int32), n.astype(np.int32)), strict=True):
                    c.append(v)
            if cols[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], names=["h", "s", "dk", "pos", "n"])

    return run


def _windows(window: int):
    """w1, w2, dk, pos, count, shard: the windows of segments; a shard only for segments that occur once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 1_000):
                cols: list[list] = [[] for _ in range(6)]
                part = b.slice(lo, 1_000)
                for dk, text, known in zip(np.asarray(part.column(0)), part.column(1), part.column(2), strict=True):
                    hashes = word_hashes(words_of(text.as_py()))
                    first, n, count, shard = (np.asarray(known.values.field(i)) for i in range(4))
                    each = np.repeat(np.arange(len(first)), n)
                    pos = first[each] + np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
                    w = [gram_hashes(np.ascontiguousarray(hashes[:, i]), window)[pos].view(np.int64) for i in (0, 1)]
                    for c, v in zip(cols, (*w, np.full(len(pos), dk), pos.astype(np.int32), count[each], shard[each]), strict=True):
                        c.append(v)
                if cols[0]:
                    arrays = [pa.array(np.concatenate(c)) for c in cols]
                    arrays[5] = pc.if_else(pc.greater_equal(arrays[5], 0), arrays[5], pa.scalar(None, pa.int32()))
                    yield pa.RecordBatch.from_arrays(arrays, names=["w1", "w2", "dk", "pos", "count", "shard"])

    return run


def _passages(window: int):
    """shard, text: the runs of representative places, as passages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shards, texts, size = [], [], 0
            for shard, places, text in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                words = words_of(text.as_py())
                first, n = (np.asarray(places.values.field(i)) for i in (0, 1))
                order = np.argsort(first)
                first, last = first[order], np.maximum.accumulate((first + n)[order])  # of windows
                cuts = np.concatenate([[0], np.flatnonzero(first[1:] > last[:-1]) + 1, [len(first)]])
                for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                    said = b" ".join(words[first[a] : last[z - 1] - 1 + window])
                    shards.append(shard)
                    texts.append(said)
                    size += len(said)
                if size > 4_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(shards, pa.int32()), pa.array(texts, pa.binary()).cast(pa.string())], names=["shard", "text"])
                    shards, texts, size = [], [], 0
            if shards:
                yield pa.RecordBatch.from_arrays([pa.array(shards, pa.int32()), pa.array(texts, pa.binary()).cast(pa.string())], names=["shard", "text"])

    return run


def symbols(words: list[bytes]) -> str:
    """A character for each word. Words that share one are told apart when a hit is extended."""
    codes = word_hashes(words)[:, 0] % _SYMBOLS + np.uint64(32)
    codes += np.uint64(0x800) * (codes >= np.uint64(0xD800))  # without surrogates
    return codes.astype("<u4").tobytes().decode("utf-32-le")


def letters(said: str) -> str:
    """Two letters for each symbol, of 64 and of 2^14 kinds and none in both: a node's children are searched one after the
    other, and with a letter a symbol the root would have a child for nearly every block."""
    codes = np.frombuffer(said.encode("utf-32-le"), dtype="<u4")
    out = np.empty(2 * len(codes), dtype="<u2")
    out[::2], out[1::2] = 0x20 + (codes & 63), 0x1000 + (codes >> 6)
    return out.tobytes().decode("utf-16-le")


class PassageAutomaton:
    """An Aho-Corasick automaton over blocks of passages, and where in which passage they stand."""

    def __init__(self, passages: list[list[bytes]], window: int = WINDOW) -> None:
        self.passages, self.window, block = passages, window, (window + 1) // 2
        self.automaton, found = ahocorasick.Automaton(), {}
        self.said = said = [symbols(p) for p in passages]
        spelled = [letters(s) for s in said]
        for i, s in enumerate(spelled):
            for at in range(0, len(said[i]) - block + 1, block):
                found.setdefault(s[2 * at : 2 * (at + block)], []).append((i, at))
        whole: dict[str, list] = {}
        for key, places in found.items():
            if len(places) <= MANY:
                self.automaton.add_word(key, (block, places))
                continue
            for i, at in places:
                for first in range(max(0, at + block - window), min(at, len(said[i]) - window) + 1):
                    whole.setdefault(spelled[i][2 * first : 2 * (first + window)], []).append((i, first))
        for key, places in whole.items():
            self.automaton.add_word(key, (window, sorted(set(places))))
        if len(self.automaton):
            self.automaton.make_automaton()

    def cover(self, words: list[bytes], covered: np.ndarray) -> None:
        """Marks the words of all occurrences in covered."""
        if not len(self.automaton) or len(words) < self.window:
            return
        reach: dict[int, int] = {}
        text = symbols(words)
        for end, (size, places) in self.automaton.iter(letters(text)):
            x = end // 2 - size + 1
            for i, at in places:
                line = (i << 32) + x - at
                if reach.get(line, -1) >= x + size:
                    continue
                back, on = behind(text, x, self.said[i], at), ahead(text, x, self.said[i], at)
                reach[line] = x + on
                if back + on >= self.window and not covered[x - back : x + on].all():
                    self._mark(words, x - back, self.passages[i], at - back, back + on, covered)

    def _mark(self, words: list[bytes], x: int, passage: list[bytes], at: int, n: int, covered: np.ndarray) -> None:
        """Marks words that agree, in `window` words or more, among n that agree by their symbols."""
        if words[x : x + n] == passage[at : at + n]:
            covered[x : x + n] = True
            return
        same = [a == b for a, b in zip(words[x : x + n], passage[at : at + n], strict=True)]
        first = 0
        for k in range(n + 1):
            if k == n or not same[k]:
                if k - first >= self.window:
                    covered[x + first : x + k] = True
                first = k + 1


def ahead(a: str, i: int, b: str, j: int) -> int:
    """How many characters agree from a[i] and b[j] on."""
    n, k, step = min(len(a) - i, len(b) - j), 0, 32
    while k < n and a[i + k : i + min(n, k + step)] == b[j + k : j + min(n, k + step)]:
        k, step = min(n, k + step), step * 2
    step = min(step, n - k)
    while step > 1:  # the next `step` characters hold a difference
        half = step // 2
        if a[i + k : i + k + half] == b[j + k : j + k + half]:
            k, step = k + half, step - half
        else:
            step = half
    return k


def behind(a: str, i: int, b: str, j: int) -> int:
    """How many characters agree before a[i] and b[j]."""
    n, k, step = min(i, j), 0, 32
    while k < n and a[i - min(n, k + step) : i - k] == b[j - min(n, k + step) : j - k]:
        k, step = min(n, k + step), step * 2
    step = min(step, n - k)
    while step > 1:
        half = step // 2
        if a[i - k - half : i - k] == b[j - k - half : j - k]:
            k, step = k + half, step - half
        else:
            step = half
    return k


def _groups(passages: list[list[bytes]], limit: int) -> list[list[list[bytes]]]:
    """Passages in groups of at most `limit` words (or one passage)."""
    out, size = [[]], 0
    for p in passages:
        if out[-1] and size + len(p) > limit:
            out.append([])
            size = 0
        out[-1].append(p)
        size += len(p)
    return out


def _stream(window: int, limit: int = AUTOMATON_WORDS):
    """Shards arrive one after the other, their passages (kind 0) before their documents (kind 1): doc_id, n_words, n_removed, kept of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind_of_id = None

        def emit(done: list[tuple]) -> pa.RecordBatch:
            ids, sizes, removed, kept = (list(c) for c in zip(*done, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(ids, kind_of_id), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary())], names=["doc_id", "n_words", "n_removed", "kept"])

        def row(doc_id, words: list[bytes], covered: np.ndarray) -> tuple:
            n = int(covered.sum())
            return doc_id, len(words), n, b" ".join(compress(words, (~covered).tolist()) if n else words)

        def flush() -> Iterator[pa.RecordBatch]:
            """The documents of a shard with several automata: each is compiled once, one at a time."""
            covers = [np.zeros(len(text.split()), dtype=bool) for _, text in spooled]
            for group in groups:
                automaton = PassageAutomaton(group, window)
                for (_, text), covered in zip(spooled, covers, strict=True):
                    automaton.cover(text.split(), covered)
            for lo in range(0, len(spooled), 500):
                yield emit([row(i, text.split(), c) for (i, text), c in zip(spooled[lo : lo + 500], covers[lo : lo + 500], strict=True)])

        now, passages, groups, automaton, spooled = None, [], None, None, []
        for b in batches:
            kind_of_id, done, size = b.column(2).type, [], 0
            for shard, kind, doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3), strict=True):
                if shard != now:
                    if spooled:
                        yield from flush()
                    now, passages, groups, automaton, spooled = shard, [], None, None, []
                words = words_of(text.as_py())
                if kind == 0:
                    passages.append(words)
                    continue
                if groups is None:
                    groups, passages = _groups(passages, limit), []
                    automaton = PassageAutomaton(groups[0], window) if len(groups) == 1 else None
                if automaton is None:
                    spooled.append((doc_id, b" ".join(words)))
                    continue
                covered = np.zeros(len(words), dtype=bool)
                automaton.cover(words, covered)
                done.append(row(doc_id, words, covered))
                size += len(done[-1][3])
                if size > 4_000_000:
                    yield emit(done)
                    done, size = [], 0
            if done:
                yield emit(done)
        if spooled:
            yield from flush()

    return run


def shard_passages(keyed: DataFrame, window: int = WINDOW, gram: int = GRAM, shard_words: int = 4_000_000) -> tuple[DataFrame, int]:
    """(shard, text: the recurring passages that each shard's documents hold; the number of shards). keyed: dk, text."""
    texts, n = keyed.select("dk", "text"), n_partitions(keyed.sparkSession)
    found = stored(texts.mapInArrow(_segments(window, gram), "h long, s long, dk long, pos int, n int"), "segments")
    total = found.count()
    n_shards = max(2 * n, total * ((window - gram + 2) // 2) // shard_words)
    often = stored(found.groupBy("h").agg(F.count("*").alias("c")).where("c > 1"), "often")
    hot = F.broadcast(often.where(F.col("c") > max(1_000, total // 1_000)).select("h"))  # at most a thousand anchors
    here = found.join(hot, "h").unionByName(found.join(hot, "h", "left_anti").join(often.select("h"), "h"))
    # an expression of h as key, so that this aggregation has an exchange of its own with partial sums
    same = here.withColumn("anchor", F.expr("h + 0L")).groupBy("anchor", "s")
    counted = same.agg(F.count("*").alias("count"), F.min("dk").alias("rep"), F.min_by("pos", "dk").alias("pos"), F.min("n").alias("n"), F.collect_set(_shard("dk", n_shards)).alias("shards"))
    distinct = stored(counted, "distinct")
    single = F.when(F.col("count") == 1, F.col("shards")[0]).otherwise(-1)
    open_ = distinct.join(distinct.where("count = 1").select("anchor").distinct(), "anchor", "left_semi")
    open_ = open_.groupBy("rep").agg(F.collect_list(F.struct("pos", "n", F.col("count").cast("long").alias("count"), single.cast("int").alias("shard"))).alias("known"))
    windows = texts.join(open_, F.col("dk") == F.col("rep")).select("dk", "text", "known").mapInArrow(_windows(window), "w1 long, w2 long, dk long, pos int, count long, shard int")
    confirmed = windows.groupBy("w1", "w2").agg(F.sum("count").alias("count"), F.min("dk").alias("rep"), F.min_by("pos", "dk").alias("pos"), F.collect_set("shard").alias("shards")).where("count > 1")
    parts = confirmed.select("rep", "pos", F.lit(1).alias("n"), "shards").unionByName(distinct.where("count > 1").select("rep", "pos", "n", "shards"))
    placed = stored(parts.select("rep", "pos", "n", F.explode("shards").alias("shard")).groupBy("rep", "shard").agg(F.collect_list(F.struct("pos", "n")).alias("places")), "places")
    holders = texts.join(placed, F.col("dk") == F.col("rep")).select("shard", "places", "text")
    return holders.mapInArrow(_passages(window), "shard int, text string"), n_shards


def _shard(dk: str, n_shards: int):
    return F.pmod(F.xxhash64(dk), F.lit(n_shards)).cast("int")


def remove_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words that stay, joined by one space) for every row."""
    keyed = _documents(docs, id_col, text_col)
    kind = dict(docs.dtypes)[id_col]
    passages, n_shards = shard_passages(keyed, window, **options)
    patterns = passages.select("shard", F.lit(0).alias("kind"), F.lit(None).cast(kind).alias("doc_id"), "text")
    streamed = keyed.select(_shard("dk", n_shards).alias("shard"), F.lit(1).alias("kind"), "doc_id", "text")
    sharded = patterns.unionByName(streamed).repartition(n_partitions(docs.sparkSession), "shard").sortWithinPartitions("shard", "kind")
    return sharded.mapInArrow(lean(_stream(window)), f"doc_id {kind}, n_words long, n_removed long, kept binary")


def query(spark, sf_dir: str) -> DataFrame:
    """op2: what stays of every document without passages of 35 words that recur."""
    done = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


__all__ = ["PassageAutomaton", "anchors", "query", "remove_repeats", "shard_passages"]
