r"""Toxicity by noisy-channel deobfuscation: Viterbi decoding of character lattices, then a score of the restored text.

1. A character trigram model is counted over all documents, over the letters that they really have (every other character
   is one class). Its table grows with the corpus and is never collected or broadcast.
2. A token that may be disguised becomes a lattice: look-alike digits and signs may stand for letters (LEET), runs of one
   character for one or two of it, and single characters spelled out with separators may be one word. The distinct tokens
   of all documents are dealt into shards; each shard is joined with the counts that its lattices can ask for, and the
   Viterbi path maximises channel plus trigram log-probability. Tokens that it changes go back to their documents, by
   broadcast up to a checked size and by a join beyond it.
3. A score is learned from at most `max_labelled` labelled rows: whole words and word starts of four to seven letters
   that significantly more toxic than clean documents have become features with their rates in either. The rows are those
   with the smallest hashes of their ids, so the sample is the same in every run; no other limit leaves a feature out.
4. Every document is scored: one Aho-Corasick pass counts the features in its restored text; the score is the posterior
   that some feature's count comes from toxic rather than clean texts.

Not in the lattice: tokens of digits alone (a number may spell anything) and letters that are merely doubled.

Labels are read only from rows whose crc32(doc_id as text) mod 3 is not 1. Labels, lang, source and doc_id are never
inputs of a score. Defined results: a null or empty text has the score of a text without features; several labels of one
id count as their largest; repeated rows get the same score; without labels every score is the prior's; an empty table
gives an empty result; extra columns stay as they are, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Mapping

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import cut, few_rows, lean, n_partitions, stored, text_key

#: What a sign may stand for besides itself.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c"}
SIGNS = "".join(LEET)
#: What a sign that stands for itself in a suspect token costs, in nats.
SIGN_COST = 9.0
_CLASS = r"[^\W\d_]"
_S = re.escape(SIGNS)
#: Signs next to a letter; then the tokens that may be disguised: a sign between letters, before a letter at a token's start,
#: digits or look-alikes of closing letters after its last letter; signs alone, with an at sign.
NEAR = re.compile(rf"[{_S}](?:(?<={_CLASS}.)|(?={_CLASS}))|@[{_S}][{_S}]")
SUSPECT = re.compile(rf"(?:[^\s{_S}]*{_CLASS}[{_S}]+{_CLASS}\S*|[{_S}]+{_CLASS}\S*|[^\s{_S}]*{_CLASS}(?:\d+|[{_S}]*[$+@|])(?![^\s.,;:!?])|@[{_S}]{{2,}}(?![^\s.,;:!?]))")
#: A letter three times; three or more single characters in a row with a separator between.
REPEAT = re.compile(rf"({_CLASS})\1\1")
SPELLED = re.compile(rf"(?<![^\W_])(?:(?:{_CLASS}|[{_S}])[ .\-_*]){{2,}}(?:{_CLASS}|[{_S}])(?![^\W_])")
LETTER = re.compile(_CLASS)
ANY = re.compile(r"\S+")
TAIL = re.compile(r"[.,;:?!\"')\]}#*%&]+$")
HEAD = re.compile(r"^[\"'(\[{#*%&]+(?=\w)")
#: Marks a token that is spelled out.
SPACED = "\x01"
_BITS = 21


def is_held_out(id_col: str):
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


# the character model ---------------------------------------------------------------------------------------------------


def letter_codes() -> np.ndarray:
    """The code of each character: its code point for letters, 0 for all others."""
    out = np.zeros(0x110000, dtype=np.int32)
    for i in range(0x110000):
        if chr(i).isalpha():
            out[i] = i
    return out


def gram(a: int, b: int, c: int) -> int:
    """The key of three codes in a row. Those of two and one are its last 42 and 21 bits; 0 is the key of all."""
    return (a + 1) << 2 * _BITS | (b + 1) << _BITS | (c + 1)


def count_grams(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """gram, n: how often each run of one to three characters stands in all texts, whole and in lower case."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, place, alphabet, room = letter_codes(), np.zeros(0x110000, dtype=np.int32), np.zeros(1, dtype=np.int64), 128
        total = np.zeros(room**3, dtype=np.int64)

        def keys(at: np.ndarray) -> np.ndarray:
            x, y, z = alphabet[at // room**2], alphabet[at // room % room], alphabet[at % room]
            return (x + 1) << 2 * _BITS | (y + 1) << _BITS | (z + 1)

        for b in batches:
            for x in b.column(0):
                if not (text := x.as_py()):
                    continue
                c = codes[np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
                small = place[c]
                if (new := (small == 0) & (c != 0)).any():
                    fresh = np.unique(c[new])
                    if len(alphabet) + len(fresh) <= room:
                        place[fresh] = len(alphabet) + np.arange(len(fresh))
                        alphabet = np.concatenate([alphabet, fresh])
                        small = place[c]
                    else:  # more letters than the table of this task has room for: this text's own counts
                        c = c.astype(np.int64)
                        own, n = np.unique((c[:-2] + 1) << 2 * _BITS | (c[1:-1] + 1) << _BITS | (c[2:] + 1), return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(n)], names=["gram", "n"])
                        continue
                at = (small[:-2] * room + small[1:-1]) * room + small[2:]
                if len(at) < 20_000:
                    np.add.at(total, at, 1)
                else:
                    total += np.bincount(at, minlength=room**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(keys(at)), pa.array(total[at])], names=["gram", "n"])

    three = docs.select(text_col).mapInArrow(lean(run), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    every = F.array("gram", *(F.col("gram").bitwiseAND(F.lit((1 << k * _BITS) - 1)) for k in (2, 1)), F.lit(0).cast("long"))
    return three.select(F.explode(every).alias("gram"), "n").groupBy("gram").agg(F.sum("n").alias("n"))


class Decoder:
    """Viterbi decoding under a smoothed trigram model. counts: by key, of all runs that the tokens can ask for."""

    def __init__(self, counts: Mapping[int, int]) -> None:
        self.counts, self.known = counts, {}

    def logp(self, a: int, b: int, c: int) -> float:
        key = gram(a, b, c)
        if key not in self.known:
            n = lambda x: self.counts.get(x, 0)
            p1 = (n(c + 1) + 1) / (n(0) + 256)
            p2 = (n(key & (1 << 2 * _BITS) - 1) + 20 * p1) / (n(b + 1) + 20)
            self.known[key] = math.log((n(key) + 20 * p2) / (n((a + 1) << _BITS | (b + 1)) + 20))
        return self.known[key]

    def options(self, token: str, spelled: bool) -> list[list[tuple[str, float]]]:
        """The lattice: for each run of one character the strings that it may stand for and their channel log-probabilities."""
        out = []
        for m in re.finditer(r"(.)\1*", token, re.S):
            ch, n = m[1], len(m[0])
            if spelled and ch in " .-_*":
                out.append([("", math.log(0.9)), (" ", math.log(0.1))] if n == 1 else [(" ", 0.0)])
                continue
            reads = [(ch, math.log(0.5))] + [(x, math.log(0.5 / len(LEET[ch]))) for x in LEET[ch]] if ch in LEET else [(ch, 0.0)]
            if n == 1:
                out.append(reads)
            else:
                out.append([(x * k, p - (0.7 if n > 2 else 3.0 * (k != n))) for x, p in reads for k in (1, 2)])
        return out

    def decode(self, token: str) -> str:
        spelled = token.startswith(SPACED)
        beam: dict[tuple[int, int], tuple] = {(0, 0): (0.0, None)}
        for choices in self.options(token.lstrip(SPACED), spelled):
            ahead: dict = {}
            for (a, b), (score, back) in beam.items():
                for text, p in choices:
                    x, y, s = a, b, score + p
                    for ch in text:
                        z = ord(ch) if ch.isalpha() else 0
                        s += self.logp(x, y, z) - (0.0 if z or ch == " " else SIGN_COST)
                        x, y = y, z
                    if (x, y) not in ahead or s > ahead[x, y][0]:
                        ahead[x, y] = (s, (back, text))
            beam = ahead
        _, _, back = max(((s + self.logp(a, b, 0), (a, b), back) for (a, b), (s, back) in beam.items()), key=lambda x: x[:2])
        parts = []
        while back is not None:
            back, text = back
            parts.append(text)
        return "".join(reversed(parts))


class Asked(Decoder):
    """Notes the keys of all counts that decoding may ask for; no path is pruned, so they do not hang on the counts."""

    def __init__(self) -> None:
        super().__init__({})
        self.keys: set[int] = {0}

    def logp(self, a: int, b: int, c: int) -> float:
        key = gram(a, b, c)
        if key not in self.keys:
            self.keys |= {key, key & (1 << 2 * _BITS) - 1, c + 1, b + 1, (a + 1) << _BITS | (b + 1)}
        return 0.0


# disguised tokens ------------------------------------------------------------------------------------------------------


def spans(text: str) -> list[tuple[int, int, str]]:
    """Where tokens stand that may be disguised, in order and apart; text: in lower case."""
    found = [(m.start(), m.end(), SPACED + m[0]) for m in SPELLED.finditer(text) if LETTER.search(m[0])]
    spelled = found.copy()
    for core, whole in ((NEAR, SUSPECT), (REPEAT, ANY)):
        last = 0
        for m in core.finditer(text):
            if m.start() < last:
                continue
            start = m.start()
            while start > last and not text[start - 1].isspace():
                start -= 1
            suspect = whole.match(text, start)
            last = (suspect or ANY.match(text, start)).end()
            if not suspect:
                continue
            tail = TAIL.search(suspect[0])
            end = start + (tail.start() if tail else len(suspect[0]))
            head = HEAD.match(suspect[0])
            start += head.end() if head else 0
            if end > start and not any(a < end and start < b for a, b, _ in spelled):
                found.append((start, end, text[start:end]))
    out, last = [], 0
    for a, b, token in sorted(found):
        if a >= last:
            out.append((a, b, token))
            last = b
    return out


def restore(text: str | None, said: Mapping[str, str]) -> str:
    """The text in lower case with the tokens of said decoded."""
    text = (text or "").lower()
    if not said:
        return text
    parts, last = [], 0
    for a, b, token in spans(text):
        parts += [text[last:a], said.get(token, text[a:b])]
        last = b
    return "".join([*parts, text[last:]])


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """dk, token: each document's distinct tokens."""
    for b in batches:
        keys, tokens = [], []
        for dk, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            own = {t for _, _, t in spans((text.as_py() or "").lower())}
            keys += [dk] * len(own)
            tokens += own
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(tokens, pa.string())], names=["dk", "token"])


def _asks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """shard, gram: what a batch of a shard's tokens may ask for."""
    for b in batches:
        asked: dict[int, Asked] = {}
        for shard, token in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            asked.setdefault(shard, Asked()).decode(token)
        for shard, a in asked.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a.keys), shard, np.int32)), pa.array(sorted(a.keys), pa.int64())], names=["shard", "gram"])


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """token, said of each token that decoding changes. Shards arrive one after the other, their counts before their tokens."""
    now, counts, decoder = None, {}, Decoder({})
    for b in batches:
        tokens, said = [], []
        for shard, key, n, token in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if shard != now:
                now, counts = shard, {}
                decoder = Decoder(counts)
            if token is None:
                counts[key] = n
            elif (read := decoder.decode(token)) != token.lstrip(SPACED):
                tokens.append(token)
                said.append(read)
        yield pa.RecordBatch.from_arrays([pa.array(tokens, pa.string()), pa.array(said, pa.string())], names=["token", "said"])


def decoded_tokens(tokens: DataFrame, grams: DataFrame) -> DataFrame:
    """token, said: the distinct tokens that the Viterbi path changes. tokens: column token; grams: of count_grams."""
    n = n_partitions(tokens.sparkSession)
    dealt = tokens.select("token").distinct().select(F.pmod(F.xxhash64("token"), F.lit(4 * n)).cast("int").alias("shard"), "token")
    asked = dealt.mapInArrow(_asks, "shard int, gram long").distinct().join(grams, "gram")
    none = lambda kind: F.lit(None).cast(kind)
    rows = asked.select("shard", "gram", "n", none("string").alias("token")).unionByName(dealt.select("shard", none("long").alias("gram"), none("long").alias("n"), "token"))
    return rows.repartition(n, "shard").sortWithinPartitions("shard", F.col("token").isNotNull()).mapInArrow(lean(_decoded), "token string, said string")


def decoded_documents(pairs: DataFrame, said: DataFrame) -> DataFrame:
    """dk, changes (array of token, said) of the documents with tokens that decoding changes. pairs: dk, token; said: of decoded_tokens.

    A token that more than a thousandth of all (document, token) pairs share is joined by broadcast: there are at most a
    thousand of these. All others are joined by shuffle, so no key holds more than a thousandth of the rows.
    """
    often = max(1_000, pairs.count() // 1_000)
    hot = cut(pairs.groupBy("token").agg(F.count("*").alias("c")).where(F.col("c") > often).join(said, "token", "left").select("token", "said"))  # at most a thousand rows
    by_hot = pairs.join(F.broadcast(hot), "token").where("said is not null")
    others = pairs.join(F.broadcast(hot.select("token")), "token", "left_anti").join(said, "token")
    return by_hot.unionByName(others).groupBy("dk").agg(F.collect_set(F.struct("token", "said")).alias("changes"))


# the score -------------------------------------------------------------------------------------------------------------

WORD = re.compile(rf"{_CLASS}+")


def features_of(text: str) -> dict[str, int]:
    """How often a text has each feature: "word " for whole words, their first four to seven letters for longer ones."""
    out: dict[str, int] = {}
    for w in WORD.findall(text):
        for f in (w + " ", *(w[:n] for n in range(4, min(7, len(w) - 1) + 1))):
            out[f] = out.get(f, 0) + 1
    return out


def _changes(value: pa.Scalar) -> dict[str, str]:
    return {x["token"]: x["said"] for x in value.as_py() or ()}


def learn(rows: DataFrame, table=None, ratio: float = 6.0, error: float = 0.05) -> tuple[float, dict[str, tuple[float, float, float]]]:
    """(prior log-odds, feature -> (share, rate in toxic texts with it, rate in clean texts)). rows: text, changes, toxic of the
    labelled rows to learn from; table: a broadcast of all decoded tokens, in place of changes. Every feature whose likelihood ratio is significant among all of them (Bonferroni, at
    `error`) and whose rate is `ratio` times as high in toxic texts is kept; of related starts the most telling one."""
    names = ["clean", "toxic", "n_clean", "n_toxic", "words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = {"": [0] * 5}
        for b in batches:
            for text, changes, toxic in zip(b.column(0), b.column(1), b.column(2).to_pylist(), strict=True):
                said, at = restore(text.as_py(), table.value if table else _changes(changes)), int(toxic > 0)
                n = len(said.split())
                found[""][at] += 1
                found[""][2 + at] += n
                for f, k in features_of(said).items():
                    if f not in found:
                        found[f] = [0] * 5
                    x = found[f]
                    x[at] += 1
                    x[2 + at] += k
                    x[4] += n * at
        every = list(found.items())
        for lo in range(0, len(every), 100_000):
            part = every[lo : lo + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in part]), *(pa.array([v[i] for _, v in part], pa.int64()) for i in range(5))], names=["f", *names])

    made = rows.select("text", "changes", "toxic").mapInArrow(run, "f string, " + ", ".join(f"{x} long" for x in names))
    sums = cut(made.groupBy("f").agg(*(F.sum(x).alias(x) for x in names)))
    whole = sums.where("f = ''").collect()
    n0, n1, w0, w1 = (whole[0].clean, whole[0].toxic, whole[0].n_clean, whole[0].n_toxic) if whole else (0, 0, 0, 0)
    prior = math.log((n1 + 0.5) / (n0 + 0.5)) if n0 + n1 else -2.0
    if not n1 or not n0:
        return min(prior, 0.0), {}
    tested = sums.where("f <> ''")
    least = 2 * math.log(max(1, tested.count()) / error)  # of the likelihood ratio, for so many tests
    share, worth = (F.col("toxic") + F.col("clean")) / float(n0 + n1), F.lit(0.0)
    for seen, n in (("toxic", n1), ("clean", n0)):
        for k, p in ((F.col(seen), share), (n - F.col(seen), 1 - share)):
            worth = worth + F.when(k > 0, 2 * k * F.log(k / (n * p))).otherwise(0.0)
    more = (F.col("toxic") * n0 > 2 * F.col("clean") * n1) & (F.col("n_toxic") * w0 > ratio * F.col("n_clean") * w1)
    kept = tested.where(more).withColumn("worth", worth).where(F.col("worth") > least).collect()  # features of a bounded sample
    out: dict[str, tuple[float, float, float]] = {}
    for r in sorted(kept, key=lambda r: (-r.worth, r.f[-1] == " ", -len(r.f), r.f)):
        if not any(r.f.startswith(f) or f.startswith(r.f) for f in out):
            out[r.f] = (r.toxic / n1, r.n_toxic / r.words, (r.n_clean + 0.5) / w0)
    total = max(1.0, sum(x[0] for x in out.values()))
    return prior, {f: (s / total, a, b) for f, (s, a, b) in out.items()}


class Scorer:
    """Scores restored texts. An automaton counts the features at word starts; a toxic text is one that some feature marks,
    whose count then follows a geometric law around its rate in such texts, against one around its rate in clean texts."""

    def __init__(self, prior: float, features: dict[str, tuple[float, float, float]]) -> None:
        self.prior, self.features, self.automaton = prior, features, ahocorasick.Automaton()
        for f in features:
            self.automaton.add_word(f.rstrip(), f)
        if features:
            self.automaton.make_automaton()

    def score(self, text: str) -> float:
        found: dict[str, int] = {}
        if self.features:
            for end, f in self.automaton.iter(text):
                start = end - len(f.rstrip()) + 1
                if start and text[start - 1].isalpha() or f[-1] == " " and end + 1 < len(text) and text[end + 1].isalpha():
                    continue
                found[f] = found.get(f, 0) + 1
        if not found:
            return 1 / (1 + math.exp(2.0 - self.prior))
        n, best = len(text.split()), []
        for f, c in found.items():
            share, high, low = self.features[f]
            m1, m0 = n * high, n * low
            best.append(math.log(share) + c * math.log(m1 * (1 + m0) / (m0 * (1 + m1))) - math.log((1 + m1) / (1 + m0)))
        top = max(best)
        z = self.prior + top + math.log(sum(math.exp(x - top) for x in best))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, max_labelled: int = 8_000, decode: bool = True, broadcast_chars: int = 4_000_000) -> DataFrame:
    """row (a struct of docs' columns), score, predicted. max_labelled bounds the sample of labelled rows that is learned
    from; decode=False scores the texts as they are, for comparison. Decoded tokens of at most broadcast_chars characters
    (checked) are broadcast, more are joined to their documents; the result is the same."""
    spark = docs.sparkSession
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), "text", F.xxhash64("doc_id", text_key()).alias("dk"))
    changes, table = few_rows(spark, [], "dk long, changes array<struct<token:string,said:string>>"), None
    if decode:
        pairs = stored(rows.select("dk", "text").mapInArrow(lean(_tokens), "dk long, token string"), "tokens")
        said = stored(decoded_tokens(pairs, count_grams(docs)), "said")
        if (said.agg(F.sum(F.length("token") + F.length("said"))).first()[0] or 0) <= broadcast_chars:
            table = spark.sparkContext.broadcast({r.token: r.said for r in said.collect()})  # its size was checked
        else:
            changes = stored(decoded_documents(pairs, said), "changes")
    with_changes = lambda df: df.withColumn("changes", F.lit(None).cast(changes.schema["changes"].dataType)) if table or not decode else df.join(changes, "dk", "left")
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~is_held_out("doc_id")).groupBy(F.col("doc_id").alias("id")).agg(F.max("toxic").alias("toxic"))
    sample = known.orderBy(F.xxhash64("id"), "id").limit(max_labelled)  # at most max_labelled rows: small enough to broadcast
    labelled = rows.select("id", "text", "dk").join(F.broadcast(sample), "id").select("dk", "text", "toxic")
    shared = spark.sparkContext.broadcast(learn(with_changes(labelled), table))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*shared.value)
        for b in batches:
            scores = [scorer.score(restore(x.as_py(), table.value if table else _changes(c))) for x, c in zip(b.column(1), b.column(2), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())], names=["row", "score", "predicted"])

    joined = with_changes(rows).select("row", "text", "changes")
    return joined.mapInArrow(lean(run), f"row {joined.schema['row'].dataType.simpleString()}, score double, predicted int")


def query(spark, sf_dir: str) -> DataFrame:
    """op10: doc_id, held_out, score, predicted for all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    scored = score_documents(docs, labels).select("row.doc_id", "score", "predicted")
    return scored.select("doc_id", is_held_out("doc_id").alias("held_out"), "score", "predicted")
