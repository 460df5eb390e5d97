"""Media columns: HTML becomes ordered sequences of text and media references, digest joins resolve the references.

`sequence` parses HTML into an array of structs (pos, kind, text, ref, caption): running text in order, and at its place
each image, audio or video with its reference and its caption (the figure's caption, else the alt text). `store` writes
payloads losslessly as 8-bit grey images (PGM, 64 samples a row) under the digest of the stored bytes' payload; a task
stores a payload once, however many of its rows hold it. `resolve` joins the described payloads to the references by
digest. A digest of more than a thousandth of all references is joined by broadcast (there are at most a thousand of
these), all others by shuffle, so no key holds more than a thousandth of the rows.

Defined results: null HTML gives an empty sequence; a reference without a stored payload stays, with null media columns;
a null or empty payload is one row of 64 zero samples; repeated rows are kept; tags and attributes that HTML does not
know are ignored; a caption ends with its figure, at the next block or with the text, and a title that is never closed is
text; an empty table gives an empty result; extra columns stay, but for those that carry a result's name.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import scratch, stored, utf8

WIDTH = 64
#: Digests that a task remembers.
SEEN = 500_000
SEQUENCE = "array<struct<pos:int,kind:string,text:string,ref:string,caption:string>>"
_ITEM = pa.struct([("pos", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("ref", pa.string()), ("caption", pa.string())])
_BLOCK = {"p", "div", "li", "h1", "h2", "h3", "h4", "h5", "h6", "br", "tr", "td", "th", "article", "section", "figure", "ul", "ol", "table", "blockquote", "pre"}
_MEDIA = {"img": "image", "audio": "audio", "video": "video"}


class _Reader(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.text: list[str] = []
        self.caption: list[str] | None = None
        self.figure: list[int] = []
        self.skip = 0

    def flush(self) -> None:
        said = re.sub(r"\s+", " ", "".join(self.text)).strip()
        self.text = []
        if said:
            self.items.append({"kind": "text", "text": said, "ref": None, "caption": None})

    def end_caption(self) -> None:
        if self.caption is None:
            return
        said = re.sub(r"\s+", " ", "".join(self.caption)).strip()
        for i in self.figure[1:]:
            self.items[i]["caption"] = said or self.items[i]["caption"]
        if said and not self.figure[1:]:  # a caption of nothing is text
            self.text.append(said)
            self.caption = None
            self.flush()
        self.caption = None

    def handle_starttag(self, tag, attrs):
        if tag in _BLOCK:
            self.end_caption()
        if tag in ("script", "style", "title"):
            self.skip += 1
        elif tag in _MEDIA:
            self.flush()
            own = dict(attrs)
            if self.figure:
                self.figure.append(len(self.items))
            self.items.append({"kind": _MEDIA[tag], "text": None, "ref": own.get("src"), "caption": own.get("alt")})
        elif tag == "figcaption":
            self.flush()
            self.caption = []
        elif tag in _BLOCK:
            self.flush()
            if tag == "figure":
                self.figure = [-1]

    def handle_endtag(self, tag):
        if tag in ("script", "style", "title"):
            self.skip = max(0, self.skip - 1)
        elif tag == "figcaption":
            self.end_caption()
        elif tag in _BLOCK:
            self.end_caption()
            self.flush()
            if tag == "figure":
                self.figure = []

    def handle_data(self, data):
        if not self.skip:
            (self.text if self.caption is None else self.caption).append(data)


def parse(html: str | None) -> list[dict]:
    """The sequence of one HTML text."""
    html = html or ""
    opened, closed = (re.findall(t, html, re.I) for t in (r"<title\b", r"</title\b"))
    if len(opened) > len(closed):  # never closed: its tag alone is left out
        html = re.sub(r"<title\b[^>]*>?", " ", html, flags=re.I)
    reader = _Reader()
    reader.feed(html)
    reader.close()
    reader.end_caption()
    reader.flush()
    return [{"pos": i, **x} for i, x in enumerate(reader.items)]


def sequence(pages: DataFrame, html_col: str = "html", out: str = "sequence") -> DataFrame:
    """pages with the column `out` in place of the HTML."""
    others = [c for c in pages.columns if c not in (html_col, out)]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = pa.array([parse(x) for x in b.column(len(others)).to_pylist()], pa.list_(_ITEM))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(others))), made], names=[*others, out])

    frame = pages.select(*others, html_col)
    return frame.mapInArrow(read, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema.fields[:-1]) + (", " if others else "") + f"`{out}` {SEQUENCE}")


def to_media(payload: bytes) -> bytes:
    """The stored form: a PGM image of 8-bit samples; the payload's length is a positive multiple of WIDTH."""
    return b"P5\n%d %d\n255\n" % (WIDTH, len(payload) // WIDTH) + payload


def from_media(stored: bytes) -> bytes:
    head = re.match(rb"P5\s+(\d+)\s+(\d+)\s+(\d+)\s", stored)
    if head is None:
        raise ValueError("not a stored image")
    w, h = int(head[1]), int(head[2])
    return stored[head.end() : head.end() + w * h]


def pad(data: bytes) -> bytes:
    """Zero bytes up to a positive multiple of WIDTH."""
    return data + bytes(max(WIDTH, -(-len(data) // WIDTH) * WIDTH) - len(data))


def digest_of(text: str | None) -> str:
    return "sha256:" + hashlib.sha256(utf8(text)).hexdigest()


def features(payload: bytes) -> str:
    """Size, mean, deviation and an eight-bin histogram of the samples."""
    x = np.frombuffer(payload, dtype=np.uint8)
    counts = np.bincount(x, minlength=256)
    n, values = len(x), np.arange(256)
    mean = int((counts * values).sum()) / n
    var = max(0.0, int((counts * values * values).sum()) / n - mean * mean)
    return f"{WIDTH}x{n // WIDTH};mean={mean:.4f};sd={var**0.5:.4f};hist=" + ",".join(map(str, counts.reshape(8, 32).sum(axis=1).tolist()))


def store(texts: DataFrame, path: str, text_col: str = "text") -> None:
    """Writes (digest, n_bytes, media) of each text to a table at path. Equal texts make equal rows under one digest, one for each task at most (while it remembers SEEN digests)."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                fresh = []
                for x in b.column(0).slice(lo, 256):
                    data = utf8(x.as_py())
                    key = hashlib.sha256(data).digest()
                    if key not in seen:
                        seen.add(key)
                        fresh.append((key, data))
                if len(seen) > SEEN:
                    seen.clear()
                yield pa.RecordBatch.from_arrays([pa.array(["sha256:" + k.hex() for k, _ in fresh], pa.string()), pa.array([len(x) for _, x in fresh], pa.int64()), pa.array([to_media(pad(x)) for _, x in fresh], pa.binary())], names=["digest", "n_bytes", "media"])

    texts.select(text_col).mapInArrow(write, "digest string, n_bytes long, media binary").write.option("compression", "zstd").parquet(path)


def describe(spark, path: str) -> DataFrame:
    """One row a digest, read back from the table at path: sizes, digests and features of payload and stored form."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for key, n, stored in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                stored = stored.as_py()
                payload = from_media(stored)
                rows.append((key, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), features(payload)))
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 8
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], names=["digest", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    made = spark.read.parquet(path).mapInArrow(read, "digest string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    return made.dropDuplicates(["digest"])


def resolve(sequences: DataFrame, media: DataFrame, seq_col: str = "sequence", with_text: bool = False) -> DataFrame:
    """A row for each media reference (and, with_text, each stretch of text) in its place: the sequence's other columns, pos, kind, text, caption, digest and the media table's columns, which replace columns of their names."""
    others = [c for c in sequences.columns if c not in {seq_col, "pos", "kind", "text", "caption", *media.columns}]
    items = sequences.select(*(f"`{c}`" for c in others), F.explode(seq_col).alias("_item"))
    if not with_text:
        items = items.where("_item.kind <> 'text'")
    items = stored(items.select(*(f"`{c}`" for c in others), *(F.col(f"_item.{n}").alias(n) for n in ("pos", "kind", "text", "caption")), F.col("_item.ref").alias("digest")), "references")
    media = stored(media, "described")
    often = max(1_000, items.count() // 1_000)
    hot = F.broadcast(items.where("digest is not null").groupBy("digest").agg(F.count("*").alias("_c")).where(F.col("_c") > often).select("digest"))  # at most a thousand digests
    by_hot = items.join(hot, "digest", "left_semi").join(F.broadcast(media.join(hot, "digest", "left_semi")), "digest", "left")
    return by_hot.unionByName(items.join(hot, "digest", "left_anti").join(media, "digest", "left"))


def as_html(text: str = "text", digest: str = "digest", caption: str = "caption"):
    """A document as an article: its text, then a figure that shows its payload."""
    escaped = F.replace(F.replace(F.coalesce(F.col(text), F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    return F.concat(F.lit("<article><p>"), escaped, F.lit("</p><figure><img src='"), F.col(digest), F.lit("'><figcaption>"), F.coalesce(F.col(caption), F.lit("")), F.lit("</figcaption></figure></article>"))


def query(spark, sf_dir: str) -> DataFrame:
    """op7: every document as an article of its own text and a figure of its payload: parsed, the payload joined by digest, read back and described. pos and caption show where the figure stands; text_sha256 is the digest of the running text before it (null without any)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    path = scratch(spark, "media")
    store(docs, path)
    digest = F.concat(F.lit("sha256:"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    articles = docs.select("doc_id", "text", digest.alias("digest"), F.concat(F.lit("document "), F.col("doc_id").cast("string")).alias("caption"))
    seqs = sequence(articles.select("doc_id", as_html().alias("html")))
    before = F.filter("sequence", lambda x: x.kind == "text")
    figures = seqs.select("doc_id", F.sha2(F.get(before, F.lit(0))["text"], 256).alias("text_sha256"), F.filter("sequence", lambda x: x.kind != "text").alias("sequence"))
    found = resolve(figures, describe(spark, path))
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pos", "caption", "text_sha256")
