import collections
import hashlib
import math
import pathlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from quantloom.llm import common, line_dedup, media, mixing, phrase_dedup, quality_rules, segmentation, sharding, similarity, simhash, stages, toxicity, url_filter

from . import fixtures


@pytest.fixture(scope="module")
def docs(spark):
    return fixtures.table(spark).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], fixtures.SCHEMA)


def words(text):
    return (text or "").encode().split()


# op1 -----------------------------------------------------------------------------------------------------------------


def all_segmentations(pieces, text):
    """Every segmentation of a short text with its normalised probability, by plain recursion."""
    table = {pieces.sp.id_to_piece(i): i for i in range(pieces.sp.get_piece_size())}
    logp = {int(i): float(p) for _, ids, ps, _ in pieces.tables for i, p in zip(ids, ps, strict=True)}

    def go(rest):
        if not rest:
            return [((), 0.0)]
        out = []
        for n in range(1, min(16, len(rest)) + 1):
            i = table.get(rest[:n])
            if i in logp:
                out += [((i, *ids), logp[i] + p) for ids, p in go(rest[n:])]
        return out

    found = go("▁" + text.replace(" ", "▁"))
    total = sum(math.exp(p) for _, p in found)
    return {ids: math.exp(p) / total for ids, p in found}


def test_segmentation_follows_the_lattice_distribution():
    sampler = segmentation.Sampler(k=2, alpha=0.3, seed=5)
    want = all_segmentations(sampler.pieces, "of at")
    n = 4000
    got = sampler.batch([(i, "of at") for i in range(n)])
    first = collections.Counter(tuple(x[0][0].tolist()) for x in got)
    assert set(first) <= set(want)
    for ids, p in want.items():
        assert abs(first[ids] / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 2e-3
    # without replacement: the second has the law p_b * p_a / (1 - p_a)
    second = collections.Counter(tuple(x[1][0].tolist()) for x in got)
    for ids, p in want.items():
        q = sum(pa * p / (1 - pa) for a, pa in want.items() if a != ids)
        assert abs(second[ids] / n - q) < 5 * math.sqrt(q * (1 - q) / n) + 2e-3


def test_segmentation_inclusion_scores_are_unbiased():
    sampler = segmentation.Sampler(k=3, alpha=0.3, seed=6)
    want = all_segmentations(sampler.pieces, "than")
    n, total = 3000, collections.Counter()
    for found in sampler.batch([(i, "than") for i in range(n)]):
        for ids, logp, _, inclusion in found:
            assert math.isclose(math.exp(logp), want[tuple(ids.tolist())], rel_tol=1e-6)
            total[tuple(ids.tolist())] += math.exp(logp - inclusion)
    assert abs(sum(total.values()) / n - 1) < 0.05


def test_segmentation_exhausts_small_lattices():
    sampler = segmentation.Sampler(k=50, alpha=1.0)
    want = all_segmentations(sampler.pieces, "of a")
    assert len(want) < 50
    (found,) = sampler.batch([(1, "of a")])
    assert {tuple(x[0].tolist()) for x in found} == set(want) and all(x[3] == 0.0 for x in found)
    keys = [x[2] for x in found]
    assert keys == sorted(keys, reverse=True)


def test_decoding_agrees_with_the_library():
    sampler = segmentation.Sampler(k=2)
    for text in ("a  b", "  lead", "trail  ", "\n\n x", "one, two", "5 6 77", "日本 xé", "", " ", "a \n b", "tab\tx²", "😀 z"):
        for ids, *_ in sampler.batch([(1, text)])[0]:
            assert sampler.decode(ids) == sampler.pieces.sp.decode(ids.tolist()) == text


def test_segmentation_operator(spark, docs, empty):
    out = segmentation.sample_segmentations(docs, k=3).collect()
    assert all(r.round_trip for r in out)
    by = collections.defaultdict(list)
    for r in out:
        by[r.doc_id].append(r)
    text = {r.doc_id: r.text for r in docs.collect()}
    assert set(by) == set(text)
    assert len(by[70]) == len(by[71]) == 1 and by[70][0].n_pieces == 0  # null and empty
    assert all(len({tuple(r.ids) for r in rows if r.sample < 3}) == 3 for i, rows in by.items() if i not in (3, 70, 71, 72))
    again = segmentation.sample_segmentations(docs.repartition(7), k=3, batch_chars=500).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.sample, r.ids)
    assert sorted(map(key, out)) == sorted(map(key, again))
    decoded = segmentation.decode_ids(segmentation.sample_segmentations(docs, k=1)).collect()
    assert all(r.text == (text[r.doc_id] or "") for r in decoded)
    assert segmentation.sample_segmentations(empty).count() == 0
    said = segmentation.sample_segmentations(docs, with_pieces=True).where("doc_id = 73").first()
    assert "".join(said.pieces) == "▁one" and len(said.pieces) == len(said.ids) == said.n_pieces


# op2 -----------------------------------------------------------------------------------------------------------------


def brute_repeats(data, window):
    seen = collections.Counter()
    for _, text in data:
        w = words(text)
        seen.update(tuple(w[i : i + window]) for i in range(len(w) - window + 1))
    out = []
    for i, text in data:
        w = words(text)
        cover = [False] * len(w)
        for a in range(len(w) - window + 1):
            if seen[tuple(w[a : a + window])] > 1:
                cover[a : a + window] = [True] * window
        out.append((i, len(w), sum(cover), b" ".join(x for x, c in zip(w, cover, strict=True) if not c)))
    return out


@pytest.mark.parametrize("shard_words", [4_000_000, 400])
def test_phrase_dedup(docs, empty, shard_words):
    got = phrase_dedup.remove_repeats(docs, shard_words=shard_words).collect()
    want = brute_repeats([(r.doc_id, r.text) for r in docs.collect()], 35)
    key = lambda x: (x[0] is None, x)
    assert sorted([(r.doc_id, r.n_words, r.n_removed, bytes(r.kept)) for r in got], key=key) == sorted(want, key=key)
    assert sum(x[2] for x in want) > 500
    assert phrase_dedup.remove_repeats(empty).count() == 0


def test_phrase_dedup_of_few_words(spark):
    """Texts over two to six words: many windows recur, in themselves, too, and blocks stand in many places."""
    rng = np.random.default_rng(4)
    rows = []
    for i in range(60):
        n = int(rng.integers(2, 7))
        rows.append((i, " ".join("abcdef"[int(x)] for x in rng.integers(0, n, int(rng.integers(1, 300)) if i % 3 else 80))))
        if i % 4 == 0:
            rows.append((100 + i, rows[-1][1][10:] + " z " + rows[0][1][:90]))
    rows += [(200, "a " * 200), (201, "x " + "a " * 50), (202, "a b " * 90)]
    for window, gram in ((35, 8), (6, 3), (1, 1)):
        got = phrase_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), window, gram=gram).collect()
        assert sorted((r.doc_id, r.n_words, r.n_removed, bytes(r.kept)) for r in got) == sorted(brute_repeats(rows, window))


def test_automaton_locates(docs):
    """What the automaton finds in whole documents is what goes; without its passages nothing goes; groups of automata agree with one."""
    data = [(r.doc_id, (r.text or "").encode().split()) for r in docs.collect()]
    seen = collections.Counter(tuple(w[i : i + 35]) for _, w in data for i in range(len(w) - 34))
    passages = [list(p) for p, n in seen.items() if n > 1]
    one, none = phrase_dedup.PassageAutomaton(passages), phrase_dedup.PassageAutomaton([])
    total = 0
    for _, w in data:
        want, got, bare, parts = (np.zeros(len(w), dtype=bool) for _ in range(4))
        for i in range(len(w) - 34):
            if seen[tuple(w[i : i + 35])] > 1:
                want[i : i + 35] = True
        one.cover(w, got)
        none.cover(w, bare)
        for group in phrase_dedup._groups(passages, 400):
            phrase_dedup.PassageAutomaton(group).cover(w, parts)
        assert (got == want).all() and (parts == want).all() and not bare.any()
        total += got.sum()
    assert total > 500


def test_shards_stream_their_documents(docs):
    passage = " ".join(f"p{i}" for i in range(50))
    rows = [(0, 0, None, passage), (0, 1, 1, "x " + passage + " y"), (0, 1, 2, None), (1, 1, 3, passage), (2, 0, None, passage), (2, 0, None, passage.replace("p", "q")), (2, 1, 4, passage.replace("p", "q") + " " + passage + " z")]
    for limit in (phrase_dedup.AUTOMATON_WORDS, 50):
        batches = [pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*part, strict=True), (pa.int32(), pa.int32(), pa.int64(), pa.string()), strict=True)], names=["shard", "kind", "doc_id", "text"]) for part in (rows[:2], rows[2:5], rows[5:])]
        got = [tuple(r.values()) for b in phrase_dedup._stream(35, limit)(iter(batches)) for r in b.to_pylist()]
        assert sorted(got) == [(1, 52, 50, b"x y"), (2, 0, 0, b""), (3, 50, 0, passage.encode()), (4, 101, 100, b"z")]


def test_anchors_depend_on_the_window_alone():
    w = phrase_dedup.word_hashes([b"%d" % (i * i % 17) for i in range(200)])[:, 0].copy()
    at, g = phrase_dedup.anchors(w)
    for i in range(0, len(at), 13):
        own, h = phrase_dedup.anchors(w[i : i + 35])
        assert len(own) == 1 and own[0] + i == at[i] and h[own[0]] == g[at[i]]


# op3 -----------------------------------------------------------------------------------------------------------------

URLS = ["http://a.example.com/en/1", "http://www.example.com/en/x?q", "https://EXAMPLE.com/EN/", "http://x.net/es/", "http://net/fr/1#f", "http://notexample.com/en/", "no scheme", None, "", "http://", "://example.com/en/", "http://u@h.com:80/p", "http://example.com?en/", "http://a.b.net/de/", "http://example.com/en/", "http://example.com/en/", "http://.com/", "http://com./", "x://y://net/es/"]


def brute_verdict(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[4] if best else "allow"


@pytest.mark.parametrize("limit", [10_000, 0])
def test_url_filter(spark, limit):
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(URLS)], "page_id long, url string, host string, rule string")
    rules = [*url_filter.RULES, ("b.net", "/d", "block"), ("net", "/de/", "allow")]
    got = url_filter.judge(pages, url_filter.rule_table(spark, rules), broadcast_rows=limit).collect()
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got} == {i: brute_verdict(u, rules) for i, u in enumerate(URLS)}
    assert len(got) == len(URLS)
    assert url_filter.judge(pages.limit(0), url_filter.rule_table(spark)).count() == 0
    assert {r.verdict for r in url_filter.judge(pages, url_filter.rule_table(spark).limit(0)).collect()} == {"allow"}


# op4 -----------------------------------------------------------------------------------------------------------------


def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    grams = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    counts = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g, 42)
        for i in range(64):
            counts[i] += h >> i & 1
    return sum((2 * c > len(grams)) << i for i, c in enumerate(counts))


def components(fps):
    """Smallest id by brute force over all pairs; fps: [(id, fp)]."""
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i][1] ^ fps[j][1]).bit_count() <= 3:
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(fps):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [(d, fp, least.get(find(i))) for i, (d, fp) in enumerate(fps)]


def test_simhash(docs, empty):
    got = simhash.near_duplicates(docs).collect()
    want = components([(r.doc_id, brute_fingerprint(r.text)) for r in docs.collect()])
    key = lambda x: (x[0] is None, x)
    assert sorted([(r.doc_id, int(r.fingerprint, 16), r.component_id) for r in got], key=key) == sorted(want, key=key)
    assert simhash.near_duplicates(empty).count() == 0


def test_simhash_index_finds_each_pair(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    fps = [int(x) for x in base]
    for b in base:
        for _ in range(12):
            fps.append(int(b) ^ sum(1 << int(i) for i in rng.choice(64, int(rng.integers(1, 4)), replace=False)))
    fps = sorted(set(fps))
    for limit in (simhash.LONG_LIST, 3):
        frame = spark.createDataFrame([(x - 2**64 if x >= 2**63 else x,) for x in fps], "fp long")
        edges = simhash.links(frame, long_list=limit).distinct()
        label = {r.node % 2**64: r.label for r in common.connected_components(edges).collect()}
        want = components([(i, x) for i, x in enumerate(fps)])
        groups = collections.defaultdict(set)
        for (_, x, c), fp in zip(want, fps, strict=True):
            assert x == fp
            groups[c].add(label.get(fp, fp))
        assert all(len(g) == 1 for g in groups.values()) and len(set.union(*groups.values())) == len(groups)


def test_components_of_long_chains(spark):
    chain = [(i, i + 1) for i in range(200)] + [(1000, 1001)]
    got = {r.node: r.label for r in common.connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(201)} | {1000: 1000, 1001: 1000}


# op5 -----------------------------------------------------------------------------------------------------------------


def test_sharding(docs, empty):
    got = sharding.shard_documents(docs, 4).collect()
    text = sorted((len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in docs.collect())
    assert sorted((r.size, r.text_crc32) for r in got) == text
    slots = collections.defaultdict(list)
    shard = collections.defaultdict(set)
    for r in got:
        slots[r.shard].append(r.slot)
        shard[r.text_crc32, r.size].add(r.shard)
    assert all(len(s) == 1 for s in shard.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard_documents(empty, 4).count() == 0


def test_differencing_is_tight_and_buckets_change_little(spark):
    rng = np.random.default_rng(1)
    sizes = (rng.lognormal(5, 1.5, 3000) + 1).astype(int).tolist()
    groups = spark.createDataFrame([(b"%d" % i, s) for i, s in enumerate(sizes)], "key binary, bytes long")
    for per in (100, 100_000):
        got = {bytes(r.key): r.shard for r in sharding.assign_groups(groups, 8, per_bucket=per).collect()}
        sums = collections.Counter()
        for i, s in enumerate(sizes):
            sums[got[b"%d" % i]] += s
        assert len(got) == 3000 and max(sums.values()) - min(sums.values()) <= 0.001 * sum(sizes) / 8
    sums, members = sharding.difference([([8, 0], ["a", None]), ([7, 0], ["b", None]), ([6, 0], ["c", None]), ([5, 0], ["d", None]), ([4, 0], ["e", None])])
    assert sorted(sums) == [14, 16] and sorted(x for m in members for x in sharding.leaves(m)) == list("abcde")


# op6 -----------------------------------------------------------------------------------------------------------------

LOW = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def line_key(x):
    return x.strip(b" \t\n\x0b\x0c\r").translate(LOW)


@pytest.mark.parametrize("least", [2, 5, 10])
def test_line_dedup(docs, empty, least):
    data = [(r.doc_id, r.text) for r in docs.collect()]
    seen = collections.defaultdict(set)
    for i, text in data:
        for x in (text or "").encode().split(b"\n"):
            seen[line_key(x)].add((i, text))
    want = []
    for i, text in data:
        lines = (text or "").encode().split(b"\n")
        keep = [x for x in lines if not line_key(x) or len(seen[line_key(x)]) < least]
        want.append((i, b"\n".join(keep)))
    got = line_dedup.rebuild(docs, least).collect()
    key = lambda x: (x[0] is None, x)
    assert sorted([(r.doc_id, (r.text or "").encode()) for r in got], key=key) == sorted(want, key=key)
    assert [r.doc_id for r in got if r.text is None] == [70] and got[0].asDict().keys() == docs.first().asDict().keys()
    assert line_dedup.rebuild(empty).count() == 0


def test_line_dedup_keeps_first(spark):
    data = [(i, f"own {i}\nshared\nshared") for i in range(40)]
    got = {r._id: r for r in line_dedup.keep_bitmaps(spark.createDataFrame(data, "doc_id long, text string"), 3, keep_first=True).collect()}
    assert line_dedup.unpack(bytes(got[0].keep_bitmap), 3).tolist() == [True, True, False]
    assert all(line_dedup.unpack(bytes(got[i].keep_bitmap), 3).tolist() == [True, False, False] for i in range(1, 40))


def test_line_stream_over_batches_and_partitions(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        data = [(i, "\n".join(["hot", "hot", f"pair {i // 2}", f"trio {i // 3}"])) for i in range(120)]
        dropped = line_dedup.dropped_lines(spark.createDataFrame(data, "doc_id long, text string").repartition(5), 3)
        got = collections.Counter(r.pos for r in dropped.collect())
        assert got == {0: 120, 1: 120, 3: 120}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


# op7 -----------------------------------------------------------------------------------------------------------------


def test_media_sequences_keep_order_and_captions():
    seq = media.parse("<p>one <b>two</b></p><script>no</script><figure><img src=d1><img src='d2' alt=alt><figcaption>cap &amp; x</figcaption></figure>tail<img src=d3 alt=own><video src=v></video>")
    assert [(x["pos"], x["kind"], x["text"], x["ref"], x["caption"]) for x in seq] == [(0, "text", "one two", None, None), (1, "image", None, "d1", "cap & x"), (2, "image", None, "d2", "cap & x"), (3, "text", "tail", None, None), (4, "image", None, "d3", "own"), (5, "video", None, "v", None)]
    assert media.parse(None) == media.parse("") == []
    short = lambda html: [(x["kind"], x["text"] or x["ref"], x["caption"]) for x in media.parse(html)]
    assert short("<figure><img src=d><figcaption>cap</figure><p>rest") == [("image", "d", "cap"), ("text", "rest", None)]
    assert short("<figure><img src=d><figcaption>cap<p>rest</p>") == [("image", "d", "cap"), ("text", "rest", None)]
    assert short("<figure><img src=d><figcaption>cap") == [("image", "d", "cap")]
    assert short("<title>open<p>body</p><img src=d>") == [("text", "open", None), ("text", "body", None), ("image", "d", None)]
    assert short("<title>shut</title><p>body") == [("text", "body", None)] and short("<figcaption>alone</figcaption>x") == [("text", "alone", None), ("text", "x", None)]


def test_media_query_recomputed(spark, docs, tmp_path):
    """Every column of the query by other means; one payload that a third of all rows share."""
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(1000 + i, "the same <b>text</b> & more") for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = media.query(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)

    def expected(i, text):
        data = (text or "").encode()
        payload = data + b"\0" * (max(64, -(-len(data) // 64) * 64) - len(data))
        stored = b"P5\n64 %d\n255\n" % (len(payload) // 64) + payload
        mean = sum(payload) / len(payload)
        spread = math.sqrt(max(0.0, sum(x * x for x in payload) / len(payload) - mean * mean))
        bins = ",".join(str(sum(32 * k <= x < 32 * k + 32 for x in payload)) for k in range(8))
        said = re.sub(r"\s+", " ", text or "").strip()
        return i, len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), f"64x{len(payload) // 64};mean={mean:.4f};sd={spread:.4f};hist={bins}", int(bool(said)), None if i is None else f"document {i}", hashlib.sha256(said.encode()).hexdigest() if said else None

    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    got = sorted((tuple(r) for r in got), key=key)
    want = sorted((expected(i, t) for i, t in rows), key=key)
    assert [x[:9] + x[10:] for x in got] == [x[:9] + x[10:] for x in want]
    assert all((a[9] or None) == b[9] or b[0] is None for a, b in zip(got, want))
    whole = spark.createDataFrame([(1, "<p>a</p><img src=gone alt=c><p>b</p>")], "page_id long, html string")
    out = media.resolve(media.sequence(whole), media.describe(spark, _stored(spark, tmp_path)), with_text=True).orderBy("pos").collect()
    assert [(r.pos, r.kind, r.text, r.caption) for r in out] == [(0, "text", "a", None), (1, "image", None, "c"), (2, "text", "b", None)]


def _stored(spark, tmp_path):
    path = f"{tmp_path}/stored"
    media.store(spark.createDataFrame([("x",), (None,)], "text string"), path)
    return path


def test_pages_become_sequences(spark):
    """All pages of the given tables: positions count up, and plain text agrees with a reader of text alone."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "html")
    html = {r.page_id: r.html for r in pages.collect()}
    got = {r.page_id: r.sequence for r in media.sequence(pages).collect()}
    assert set(got) == set(html)
    for i, items in got.items():
        assert [x.pos for x in items] == list(range(len(items)))
        assert sum(x.kind == "image" for x in items) == len(re.findall(r"<img\b", html[i] or "", re.I))


def test_media_round_trip(spark, docs, empty, tmp_path):
    for data in (b"", b"x", b"y" * 64, bytes(range(256)) * 3):
        assert media.from_media(media.to_media(media.pad(data))) == media.pad(data)
        assert len(media.pad(data)) % 64 == 0 and len(media.pad(data)) > 0
    path = str(tmp_path / "media")
    media.store(docs, path)
    found = {r.digest: r for r in media.describe(spark, path).collect()}
    for r in docs.collect():
        data = (r.text or "").encode()
        own = found["sha256:" + hashlib.sha256(data).hexdigest()]
        padded = media.pad(data)
        assert (own.n_bytes, own.payload_bytes, own.payload_sha256, own.tail_crc32) == (len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
    pages = spark.createDataFrame([(1, f"<p>a</p><img src='{next(iter(found))}' alt=c>", 5), (2, "<img src=gone>", 6), (3, None, 7)], "page_id long, html string, pos long")
    out = media.resolve(media.sequence(pages), media.describe(spark, path)).orderBy("page_id").collect()
    assert [(r.page_id, r.pos, r.caption, r.media_bytes is None) for r in out] == [(1, 1, "c", False), (2, 0, None, True)]
    assert media.sequence(pages.limit(0)).count() == 0


# op8 -----------------------------------------------------------------------------------------------------------------


def test_quality_statistics(docs, empty):
    got = {(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality_rules.statistics(docs).collect()}
    want = set()
    for r in docs.collect():
        text = r.text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        grams = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        cover = set()
        for i in range(len(w) - 4):
            if grams[tuple(w[i : i + 5])] > 1:
                cover |= set(range(i, i + 5))
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want.add((r.doc_id, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(cover), len(w) < 10 or 100 * len(cover) > 20 * len(w)))
    assert got == want
    assert quality_rules.statistics(empty).count() == 0


def test_quality_learning(spark):
    rng = np.random.default_rng(2)
    rows = []
    for _ in range(900):
        x = rng.random(len(quality_rules.FEATURES)).round(6).tolist()
        rows.append((x, int(x[2] > 0.7 or (x[5] > 0.8 and x[6] < 0.3))))
    rules = quality_rules.cover(rows)
    wrong = sum(any(quality_rules._holds(x, r) for r in rules) != bool(y) for x, y in rows)
    assert wrong < 0.05 * len(rows) and quality_rules.cover([(rows[0][0], 0)]) == []
    texts = [(i, "word " * 3 + " ".join(f"w{i}x{j}" + ("###" if i % 4 == 0 else "") for j in range(30))) for i in range(200)]
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(0, 200, 2)], "doc_id long, quality int")
    out = {r.doc_id: r.kept for r in quality_rules.judge(frame, labels).collect()}
    assert out == {i: i % 4 != 0 for i in range(200)}
    assert all(r.kept for r in quality_rules.judge(frame, labels.limit(0)).collect())


# op9 -----------------------------------------------------------------------------------------------------------------


def test_mixing(spark, docs, empty):
    got = mixing.taken_words(docs, block=16).collect()
    size = collections.Counter()
    for r in docs.collect():
        size[r.source] += len(words(r.text))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    want = dict(zip(order, mixing.targets([size[s] for s in order]), strict=True))
    assert sum(r.size for r in got) == sum(size.values()) and len(got) == docs.count()
    taken = collections.Counter()
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        taken[r.target] += r.taken
    for s in order:
        assert abs(taken[want[s]] - want[s]) <= 0.1 * want[s] + 32
    key = lambda r: (r.doc_id is None, r.doc_id, r.size, r.taken)
    assert sorted(map(key, got)) == sorted(map(key, mixing.taken_words(docs.repartition(5), block=16).collect()))
    assert mixing.taken_words(empty).count() == 0


def test_mixing_parts():
    assert mixing.targets([100, 100, 100]) == pytest.approx([200, 500 / 3, 250 / 3])
    assert mixing.targets([0, 10]) == [0, 15] and mixing.targets([1, 1, 1000]) == [2, 2, 1499]
    for n in (1, 2, 3, 7, 64, 1000):
        assert sorted(mixing.permute(np.arange(n), n, 9).tolist()) == list(range(n))
    weights = np.array([500.0, 30.0, 0.0, 7.0])
    drawn = [mixing.draw(i, weights, 537, 64, 1) for i in range(9)]
    assert [int(x.sum()) for x in drawn] == [64] * 8 + [25] and all(x[2] == 0 for x in drawn)
    many = sum(mixing.draw(i, weights, 64 * 5000, 64, 1) for i in range(5000))
    assert np.allclose(many / many.sum(), weights / weights.sum(), atol=2e-3)
    assert mixing.limits([1000, 10, 40], [2000, 2000, 20], 0.01) == [(990, 1010), (10, 10), (40, 40)]


def brute_mix(docs, block, shard_slots, seed=9, tolerance=0.05):
    """The mix in plain Python over the same draws: words taken of each (doc_id, text)."""
    keyed = docs.select("doc_id", "text", "source", F.xxhash64("doc_id", F.xxhash64(F.coalesce("text", F.lit("\0null")))).alias("h")).collect()
    streams = collections.defaultdict(list)
    for r in sorted(keyed, key=lambda r: (r.h, r.doc_id is None, r.doc_id or 0)):
        streams[r.source] += [(r.doc_id, r.text)] * len(words(r.text))
    order = sorted({r.source for r in keyed}, key=lambda s: (s is None, s or ""))
    goal = mixing.targets([len(streams[s]) for s in order])
    blocks = [-(-len(streams[s]) // block) for s in order]
    owed = [min(2 * b, round(t / len(streams[s]) * b)) if b else 0 for s, t, b in zip(order, goal, blocks)]
    n_shards = -(-sum(owed) // shard_slots)
    got = sum(mixing.draw(i, np.array(owed, dtype=float), sum(owed), shard_slots, seed) for i in range(n_shards)).tolist()
    taken = collections.Counter()
    for i, (s, n, (least, most)) in enumerate(zip(order, got, mixing.limits(owed, blocks, tolerance))):
        turn = mixing.permute(np.arange(blocks[i]), blocks[i], seed * 1_000_003 + i).tolist()
        for j in range(min(max(n, least), most)):
            at = turn[j % blocks[i]]
            taken.update(streams[s][at * block : (at + 1) * block])
    return taken


def test_mixing_agrees_with_plain_python(spark, docs, monkeypatch):
    once = docs.dropDuplicates(["doc_id", "text"]).cache()
    got = {}
    for n in ("1", "4", "9", "61"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        try:
            got[n] = sorted(((r.doc_id is None, r.doc_id, r.size, r.taken) for r in mixing.taken_words(once, block=2, shard_slots=64, tolerance=0.05).collect()), key=str)
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got["1"] == got["4"] == got["9"] == got["61"]
    want = brute_mix(once, 2, 64)
    text = {r.doc_id: r.text for r in once.collect()}
    assert got["4"] == sorted(((d is None, d, len(words(t)), want[d, t]) for d, t in text.items()), key=str)
    # the draw decides what is taken
    even = mixing.draw
    monkeypatch.setattr(mixing, "draw", lambda shard, w, total, size, seed: even(shard, w[::-1].copy(), total, size, seed)[::-1])
    assert brute_mix(once, 2, 64) != want
    monkeypatch.setattr(mixing, "draw", lambda shard, w, total, size, seed: even(shard, w, total, size, seed + 1))
    assert brute_mix(once, 2, 64) != want


def test_mixing_slots(spark, docs):
    documents, slots, _ = mixing.mix(docs, block=4, shard_slots=64)
    found = slots.collect()
    assert len({(r.shard, r.slot) for r in found}) == len(found) and all(0 <= r.slot < 64 for r in found)
    times = collections.Counter((r.src, r.block) for r in found)
    assert max(times.values()) <= 2
    size = {r.src: r.source_size for r in documents.collect()}
    assert all(0 <= b < -(-size[s] // 4) for s, b in times)
    mixed_in = collections.defaultdict(set)
    for r in found:
        mixed_in[r.shard].add(r.src)
    assert all(len(x) > 1 for s, x in mixed_in.items() if s < max(mixed_in) - len(size))


# op10 ----------------------------------------------------------------------------------------------------------------


def grams_of(texts):
    """Counts of all runs of one to three codes, in plain Python."""
    out = collections.Counter()
    for t in texts:
        c = [0, *(ord(x) if x.isalpha() else 0 for x in t.lower()), 0]
        for x, y, z in zip(c, c[1:], c[2:], strict=False):
            key = toxicity.gram(x, y, z)
            out.update((key, key & (1 << 42) - 1, key & (1 << 21) - 1, 0))
    return out


def test_grams_of_all_letters(spark, docs, empty):
    texts = [r.text for r in docs.collect()] + ["".join(map(chr, range(0x4E00, 0x4F00))) + " z", "ΑΒΓ αβγ 12 ab", "x" * 30_000]
    frame = spark.createDataFrame([(x,) for x in texts], "text string").repartition(2)
    got = {r.gram: r.n for r in toxicity.count_grams(frame).collect()}
    assert got == dict(grams_of([x for x in texts if x]))
    assert toxicity.count_grams(empty).count() == 0


BAD = ["idiot", "moron", "pathetic", "loser", "trash", "stupid", "worthless", "scum"]


def restored(counts, text):
    decoder = toxicity.Decoder(counts)
    return toxicity.restore(text, {t: decoder.decode(t) for _, _, t in toxicity.spans(text.lower())})


def test_decoder_restores_disguised_words():
    counts = grams_of([" ".join(BAD * 20 + ["the", "was", "then", "shore", "shit", "dumbass"] * 50)])
    for said, want in (("1d10t", "idiot"), ("m0r0n!", "moron!"), ("p4th3t1c", "pathetic"), ("i d i o t", "idiot"), ("l.o.s.e.r", "loser"), ("tr@$h", "trash"), ("stuuupid", "stupid"), ("The WAS", "the was"), ("", ""), ("shi+", "shit"), ("dumba$$ then", "dumbass then"), ("(5cum)", "(scum)"), ("h a s", "has"), ("in 455 of 2019", "in 455 of 2019"), ("a b", "a b")):
        assert restored(counts, said) == want, said
    assert toxicity.restore(None, {}) == "" and toxicity.spans("") == []


def test_decoding_in_shards_is_decoding(spark):
    """The distributed lookup of counts gives what a decoder with all counts gives, for whatever token."""
    rng = np.random.default_rng(6)
    plain = ["".join(rng.choice(list("aeioustrnlm"), int(rng.integers(2, 9)))) for _ in range(300)]
    counts = grams_of([" ".join(plain)])
    signs = list("0134578@$!+|") + list("aeioustrn")
    tokens = ["".join(rng.choice(signs, int(rng.integers(1, 9)))) for _ in range(150)] + [toxicity.SPACED + "i d 1 o t", "日1本", "ß0ß"]
    grams = spark.createDataFrame(list(counts.items()), "gram long, n long")
    frame = spark.createDataFrame([(t,) for t in tokens + tokens[:20]], "token string")
    got = {r.token: r.said for r in toxicity.decoded_tokens(frame, grams).collect()}
    decoder = toxicity.Decoder(counts)
    want = {t: decoder.decode(t) for t in tokens}
    assert got == {t: x for t, x in want.items() if x != t.lstrip(toxicity.SPACED)} and len(got) > 100


def disguised(word, how):
    if how == 0:
        return word.translate(str.maketrans("ieaost", "13@0$+"))
    return " ".join(word) if how == 1 else "".join(c * 4 if c in "aeiou" else c for c in word)


def test_decoding_finds_what_plain_scoring_misses(spark):
    """Trained on plain insults, scored on disguised ones in held-out rows: recall with the decoder on and off, and clean rows left alone."""
    rng = np.random.default_rng(7)
    plain = ["".join(rng.choice(list("bcdfglmnprstv"), 1)) + "".join(rng.choice(list("aeioulrn"), int(rng.integers(2, 6)))) for _ in range(150)]
    rows, labels = [], []
    for i in range(900):
        held, toxic = zlib.crc32(str(i).encode()) % 3 == 1, i % 3 == 0
        w = [str(x) for x in rng.choice(plain, 40)]
        for j in range(3 if toxic else 0):
            bad = BAD[int(rng.integers(0, len(BAD)))]
            w[10 * j + 5] = disguised(bad, i // 3 % 3) if held else bad
        if not toxic and i % 2:
            w[7], w[9] = ["2nd", "mp3", "covid19", "a b c", "zzz", "$100", "4x4"][i % 7], "455"
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    frame, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    recall = {}
    for on in (True, False):
        out = {r.row.doc_id: r.predicted for r in toxicity.score_documents(frame, lab, decode=on).collect()}
        held = [i for i, _ in labels if zlib.crc32(str(i).encode()) % 3 == 1]
        recall[on] = sum(out[i] for i in held if i % 3 == 0) / sum(i % 3 == 0 for i in held)
        assert not any(out[i] for i, y in labels if not y)
    assert recall[True] >= 0.95 and recall[False] <= 0.1


def test_toxicity(spark, empty):
    bad = ["idiot", "scum", "venomix"]
    texts, labels = [], []
    for i in range(400):
        w = [f"plain{(i * 7 + j) % 50}" for j in range(40)]
        if i % 5 == 0:
            w[3:6] = [bad[i % 3], bad[(i + 1) % 3] + ("x" if i % 2 else ""), "1d10t" if i % 25 == 0 else "word"]
        texts.append((i, " ".join(w)))
        labels.append((i, int(i % 5 == 0)))
    texts += [(1000, None), (1001, ""), (1002, "i d i o t and 5cum"), (None, "idiot scum idiot")]
    frame = spark.createDataFrame(texts, "doc_id long, text string").withColumns({"score": F.lit("own"), "row": F.lit(1), "dk": F.lit(2)})
    lab = spark.createDataFrame(labels + [(5, 0), (None, 1)], "doc_id long, toxic int")
    out = {r.row.doc_id: r for r in toxicity.score_documents(frame, lab).collect()}
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) and r.row.score == "own" for r in out.values())
    assert all(out[i].predicted == y for i, y in labels)
    assert out[1000].predicted == out[1001].predicted == 0 and out[1000].score == out[1001].score
    assert out[None].predicted == out[1002].predicted == 1
    joined = {r.row.doc_id: r for r in toxicity.score_documents(frame, lab, broadcast_chars=0).collect()}
    assert joined == out
    assert {r.predicted for r in toxicity.score_documents(frame, lab.limit(0)).collect()} == {0}
    assert toxicity.score_documents(empty, lab).count() == 0
    clean = stages.without_toxic(frame, lab)
    assert clean.columns == frame.columns and {r.doc_id for r in clean.collect()} == {i for i, y in labels if not y} | {1000, 1001}


def test_labels_of_held_out_rows_change_nothing(spark):
    held = {r.doc_id for r in spark.range(300).withColumnRenamed("id", "doc_id").where(toxicity.is_held_out("doc_id")).collect()}
    assert held == {i for i in range(300) if zlib.crc32(str(i).encode()) % 3 == 1}
    frame = spark.createDataFrame([(i, f"{'awfulword' if i % 4 == 0 else 'fine'} text number{i % 9}") for i in range(300)], "doc_id long, text string")
    a = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(300)], "doc_id long, toxic int")
    b = spark.createDataFrame([(i, 1 - int(i % 4 == 0) if i in held else int(i % 4 == 0)) for i in range(300)], "doc_id long, toxic int")
    score = lambda lab: sorted((r.row.doc_id, r.score) for r in toxicity.score_documents(frame, lab).collect())
    assert score(a) == score(b)


# stages --------------------------------------------------------------------------------------------------------------


def clashing(docs):
    """docs with extra columns named like those that operators use inside."""
    names = ("__keep", "__id", "__tk", "__i", "__k", "__size", "__score", "row", "id", "tk", "fp", "label", "dk", "keep", "size", "pieces", "changes", "start")
    return docs.select("*", *(F.lit(f"own {n}").alias(n) for n in names if n not in docs.columns))


@pytest.mark.parametrize("kind", ["long", "string"])
def test_stages(spark, docs, empty, kind):
    docs = clashing(docs.withColumn("doc_id", F.col("doc_id").cast(kind))).cache()
    empty = clashing(empty.withColumn("doc_id", F.col("doc_id").cast(kind)))
    columns, dtypes = docs.columns, docs.dtypes
    whole = {(r.doc_id, r.text): r for r in docs.collect()}
    lines = stages.without_repeated_lines(docs)
    assert lines.dtypes == dtypes and lines.count() == docs.count()
    assert all(r.n_chars == len(r.text) for r in lines.collect() if r.text is not None)
    mixed = stages.mixed(docs, block=16)
    assert mixed.dtypes == dtypes
    total = sum(len(words(r.text)) for r in docs.dropDuplicates(["doc_id", "text"]).collect())
    assert 1.2 * total < sum(len(words(r.text)) for r in mixed.collect()) < 1.8 * total
    near = stages.without_near_duplicates(docs)
    for made in (lines, mixed, near):
        assert made.dtypes == dtypes and all(r["__keep"] == "own __keep" and r.pieces == "own pieces" and r.key == 8 for r in made.collect())
    assert all((r.doc_id, r.text) in whole for r in near.collect()) and 20 < near.count() < docs.count()
    cut_up = segmentation.decode_ids(stages.segmented(docs)).collect()
    assert {(r.doc_id, r.text) for r in cut_up} == {(i, t or "") for i, t in whole} and all(r.round_trip for r in cut_up)
    labels = spark.createDataFrame([(1, 0)], "doc_id long, toxic int").withColumn("doc_id", F.col("doc_id").cast(kind))
    for stage in (stages.without_near_duplicates, stages.without_repeated_lines, stages.mixed, stages.segmented):
        assert stage(empty).count() == 0
    clean = stages.without_toxic(docs, labels)
    assert clean.dtypes == dtypes and clean.count() == docs.count()


def test_repeated_rows_have_a_defined_choice(spark):
    rows = [(1, "a b c d e f g", f"v{i}", "s") for i in range(6)] + [(2, "other words stand here", "x", "s")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, extra string, source string")
    got = [{tuple(r) for r in stages.without_near_duplicates(frame.repartition(n)).collect()} for n in (1, 5)]
    assert got[0] == got[1] and len(got[0]) == 2


def test_pipeline_runs(spark, tmp_path):
    """All stages over written tables: each stage against the one before, and the whole against run()."""
    rows = fixtures.rows()
    insult = "you idiot moron are pathetic trash " * 4
    rows += [(200 + i, f"{insult} number{i} " + " ".join(f"q{i}w{j}" for j in range(20)), "en", "s1", 0, "extra", 7, 8) for i in range(90)]
    rows += [(400 + i, " ".join(f"fine{(i * j) % 83}" for j in range(5, 60)), "en", "s2", 0, "extra", 7, 8) for i in range(90)]
    fixtures.table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(r[0], int(200 <= r[0] < 400)) for r in rows if r[0] is not None and r[0] >= 200]
    spark.createDataFrame(labels, "doc_id long, quality int").withColumnRenamed("quality", "toxic").write.parquet(f"{tmp_path}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash", "mixing", "segmentation"]
    df, made = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        df = made[name] = stage(spark, df, str(tmp_path)).cache()
    kept = {r.doc_id for r in made["toxicity"].collect()}
    assert kept == {r[0] for r in rows if r[0] is None or not 200 <= r[0] < 400}
    line = "this line stands in many documents"
    assert not any(line in (r.text or "").lower().split("\n") for r in made["line_dedup"].collect())
    texts = [r.text for r in made["simhash"].collect()]
    assert len(set(texts)) == len(texts) < made["line_dedup"].count()
    words_in, words_out = (sum(len(words(r.text)) for r in made[n].collect()) for n in ("simhash", "mixing"))
    assert 1.3 * words_in < words_out < 1.7 * words_in
    decoded = segmentation.decode_ids(made["segmentation"]).where("sample = 0").collect()
    assert collections.Counter((r.doc_id, r.text) for r in decoded) == collections.Counter((r.doc_id, r.text) for r in made["mixing"].collect())
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.sample, r.ids)
    assert sorted(map(key, corpus_pipeline.run(spark, str(tmp_path)).collect())) == sorted(map(key, made["segmentation"].collect()))


def test_results_do_not_hang_on_partitions(docs):
    one, two = (sorted((r.doc_id is None, r.doc_id, r.fingerprint) for r in simhash.near_duplicates(x).collect()) for x in (docs, docs.repartition(5)))
    assert one == two
    assert docs.select(F.max("doc_id")).first()[0] == 77


def test_tallies_never_lose_a_similar_pair():
    rng = np.random.default_rng(9)
    common = np.unique(rng.integers(0, 2**64 - 1, 40, dtype=np.uint64))
    places, lost, spared = np.arange(len(common)), 0, 0
    for _ in range(3000):
        base = np.concatenate([rng.integers(0, 2**64 - 1, int(rng.integers(1, 60)), dtype=np.uint64), rng.choice(common, int(rng.integers(0, 30)), replace=False)])
        a = np.unique(base)
        b = np.unique(np.concatenate([rng.choice(a, int(rng.integers(0, len(a) + 1)), replace=False), rng.integers(0, 2**64 - 1, int(rng.integers(0, 12)), dtype=np.uint64)]))
        if not len(b):
            continue
        (x, rx), (y, ry) = (similarity.prefix(v, common, places, 80) for v in (a, b))
        may = similarity.plausible(x, rx, len(a), y, ry, len(b))
        lost += similarity.similar(a, b) and not may
        spared += not may
    assert lost == 0 and spared > 500


def test_signatures_never_differ_in_more_bits_than_members():
    rng = np.random.default_rng(10)
    assert not similarity.signature(np.zeros(0, dtype=np.uint64)).any()
    for _ in range(2000):
        both = rng.integers(0, 2**64 - 1, int(rng.integers(0, 900)), dtype=np.uint64)
        a, b = (np.unique(np.concatenate([both, rng.integers(0, 2**64 - 1, int(rng.integers(0, 200)), dtype=np.uint64)])) for _ in range(2))
        bits = int(np.bitwise_count((similarity.signature(a) ^ similarity.signature(b)).view(np.uint64)).sum())
        assert bits <= len(np.setxor1d(a, b)) and len(similarity.signature(a)) * 64 == similarity.SIGNATURE


def test_pipeline_near_dedup_links_all_pairs_of_similarity(spark, docs, empty, monkeypatch):
    """Against brute force on shingle sets: copies with a changed stretch mostly differ in more than three bits of a fingerprint."""
    rng = np.random.default_rng(8)
    rows = list(fixtures.rows())
    for base in range(12):
        words_ = [f"w{rng.integers(0, 5000)}" for _ in range(int(rng.integers(60, 200)))]
        for copy in range(6):
            said = list(words_)
            for _ in range(copy):
                said[int(rng.integers(0, len(said)))] = f"other{rng.integers(0, 5000)}"
            rows.append((1000 + 10 * base + copy, " ".join(said), *rows[0][2:]))
    frame = fixtures.table(spark, rows).cache()

    def grams(text):
        w = (text or "").encode().lower().split()
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    found = [(r.doc_id, grams(r.text)) for r in frame.collect()]
    parent = list(range(len(found)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (_, x) in enumerate(found):
        for j, (_, y) in enumerate(found[:i]):
            if x == y or 5 * len(x & y) >= 4 * len(x | y):
                parent[find(i)] = find(j)
    groups = collections.defaultdict(list)
    for i, (d, _) in enumerate(found):
        groups[find(i)].append((d is None, d or 0))
    want = sorted(min(g) for g in groups.values())
    stage = dict(corpus_pipeline.STAGES)["simhash"]
    for share in (similarity.SAMPLE, 1):  # with few and with all texts in the sample for common shingles
        monkeypatch.setattr(similarity, "SAMPLE", share)
        got = stage(spark, frame, "")
        assert got.columns == frame.columns and sorted((r.doc_id is None, r.doc_id or 0) for r in got.collect()) == want
    assert stage(spark, empty, "").count() == 0


# findings of round 3 -------------------------------------------------------------------------------------------------


def test_f1_a_task_gives_its_memory_back():
    def mb():
        found = re.findall(r"\nPss_Anon:\s+(\d+)", pathlib.Path("/proc/self/smaps_rollup").read_text())
        return int(found[0]) / 1024

    kept = []

    def run(batches):
        held = [bytes(1000) for _ in range(100_000)]  # with small objects between them, so that they don't lie at the heap's end
        kept.extend(bytes(600) for _ in range(10))
        yield from batches
        del held

    common.give_back()
    before = mb()
    assert list(common.lean(run)(iter([1, 2]))) == [1, 2]
    assert mb() - before < 30


def test_f2_parts_are_cut_once_and_as_their_text():
    sampler = segmentation.Sampler(k=2)
    texts = ["of  at", " of at ", "   ", "a1b of\nat of", "of at of at", "x\u2581 y", ""]
    for text, found in zip(texts, sampler.batch([(i, t) for i, t in enumerate(texts)]), strict=True):
        for ids, *_ in found:
            assert sampler.decode(ids) == text.replace("\u2581", " ")
    assert len(sampler.parts) == len(sampler.parts.begin) - 1
    which = np.array([sampler.parts["of"], sampler.parts["a1b"]])
    units, ends = sampler.parts.units(which)
    names = {n: u for u, n in sampler.index.items()}
    assert [names[u] for u in units.tolist()] == segmentation.UNIT.findall("\u2581of\u2581a1b") and ends.tolist() == [1, len(units)]


def test_f2_forgotten_parts_change_no_sample():
    rows = [[(i, f"common words and rare{i} x{i}y")] for i in range(40)]
    whole, small = segmentation.Sampler(k=2), segmentation.Sampler(k=2)
    small.KEPT, small.KEPT_UNITS = 60, 20
    for row in rows:
        a, b = whole.batch(row), small.batch(row)
        assert [x[0].tolist() for x in a[0]] == [x[0].tolist() for x in b[0]]
        assert len(small.parts) == len(small.parts.begin) - 1 and len(small.parts.flat) <= 20 + 8
    assert len(small.parts) < len(whole.parts)


def test_f3_the_automatons_root_has_few_children():
    words = [[b"p%d-%d" % (p, i) for i in range(40)] for p in range(300)]
    automaton = phrase_dedup.PassageAutomaton(words)
    assert len({key[0] for key in automaton.automaton.keys()}) <= 64
    text = [b"a", *words[7], b"b", *words[299][:34], b"c", *words[3][2:37]]
    covered = np.zeros(len(text), dtype=bool)
    automaton.cover(text, covered)
    assert np.flatnonzero(covered).tolist() == [*range(1, 41), *range(len(text) - 35, len(text))]
    symbols = "".join(map(chr, [32, 33, 95, 96, 0xD7FF, 0xE000, 1_002_079]))
    assert len({phrase_dedup.letters(c) for c in symbols}) == len(symbols) and all(len(phrase_dedup.letters(c)) == 2 for c in symbols)


# findings of round 3, second reading ---------------------------------------------------------------------------------


def test_f2_new_parts_of_known_units_are_kept_when_the_lattices_are_full():
    sampler = segmentation.Sampler(k=2)
    sampler.KEPT = 20
    sampler.batch([(0, "of at the of")])
    kept = len(sampler.index)
    text = "wholly unknown signs of\nof the\nof of\u2581at"
    assert all(sampler.decode(ids) == text.replace("\u2581", " ") for ids, *_ in sampler.batch([(1, text)])[0])
    assert len(sampler.index) == kept == sampler.lattices.used[0] and "unknown" not in sampler.parts and "of\u2581at" in sampler.parts
    units, ends = sampler.parts.units(np.arange(len(sampler.parts)))
    names = {n: u for u, n in sampler.index.items()}
    want = [segmentation.UNIT.findall("\u2581" + part) for part in sampler.parts]
    assert [names[u] for u in units.tolist()] == sum(want, []) and np.diff(ends, prepend=0).tolist() == list(map(len, want))


def test_f1_the_mix_needs_no_workers_that_only_unpickle_rows(spark, docs):
    documents, slots, pieces = mixing.mix(docs)
    for frame in (documents, slots, pieces):
        assert "PythonRDD" not in frame._jdf.queryExecution().toRdd().toDebugString()
    few = common.few_rows(spark, [(1, None, b"a"), (2, "x", None)], "n int, s string, b binary")
    assert few.dtypes == [("n", "int"), ("s", "string"), ("b", "binary")] and sorted(map(tuple, few.collect())) == [(1, None, b"a"), (2, "x", None)]
    assert common.few_rows(spark, [], "dk long, changes array<struct<token:string,said:string>>").count() == 0


# findings of round 3, third reading ----------------------------------------------------------------------------------


def test_f1_known_parts_are_found_without_their_names(monkeypatch):
    text, others = "common words of  at\nx 12 \u2581y  ", ["", " ", "of at", "  of\u2581at words", "x" * 300 + " of"]
    rows = [(i, t) for i, t in enumerate([text, *others])]
    sampler, asked = segmentation.Sampler(k=2), []
    want = [[(ids.tolist(), *numbers) for ids, *numbers in found] for found in sampler.batch(rows)]
    monkeypatch.setattr(sampler.parts, "numbers", lambda keys: asked.extend(keys) or type(sampler.parts).numbers(sampler.parts, keys))
    assert [[(ids.tolist(), *numbers) for ids, *numbers in found] for found in sampler.batch(rows)] == want and asked == []
    # parts of one slot are told apart by their characters, or asked for by name
    crowded = segmentation.Sampler(k=2)
    monkeypatch.setattr(crowded.parts, "_slot", lambda chars, starts, sizes: np.zeros(len(starts), dtype=np.int64))
    for _ in range(2):
        assert [[(ids.tolist(), *numbers) for ids, *numbers in found] for found in crowded.batch(rows)] == want
    assert (crowded.parts.slots >= 0).sum() == 1


def test_f1_draws_and_texts_of_many_rows_are_those_of_each():
    sampler = segmentation.Sampler(k=3)
    rows = [(i, "of at the " * (i % 5) + f"word{i} \u65e5 x\u00e9" * (i % 3)) for i in range(150)]
    whole = sampler.batch(rows)
    assert [[(x[0].tolist(), *x[1:]) for x in found] for found in whole] == [[(x[0].tolist(), *x[1:]) for x in segmentation.Sampler(k=3).batch([row])[0]] for row in rows[:20]] + [[(x[0].tolist(), *x[1:]) for x in found] for found in whole[20:]]
    ids = [x[0] for found in whole for x in found]
    said = list(sampler.decoded(np.concatenate(ids), np.cumsum([len(x) for x in ids])))
    assert said == [sampler.decode(x).encode() for x in ids] and {*said} == {text.encode() for _, text in rows}
    lattice, rng = sampler.lattices, np.random.default_rng(1)
    nodes, u = rng.integers(0, len(lattice.first), 500), rng.random(500)
    for node, x, edge in zip(nodes.tolist(), u.tolist(), lattice.draw(nodes, u).tolist(), strict=True):
        first, last = int(lattice.first[node]), int(lattice.last[node])
        assert edge == next((e for e in range(first, last) if x < lattice.cum[e]), last)
