r"""Quality rules: a decision list learned by sequential covering, applied as ordered Spark conditional expressions.

`statistics` computes each whole text's statistics with DataFrame functions alone. `learn` takes labelled statistics of
at most `max_labelled` rows (those with the smallest hashes of their ids) and covers the low-quality ones rule by rule: a
rule grows by the threshold condition of the largest information gain on two thirds of the rows, is pruned from its end
as long as that does not lower its value on the last third, and is kept if its precision there is at least
`min_precision`; the rows it covers then go. `verdict` turns the ordered rules into when(...).when(...).otherwise(...).

A five-word window is compared by a 64-bit hash inside its own document. Only documents with a repeated window sort
(hash, position) pairs; all others stop at the distinct count.

Defined results: a null or blank text has no words and fails the base rules; texts of fewer than five words have no
window; repeated rows get the same verdict; without labels the list is empty and keeps what the base rules keep; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import SPACE

WINDOW = 5
SYMBOLS = "#*$%&|<>"
FEATURES = ["n_words", "mean_chars", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "exclaim_share", "digit_share", "stop_share", "line_words"]


def _held(df: DataFrame, **exprs: Column) -> DataFrame:
    """df with columns that are computed once: a generator keeps the optimizer from copying them into each use."""
    for name, e in exprs.items():
        df = df.select("*", F.explode(F.array(e)).alias(name))
    return df


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and the columns FEATURES for every row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = _held(docs.select(F.col(id_col).alias("_id"), text.alias("_t")), _w=F.when(F.trim("_t", F.lit(SPACE)) == "", F.array().cast("array<string>")).otherwise(F.split(F.trim("_t", F.lit(SPACE)), r"[\x20\x09-\x0D]+", -1)))
    n = F.size("_w")
    window = F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get("_w", i + k) for k in range(WINDOW)]))
    df = _held(df, _h=F.when(n >= WINDOW, window).otherwise(F.array().cast("array<bigint>")))
    # (hash, position) of all windows in order, only where a hash repeats
    pairs = F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = _held(df, _p=F.when(F.size(F.array_distinct("_h")) < F.size("_h"), pairs).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")))
    twice = F.filter("_p", lambda x, j: x.h.eqNullSafe(F.get("_p", j - 1).h) | x.h.eqNullSafe(F.get("_p", j + 1).h))
    df = _held(df, _q=F.sort_array(F.transform(twice, lambda x: x.i)))
    covered = F.aggregate(F.transform("_q", lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get("_q", j + 1) - x, F.lit(WINDOW)))), F.lit(0).cast("long"), lambda a, x: a + x)
    lines = F.filter(F.split("_t", "\n", -1), lambda x: F.trim(x, F.lit(SPACE)) != "")
    df = _held(df, _l=lines)
    chars = F.length(F.array_join("_w", ""))
    symbols = F.length(F.regexp_replace("_t", rf"[^{SYMBOLS}]+", ""))
    df = df.select(
        F.col("_id").alias(id_col), n.cast("long").alias("n_words"), chars.cast("long").alias("word_chars"), symbols.cast("long").alias("n_symbols"), (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"), covered.alias("n_repeat_words"),
        F.size("_l").alias("_nl"), F.length(F.regexp_replace("_t", r"[^A-Z]+", "")).alias("_up"), F.length(F.regexp_replace("_t", r"[^!?]+", "")).alias("_ex"), F.length(F.regexp_replace("_t", r"[^0-9]+", "")).alias("_di"), F.size(F.filter("_w", lambda w: F.length(w) <= 3)).alias("_st"),
    )
    per = lambda a, b: F.round(F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0)), 6)
    return df.withColumns({
        "base_failed": (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")), "mean_chars": per("word_chars", "n_words"), "symbol_share": per("n_symbols", "n_words"), "dup_line_share": per("n_dup_lines", "_nl"), "repeat_share": per("n_repeat_words", "n_words"),
        "upper_share": per("_up", "word_chars"), "exclaim_share": per("_ex", "n_words"), "digit_share": per("_di", "word_chars"), "stop_share": per("_st", "n_words"), "line_words": per("n_words", "_nl"),
    }).drop("_nl", "_up", "_ex", "_di", "_st")


Condition = tuple[str, str, float]  # feature, ">=" or "<", threshold
Row = tuple[list[float], int]  # features, 1: low quality


def _holds(x: list[float], rule: list[Condition]) -> bool:
    return all(x[FEATURES.index(f)] >= t if op == ">=" else x[FEATURES.index(f)] < t for f, op, t in rule)


def _best(rows: list[Row], rule: list[Condition]) -> Condition | None:
    """The condition with the largest information gain over what the rule covers; thresholds lie halfway between neighbours of unlike labels."""
    p0 = sum(y for _, y in rows)
    n0 = len(rows) - p0
    if not p0 or not n0:
        return None
    base, best, gain = math.log2(p0 / (p0 + n0)), None, 1e-9
    for i, f in enumerate(FEATURES):
        order = sorted((x[i], y) for x, y in rows)
        below = [0, 0]
        for (v, y), (w, z) in zip(order, order[1:], strict=False):
            below[y] += 1
            if v == w:
                continue
            for op, p, n in (("<", below[1], below[0]), (">=", p0 - below[1], n0 - below[0])):
                if p and (g := p * (math.log2(p / (p + n)) - base)) > gain:
                    best, gain = (f, op, round((v + w) / 2, 6)), g
            del z
    return None if best in rule else best


def cover(rows: list[Row], max_rules: int = 12, max_conditions: int = 4, min_precision: float = 0.95, min_support: float = 0.002) -> list[list[Condition]]:
    """Sequential covering: the ordered rules that reject."""
    grow, prune = [r for i, r in enumerate(rows) if i % 3], [r for i, r in enumerate(rows) if i % 3 == 0]
    rules: list[list[Condition]] = []
    while len(rules) < max_rules and any(y for _, y in grow):
        rule: list[Condition] = []
        inside = grow
        while len(rule) < max_conditions and any(not y for _, y in inside) and (c := _best(inside, rule)):
            rule.append(c)
            inside = [r for r in inside if _holds(r[0], [c])]

        def value(r: list[Condition]) -> float:
            got = [y for x, y in prune if _holds(x, r)]
            return (2 * sum(got) - len(got)) / max(1, len(got)) if got else -1.0

        while len(rule) > 1 and value(rule[:-1]) >= value(rule):
            rule.pop()
        hit = [y for x, y in prune if _holds(x, rule)] if rule else []
        if not rule or len(hit) < max(3, min_support * len(prune)) or sum(hit) < min_precision * len(hit):
            break
        rules.append(rule)
        grow, prune = ([r for r in part if not _holds(r[0], rule)] for part in (grow, prune))
    return rules


def learn(stats: DataFrame, labels: DataFrame, max_labelled: int = 6_000, id_col: str = "doc_id", **options) -> list[list[Condition]]:
    """Rules from statistics of labelled rows; labels: (id_col, quality). At most max_labelled rows reach the driver."""
    rows = stats.join(labels, id_col).select(F.xxhash64(id_col).alias("h"), (F.col("quality") == 0).cast("int").alias("y"), *FEATURES).orderBy("h").limit(max_labelled).collect()
    return cover([([float(r[f]) for f in FEATURES], r.y) for r in rows], **options)


def sample_labels(labels: DataFrame, max_labelled: int, id_col: str = "doc_id") -> DataFrame:
    """At most max_labelled labelled ids, those with the smallest hashes."""
    known = labels.where(F.col("quality").isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min("quality").alias("quality"))
    return known.orderBy(F.xxhash64(id_col), id_col).limit(max_labelled)


def verdict(rules: list[list[Condition]]) -> tuple[Column, Column]:
    """(kept, rule number or null): the ordered conditions as one conditional expression each."""
    if not rules:
        return F.lit(True), F.lit(None).cast("int")
    kept = number = None
    for i, rule in enumerate(rules):
        cond = F.lit(True)
        for f, op, t in rule:
            cond = cond & (F.col(f) >= t if op == ">=" else F.col(f) < t)
        kept = F.when(cond, False) if kept is None else kept.when(cond, False)
        number = F.when(cond, i) if number is None else number.when(cond, i)
    return kept.otherwise(True), number


def judge(docs: DataFrame, labels: DataFrame, max_labelled: int = 6_000, **options) -> DataFrame:
    """The statistics of every document with kept and the number of the rule that rejected it."""
    sample = sample_labels(labels, max_labelled)
    some = docs.join(F.broadcast(sample.select("doc_id")), "doc_id")  # at most max_labelled ids
    kept, number = verdict(learn(statistics(some), sample, max_labelled, **options))
    return statistics(docs).withColumns({"kept": ~F.col("base_failed") & kept, "rule": number})


def query(spark, sf_dir: str) -> DataFrame:
    """op8: base statistics and verdict for all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return judge(docs, labels).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


__all__ = ["FEATURES", "SYMBOLS", "cover", "judge", "learn", "query", "statistics", "verdict"]
