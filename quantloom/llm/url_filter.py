"""URL filters by host-suffix and path-prefix expressions, natively in DataFrame functions.

Each URL expands into every suffix of its host times every prefix of its path that has the length of some rule's path.
Expressions and rules are equi-joined on the first four bytes of a SHA-256 digest; a candidate counts only if the whole
digest agrees. Of the confirmed rules the longest wins (then the longer host, then block before allow).

A rule table is joined by broadcast only if its row count is at most `broadcast_rows`; a larger one is joined by a
shuffle on the hash prefix, where distinct expressions, not URLs, are the rows, so a host that a third of the URLs share
is one row.

Defined results: a null URL or one without "://" has an empty host and path and no rule; a URL that no rule fits is
allowed with a null rule; repeated rows are judged alike; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm.common import lower_ascii

#: The rules of the query: host, path, verdict.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", url)
    after = F.when(at > 0, url.substr(at + 3, F.length(url)))
    host = F.regexp_extract(after, r"^([^/?#]*)", 1)
    path = F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(lower_ascii(host), F.lit("")), F.coalesce(path, F.lit(""))


def with_digests(rules: DataFrame) -> DataFrame:
    """rules (host, path, verdict) with the rule's text, digest and hash prefix."""
    digest = F.sha2(F.concat_ws("\n", "host", "path"), 256)
    return rules.select(F.concat("host", "path").alias("rule"), F.length("host").alias("host_len"), "verdict", digest.alias("digest"), F.substring(digest, 1, 8).alias("prefix"))


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", broadcast_rows: int = 10_000) -> DataFrame:
    """id_col, host, path, rule, verdict for every row of pages."""
    lengths = [r[0] for r in rules.select(F.length("path")).distinct().collect()]  # a URL's length bounds them, not the number of rules
    small = rules.limit(broadcast_rows + 1).count() <= broadcast_rows
    host, path = host_and_path(F.col(url_col))
    parts = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    labels = F.split("host", r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    cuts = F.filter(F.array(*[F.lit(n) for n in sorted(lengths)]) if lengths else F.array().cast("array<int>"), lambda n: n <= F.length("path"))
    prefixes = F.transform(cuts, lambda n: F.substring(F.col("path"), F.lit(1), n))
    expressions = F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.concat_ws("\n", h, p))))
    hashed = with_digests(rules)
    best = F.struct(F.length("rule").alias("n"), "host_len", (F.col("verdict") == "block").alias("block"), "rule", "verdict")
    urls = parts.select("host", "path").distinct()
    tried = urls.select("host", "path", F.explode(expressions).alias("e")).withColumn("digest", F.sha2("e", 256)).withColumn("prefix", F.substring("digest", 1, 8))
    if small:
        hits = tried.join(F.broadcast(hashed.withColumnRenamed("digest", "whole")), "prefix").where("digest = whole")
    else:
        each = tried.select("digest", "prefix").distinct().join(hashed.withColumnRenamed("digest", "whole"), "prefix").where("digest = whole").drop("whole", "prefix")
        hits = tried.join(each, "digest")
    found = hits.groupBy("host", "path").agg(F.max(best).alias("best"))
    out = parts.join(found, ["host", "path"], "left")
    return out.select(id_col, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def rule_table(spark: SparkSession, rules=None) -> DataFrame:
    return spark.createDataFrame(RULES if rules is None else rules, "host string, path string, verdict string")


def query(spark, sf_dir: str) -> DataFrame:
    """op3: page_id, host, path, rule, verdict for every page."""
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"), rule_table(spark))


SQL = r"""
WITH rules(rh, rp, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
p AS (
  SELECT row_number() OVER () AS k, page_id,
    coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages)
), hit AS (
  SELECT p.*, rh || rp AS rule, v, row_number() OVER (PARTITION BY k ORDER BY length(rh || rp) DESC, length(rh) DESC) AS n
  FROM p LEFT JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)
)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM hit WHERE n = 1
"""
