"""URL filters by hashed host-suffix and path-prefix expressions.

Every distinct URL is expanded into expressions ``host suffix + path prefix``: suffixes begin at
a label, prefixes have a length that some rule's path has. An expression's SHA-256 digest meets
the rules' in an equi-join on its first 8 hex digits; full digests confirm the match, and of a
URL's confirmed rules the longest decides. All of it is DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: (verdict, host, path); a fixed rule set.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
DEFAULT = "allow"
SHORT = 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame([tuple(r) for r in rules], "verdict string, host string, path string")


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, F.lit("://"))
    return F.when(F.coalesce(at, F.lit(0)) > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def judge_urls(pages: DataFrame, rules: DataFrame, id_column: str = "page_id", url_column: str = "url", default: str = DEFAULT) -> DataFrame:
    """(id, host, path, rule, verdict) for every row of ``pages``.

    ``rules`` has (verdict, host, path), paths beginning with ``/``. A rule fits its host and all
    subdomains where the URL's path starts with the rule's; the longest ``host + path`` wins, of
    equal ones that with the longer host, then ``block``. Without a rule ``rule`` is null and the
    verdict ``default``. Null URLs and those without ``://`` have empty host and path and no rule.
    Repeated rows are judged each; other columns are ignored; empty tables give empty results.
    Null rules, hosts or paths never fit.
    """
    rules = rules.filter(F.col("host").isNotNull() & F.col("path").isNotNull() & F.col("verdict").isNotNull()).select("verdict", "host", "path").distinct()
    # Which lengths and label counts any rule has: two short sorted arrays, whatever the number of rules.
    shape = rules.agg(F.sort_array(F.collect_set(F.length("path"))).alias("lengths"), F.sort_array(F.collect_set(_labels(F.col("host")))).alias("labels")).first()
    named = pages.select(F.col(id_column), F.col(url_column).alias("_url"))
    hosts = F.split("host", r"\.", -1)
    lengths, labels = (F.array(*[F.lit(x) for x in found]).cast("array<int>") for found in (shape["lengths"], shape["labels"]))
    suffixes = F.transform(F.filter(labels, lambda n: n <= F.size(hosts)), lambda n: F.array_join(F.slice(hosts, F.size(hosts) - n + 1, n), "."))
    prefixes = F.transform(F.filter(lengths, lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    # a URL is judged by host and a stretch of path no longer than the longest rule's
    longest = max(shape["lengths"], default=0)
    parts = named.select(url_host(F.col("_url")).alias("host"), F.substring(url_path(F.col("_url")), 1, longest).alias("path"))
    distinct = parts.filter((F.col("host") != "") & (F.col("path") != "")).distinct()
    expressions = distinct.select("host", "path", F.explode(suffixes).alias("_suffix"), prefixes.alias("_prefixes")).select("host", "path", "_suffix", F.explode("_prefixes").alias("_prefix"))
    digest = F.sha2(F.concat("_suffix", "_prefix"), 256)
    expressions = expressions.select("host", "path", digest.alias("_digest"), F.substring(digest, 1, SHORT).alias("_short"))
    text = F.concat("host", "path")
    known = rules.select(
        F.sha2(text, 256).alias("_full"),
        F.substring(F.sha2(text, 256), 1, SHORT).alias("_short"),
        F.struct(F.length(text).alias("length"), F.length("host").alias("host_length"), (F.col("verdict") == "block").alias("blocks"), text.alias("rule"), F.col("verdict").alias("verdict")).alias("_rule"),
    )
    best = expressions.join(known, "_short").filter(F.col("_digest") == F.col("_full")).groupBy("host", "path").agg(F.max("_rule").alias("_rule"))
    best = best.select(F.col("host").alias("_host"), F.col("path").alias("_path"), "_rule")
    judged = named.select(id_column, url_host(F.col("_url")).alias("host"), url_path(F.col("_url")).alias("path"))
    judged = judged.join(best, (F.col("host") == F.col("_host")) & (F.substring("path", 1, longest) == F.col("_path")), "left")
    return judged.select(id_column, "host", "path", F.col("_rule.rule").alias("rule"), F.coalesce("_rule.verdict", F.lit(default)).alias("verdict"))


def _labels(host: Column) -> Column:
    return F.size(F.split(host, r"\.", -1))


#: ``op7_url_filter`` in DuckDB SQL.
ORACLE = """
WITH parts AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
rules(verdict, host, path) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
                                      ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
best AS (
  SELECT s.host, s.path, arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(r.verdict, length(r.host || r.path)) AS verdict
  FROM (SELECT DISTINCT host, path FROM split) s JOIN rules r
    ON (s.host = r.host OR ends_with(s.host, '.' || r.host)) AND starts_with(s.path, r.path)
  GROUP BY 1, 2)
SELECT s.page_id, s.host, s.path, b.rule, coalesce(b.verdict, 'allow') AS verdict
FROM split s LEFT JOIN best b ON s.host = b.host AND s.path = b.path
"""
