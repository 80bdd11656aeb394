"""Operator 6: URL rules by host-suffix and path-prefix expressions, hash prefixes and full digests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crease.llm.common import materialize, read_table
from crease.llm.licenses import LOWER, UPPER

#: The rules of the query (host, path, verdict).
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]

#: Characters of a hex digest that make the short prefix.
PREFIX = 8


def _hashed(text: F.Column, name: str) -> list[F.Column]:
    """The short prefix and the full digest of a text."""
    digest = F.sha2(text, 256)
    return [F.substring(digest, 1, PREFIX).alias("prefix"), digest.alias(name)]


def judge_urls(
    pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", default: str = "allow"
) -> DataFrame:
    """The rule that decides each URL: key, host, path, rule, verdict; one row per row of pages.

    rules: host, path, verdict. A rule fits its host and all subdomains if the URL's path starts with the rule's; of
    the fitting ones the longest (host and path together) wins, then the one with the longer host, then the verdict
    that sorts last (block). Without one, rule is null and verdict the default. Null URLs and those without :// have
    empty host and path; keys may be null or repeat. Rules with a null host, path or verdict are left out. An empty
    rule list gives every URL the default.

    Each URL becomes its host suffixes, no longer than the longest rule host; those are equi-joined with the rules'
    hosts on a short hash prefix and confirmed by the full digest. Each confirmed host then gives the path prefixes
    of the lengths that this host's rules have, and host with path is joined with the rules in the same way. No list
    of rules or lengths is gathered on the driver. Spark sends a side to all executors only where its size allows;
    in the shuffled form every join reads a written table on one side, so AQE splits a prefix that many URLs share.
    """
    rules = rules.filter("host is not null and path is not null and verdict is not null")
    rules = materialize(rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict")))
    labels_of = lambda h: F.split(h, r"\.", -1)
    depth = rules.agg(F.max(F.size(labels_of(F.col("host"))))).first()[0] or 0
    hosts = materialize(
        rules.groupBy("host")
        .agg(F.collect_set(F.length("path")).alias("lengths"))
        .select(*_hashed(F.col("host"), "host_digest"), "lengths")
    )
    rank = F.struct(
        F.length(F.concat("host", "path")).alias("n"), F.length("host").alias("h"), "verdict", F.concat("host", "path").alias("rule")
    )
    of_both = lambda host, path: F.concat(host, F.lit("\n"), path)
    whole = materialize(rules.select(*_hashed(of_both(F.col("host"), F.col("path")), "rule_digest"), rank.alias("rank")))

    rest = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    judged = pages.select(F.col(key).alias("key"), host.alias("host"), path.alias("path"))

    tried = judged.select("host", "path", F.explode(F.sequence(F.lit(1), F.least(F.size(labels_of(F.col("host"))), F.lit(depth)))).alias("k"))
    tried = tried.filter(F.lit(depth) > 0).select("host", "path", F.expr("substring_index(host, '.', -k)").alias("suffix"))
    tried = tried.select("*", *_hashed(F.col("suffix"), "digest")).join(hosts, "prefix").filter("digest = host_digest")
    cuts = tried.select("host", "path", "suffix", F.explode(F.filter("lengths", lambda n: n <= F.length("path"))).alias("n"))
    cut = F.expr("substring(path, 1, n)")
    best = materialize(
        cuts.select("host", "path", *_hashed(of_both(F.col("suffix"), cut), "digest"))
        .join(whole, "prefix")
        .filter("digest = rule_digest")
        .groupBy("host", "path")
        .agg(F.max("rank").alias("best"))
    )
    # it grows with the pages, however small its files are: never broadcast it
    return judged.join(best.hint("merge"), ["host", "path"], "left").select(
        F.col("key").alias(key),
        "host",
        "path",
        F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
    )


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return judge_urls(read_table(spark, sf_dir, "pages"), rules)


OP6_SQL = r"""
WITH rules(r_host, r_path, r_verdict) AS (VALUES
  ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
  ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
parts AS (
  SELECT page_id, row_number() OVER () AS n,
    CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
split AS (
  SELECT page_id, n,
    translate(regexp_extract(rest, '^([^/?#]*)', 1, 's'),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1, 's') AS path
  FROM parts),
fit AS (
  SELECT n, arg_max(r_host || r_path, length(r_host || r_path)) AS rule,
    arg_max(r_verdict, length(r_host || r_path)) AS verdict
  FROM split JOIN rules ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path)
  GROUP BY n)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM split LEFT JOIN fit USING (n)
"""
