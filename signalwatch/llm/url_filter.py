"""URL filtering by hashed expressions: each URL becomes every pair of a host suffix and a path prefix, as rules could name it;
the expressions meet the rules in an equi-join on a short hash prefix alone, full digests confirm, and the longest rule wins.

All on columns of Spark. A URL has as many expressions as its host has labels times the distinct lengths of rule paths,
which are no more than the longest rule path has characters. Rules are joined by their hash prefix, so there may be any
number of them; equal URLs are judged once, and only pages whose prefix some rule has go on from the join.

Defined results: null URLs and those without `://` have empty host and path, fit no rule and are allowed; an empty path fits only rules
with an empty path; of rules of one length the one with the longer host wins, then block before allow; repeated rules count once.
Columns of the input other than the id and url are dropped, so none can clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import keep

#: Hexadecimal digits of the digest that the join compares, as one number.
PREFIX = 8


def _after_scheme(url: Column) -> Column:
    """What follows the first `://`; null where there is none."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    host = F.regexp_extract(_after_scheme(url), r"^([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*(/[^?#]*)", 1), F.lit(""))


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def _prefix(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, PREFIX), 16, 10).cast("bigint")


def expressions(host: Column, path: Column, lengths: list[int]) -> Column:
    """Distinct digests of every host suffix with every path prefix of the given lengths."""
    labels = F.split(host, r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.filter(F.array(*(F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths)), lambda p: p.isNotNull())
    return F.array_distinct(F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: _digest(s, p)))))


def judged(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url") -> DataFrame:
    """(key, host, path, rule, verdict, n_rules): pages judged by rules (host, path, verdict allow or block)."""
    named = rules.select(F.lower("host").alias("rule_host"), F.coalesce("path", F.lit("")).alias("rule_path"), F.col("verdict").alias("rule_verdict")).where("rule_host <> ''")
    named = named.groupBy("rule_host", "rule_path").agg(F.max("rule_verdict").alias("rule_verdict"))
    named = named.withColumn("rule_digest", _digest(F.col("rule_host"), F.col("rule_path"))).withColumn("prefix", _prefix(F.col("rule_digest")))
    # distinct lengths only: bounded by the longest rule path, whatever the number of rules
    lengths = sorted(r[0] for r in named.select(F.length("rule_path")).distinct().collect())
    parts = pages.select(F.col(key).alias("key"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    if not lengths:
        return parts.select(F.col("key").alias(key), "host", "path", F.lit(None).cast("string").alias("rule"), F.lit("allow").alias("verdict"), F.lit(0).cast("bigint").alias("n_rules"))
    # equal hosts and paths are judged once; probes carry a number each, and the host and path that make the digest again
    each = parts.select("host", "path").where("host <> ''").distinct()
    probes = each.withColumn("prefix", F.explode(F.array_distinct(F.transform(expressions(F.col("host"), F.col("path"), lengths), _prefix))))
    met = probes.join(named, "prefix").where(F.array_contains(expressions(F.col("host"), F.col("path"), lengths), F.col("rule_digest")))
    rule = F.concat("rule_host", "rule_path")
    best = met.groupBy("host", "path").agg(F.max(F.struct(F.length(rule).alias("size"), F.length("rule_host").alias("host_size"), "rule_verdict", rule.alias("rule"))).alias("best"), F.count("*").alias("n_rules"))
    # written before it is joined, so that adaptive execution can split a page that stands very often
    out = parts.join(keep(best), ["host", "path"], "left")
    return out.select(F.col("key").alias(key), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.rule_verdict", F.lit("allow")).alias("verdict"), F.coalesce("n_rules", F.lit(0)).alias("n_rules"))
