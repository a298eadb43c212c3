"""Feeds: union, deduplication, ranking, source metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.webtext import relevance


def fingerprint(url: Column, title: Column) -> Column:
    """Host and path in lower case without a closing slash; without a URL, the title's first 80 characters as a slug."""
    host, path = F.try_parse_url(url, F.lit("HOST")), F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))
    slug = F.substring(F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), "[^a-z0-9]+", "-"), 1, 80)
    return F.when(host.isNotNull(), F.regexp_replace(F.lower(F.concat(host, path)), "/$", "")).otherwise(slug)


def merged(items: DataFrame, order: list[str]) -> DataFrame:
    """One item a fingerprint: the first by source order; newest first. items: item_id, source, url, title, published."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col("source"))
    rank = F.when(place == 0, len(order) + 1).otherwise(place)
    keyed = items.withColumn("key", fingerprint(F.col("url"), F.col("title")))
    first = F.row_number().over(Window.partitionBy("key").orderBy(rank, "item_id"))
    return keyed.withColumn("k", first).where("k = 1").drop("k").orderBy(F.desc("published"), "item_id")


def ranked(items: DataFrame, query: str, limit: int) -> DataFrame:
    """Relevant items by score, then freshness."""
    scored = items.withColumn("r", relevance(F.col("title"), F.col("url"), F.col("tags"), query)).select("*", "r.*").drop("r")
    return scored.where("relevant").orderBy(F.desc("score"), F.desc("published"), "item_id").limit(limit)


def source_metrics(items: DataFrame, fetches: DataFrame) -> DataFrame:
    """(source, count, scanned, latency, ok): items kept of those scanned. fetches: source, scanned, latency, ok."""
    kept = items.groupBy("source").agg(F.count("*").alias("count"))
    of = fetches.groupBy("source").agg(F.sum("scanned").alias("scanned"), F.avg("latency").alias("latency"), F.bool_and("ok").alias("ok"))
    return of.join(kept, "source", "left").na.fill(0, ["count"])


def buffered(known: DataFrame, new: DataFrame, cap: int, key: str = "event_id", ts: str = "ts") -> DataFrame:
    """New events that aren't known, newest first, `cap` of them."""
    return new.join(known.select(key), key, "left_anti").orderBy(F.desc(ts), key).limit(cap)


def absent(new: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    return new.join(stored.select(key), key, "left_anti")
