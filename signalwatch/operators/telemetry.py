"""Telemetry: filters, rolling means, time buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .slices import OWN, PART, PLACE, by_rows


def epoch_seconds(ts: Column) -> Column:
    """Whole seconds since 1970 of a timestamp without time zone."""
    return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))


def rolling_mean(df: DataFrame, groups: list[str], n: int, ts: str = "ts", tie: str = "event_id", value: str = "value", rows: int = 100_000) -> DataFrame:
    """df with moving_avg: mean of the last n rows of the group, fewer at its start. Filters come before it.

    A group is cut into runs of `rows` rows that carry the n - 1 before them, so neither a large group nor a table without groups is one task.
    """
    parts = by_rows(df, groups, [ts, tie], F.floor(epoch_seconds(F.col(ts)) / 3600), n - 1, rows)
    window = Window.partitionBy(*groups, PART).orderBy(ts, tie).rowsBetween(-(n - 1), 0)
    return parts.withColumn("moving_avg", F.avg(value).over(window)).where(OWN).drop(PART, OWN, PLACE)


def bucketed(df: DataFrame, groups: list[str], seconds: int, ts: str = "ts", tie: str = "event_id", value: str = "value") -> DataFrame:
    """count, mean, min, max, sample deviation and last moving average per time bucket and group; bucket in seconds."""
    bucket = (F.floor(epoch_seconds(F.col(ts)) / seconds) * seconds).cast("bigint").alias("bucket")
    v = F.col(value)
    return df.groupBy(bucket, *groups).agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.min(v).alias("low"), F.max(v).alias("high"), F.stddev_samp(v).alias("deviation"),
        F.max_by("moving_avg", F.struct(ts, tie)).alias("last_avg"))


def telemetry(df: DataFrame, groups: list[str], seconds: int, n: int, least: float | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Drop nulls, filter by value and half-open time window, rolling mean, buckets."""
    df = df.where(F.col("ts").isNotNull() & F.col("value").isNotNull())
    df = df.where(F.col("value") >= least) if least is not None else df
    df = df.where(F.col("ts") >= F.lit(start).cast("timestamp_ntz")) if start else df
    df = df.where(F.col("ts") < F.lit(end).cast("timestamp_ntz")) if end else df
    return bucketed(rolling_mean(df, groups, n), groups, seconds)
