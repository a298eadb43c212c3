"""Sliding windows by signed days, against the one-window operator, and their stream."""

import datetime as dt
import random

from pyspark.sql import functions as F

from signalwatch.operators import signals
from signalwatch.streaming import jobs

OBS = "lat double, lon double, ts timestamp, weight double"


def observations(spark):
    r = random.Random(3)
    start = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    rows = [(r.uniform(-3, 3), r.uniform(-3, 3), start + dt.timedelta(days=r.choice([0, 1, 2, 3, 9, 10, 25]), seconds=r.choice([0, 0, 1, 40_000, 86_399])), r.choice([0.1, 0.2, 1.0, 2.5])) for _ in range(300)]
    rows.append((2.5, 2.5, start + dt.timedelta(days=4, microseconds=1), 1e6))
    return sorted(rows, key=lambda x: x[2])


def test_every_window_is_the_one_operator(spark):
    obs = spark.createDataFrame(observations(spark), OBS)
    odd = spark.createDataFrame([(None, 1.0, dt.datetime(2024, 1, 2), 1.0), (1.0, None, dt.datetime(2024, 1, 2), 1.0), (1.0, 1.0, None, 1.0)], OBS)
    windows = signals.poisson_windows(obs.unionByName(odd), degrees=2.0).collect()
    first = (dt.date(2024, 1, 1) - dt.date(1970, 1, 1)).days
    assert {w["until"] for w in windows} <= set(range(first, first + 33))
    plain = obs.withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    for until in (first, first + 1, first + 4, first + 8, first + 16, first + 17, first + 20, first + 32):
        now = (dt.datetime(1970, 1, 1) + dt.timedelta(days=until)).isoformat(" ")
        want = sorted(((c["centroid_lat"] / 2 - 0.5, c["centroid_lon"] / 2 - 0.5, c["population"], round(c["expected"], 6), round(c["llr"], 4)) for c in signals.poisson_clusters(plain, now, degrees=2.0).collect()))
        got = sorted((float(w["cy"]), float(w["cx"]), w["population"], round(w["rate"], 6), round(w["llr"], 4)) for w in windows if w["until"] == until)
        assert got == want, until
    assert signals.poisson_windows(obs.limit(0)).count() == 0


def test_the_stream_is_the_batch(spark, tmp_path):
    rows = observations(spark)
    land, root = str(tmp_path / "land"), str(tmp_path / "out")
    told = lambda df: sorted((r["until"], r["cy"], r["cx"], r["population"], round(r["weight"], 6), round(r["llr"], 6)) for r in df.collect())
    for i in range(3):  # a run each, so a restart between
        spark.createDataFrame(rows[i * 101 : (i + 1) * 101], OBS).coalesce(1).write.mode("append").parquet(land)
        jobs.cluster_stream(jobs.read_stream(spark, land, OBS, 1), root, str(tmp_path / "checkpoint"), degrees=2.0).start().awaitTermination()
    days = spark.read.schema(jobs.DAYS).parquet(f"{root}/days")
    closed = days.agg(F.max("day")).first()[0]
    windows = spark.read.schema(jobs.WINDOWS).parquet(f"{root}/windows/batch=*")
    assert told(windows) == told(signals.poisson_windows(spark.createDataFrame(rows, OBS), degrees=2.0).where(F.col("until") <= closed)) != []
    assert windows.select("until", "cy", "cx").distinct().count() == windows.count()
