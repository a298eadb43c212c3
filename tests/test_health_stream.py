"""Source health over micro-batches and restarts is that of one fold over all outcomes."""

import random

from signalwatch.operators import ledger
from signalwatch.streaming import jobs

SCHEMA = "source string, seq bigint, success boolean"


def test_health_over_batches_and_restarts(spark, tmp_path):
    r = random.Random(9)
    rows = [(r.choice(["hot", "hot", "hot", "a", None]), i // 4, r.choice([True, False, False, None])) for i in range(240)]  # seqs tie
    land, root = str(tmp_path / "land"), str(tmp_path / "out")
    for i in range(3):
        spark.createDataFrame(rows[i * 80 : (i + 1) * 80], SCHEMA).repartition(1).write.mode("append").parquet(land)
        jobs.health_stream(jobs.read_stream(spark, land, SCHEMA, 1), root, str(tmp_path / "checkpoint")).start().awaitTermination()
    told = lambda df: sorted((str(x["source"]), x["seq"], round(x["health"], 9), x["failures"], x["is_open"]) for x in df.collect())
    got = spark.read.schema(jobs.HEALTH).parquet(f"{root}/health/batch=*")
    assert told(got) == told(ledger.breaker(spark.createDataFrame(rows, SCHEMA))) and got.count() == 240
