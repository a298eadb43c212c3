"""Bucketed tables with generations, and the streams that keep their state in them."""

import math
import random

from pyspark.sql import functions as F

from signalwatch.operators import signals
from signalwatch.operators.graph import latest_by_key
from signalwatch.sources.buckets import BucketTable
from signalwatch.streaming import jobs

ROW = "k string, v int"


def rows_of(table, **how):
    return sorted(map(tuple, table.read(**how).collect()), key=repr)


def test_absent_rows_before_and_after_compaction(spark, tmp_path):
    table = BucketTable(spark, str(tmp_path / "t"), ROW, ["k"], 4)
    new = lambda *rows: spark.createDataFrame(list(rows), ROW)
    table.insert_absent(new(("a", 1), ("a", 2), ("b", 1)), 0)
    table.insert_absent(new(("b", 9), ("c", 1)), 1)
    want = [("a", 1), ("b", 1), ("c", 1)]
    assert rows_of(table) == want and rows_of(table, upto=0) == want[:2]
    table.insert_absent(new(("b", 9), ("c", 1), ("d", 1)), 1)  # sent again: nothing, whatever it holds
    assert rows_of(table) == want
    table.insert_absent(new(("e", 1)), 2)
    assert table.compact(0) and not table.compact(0)
    table.insert_absent(new(("e", 1)), 2), table.insert_absent(new(("b", 9), ("c", 1)), 1)
    assert rows_of(table) == [*want, ("e", 1)]
    table.insert_absent(new(("a", 7), ("f", 1)), 3)
    assert rows_of(table) == [*want, ("e", 1), ("f", 1)]
    assert table.vacuum(3) > 0
    table.insert_absent(new(("a", 7), ("f", 1)), 3)
    table.insert_absent(new(("a", 7), ("g", 1), (None, 1)), 4)
    assert len(rows_of(table)) == 7 and rows_of(BucketTable(spark, str(tmp_path / "t"), ROW, ["k"], 4)) == rows_of(table)


def test_only_touched_buckets_are_read(spark, tmp_path):
    table = BucketTable(spark, str(tmp_path / "t"), ROW, ["k"], 16)
    table.append(spark.range(200).select(F.col("id").cast("string").alias("k"), F.lit(1).alias("v")), 0)
    one = spark.createDataFrame([("5", 2)], ROW)
    buckets = table.touched(one)
    files = table.read(buckets).inputFiles()
    assert len(buckets) == 1 and files and all(f"bucket={buckets[0]}/" in f for f in files) and len(table.read().inputFiles()) >= 12
    unfinished = tmp_path / "t" / "delta=1" / f"bucket={buckets[0]}"
    unfinished.mkdir(parents=True)
    assert table.read().count() == 200 and not table.has(1)


def test_replaced_buckets(spark, tmp_path):
    table = BucketTable(spark, str(tmp_path / "t"), ROW, ["k"], 3)
    change = lambda old, new: latest_by_key(old.withColumn("o", F.lit(0)).unionByName(new.withColumn("o", F.lit(1))), ["k"], [F.desc("o")]).drop("o")
    for batch, rows in enumerate(([("a", 1), ("b", 1)], [("a", 2)], [("c", 3)])):
        for _ in range(2):
            table.replace(spark.createDataFrame(rows, ROW), batch, change)
    assert rows_of(table) == [("a", 2), ("b", 1), ("c", 3)] and rows_of(table, upto=0) == [("a", 1), ("b", 1)]
    table.replace(spark.createDataFrame([("a", 50)], ROW), 0, change)  # later batches have built on it
    table.vacuum(2)
    assert rows_of(table) == [("a", 2), ("b", 1), ("c", 3)]


def landed(spark, path, schema, batches):
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def test_graph_stream_through_compaction(spark, tmp_path):
    edge = "struct<src:string,dst:string,valid_from:string,evidence:string>"
    schema = f"entities array<struct<id:string,entity_type:string,name:string,confidence:double,updated:bigint>>, edges array<{edge}>"
    rng = random.Random(1)
    batches = [[([(rng.choice("abc"), "EVENT", f"n{k}", 0.9, k)], [(rng.choice("abcd"), rng.choice("abcd"), "2020", "x") for _ in range(4)])] for k in range(5)]
    landed(spark, str(tmp_path / "in"), schema, batches)
    tables = jobs.GraphTables(str(tmp_path / "out"), buckets=4)
    jobs.graph_stream(jobs.read_stream(spark, str(tmp_path / "in"), schema, 1), tables, str(tmp_path / "checkpoint"), compact_every=2).start().awaitTermination()
    jobs.compact_graph(spark, tables, 0)
    entities, edges = jobs.graph_snapshot(spark, tables)
    got = [(r["src"], r["dst"]) for r in edges.collect()]
    assert sorted(got) == sorted({e[:2] for b in batches for _, es in b for e in es})
    want = {b[0][0][0][0]: b[0][0][0][2] for b in batches}
    assert {r["id"]: r["name"] for r in entities.collect()} == want
    # all of it once more, from a new checkpoint: batches that are in change nothing
    jobs.graph_stream(jobs.read_stream(spark, str(tmp_path / "in"), schema, 1), tables, str(tmp_path / "again")).start().awaitTermination()
    assert sorted((r["src"], r["dst"]) for r in jobs.graph_snapshot(spark, tables)[1].collect()) == sorted(got)


def test_spike_stream_keeps_trends(spark, tmp_path):
    """Over many batches and a restart: the points of the batch operator, one trend a series, and days read once."""
    rng = random.Random(2)
    days = [[(k, "1", f"2024-01-{1 + d:02d} {rng.randint(0, 23):02d}:00:00") for k in ("a", "b") for _ in range(rng.choice([1, 2, 9]))] for d in range(12)]
    schema = "keyword string, district string, ts string"
    stream = lambda: jobs.read_stream(spark, str(tmp_path / "in"), schema, 1).withColumn("ts", F.col("ts").cast("timestamp"))
    tables = jobs.SpikeTables(str(tmp_path / "out"))
    for part in (days[:5], days[5:]):
        landed(spark, str(tmp_path / "in"), schema, part)
        jobs.spike_stream(stream(), tables, str(tmp_path / "checkpoint")).start().awaitTermination()
    trends = BucketTable(spark, tables.trends, jobs.TRENDS, ["keyword", "district"])
    assert trends.read().count() == 2 and len(jobs._names(spark, tables.closed, "batch")) == 2
    before = trends.read().collect()
    # the last batch once more, as after a failure before its checkpoint was written
    last = jobs._names(spark, tables.spikes, "batch")[-1]
    _, closed, _ = jobs._closed_before(spark, tables, last)
    now = jobs._closed_before(spark, tables, None)[1]
    jobs._close(spark, tables, last, closed, now, {})
    assert sorted(trends.read().collect()) == sorted(before)
    jobs.flush(spark, tables), jobs.flush(spark, tables)
    rows = [(k, d, t) for b in days for k, d, t in b]
    counts = spark.createDataFrame(rows, schema).groupBy("keyword", "district", F.datediff(F.to_date("ts"), F.lit("1970-01-01")).alias("day")).agg(F.count("*").alias("n"))
    got = {(r["keyword"], r["day"]): r for r in jobs.stored(spark, tables.spikes, jobs.SPIKES).collect()}
    want = signals.ewma_spikes(counts).collect()
    assert len(got) == len(want) == 24
    for r in want:
        g = got[r["keyword"], r["day"]]
        assert (g["n"], g["prior"], g["is_spike"]) == (r["n"], r["prior"], r["is_spike"]) and math.isclose(g["baseline"], r["baseline"], rel_tol=1e-9) and math.isclose(g["z"], r["z"], rel_tol=1e-9, abs_tol=1e-9)
