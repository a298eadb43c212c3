"""The vector index against the exact search: recall at two sizes, hot lists, odd rows, later batches."""

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from signalwatch.operators import vector_index as vi
from signalwatch.operators.vectors import nearest


def share(got, want):
    return len({(r["question"], r["vec_id"]) for r in got} & {(r["question"], r["vec_id"]) for r in want}) / len(want)


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall(spark, tmp_path, sf):
    rows = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    asked = rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("question"), "embedding")
    index = vi.built(rows, str(tmp_path / "index"))
    assert 1 < index.probes < len(index.centroids)
    want = nearest(asked, rows, 5).collect()
    got = vi.search(vi.opened(spark, index.path), asked).collect()
    assert share(got, want) >= 0.9 and len(got) == len(want)
    cosine = {(r["question"], r["vec_id"]): r["cosine"] for r in want}
    assert all(abs(r["cosine"] - cosine.get((r["question"], r["vec_id"]), r["cosine"])) < 1e-9 for r in got)
    everywhere = vi.search(index, asked, probes=len(index.centroids)).collect()
    assert {(r["question"], r["vec_id"]) for r in everywhere} == {(r["question"], r["vec_id"]) for r in want}


def test_clusters_need_few_probes(spark, tmp_path, monkeypatch):
    """Where vectors cluster, few lists hold the nearest; a third of all rows are one vector, in pieces."""
    monkeypatch.setattr(vi, "PIECE", 50), monkeypatch.setattr(vi, "BLOCK", 8)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 16))
    points = [(i, (centres[i % 20] + 0.1 * rng.normal(size=16)).tolist()) for i in range(600)] + [(i, centres[3].tolist()) for i in range(600, 900)]
    rows = spark.createDataFrame(points, "vec_id long, embedding array<double>")
    index = vi.built(rows, str(tmp_path / "index"), lists=20, recall=0.9)
    assert index.probes <= 5
    asked = rows.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "question")
    assert share(vi.search(index, asked).collect(), nearest(asked, rows, 5).collect()) >= 0.9
    one = vi.search(index, asked.where("question = 0"))
    assert len(one.select(F.col("vec_id")).collect()) == 5


def test_odd_rows_and_batches(spark, tmp_path):
    kind = "vec_id long, embedding array<double>, list int"
    good = [(i, [float(i % 5 - 2), 1.0, float(i % 3)], 0) for i in range(40)]
    odd = [(None, [1.0, 1.0, 1.0], 0), (90, None, 0), (91, [0.0, 0.0, 0.0], 0), (92, [1.0, None, 1.0], 0), (93, [float("nan"), 1.0, 1.0], 0), (94, [1.0, 1.0], 0), (95, [], 0), (96, [1e200, 1e200, 1e200], 0)]
    index = vi.built(spark.createDataFrame(good + odd, kind), str(tmp_path / "index"), lists=4, recall=1.0)
    asked = spark.createDataFrame([(7, [1.0, 1.0, 1.0]), (8, None), (9, [1.0, 1.0]), (10, [0.0, 0.0, 0.0])], "question long, embedding array<double>")
    got = vi.search(index, asked, 50, probes=4).collect()
    assert {r["question"] for r in got} == {7} and {r["vec_id"] for r in got} <= {*range(40), 96}
    late = spark.createDataFrame([(500, [1.0, 1.0, 1.0], 0)], kind)
    for _ in range(2):  # a batch that is sent again is there once
        vi.add(index, late, 1)
    first = vi.search(vi.opened(spark, index.path), asked, 3, probes=4).orderBy(F.desc(F.round("cosine", 9)), "vec_id").collect()
    assert [r["vec_id"] for r in first].count(500) == 1 and all(abs(r["cosine"] - 1) < 1e-9 for r in first)
    with pytest.raises(ValueError):
        vi.built(spark.createDataFrame(odd[1:3], kind), str(tmp_path / "none"))


def test_the_sample(spark, monkeypatch):
    """It is a written table, of the rows with the smallest hashes of all."""
    monkeypatch.setattr(vi, "SAMPLE", 100)
    rows = spark.range(1000).select("id", F.encode(F.col("id").cast("string"), "utf-8").alias("v"))
    got = vi._sample(rows, 1000)
    assert "Limit" not in (plan := got._jdf.queryExecution().executedPlan().toString()) and "TakeOrdered" not in plan
    assert {r["id"] for r in got.collect()} == {r["id"] for r in rows.orderBy(F.xxhash64("id")).limit(100).collect()}
    same = rows.withColumn("id", F.lit(1).cast("bigint"))
    assert vi._sample(same, 1000).count() == 100 and vi._sample(rows.limit(50), 50).count() == 50


def test_fitting_is_bounded(monkeypatch):
    """Scores are told block by block: the driver never holds all points times all lists."""
    points = np.random.default_rng(1).normal(size=(4000, 8))
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    tracemalloc.start()
    fitted = vi._fitted(points, 512, 2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 * 4000 * 512 / 2 and fitted.shape == (512, 8)
    monkeypatch.setattr(vi, "BLOCK", 10_000)
    assert np.allclose(vi._fitted(points, 512, 2), fitted)


def test_vectors_are_not_broadcast(spark, tmp_path):
    """However small their files are, neither vectors nor questions go through the driver."""
    rows = spark.range(400).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0), (F.col("id") % 3).cast("double"), F.lit(2.0)).alias("embedding"))
    found = vi.search(vi.built(rows, str(tmp_path / "index")), rows.withColumnRenamed("vec_id", "question"), 3)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and found.count() == 1200
