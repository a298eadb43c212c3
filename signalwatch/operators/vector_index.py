"""A partitioned vector index: lists of vectors around centroids, kept as table partitions, and search by an equi-join on the lists that are probed.

Building fits centroids on a bounded sample, sends every vector to the list of its nearest one, and learns from a bounded set of questions, answered
exactly over all vectors, how many lists must be probed for the recall that is asked. Searching sends each question to that many lists, meets
the lists' vectors there in bounded pieces, and ranks by exact cosine. operators.vectors.nearest stays as the exact search.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.scratch import written

#: Rows that centroids are fitted on, questions that probes are learned from, and lists, at most.
SAMPLE, ASKED, LISTS = 20_000, 256, 1024
#: Vectors of a list, and questions, that are compared at once.
PIECE, BLOCK = 4096, 256


@dataclass
class VectorIndex:
    """path: a folder that all executors share. probes: lists to probe for the recall that was asked when it was built."""

    path: str
    centroids: np.ndarray
    probes: int
    recall: float

    @property
    def width(self) -> int:
        return self.centroids.shape[1]


def usable(vectors: DataFrame, key: str) -> DataFrame:
    """(id, v): unit vectors as bytes of doubles; rows with a null id, or a vector that is null, zero or not finite, are in no index."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for raw in batch.column(1).to_pylist():
                x = np.array(raw, float) if raw and None not in raw else np.zeros(1)
                size = float(np.linalg.norm(x))
                out.append((x / size).tobytes() if np.isfinite(size) and size > 0 else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["id", "v"])

    rows = vectors.select(F.col(key).cast("bigint").alias("id"), F.col("embedding").cast("array<double>").alias("v")).where("id is not null and v is not null")
    return rows.mapInArrow(run, "id bigint, v binary").where("v is not null")


def _stack(raw: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(raw), float).reshape(-1, width)


def _fitted(points: np.ndarray, lists: int, rounds: int = 10) -> np.ndarray:
    """Spherical k-means: unit centroids."""
    rng = np.random.default_rng(7)
    centroids = points[rng.choice(len(points), min(lists, len(points)), replace=False)]
    for _ in range(rounds):
        # by blocks: scores of all points at once are 164 MB on the driver for 20,000 points and 1,024 lists
        own = np.concatenate([np.argmax(points[at : at + BLOCK] @ centroids.T, 1) for at in range(0, len(points), BLOCK)])
        total = np.zeros_like(centroids)
        np.add.at(total, own, points)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        centroids = np.where(size > 1e-12, total / np.maximum(size, 1e-12), centroids)
    return centroids


def _listed(rows: DataFrame, centroids: np.ndarray, probes: int = 1) -> DataFrame:
    """rows (id, v) once for each of their `probes` nearest lists: (id, v, list)."""
    width = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = np.argsort(-(_stack(batch.column(1).to_pylist(), width) @ centroids.T), 1, kind="stable")[:, :probes]
                rows = pa.array(np.repeat(np.arange(batch.num_rows), near.shape[1]))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(near.ravel().astype(np.int32))], ["id", "v", "list"])

    return rows.where(F.length("v") == 8 * width).mapInArrow(run, "id bigint, v binary, list int")


def add(index: VectorIndex, vectors: DataFrame, batch: int, key: str = "vec_id") -> None:
    """Puts vectors into their lists, as one batch: sent again, it takes its own place. Vectors of another width than the index are left out."""
    rows = written(_listed(usable(vectors, key), index.centroids), "listed")
    # a list that many vectors share is written by as many tasks as it has pieces; there are at most LISTS lists
    sizes = rows.groupBy("list").agg(F.ceil(F.count("*") / PIECE).cast("int").alias("pieces"))
    piece = F.pmod(F.xxhash64("id"), F.col("pieces")).cast("int")
    rows.join(F.broadcast(sizes), "list").repartition("list", piece).select("id", "v", "list").write.mode("overwrite").partitionBy("list").parquet(f"{index.path}/lists/batch={batch}")


def _sample(rows: DataFrame, n: int) -> DataFrame:
    """SAMPLE of the n rows at most: those whose ids have the smallest hashes.

    A slice of hashes that holds about twice as many is ranked, so that the task that ranks what the others found doesn't get SAMPLE rows of each. Where ids
    repeat so that the slice holds too few, all rows are ranked.
    """
    ranked = lambda df: df.orderBy(F.xxhash64("id"), "id").limit(SAMPLE)
    if n <= 2 * SAMPLE:
        return written(ranked(rows), "sample")
    upto = -(1 << 63) + int((1 << 64) * (2 * SAMPLE / n))
    some = written(ranked(rows.where(F.xxhash64("id") < upto)), "sample")
    return some if some.count() == SAMPLE else written(ranked(rows), "sample")


def built(vectors: DataFrame, path: str, key: str = "vec_id", k: int = 5, recall: float = 0.95, lists: int | None = None) -> VectorIndex:
    """An index of all rows of vectors (key, embedding) in a new folder; widths other than the commonest in the sample are left out.

    lists: as many as the root of the rows unless said, LISTS at most. recall: share of the k nearest that a search should find, learned from ASKED of the vectors.
    """
    path = path.rstrip("/")
    rows = written(usable(vectors, key), "usable")
    n = rows.count()
    sample = _sample(rows, n).toArrow()["v"].to_pylist()
    if not sample:
        raise ValueError("no vectors to index")
    sizes = np.array([len(x) // 8 for x in sample])
    width = int(np.bincount(sizes).argmax())
    points = _stack([x for x, size in zip(sample, sizes, strict=True) if size == width], width)
    del sample
    index = VectorIndex(path, _fitted(points, min(LISTS, lists or max(1, round(n ** 0.5)))), 1, recall)
    add(index, vectors, 0, key)
    index.probes = _probes(index, rows.where(F.length("v") == 8 * width), points[:ASKED], k)
    about = json.dumps({"probes": index.probes, "recall": recall, "width": width})
    table = [(i, [float(x) for x in c], about) for i, c in enumerate(index.centroids)]
    rows.sparkSession.createDataFrame(table, "list int, centroid array<double>, about string").coalesce(1).write.parquet(f"{path}/centroids")
    return index


def _probes(index: VectorIndex, rows: DataFrame, asked: np.ndarray, k: int) -> int:
    """The fewest lists that hold the wanted share of the k nearest of `asked` (a bounded number), which one pass over all rows finds exactly."""
    order = np.argsort(np.argsort(-(asked @ index.centroids.T), 1, kind="stable"), 1)
    centroids, width, some = index.centroids, index.width, k + 1  # a question is its own nearest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.full((len(asked), 0), 0.0)
        place = np.zeros((len(asked), 0), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _stack(batch.column(0).to_pylist(), width)
            score = np.concatenate((best, asked @ x.T), 1)
            where = np.concatenate((place, np.take_along_axis(order, np.broadcast_to(np.argmax(x @ centroids.T, 1)[None], (len(asked), len(x))), 1)), 1)
            top = np.argsort(-score, 1, kind="stable")[:, :some]
            best, place = np.take_along_axis(score, top, 1), np.take_along_axis(where, top, 1)
        q = np.repeat(np.arange(len(asked)), best.shape[1])
        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(best.ravel()), pa.array(place.ravel())], ["q", "score", "place"])

    found = rows.select("v").mapInArrow(run, "q bigint, score double, place bigint")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "place"))
    # as many rows as lists at most
    per = found.withColumn("rank", rank).where((F.col("rank") <= some) & (F.col("rank") > 1)).groupBy("place").count().collect()
    count = np.bincount([r["place"] for r in per], [r["count"] for r in per], len(centroids)) if per else np.ones(1)
    return 1 + int(np.searchsorted(np.cumsum(count) / count.sum(), index.recall - 1e-12))


def opened(spark: SparkSession, path: str) -> VectorIndex:
    """An index that was built before."""
    rows = sorted(spark.read.parquet(f"{path.rstrip('/')}/centroids").collect(), key=lambda r: r["list"])  # LISTS at most
    about = json.loads(rows[0]["about"])
    return VectorIndex(path.rstrip("/"), np.array([r["centroid"] for r in rows]), about["probes"], about["recall"])


def search(index: VectorIndex, questions: DataFrame, k: int = 5, question: str = "question", key: str = "vec_id", probes: int | None = None) -> DataFrame:
    """(question, key, cosine): of the vectors in the probed lists the k nearest to each question (question, embedding), by cosine rounded to nine places, then key. Only probed lists are read."""
    spark, width = questions.sparkSession, index.width
    asked = written(_listed(usable(questions, question), index.centroids, min(probes or index.probes, len(index.centroids))), "asked")
    probed = [r[0] for r in asked.select("list").distinct().collect()]  # LISTS at most
    stored = spark.read.schema("id bigint, v binary, batch bigint, list int").parquet(f"{index.path}/lists").where(F.col("list").isin(probed))
    size = lambda rows, most, name: rows.groupBy("list").agg(F.ceil(F.count("*") / most).cast("int").alias(name))
    piece = lambda name: F.pmod(F.xxhash64("id"), F.col(name)).cast("int")
    packed = lambda rows, most, name: rows.join(F.broadcast(size(rows, most, "n")), "list").groupBy("list", piece("n").alias(name)).agg(F.collect_list(F.struct("id", "v")).alias(f"{name}s"))
    # merged: files of vectors that repeat are small, so Spark would send such vectors, or the questions of all lists, to the driver and broadcast them
    tasks = written(packed(stored, PIECE, "piece"), "pieces").hint("merge").join(packed(asked, BLOCK, "block").hint("merge"), "list")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                (ids, v), (names, q) = ((x.field("id").to_numpy(), _stack(x.field("v").to_pylist(), width)) for x in (batch.column(c)[i].values for c in (0, 1)))
                score = q @ v.T
                best = np.array([np.lexsort((ids, -np.round(row, 9)))[:k] for row in score])
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names, best.shape[1])), pa.array(ids[best.ravel()]), pa.array(np.take_along_axis(score, best, 1).ravel())], [question, key, "cosine"])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = tasks.repartition(parts, "list", "piece", "block").select("pieces", "blocks").mapInArrow(run, f"{question} bigint, {key} bigint, cosine double")
    place = F.row_number().over(Window.partitionBy(question).orderBy(F.desc(F.round("cosine", 9)), key))
    return found.withColumn("k", place).where(F.col("k") <= k).drop("k")
