"""Nearest vectors by cosine."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def top_k(vectors: DataFrame, target: list[float], k: int = 5, key: str = "vec_id") -> DataFrame:
    """The k vectors nearest to one target: rows are scored where they lie and each task sends k."""
    norm = float(np.linalg.norm(target)) or 1.0
    unit = F.array(*(F.lit(float(x) / norm) for x in target))
    cosine = dot(F.col("embedding"), unit) / F.sqrt(dot(F.col("embedding"), F.col("embedding")))
    return vectors.where("embedding is not null").withColumn("cosine", cosine).orderBy(F.desc(F.round("cosine", 9)), key).limit(k)


#: Vectors, and questions, that are compared at once.
PIECE = 2048


def nearest(questions: DataFrame, vectors: DataFrame, k: int = 5, question: str = "question", key: str = "vec_id") -> DataFrame:
    """(question, key, cosine): the k vectors nearest to each question (question, embedding), by cosine rounded to nine places, then key.

    Vectors and questions are cut into pieces; each piece of vectors meets each piece of questions in one matrix product that sends on k rows a
    question, and the best k of those are picked by question. Vectors that are null, zero or of another width than a question are near to none.
    """
    def pieces(df: DataFrame, name: str) -> tuple[DataFrame, int]:
        df = df.select(F.col(name).cast("bigint").alias("id"), F.col("embedding").cast("array<double>").alias("v")).where("id is not null and v is not null")
        n = max(1, -(-df.count() // PIECE))
        return df.groupBy(F.pmod(F.xxhash64("id"), F.lit(n)).alias("piece")).agg(F.collect_list(F.struct("id", "v")).alias("rows")), n

    asked, many = pieces(questions, question)
    known, _ = pieces(vectors, key)
    tasks = known.select(F.col("rows").alias("known"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(many - 1).cast("bigint"))).alias("piece")).join(asked.withColumnRenamed("rows", "asked"), "piece").select("asked", "known")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                sides = []
                for c in (0, 1):
                    rows = [(r["id"], np.array(r["v"], float)) for r in batch.column(c)[i].as_py() if None not in r["v"]]
                    sides.append([(a, x / np.linalg.norm(x)) for a, x in rows if len(x) and np.isfinite(x).all() and np.linalg.norm(x) > 0])
                out: list[tuple[int, int, float]] = []
                for width in {len(x) for _, x in sides[0]}:
                    q, v = ([(a, x) for a, x in side if len(x) == width] for side in sides)
                    if not v:
                        continue
                    ids = np.array([a for a, _ in v])
                    scores = np.stack([x for _, x in q]) @ np.stack([x for _, x in v]).T
                    for (name, _), row in zip(q, scores, strict=True):
                        best = np.lexsort((ids, -np.round(row, 9)))[:k]
                        out += [(name, int(ids[j]), float(row[j])) for j in best]
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.float64())], [question, key, "cosine"])

    found = tasks.mapInArrow(run, f"{question} bigint, {key} bigint, cosine double")
    place = F.row_number().over(Window.partitionBy(question).orderBy(F.desc(F.round("cosine", 9)), key))
    return found.withColumn("k", place).where(F.col("k") <= k).drop("k")
