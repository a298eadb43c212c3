"""What several operators need: a place for intermediate tables, and connected components as joins."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession) -> str:
    """A folder that driver and executors share: spark.checkpoint.dir, or an own one where that is unset and the master is local."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", where)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(where)
    return where


_kept: list[str] = []


def kept_since(spark: SparkSession) -> int:
    """A mark for release()."""
    return len(_kept)


def release(spark: SparkSession, mark: int = 0) -> None:
    """Deletes the tables written by keep() since the mark. Only for callers that have written what they read from them."""
    for path in _kept[mark:]:
        name = spark._jvm.org.apache.hadoop.fs.Path(path)
        name.getFileSystem(spark._jsc.hadoopConfiguration()).delete(name, True)
    del _kept[mark:]


#: Bytes that go to a Python worker at once: bounds its memory, and the buffers of its executor.
BATCH = 4 << 20


def modest(spark: SparkSession) -> None:
    """Has the session hand at most BATCH bytes to a Python worker at once; a smaller setting stays. Spark reads it when a result is computed, so it isn't set back."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = re.fullmatch(r"(-?\d+)b?", spark.conf.get(name))
    if not now or not 0 < int(now[1]) <= BATCH:
        spark.conf.set(name, str(BATCH))


def keep(df: DataFrame) -> DataFrame:
    """df, written as Parquet to the shared folder and read again: lineage ends here, and a lost executor costs nothing.

    The table stays until release(), since what the caller builds on it is lazy.
    """
    spark = df.sparkSession
    path = f"{scratch(spark).rstrip('/')}/kept-{uuid.uuid4().hex}"
    modest(spark)
    df.write.parquet(path)
    _kept.append(path)
    return spark.read.schema(df.schema).parquet(path)


#: Places of the bit table of among(): two megabytes at most are broadcast, whatever the tables.
PLACES = 1 << 24


def among(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """The rows of df whose key is in ids (one column), and a few others: an exact join must follow.

    Keys are hashed to PLACES bits, 63 to a row of a table that is broadcast, so that most rows an exact join would drop aren't shuffled for
    it. With very many ids it lets most rows through, which costs time and loses nothing.
    """
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(PLACES))
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("bigint"), (place(c) % 63).cast("int"))
    only = ids.columns[0]
    bits = ids.select(F.floor(place(only) / 63).alias("__cell"), bit(only).alias("__bit")).groupBy("__cell").agg(F.bit_or("__bit").alias("__bits"))
    marked = df.withColumn("__cell", F.floor(place(key) / 63)).join(F.broadcast(bits), "__cell")
    return marked.where(F.col("__bits").bitwiseAND(bit(key)) != 0).select(*df.columns)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node that `edges` (a, b; either way round, any repeats) reach from each node.

    Each round sends every node to its smallest neighbour and contracts the edges; the rounds are logarithmic in a
    component's width. Only a count of edges reaches the driver. Minima combine before the shuffle, and joins on a
    node that many edges share are ones that adaptive execution splits. Nulls and loops are left out.
    """
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    live = keep(both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    steps = []
    while live.limit(1).count():
        up = keep(live.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("p")))
        steps.append(up)
        left = up.select("u", F.col("p").alias("pu"))
        right = up.select(F.col("u").alias("v"), F.col("p").alias("pv"))
        live = keep(live.join(left, "u").join(right, "v").where("pu <> pv").select(F.col("pu").alias("u"), F.col("pv").alias("v")).distinct())
    if not steps:
        return both.select(F.col("u").alias("node"), F.col("v").alias("component")).limit(0)
    out = steps[0].select(F.col("u").alias("node"), F.col("p").alias("component"))
    for up in steps[1:]:
        out = out.join(up.select(F.col("u").alias("component"), "p"), "component", "left").select("node", F.coalesce("p", "component").alias("component"))
    return out
