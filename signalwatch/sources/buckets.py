"""A table in buckets with generations, for streams that look up what they have stored.

Rows lie in buckets by the hash of their key. A micro-batch reads only the buckets that its own keys fall into, and writes either what it adds to them (a
delta) or their whole new contents (a base) under its own id. A folder counts once Spark has finished it, so a batch that died half-way isn't seen, and
one that is sent again writes what it wrote before, or nothing if later work has built on it. Compaction rewrites buckets with many deltas as bases;
readers go from a bucket's newest base on.

    root/base=7/bucket=12/...    the whole of bucket 12 after batch 7
    root/delta=9/bucket=12/...   what batch 9 adds to it
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class BucketTable:
    """schema: DDL of the rows. key: columns that name a bucket. buckets: fixed for the life of the table."""

    def __init__(self, spark: SparkSession, root: str, schema: str, key: list[str], buckets: int = 64) -> None:
        self.spark, self.root, self.key, self.buckets = spark, root.rstrip("/"), key, buckets
        self.schema = StructType.fromDDL(schema)

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*(F.col(c).cast("string") for c in self.key)), F.lit(self.buckets)).cast("int")

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _children(self, name: str, prefix: str) -> list[int]:
        path, files = self._path(name)
        if not files.exists(path):
            return []
        found = [x.getPath().getName() for x in files.listStatus(path)]
        return sorted(int(x.split("=", 1)[1]) for x in found if x.startswith(f"{prefix}="))

    def _finished(self, kind: str) -> list[int]:
        """Ids of finished deltas or bases: compaction keeps them few."""
        done = lambda k: (lambda p: p[1].exists(p[0]))(self._path(f"{self.root}/{kind}={k}/_SUCCESS"))
        return [k for k in self._children(self.root, kind) if done(k)]

    def _folders(self, upto: int | None) -> dict[int, list[tuple[str, int]]]:
        """For each bucket its newest base and the deltas after it, of batches up to `upto`."""
        out: dict[int, list[tuple[str, int]]] = {}
        bases = {k: self._children(f"{self.root}/base={k}", "bucket") for k in self._finished("base") if upto is None or k <= upto}
        newest = {b: k for k in sorted(bases) for b in bases[k]}
        for b, k in newest.items():
            out[b] = [("base", k)]
        for k in self._finished("delta"):
            if upto is None or k <= upto:
                for b in self._children(f"{self.root}/delta={k}", "bucket"):
                    if k > newest.get(b, -1):
                        out.setdefault(b, []).append(("delta", k))
        return out

    def read(self, buckets: list[int] | None = None, upto: int | None = None) -> DataFrame:
        """The rows of some buckets, or all, as they stand after batch `upto`, or now."""
        folders = self._folders(upto)
        paths = [f"{self.root}/{kind}={k}/bucket={b}" for b, parts in sorted(folders.items()) if buckets is None or b in buckets for kind, k in parts]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def touched(self, rows: DataFrame) -> list[int]:
        """The buckets of rows: as many numbers as there are buckets at most."""
        return sorted(r[0] for r in rows.select(self.bucket().alias("b")).distinct().collect())

    def ids(self) -> list[int]:
        """Batches that are in, as far as compaction has left them apart."""
        return sorted({*self._finished("delta"), *self._finished("base")})

    def has(self, batch: int) -> bool:
        """Whether the batch is in, by itself or within a base."""
        return batch in self._finished("delta") or any(k >= batch for k in self._finished("base"))

    def _write(self, kind: str, batch: int, rows: DataFrame) -> None:
        out = rows.select(*self.schema.names).withColumn("bucket", self.bucket())
        out.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/{kind}={batch}")

    def insert_absent(self, rows: DataFrame, batch: int, least: Column | None = None) -> None:
        """Adds those rows whose key isn't there yet, one a key (the one with the least `least`). Of what is stored only keys of touched buckets are read; a batch that is in changes nothing."""
        if self.has(batch):
            return
        rows = rows.persist()
        one = rows.groupBy(*self.key).agg(F.min_by(F.struct(*rows.columns), least if least is not None else F.struct(*self.schema.names)).alias("r")).select("r.*")
        known = self.read(self.touched(rows), batch - 1).select(*self.key)
        self._write("delta", batch, one.join(known, self.key, "left_anti"))
        rows.unpersist()

    def append(self, rows: DataFrame, batch: int) -> None:
        """Adds rows as they are; a batch that is in changes nothing."""
        if not self.has(batch):
            self._write("delta", batch, rows)

    def replace(self, rows: DataFrame, batch: int, change: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
        """Writes touched buckets anew as change(stored rows, rows), which leaves no bucket empty. A batch sent again starts from what was stored before it; one that
        later batches have built on changes nothing."""
        if any(k > batch for k in self._finished("base")):
            return
        self._write("base", batch, change(self.read(self.touched(rows), batch - 1), rows))

    def compact(self, most: int = 4, merge: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> list[int]:
        """Rewrites buckets of more than `most` folders as bases, under the id of the last batch; their numbers. merge: what becomes of a bucket's rows, such as the last
        of each key. Once for a batch: a second call waits for the next one."""
        folders = self._folders(None)
        many = sorted(b for b, parts in folders.items() if len(parts) > most)
        last = max((k for parts in folders.values() for _, k in parts), default=None)
        if not many or last in self._finished("base"):
            return []
        self._write("base", last, merge(self.read(many)))
        return many

    def vacuum(self, before: int) -> int:
        """Deletes folders of buckets that readers from batch `before` on no longer need; how many. Batches before it can't be sent again."""
        needed = {(kind, k, b) for b, parts in self._folders(None).items() for kind, k in parts}
        needed |= {(kind, k, b) for b, parts in self._folders(before - 1).items() for kind, k in parts}
        gone = 0
        for kind in ("base", "delta"):
            for k in self._finished(kind):
                for b in self._children(f"{self.root}/{kind}={k}", "bucket"):
                    if k < before and (kind, k, b) not in needed:
                        path, files = self._path(f"{self.root}/{kind}={k}/bucket={b}")
                        gone += files.delete(path, True)
        return gone
