"""Token totals by source, language and tokenizer version, maintained by signed changes.

A change is a document's count with a sign: +n when it comes, -n when it goes, both when its count is revised. A batch of
changes is added up to a few rows before it is written, under its own id, so totals are a sum over committed batches and
never need the documents again. Committing an id again does nothing; a batch that died half-way has no _SUCCESS mark,
isn't read, and is overwritten by its retry. Compaction carries the ids of the batches it adds up into the new table, so a batch sent again
afterwards is still known.

Changes are made from rows, not from ids: an insert of a row and its later delete or revision come from the same row of the counts, so rows that share
a doc_id or have none keep their own counts.

Defined results: null text counts as empty; null source, language or doc_id are values like others; repeated rows count each for themselves;
a group whose documents have all gone stays with zeros until compaction drops it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import modest
from .tokens import encode_words

KEYS = ["source", "lang", "tokenizer"]
CHANGES = "source string, lang string, tokenizer string, docs bigint, tokens bigint"
GROUP = 256


def counted(docs: DataFrame, path: str, version: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, source, lang, carried columns, tokenizer, tokens) for whole texts. carry: columns that come along, such as what tells an old text from a new one."""
    first = len(carry) + 3

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, GROUP):
                some = batch.slice(at, GROUP)
                n = [len(x) // 4 for x in encode_words([t or "" for t in some.column(first).to_pylist()], path)]
                yield pa.RecordBatch.from_arrays([*some.columns[:first], pa.array([version] * len(n)), pa.array(n, pa.int64())], ["doc_id", "source", "lang", *carry, "tokenizer", "tokens"])

    modest(docs.sparkSession)
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    plain = docs.select("doc_id", *(F.col(x).cast("string").alias(x) for x in ("source", "lang")), *carry, F.col("text").cast("string").alias("text"))
    carried = "".join(f", `{c}` {kinds[c]}" for c in carry)
    return plain.mapInArrow(run, f"doc_id {kinds['doc_id']}, source string, lang string{carried}, tokenizer string, tokens bigint")


def inserts(counts: DataFrame) -> DataFrame:
    return counts.select("doc_id", *KEYS, F.lit(1).cast("bigint").alias("docs"), "tokens")


def deletes(counts: DataFrame) -> DataFrame:
    return counts.select("doc_id", *KEYS, F.lit(-1).cast("bigint").alias("docs"), (-F.col("tokens")).alias("tokens"))


def revisions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Changes that turn the counts of `old` into those of `new`."""
    return deletes(old).unionByName(inserts(new))


def _path(spark: SparkSession, name: str):
    return spark._jvm.org.apache.hadoop.fs.Path(name)


def _exists(spark: SparkSession, name: str) -> bool:
    path = _path(spark, name)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def _carried(spark: SparkSession, table: str) -> DataFrame:
    """(batch): ids of batches that compaction has added up in this table."""
    where = f"{table.rstrip('/')}/carried"
    return spark.read.schema("batch bigint").parquet(where) if _exists(spark, f"{where}/_SUCCESS") else spark.createDataFrame([], "batch bigint")


def commit(changes: DataFrame, table: str, batch_id: int) -> bool:
    """Adds a batch of changes to the table (a folder that all executors share) once; False if it was there, by itself or within a compacted one."""
    spark = changes.sparkSession
    folder = f"{table.rstrip('/')}/batch={batch_id}"
    if _exists(spark, f"{folder}/_SUCCESS") or _carried(spark, table).where(F.col("batch") == batch_id).limit(1).count():
        return False
    changes.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).write.mode("overwrite").parquet(folder)
    return True


def committed(spark: SparkSession, table: str) -> list[str]:
    """Folders of whole batches."""
    root = _path(spark, table)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(root):
        return []
    found = [str(x.getPath()) for x in files.listStatus(root) if x.getPath().getName().startswith("batch=")]
    return sorted(x for x in found if files.exists(_path(spark, f"{x}/_SUCCESS")))


def totals(spark: SparkSession, table: str) -> DataFrame:
    """(source, lang, tokenizer, docs, tokens): sums over committed batches."""
    folders = committed(spark, table)
    changes = spark.read.schema(CHANGES).parquet(*folders) if folders else spark.createDataFrame([], CHANGES)
    return changes.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))


def compact(spark: SparkSession, table: str, into: str) -> None:
    """Writes the totals as one batch of a new table, without groups that are empty, and beside it the ids of all batches they hold."""
    names = [x.rsplit("=", 1)[1] for x in committed(spark, table)]
    own = spark.createDataFrame([(int(n),) for n in names if n != "compacted"], "batch bigint")
    into = into.rstrip("/")
    own.unionByName(_carried(spark, table)).distinct().write.mode("overwrite").parquet(f"{into}/carried")
    totals(spark, table).where("docs <> 0 or tokens <> 0").write.mode("overwrite").parquet(f"{into}/batch=compacted")
