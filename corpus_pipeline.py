"""From raw documents to packed training sequences, in five stages that each write a table for the next.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps with their columns (doc_id, text, lang, source, n_chars),
the last one packed pieces. Near-duplicate stages take five words and a similarity of 0.8.
Other columns are dropped, so none can clash. Rows without a doc_id are left out by the stages that decide by it. Rows that share a doc_id: equal texts count
as copies, others as documents of their own, but a benchmark hit found for one decides for all of them. Null or empty texts have no
language and go with the first stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalwatch.llm.decontamination import contaminated
from signalwatch.llm.language_id import identified
from signalwatch.llm.minhash_dedup import grouped
from signalwatch.llm.packing import packed
from signalwatch.llm.queries import word_tokenizer
from signalwatch.llm.shared import keep, kept_since, release, scratch
from signalwatch.llm.substring_dedup import without_repeats

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is sure enough; lang becomes what was identified, from text, declared lang and source."""
    docs = docs.select(*COLUMNS).withColumn("row", F.xxhash64("text"))
    asked = docs.select("doc_id", "row", F.col("lang").alias("declared"), F.lit(None).cast("string").alias("suffix"), F.col("source").alias("host"), "text")
    known = identified(asked).where("kept").groupBy("doc_id", "row").agg(F.max_by("lang", F.struct("confidence", "lang")).alias("found"))
    return docs.join(known, ["doc_id", "row"]).withColumn("lang", F.col("found")).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest doc_id, of several rows with it the one whose text has the smallest hash."""
    docs = docs.select(*COLUMNS).withColumn("row", F.xxhash64("text"))
    judged = grouped(docs, shingle=5, per_cent=80).where("kept")
    kept = keep(judged.groupBy("component", "doc_id", F.when(F.col("component").isNull(), F.col("row"))).agg(F.min("row").alias("row")).select("doc_id", "row"))
    return docs.join(kept, ["doc_id", "row"], "left_semi").dropDuplicates(["doc_id", "row"]).select(*COLUMNS)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the later places of passages that repeat across documents; n_chars follows the text."""
    return without_repeats(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any ten words in a row of a benchmark item."""
    docs = docs.select(*COLUMNS)
    clean = contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("not contaminated").select("doc_id").distinct()
    return docs.join(clean, "doc_id", "left_semi").select(*COLUMNS)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of power-of-two length with their token ids."""
    return packed(docs, word_tokenizer(), end_id=1, most=2048)


STAGES = [("language", language), ("near_copies", near_copies), ("passages", passages), ("benchmark", benchmark), ("sequences", sequences)]
#: Tokenizing and hashing whole texts are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; each result is written to the shared folder and read again."""
    folder = f"{scratch(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        path, mark = f"{folder}/{k}-{name}", kept_since(spark)
        stage(spark, docs, sf_dir).write.parquet(path)
        release(spark, mark)  # the stage's result is written, so its own tables can go
        docs = spark.read.parquet(path)
    return docs
