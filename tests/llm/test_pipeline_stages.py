"""Stages of the pipeline one by one on odd documents: nulls, empty and repeated rows, nothing at all."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, found string"


def rows():
    r = random.Random(21)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6))) for _ in range(300)]
    texts = [" ".join(r.choice(words) for _ in range(120)) for _ in range(30)]
    out = [(i, t, "en", "s", 1, "x") for i, t in enumerate(texts)]
    near = texts[0].split()
    near[5] = "changed"
    return [*out, (50, " ".join(near), "en", None, 1, "x"), (51, None, "en", "s", None, None), (52, "", None, "s", 0, "x"), (53, "123 !!", "en", "s", 6, "x"), (54, texts[1], None, None, None, "x"), (55, "unique " + " ".join(texts[2].split()[10:90]) + " end", "en", "s", 1, "x")]


@pytest.mark.parametrize("k", range(5))
def test_stage(spark, k):
    docs = spark.createDataFrame(rows(), SCHEMA)
    name, stage = corpus_pipeline.STAGES[k]
    out = stage(spark, docs, SF)
    got = out.collect()
    ids = {r["doc_id"] for r in got}
    clean = set(range(30))
    assert clean <= ids
    if k < 4:
        assert out.columns == corpus_pipeline.COLUMNS
    if name == "language":
        assert ids == clean | {50, 54, 55} and {r["lang"] for r in got} == {"en"}
    if name == "near_copies":
        assert ids == clean | {51, 52, 53, 55}
    if name == "passages":
        text = {r["doc_id"]: r["text"] for r in got}
        assert text[0] == rows()[0][1] and 54 not in text and len(text[55].split()) < 40 and text[51] is None and text[52] == ""
        assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in got)
    if name == "benchmark":
        item = spark.read.parquet(f"{SF}/benchmark.parquet").first()["text"]
        leaked = docs.limit(1).withColumn("text", F.concat(F.lit("so "), F.lit(item))).withColumn("doc_id", F.lit(99).cast("long"))
        assert ids == {r[0] for r in rows()} and stage(spark, leaked, SF).count() == 0
    if name == "sequences":
        assert ids == {r[0] for r in rows()}
    assert stage(spark, docs.limit(0), SF).count() == 0
