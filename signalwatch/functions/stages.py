"""Stages that can be swapped: a stage is a function from DataFrame to DataFrame under a name; models plug in as iterator pandas UDFs."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import annotate as a
from .names import hashed_rows

Stage = Callable[[DataFrame], DataFrame]
STAGES: dict[str, Stage] = {}


def stage(name: str) -> Callable[[Stage], Stage]:
    """Registers a stage; a later one of the same name takes its place."""
    def put(f: Stage) -> Stage:
        STAGES[name] = f
        return f

    return put


def applied(mentions: DataFrame, names: list[str]) -> DataFrame:
    for name in names:
        mentions = STAGES[name](mentions)
    return mentions


@stage("redact")
def _redact(df: DataFrame) -> DataFrame:
    return df.withColumn("findings", a.pii_findings(F.col("text"))).withColumn("text", a.redacted(F.col("text"), F.col("findings")))


@stage("language")
def _language(df: DataFrame) -> DataFrame:
    return df.withColumn("segments", a.language_segments(F.col("text"))).withColumn("language", a.dominant_language(F.col("segments")))


@stage("translate")
def _translate(df: DataFrame) -> DataFrame:
    """The identity, until a model takes its place: always on redacted text."""
    return df.withColumn("translated", F.when(a.needs_translation(F.col("segments")), F.col("text")))


@stage("sentiment")
def _sentiment(df: DataFrame) -> DataFrame:
    return df.withColumn("sentiment", a.sentiment(F.col("text")))


@stage("misinformation")
def _misinformation(df: DataFrame) -> DataFrame:
    return df.withColumn("misinformation", a.misinformation(F.col("text")))


def embedding(load: Callable[[], Callable[[list[str]], np.ndarray]]) -> Callable[[Column], Column]:
    """A column function from a model: `load` runs once a task and gives texts -> matrix."""
    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in batches:
            yield pd.Series(list(model(texts.fillna("").tolist()).astype("float32")), index=texts.index)

    return embed


def _blake_place(gram: str, width: int) -> tuple[int, int]:
    h = hashlib.blake2b(gram.encode(), digest_size=8).digest()
    return int.from_bytes(h[:4], "little") % width, 1 if h[4] & 1 else -1


def nonzero_weights(vectors: DataFrame) -> DataFrame:
    """(id, b, w, most) of vectors (id, v array<float>): a row for each weight that isn't zero, with its place and the largest weight's size. Zeros, which are most, never become rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w, n = batch.column(1).flatten().to_numpy(zero_copy_only=False), batch.column(1).value_lengths().fill_null(0).to_numpy()
            row = np.repeat(np.arange(len(n)), n)
            b = np.arange(len(w)) - np.repeat(np.cumsum(n) - n, n)
            most = np.zeros(len(n))
            np.maximum.at(most, row, np.abs(w))
            some = np.flatnonzero(w)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row[some])), pa.array(b[some].astype(np.int32)), pa.array(w[some]), pa.array(most[row[some]])], ["id", "b", "w", "most"])

    return vectors.select("id", "v").mapInArrow(run, f"id {vectors.schema['id'].dataType.simpleString()}, b int, w float, most double")


def md5_place(gram: str, width: int) -> tuple[int, int]:
    """The place and sign that names.hashed_vector gives a gram."""
    h = hashlib.md5(gram.encode(), usedforsecurity=False).hexdigest()
    return int(h[:8], 16) % width, 1 if int(h[8], 16) % 2 else -1


def hashed_name_model(width: int = 192, low: int = 3, high: int = 5, place: Callable[[str, int], tuple[int, int]] = _blake_place) -> Callable[[list[str]], np.ndarray]:
    """Signed feature hashing of character n-grams, unit length; `place` says where a gram goes, by default by BLAKE2b."""
    rows = hashed_rows(width, low, high, place)

    def run(texts: list[str]) -> np.ndarray:
        out = rows(texts)
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    return run


def author_digest(salt: str) -> Callable[[Column], Column]:
    """A column function: 16 digits of BLAKE2b for a handle without outer blanks and in lower case, to meet hashes made elsewhere; without a handle that of `anonymous`. annotate.author_hash stays in the JVM and is the one to take otherwise."""
    @F.pandas_udf("string")
    def digest(handles: pd.Series) -> pd.Series:
        return handles.map(lambda h: hashlib.blake2b(f"{salt}::{(h or 'anonymous').strip().lower()}".encode(), digest_size=8).hexdigest())

    return digest
