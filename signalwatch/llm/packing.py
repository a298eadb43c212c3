"""Packing by power-of-two decomposition: each document's tokens are cut into pieces of binary lengths, and each piece is a
sequence of its own, in the bucket of its length. No sequence crosses documents and none holds padding; a trainer draws
each batch from one bucket. No shuffle is needed: the pieces of a document follow from its number of tokens alone.

Defined results: null or empty text has one token, the end id; repeated rows are packed each for itself; other columns are
ignored. A document of any length is packed whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import modest
from .tokens import encode_words

#: Texts encoded together: bounds a task's memory.
GROUP = 256


def binary_lengths(n: int, most: int) -> list[int]:
    """n as full pieces of `most` and then falling powers of two; `most` is a power of two."""
    return [most] * (n // most) + [1 << k for k in range(most.bit_length() - 2, -1, -1) if n % most >> k & 1]


def packed(docs: DataFrame, path: str, end_id: int = 1, most: int = 2048, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, bucket[, input_ids]): one row per piece.

    docs: doc_id, text. path: a word-level file of `tokenizers`. bucket: the power of two that a sequence's length is; see write_buckets.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, GROUP):
                some = batch.slice(at, GROUP)
                row, start, length, crc, total, ids = [], [], [], [], [], []
                for k, own in enumerate(encode_words([t or "" for t in some.column(1).to_pylist()], path)):
                    own += tail
                    first = 0
                    for n in binary_lengths(len(own) // 4, most):
                        piece = own[4 * first : 4 * (first + n)]
                        row.append(k), start.append(first), length.append(n), crc.append(zlib.crc32(piece)), total.append(len(own) // 4)
                        if with_ids:
                            ids.append(piece)
                        first += n
                columns = [some.column(0).take(pa.array(row, pa.int32())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(length))), pa.int32()), pa.array(np.frombuffer(b"".join(ids), "<u4").astype(np.int32))))
                    names.append("input_ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    modest(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint" + ", input_ids array<int>" * with_ids
    pieces = docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, schema)
    out = pieces.withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("bigint"))
    return out.withColumn("bucket", F.round(F.log2("length")).cast("int"))


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Writes packed pieces with a folder for each bucket, so that a trainer reads sequences of one length together. No shuffle: every task writes to the buckets it has."""
    pieces.write.partitionBy("bucket").parquet(path)
