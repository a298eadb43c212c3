"""Substring deduplication by content-defined chunking: a gear rolling hash cuts texts at content, equal chunks are found by
digest, and runs of chunks that repeat together are passages. An insertion moves no cut beyond the words around it.

Cuts fall after white space only, where the gear hash of the last WINDOW bytes is in the lowest 1/`words_per_chunk` of its range, so
chunks are whole words and a passage keeps its chunks wherever it stands. Text without white space for LONGEST bytes is cut there.

From each chunk on, `least_words` words make a window, and so do the last ones of a text. A window is repeated if its digest, taken over all its
bytes, stands in another document too (what repeats within one document only is left alone); chunks that repeat one by one, each beside others, prove
nothing. Repeated windows that overlap or touch make a passage, and shorter repeats (stock phrases) stay. The first place of a window, by doc_id and
position, is kept and every later one is cut. Counts combine before the shuffle and are written before they are joined, so that adaptive
execution splits the joins and a passage that a third of all documents hold makes no large task.

Defined results: null and empty texts have no chunks; equal rows under one doc_id are one document, different texts under one doc_id are documents of
their own (told apart by 32 bits of the text's hash); rows without a doc_id pass untouched; text that was null stays null; other columns, whatever their
names, stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import keep, modest
from .textbytes import SPACE, chunks, mix, power_table

WINDOW, LONGEST = 8, 4096
#: Bits for the second of two numbers that share one: enough for any length of a text. ROW: for the part of a text's hash that tells rows of one doc_id apart.
BITS, ROW = 31, 32
_U = np.uint64
GEAR = (mix(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15)) >> _U(48)).astype(np.uint16)


def gear(data: np.ndarray) -> np.ndarray:
    """At each byte the gear hash modulo 2**16 of the last WINDOW bytes: sum of GEAR[byte] << distance."""
    h = GEAR[data]
    step = 1
    while step < WINDOW:
        h[step:] = h[step:] + (h[:-step] << np.uint16(step))
        step *= 2
    return h


def cut_points(offsets: np.ndarray, data: np.ndarray, words_per_chunk: int) -> np.ndarray:
    """Ends of all chunks, rising; every end of a row that isn't empty is one."""
    ends = np.flatnonzero(SPACE[data] & (gear(data) < np.uint16(65536 // words_per_chunk))) + 1
    ends = ends[ends - offsets[np.searchsorted(offsets, ends - 1, "right") - 1] >= WINDOW]  # the window lies within the row
    ends = np.union1d(ends, offsets[1:][np.diff(offsets) > 0])
    long = np.flatnonzero(np.diff(ends, prepend=0) > LONGEST)
    if len(long):
        more = []
        for k in long:
            at = (ends[k - 1] if k else 0) + LONGEST
            while at < ends[k]:
                while at < ends[k] and data[at] & 0xC0 == 0x80:
                    at += 1  # not inside a character
                more.append(at)
                at += LONGEST
        ends = np.union1d(ends, np.array(more, np.int64))
    return ends


def windows(docs: DataFrame, least_words: int, words_per_chunk: int) -> DataFrame:
    """(doc_id, windows array<struct<digest, place, tag>>); place holds start and bytes of a window, tag its first word's number and the row's hash."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = batch.column(1).to_numpy() & ((1 << ROW) - 1)
            for first, end, offsets, data in chunks(batch.column(2)):
                data = np.where(SPACE[data], np.uint8(32), data)  # one kind of white space is as good as another
                ends = cut_points(offsets, data, words_per_chunk)
                starts = np.concatenate(([0], ends[:-1])).astype(np.int64) if len(ends) else ends
                up, down = power_table(len(data) + 1)
                total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + _U(1)) * down[: len(data)])))
                inside = ~SPACE[data]
                begins = inside & ~np.concatenate((np.zeros(1, bool), inside[:-1])) if len(data) else inside
                begins[offsets[:-1][offsets[:-1] < len(data)]] |= inside[offsets[:-1][offsets[:-1] < len(data)]]
                seen = np.concatenate(([0], np.cumsum(begins)))
                row = np.searchsorted(offsets[1:], starts, "right")
                outside = np.concatenate((~inside[1:], np.ones(1, bool))) if len(data) else inside
                outside[offsets[1:][offsets[1:] > 0] - 1] = True
                first_byte, word_end = np.flatnonzero(begins), np.flatnonzero(inside & outside) + 1
                tail = np.flatnonzero(seen[offsets[1:]] - seen[offsets[:-1]] >= least_words)
                starts = np.concatenate((starts, first_byte[seen[offsets[1:][tail]] - least_words]))
                row = np.concatenate((row, tail))
                whole = seen[starts] + least_words <= seen[offsets[1:]][row]
                starts, order = np.unique(starts[whole], return_index=True)
                row = row[whole][order]
                ends = word_end[seen[starts] + least_words - 1]
                digest = mix((total[ends] - total[starts]) * up[starts] + (ends - starts).astype(np.uint64) * _U(0xD6E8FEB86659FD93))
                low = np.searchsorted(row, np.arange(end - first + 1)).astype(np.int32)
                place = ((starts - offsets[row]) << BITS) | (ends - starts)
                tag = ((seen[starts] - seen[offsets[row]]) << ROW) | hashes[first:end][row]
                parts = pa.StructArray.from_arrays([pa.array(digest.view(np.int64)), pa.array(place.astype(np.int64)), pa.array(tag.astype(np.int64))], ["digest", "place", "tag"])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), pa.ListArray.from_arrays(pa.array(low), parts)], ["doc_id", "windows"])

    modest(docs.sparkSession)
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("bigint"), F.xxhash64(text), text).mapInArrow(run, "doc_id bigint, windows array<struct<digest:bigint,place:bigint,tag:bigint>>")


def _row(text: Column) -> Column:
    return F.xxhash64(text.cast("string")).bitwiseAND((1 << ROW) - 1)


def passage_windows(docs: DataFrame, least_words: int = 20, words_per_chunk: int = 4) -> DataFrame:
    """(doc_id, row, start, end, first_word, last_word, first, first_doc_id): repeated windows. first: not to be cut.

    Texts are cut twice, once to count digests and once to find their places: cheaper than to store all windows in between.
    """
    cut = windows(docs.where("doc_id is not null"), least_words, words_per_chunk)
    often = keep(cut.select(F.explode(F.array_distinct("windows.digest")).alias("digest")).groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest"))
    each = cut.select("doc_id", F.explode("windows").alias("w")).select("doc_id", "w.digest", "w.place", "w.tag")
    rows = keep(each.join(often, "digest").select("doc_id", "digest", "place", "tag"))
    row, start = F.col("tag").bitwiseAND((1 << ROW) - 1).alias("row"), F.shiftright("place", BITS).alias("start")
    sites = rows.groupBy("digest").agg(F.min(F.struct("doc_id", row, start)).alias("origin"), F.max(F.struct("doc_id", row)).alias("last"))
    # what stands in several rows of one document only is no passage
    origin = keep(sites.where("origin.doc_id <> last.doc_id or origin.row <> last.row").select("digest", F.col("origin.doc_id").alias("first_doc_id"), F.col("origin.row").alias("o_row"), F.col("origin.start").alias("o_start")))
    end, word = start + F.col("place").bitwiseAND((1 << BITS) - 1), F.shiftright("tag", ROW)
    at = rows.join(origin, "digest").select("doc_id", row, start, end.alias("end"), word.alias("first_word"), (word + least_words).alias("last_word"), "first_doc_id", "o_row", "o_start")
    first = (F.col("first_doc_id") == F.col("doc_id")) & (F.col("o_row") == F.col("row")) & (F.col("o_start") == F.col("start"))
    return at.withColumn("first", first).drop("o_row", "o_start")


def repeated_passages(docs: DataFrame, least_words: int = 20, words_per_chunk: int = 4) -> DataFrame:
    """(doc_id, start, bytes, words, cut_bytes, first_doc_id, kept): one row per passage of a document. kept: nothing of it is cut."""
    by_doc = Window.partitionBy("doc_id", "row").orderBy("start", "end")
    before = by_doc.rowsBetween(Window.unboundedPreceding, -1)
    later = F.max(F.when(~F.col("first"), F.col("end"))).over(before)
    p = passage_windows(docs, least_words, words_per_chunk)
    p = p.withColumn("opens", F.when(F.col("start") <= F.max("end").over(before), 0).otherwise(1)).withColumn("cut", F.when(F.col("first"), 0).otherwise(F.greatest(F.col("end") - F.greatest("start", later), F.lit(0))))
    p = p.withColumn("passage", F.sum("opens").over(by_doc.rowsBetween(Window.unboundedPreceding, 0)))
    out = p.groupBy("doc_id", "row", "passage").agg(F.min("start").alias("start"), (F.max("end") - F.min("start")).alias("bytes"), (F.max("last_word") - F.min("first_word")).alias("words"), F.sum("cut").alias("cut_bytes"), F.min("first_doc_id").alias("first_doc_id"))
    return out.drop("passage", "row").withColumn("kept", F.col("cut_bytes") == 0)


def without_repeats(docs: DataFrame, least_words: int = 20, words_per_chunk: int = 4) -> DataFrame:
    """docs with every later place of a repeated passage cut from text; documents left without any word by it are dropped."""
    names = docs.columns
    own_id, own_row, own_cuts = (next(n for k in range(len(names) + 1) if (n := f"__{x}{k}") not in names) for x in ("id", "row", "cuts"))
    p = passage_windows(docs, least_words, words_per_chunk).where(~F.col("first"))
    cuts = p.groupBy(F.col("doc_id").alias(own_id), F.col("row").alias(own_row)).agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias(own_cuts))
    joined = docs.join(cuts, (docs["doc_id"].cast("bigint") == F.col(own_id)) & (_row(docs["text"]) == F.col(own_row)), "left")
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, out, alive = batch.column(at).to_pylist(), [], []
            for text, own in zip(texts, batch.column(len(names)).to_pylist(), strict=True):
                if own and text is not None:
                    raw, left, end = text.encode(), [], 0
                    for x in own:
                        left.append(raw[end : x["start"]])
                        end = max(end, x["end"])
                    left.append(raw[end:])
                    text = b"".join(left).decode("utf-8", "replace")
                    alive.append(bool(text.strip()))
                else:
                    alive.append(True)
                out.append(text)
            columns = [batch.column(i) if i != at else pa.array(out, pa.string()) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays(columns, names).filter(pa.array(alive, pa.bool_()))

    fixed = joined.select(*names, own_cuts).withColumn("text", F.col("text").cast("string"))
    return fixed.mapInArrow(run, fixed.drop(own_cuts).schema)
