"""A stream source counted in records: append-only logs of lines, read from the earliest on by byte offsets.

A folder holds one log a writer, as a topic has partitions; a log only grows, and its records end with a newline. An offset says how far each log is read.
A micro-batch takes `per_batch` records at most, those logs first that were read least, so none is starved. The driver only looks for where the
records of the next batch end, tasks read them; Spark keeps the offsets in its checkpoint, so a restart goes on where the last batch ended and a
batch that is tried again has the same records.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

RECORD = "log string, at bigint, value string"
NAME = "landed_records"


def _files(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def _lines(files: pafs.FileSystem, path: str, start: int, stop: int) -> Iterator[tuple[int, bytes]]:
    """(position, line) of the whole lines between two positions; a last line without its newline is still being written and isn't there yet."""
    with files.open_input_file(path) as raw:
        raw.seek(start)
        buffered = io.BufferedReader(raw, 1 << 20)
        while start < stop:
            line = buffered.readline()
            if not line.endswith(b"\n"):
                return
            yield start, line
            start += len(line)


class Slice(InputPartition):
    """Bytes of one log."""

    def __init__(self, log: str, start: int, stop: int) -> None:
        super().__init__((log, start, stop))
        self.log, self.start, self.stop = log, start, stop


class RecordReader(DataSourceStreamReader):
    def __init__(self, path: str, per_batch: int) -> None:
        self.path, self.per_batch, self.seen = path.rstrip("/"), per_batch, None

    def _sizes(self) -> dict[str, int]:
        files, root = _files(self.path)
        found = files.get_file_info(pafs.FileSelector(root, allow_not_found=True))
        return {x.base_name: x.size for x in found if x.type == pafs.FileType.File and x.base_name[0] not in "._"}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """Where the next batch ends: `per_batch` records on, or as many as are there."""
        at, left = dict(self.seen or {}), self.per_batch
        files, root = _files(self.path)
        sizes = self._sizes()
        cut = sorted(x for x in at if x in sizes and sizes[x] < at[x])
        if cut:
            raise ValueError(f"logs are shorter than what was read of them: {', '.join(cut)}")
        behind = sorted((x for x in sizes if sizes[x] > at.get(x, 0)), key=lambda x: (at.get(x, 0), x))
        for i, log in enumerate(behind):
            share = -(-left // (len(behind) - i))
            for _, (start, line) in zip(range(share), _lines(files, f"{root}/{log}", at.get(log, 0), sizes[log])):
                at[log], left = start + len(line), left - 1
            if not left:
                break
        self.seen = at
        return at

    def partitions(self, start: dict, end: dict) -> list[Slice]:
        """Spark names the last offset here after a restart, before it asks for the latest."""
        self.seen = end
        return [Slice(log, start.get(log, 0), stop) for log, stop in sorted(end.items()) if stop > start.get(log, 0)]

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        files, root = _files(self.path)
        rows: list[tuple[int, str]] = []
        size = 0
        for at, line in _lines(files, f"{root}/{partition.log}", partition.start, partition.stop):
            rows.append((at, line.rstrip(b"\r\n").decode("utf-8", "replace")))
            size += len(line)
            if size > 4 << 20:
                yield self._batch(partition.log, rows)
                rows, size = [], 0
        if rows:
            yield self._batch(partition.log, rows)

    @staticmethod
    def _batch(log: str, rows: list[tuple[int, str]]) -> pa.RecordBatch:
        at, values = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array([log] * len(rows), pa.string()), pa.array(at, pa.int64()), pa.array(values, pa.string())], ["log", "at", "value"])

    def commit(self, end: dict) -> None:
        """Logs stay as they are."""


class LandedRecords(DataSource):
    """Options: path, perBatch."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return RECORD

    def streamReader(self, schema) -> RecordReader:  # noqa: ANN001
        return RecordReader(self.options["path"], int(self.options.get("perBatch", 250)))


def record_stream(spark: SparkSession, path: str, per_batch: int = 250) -> DataFrame:
    """(log, at, value): records of the logs in `path`, at most `per_batch` a micro-batch. Without a log there is nothing yet; an empty line is an empty value; bytes
    that aren't UTF-8 become replacement characters; a log that was cut stops the stream. For processingTime triggers: Spark gives this kind of source one batch when
    started with availableNow."""
    if per_batch < 1:
        raise ValueError("a batch holds a record at least")
    spark.dataSource.register(LandedRecords)
    return spark.readStream.format(NAME).option("perBatch", per_batch).load(path)
