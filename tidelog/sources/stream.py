"""A Python data source over log segments, for batch and streaming reads with offsets by partition."""

from __future__ import annotations

import glob
import itertools
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from tidelog.sources.codec import decode_log

SCHEMA = "topic string, partition int, offset bigint, timestamp_unix_ns bigint, key binary, value binary, encoded_byte_size bigint"

#: records of one Arrow batch
BATCH_ROWS = 1 << 14
_COLUMNS = [("topic", pa.string()), ("partition", pa.int32()), ("offset", pa.int64()), ("timestamp_unix_ns", pa.int64()), ("key", pa.binary()), ("value", pa.binary()), ("encoded_byte_size", pa.int64())]


class Span(InputPartition):
    def __init__(self, folder: str, start: int, end: int):
        self.folder, self.start, self.end = folder, start, end


def _folders(path: str) -> list[str]:
    return sorted(f for f in glob.glob(os.path.join(path, "*", "[0-9]" * 6)) if os.path.isdir(f))


def _records(folder: str, start: int, end: int) -> Iterator[tuple]:
    topic, partition = os.path.basename(os.path.dirname(folder)), int(os.path.basename(folder))
    files = sorted(glob.glob(os.path.join(folder, "[0-9]" * 20 + ".log")))
    bases = [int(os.path.basename(f)[:20]) for f in files]
    for k, f in enumerate(files):
        if bases[k] >= end or (k + 1 < len(files) and bases[k + 1] <= start):
            continue  # the segment's names bound its offsets
        with open(f, "rb") as data:
            for _, _, found, problem in decode_log(data.read()):
                if problem:
                    return
                for offset, nanos, key, value, size in found:
                    if start <= offset < end:
                        yield topic, partition, offset, nanos, key, value, size


def _next(folder: str) -> int:
    """The offset after the last record: of the last segment only, as its name says where it begins."""
    files = sorted(glob.glob(os.path.join(folder, "[0-9]" * 20 + ".log")))
    if not files:
        return 0
    last = int(os.path.basename(files[-1])[:20])
    with open(files[-1], "rb") as data:
        for _, _, found, problem in decode_log(data.read()):
            if problem:
                break
            last = found[-1][0] + 1
    return last


def _batches(folder: str, start: int, end: int) -> Iterator[pa.RecordBatch]:
    records = _records(folder, start, end)
    while rows := list(itertools.islice(records, BATCH_ROWS)):
        yield pa.RecordBatch.from_arrays([pa.array(column, kind) for column, (_, kind) in zip(zip(*rows, strict=True), _COLUMNS, strict=True)], [name for name, _ in _COLUMNS])


class _Batch(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Span]:
        return [Span(f, 0, 1 << 62) for f in _folders(self.path)]

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        yield from _batches(partition.folder, partition.start, partition.end)


class _Stream(DataSourceStreamReader):
    def __init__(self, path: str, starting: str):
        self.path, self.starting = path, starting

    def initialOffset(self) -> dict:
        return {f: (_next(f) if self.starting == "latest" else 0) for f in _folders(self.path)}

    def latestOffset(self) -> dict:
        return {f: _next(f) for f in _folders(self.path)}

    def partitions(self, start: dict, end: dict) -> list[Span]:
        return [Span(f, start.get(f, 0), e) for f, e in end.items() if e > start.get(f, 0)]

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        yield from _batches(partition.folder, partition.start, partition.end)

    def commit(self, end: dict) -> None:
        return


class LogSource(DataSource):
    """``spark.read.format("tidelog").load(folder)`` and ``readStream``; option ``startingOffsets`` is earliest or latest."""

    @classmethod
    def name(cls) -> str:
        return "tidelog"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Batch(self.options["path"])

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self.options["path"], self.options.get("startingOffsets", "earliest"))
