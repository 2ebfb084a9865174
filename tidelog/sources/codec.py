"""The binary log: entries of single records and of compressed batches.

An entry is a big-endian length, a body, and the CRC-32 of the body. Layouts
(fixed values of the format) are the two ``struct`` strings below.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.shipping import map_arrow, sliced

try:
    import zstandard
except ImportError:  # logs without compressed batches can still be read
    zstandard = None

# version, flags, offset, nanoseconds, key bytes, value bytes, headers
RECORD = struct.Struct(">HHQQIII")
# version, flags, codec, reserved, base offset, nanoseconds, records, raw bytes, stored bytes
BATCH = struct.Struct(">HHHHQQIII")
NONE, ZSTD = 0, 1
MAX_RAW = 64 << 20

ENTRY = "topic string, partition int, segment_base bigint, position bigint, entry_bytes bigint, offset bigint, timestamp_unix_ns bigint, key binary, value binary, encoded_byte_size bigint, valid boolean, problem string"


def _framed(body: bytes) -> bytes:
    return struct.pack(">I", len(body) + 4) + body + struct.pack(">I", zlib.crc32(body))


def encode_record(offset: int, nanos: int, key: bytes, value: bytes) -> bytes:
    return _framed(RECORD.pack(1, 0, offset, nanos, len(key), len(value), 0) + key + value)


def encode_record_set(records: list[tuple[bytes, bytes]]) -> bytes:
    parts = [struct.pack(">I", len(records))]
    for key, message in records:
        parts += [struct.pack(">I", len(key)), key, struct.pack(">I", len(message)), message]
    return b"".join(parts)


def decode_record_set(raw: bytes, count: int) -> list[tuple[bytes, bytes]]:
    """The records; ValueError for another count, an empty message, or bytes left over."""
    at, out = 4, []
    if len(raw) < 4 or struct.unpack_from(">I", raw)[0] != count:
        raise ValueError("invalid_batch: count")
    for _ in range(count):
        pair = []
        for _ in range(2):
            if at + 4 > len(raw):
                raise ValueError("invalid_batch: short")
            (n,) = struct.unpack_from(">I", raw, at)
            pair.append(raw[at + 4 : at + 4 + n])
            at += 4 + n
        if at > len(raw) or not pair[1]:
            raise ValueError("invalid_batch: short or empty message")
        out.append((pair[0], pair[1]))
    if at != len(raw):
        raise ValueError("invalid_batch: trailing bytes")
    return out


def compress(codec: int, raw: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(raw) if codec == ZSTD else raw


def decompress(codec: int, stored: bytes, size: int) -> bytes:
    if codec not in (NONE, ZSTD):
        raise ValueError("unsupported_codec")
    if size > MAX_RAW:
        raise ValueError("invalid_length")
    raw = zstandard.ZstdDecompressor().decompress(stored, max_output_size=size) if codec == ZSTD else stored
    if len(raw) != size:
        raise ValueError("invalid_length")
    return raw


def encode_batch(base: int, nanos: int, records: list[tuple[bytes, bytes]], codec: int = ZSTD) -> bytes:
    raw = encode_record_set(records)
    stored = compress(codec, raw)
    return _framed(BATCH.pack(2, 0, codec, 0, base, nanos, len(records), len(raw), len(stored)) + stored)


def decode_log(data: bytes) -> Iterator[tuple]:
    """(position, entry bytes, [(offset, nanos, key, value, charged bytes)], problem) of each entry, up to the first bad one."""
    at = 0
    while at < len(data):
        size = struct.unpack_from(">I", data, at)[0] if at + 4 <= len(data) else 0
        body, end = data[at + 4 : at + size], at + 4 + size
        try:
            if size < 6 or end > len(data):
                raise ValueError("torn")
            if zlib.crc32(body) != struct.unpack_from(">I", data, end - 4)[0]:
                raise ValueError("crc_mismatch")
            version = struct.unpack_from(">H", body)[0]
            if version == 1 and len(body) >= RECORD.size:
                _, flags, offset, nanos, nk, nv, headers = RECORD.unpack_from(body)
                if flags or headers or RECORD.size + nk + nv != len(body):
                    raise ValueError("unsupported_version")
                found = [(offset, nanos, body[RECORD.size : RECORD.size + nk], body[RECORD.size + nk :], 4 + size)]
            elif version == 2 and len(body) >= BATCH.size:
                _, flags, codec, reserved, base, nanos, count, raw, stored = BATCH.unpack_from(body)
                if flags or reserved or not count or stored != len(body) - BATCH.size:
                    raise ValueError("invalid_batch")
                pairs = decode_record_set(decompress(codec, body[BATCH.size :], raw), count)
                found = [(base + k, nanos, key, value, (4 + size) // count) for k, (key, value) in enumerate(pairs)]
            else:
                raise ValueError("unsupported_version")
        except ValueError as e:
            yield at, len(data) - at, [], str(e)
            return
        yield at, 4 + size, found, None
        at = end


def read_entries(spark: SparkSession, path: str) -> DataFrame:
    """Every entry of the segments ``<topic>/<partition>/<base>.log`` below ``path``; foreign files are ignored.

    A damaged entry is one row with ``valid`` false and the bytes up to the end of its segment.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.log").load(path)
    name = r"([^/]+)/([0-9]{6})/([0-9]{20})\.log$"
    named = files.filter(F.col("path").rlike(name)).select(
        F.regexp_extract("path", name, 1).alias("topic"),
        F.regexp_extract("path", name, 2).cast("int").alias("partition"),
        F.regexp_extract("path", name, 3).cast("bigint").alias("segment_base"),
        "content",
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int32(), *[pa.int64()] * 5, pa.binary(), pa.binary(), pa.int64(), pa.bool_(), pa.string()]
        names = [part.strip().split(" ")[0] for part in ENTRY.split(",")]
        for batch in sliced(batches, 1):
            for topic, partition, base, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows = []
                for at, size, found, problem in decode_log(content):
                    rows += [(topic, partition, base, at, size, *r, True, None) for r in found] or [(topic, partition, base, at, size, None, None, None, None, None, False, problem)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return map_arrow(named, run, ENTRY)


def recover_log(spark: SparkSession, path: str) -> DataFrame:
    """The records that survive recovery: of each partition, all before the first damaged entry."""
    from pyspark.sql import Window as W

    entries = read_entries(spark, path)
    bad = F.min(F.when(~F.col("valid"), F.struct("segment_base", "position"))).over(W.partitionBy("topic", "partition"))
    return entries.withColumn("_bad", bad).filter("valid AND (_bad IS NULL OR struct(segment_base, position) < _bad)").drop("_bad", "valid", "problem")


def encode_sets(records: DataFrame, keys: list[str], order: str, key: str, value: str) -> DataFrame:
    """A compressed record set for each group: records, raw and stored bytes."""
    spec = ", ".join(f"`{k}` {records.schema[k].dataType.simpleString()}" for k in keys) + ", records bigint, logical_bytes bigint, encoded_bytes bigint"
    sets = records.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(order, F.col(key).cast("binary").alias("k"), F.col(value).cast("binary").alias("v")))).alias("set"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 64):
            out = []
            for pairs in batch.column(len(keys)).to_pylist():
                raw = encode_record_set([(p["k"] or b"", p["v"] or b"") for p in pairs])
                out.append((len(pairs), len(raw), len(compress(ZSTD, raw))))
            columns = [pa.array([o[j] for o in out], pa.int64()) for j in range(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], *columns], [*keys, "records", "logical_bytes", "encoded_bytes"])

    return map_arrow(sets, run, spec)
