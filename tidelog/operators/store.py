"""A log that can be written: Parquet by topic and partition, sorted by offset, so that offsets are pushed down to row groups.

Appends are all or nothing, as Parquet jobs are committed as a whole. One writer
a topic is assumed: the next offset is read before the write.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions import INVALID_BATCH, INVALID_LENGTH, INVALID_PARTITION, UNSUPPORTED_CODEC, record_bytes
from tidelog.operators.log import assign_offsets, bounds
from tidelog.shipping import map_arrow, sliced

RECORDS = "topic string, partition int, offset bigint, timestamp_unix_ns bigint, key string, value string, encoded_byte_size bigint"
BATCHES = "batch bigint, topic string, partition int, codec int, record_count bigint, uncompressed_bytes bigint, encoded binary, timestamp_unix_ns bigint"


def write_log(records: DataFrame, path: str, mode: str = "append") -> None:
    columns = [part.strip().split(" ")[0] for part in RECORDS.split(",")]
    slim = records.select(*columns)
    # a hot partition of the log is written by several tasks, each a range of its offsets
    slim.repartitionByRange("topic", "partition", "offset").sortWithinPartitions("topic", "partition", "offset").write.mode(mode).partitionBy("topic", "partition").parquet(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RECORDS).parquet(path)


def append(spark: SparkSession, path: str, rows: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Appends (topic, partition, seq, timestamp_unix_ns, key, value) after the log's last offsets; (topic, partition, base_offset, next_offset, records, encoded_bytes).

    No rows append nothing. ``existing``: the log's bounds, if they are known.
    """
    if existing is None:
        existing = bounds(read_log(spark, path)) if _there(spark, path) else None
    numbered = assign_offsets(rows, existing).withColumn("encoded_byte_size", record_bytes(F.col("key"), F.col("value")))
    write_log(numbered, path)
    told = numbered.groupBy("topic", "partition").agg(F.min("offset").alias("base_offset"), (F.max("offset") + 1).alias("next_offset"), F.count(F.lit(1)).alias("records"), F.sum("encoded_byte_size").alias("encoded_bytes"))
    return told


def _there(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def decode_batches(batches: DataFrame, offered: int = 3, max_records: int = 1 << 20, max_bytes: int = 64 << 20) -> DataFrame:
    """Rows of ``BATCHES`` with ``error_code`` and, without one, ``records``: what a producer of encoded batches is told before anything is appended.

    The codec must be among those ``offered`` (a mask), counts and sizes within
    the limits, and the payload must be just what its records encode to.
    """
    from tidelog.sources.codec import decode_record_set, decompress, encode_record_set

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("key", pa.string()), ("value", pa.string())]))
        for part in sliced(parts, 16):
            codes, out = [], []
            for row in part.to_pylist():
                found, code = None, "none"
                if row["codec"] not in (0, 1) or not offered >> row["codec"] & 1:
                    code = UNSUPPORTED_CODEC
                elif row["record_count"] > max_records or row["uncompressed_bytes"] > max_bytes:
                    code = INVALID_LENGTH
                else:
                    try:
                        raw = decompress(row["codec"], row["encoded"], row["uncompressed_bytes"])
                        pairs = decode_record_set(raw, row["record_count"])
                        if not pairs or encode_record_set(pairs) != raw:
                            raise ValueError("not canonical")
                        found = [{"key": k.decode(), "value": v.decode()} for k, v in pairs]
                    except Exception:  # whatever the payload breaks on, the producer is told the same
                        code = INVALID_BATCH
                codes.append(code)
                out.append(found)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(codes, pa.string()), pa.array(out, kind)], [*part.schema.names, "error_code", "records"])

    columns = [c.strip().split(" ")[0] for c in BATCHES.split(",")]
    return map_arrow(batches.select(*columns), run, BATCHES + ", error_code string, records array<struct<key:string,value:string>>")


def append_encoded(spark: SparkSession, path: str, batches: DataFrame, partitions: DataFrame, **limits: int) -> DataFrame:
    """Appends whole batches to explicit partitions in the order of ``batch``; a row a batch: error_code, base_offset, next_offset, records.

    ``partitions`` holds (topic, partition) that exist. A batch's records share its time.
    """
    known = partitions.select("topic", "partition").distinct().withColumn("_known", F.lit(True))
    decoded = decode_batches(batches, **limits).join(known, ["topic", "partition"], "left")
    decoded = decoded.withColumn("error_code", F.when(F.col("_known").isNull(), INVALID_PARTITION).otherwise(F.col("error_code"))).drop("_known")
    good = decoded.filter("error_code = 'none'").select("batch", "topic", "partition", "timestamp_unix_ns", F.posexplode("records").alias("at", "r"))
    rows = good.select((F.col("batch") * (1 << 20) + F.col("at")).alias("seq"), "batch", "topic", "partition", "timestamp_unix_ns", "r.key", "r.value")
    existing = bounds(read_log(spark, path)) if _there(spark, path) else None
    numbered = assign_offsets(rows, existing)
    write_log(numbered.withColumn("encoded_byte_size", record_bytes(F.col("key"), F.col("value"))), path)
    per = numbered.groupBy("batch").agg(F.min("offset").alias("base_offset"), (F.max("offset") + 1).alias("next_offset"), F.count(F.lit(1)).alias("records"))
    return decoded.select("batch", "topic", "partition", "error_code").join(per, "batch", "left").fillna(0, ["records"])


def wait_for_records(spark: SparkSession, path: str, requests: DataFrame, max_wait_ms: int, every_ms: int = 50) -> DataFrame:
    """The log's bounds of each (topic, partition, from_offset), once one of them has records to give or the wait is over.

    Only bounds are looked at between; the fetch that follows is a query like others.
    """
    import time

    until = time.monotonic() + max_wait_ms / 1000
    while True:
        told = requests.join(bounds(read_log(spark, path)), ["topic", "partition"], "left")
        if time.monotonic() >= until or told.filter("next_offset > from_offset").limit(1).count():
            return told
        time.sleep(every_ms / 1000)


def append_commits(commits: DataFrame, path: str) -> None:
    """Appends accepted commits (group, seq, topic, partition, next_offset) to the offset log: lines with their CRC, by group."""
    from tidelog.sources.text import offset_log_lines

    offset_log_lines(commits).write.mode("append").partitionBy("group").parquet(path)


def read_commits(spark: SparkSession, path: str) -> DataFrame:
    from tidelog.sources.text import parse_offset_log

    return parse_offset_log(spark.read.schema("group string, seq bigint, line string").parquet(path))
