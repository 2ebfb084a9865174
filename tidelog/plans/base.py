"""How the tables map to the log model, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions import record_bytes, unix_nanos
from tidelog.operators.log import assign_offsets, bounds, roll_segments, route

PARTITIONS = 4
SEGMENT_BYTES = 4096
#: the first offsets that retention has taken away, in queries that read a trimmed log
EARLIEST = 100


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrivals(spark: SparkSession, sf_dir: str, topic: str = "events") -> DataFrame:
    """Events as arriving records: topic (or the event type), key, value, seq, time."""
    ev = table(spark, sf_dir, "events")
    named = F.col("event_type") if topic == "event_type" else F.lit(topic)
    return ev.select(F.col("event_id").alias("seq"), named.alias("topic"), F.col("user_id").cast("string").alias("key"), F.col("props").alias("value"), unix_nanos(F.col("ts")).alias("timestamp_unix_ns"))


def records(spark: SparkSession, sf_dir: str, topic: str = "events") -> DataFrame:
    routed = route(arrivals(spark, sf_dir, topic), PARTITIONS)
    return assign_offsets(routed).withColumn("encoded_byte_size", record_bytes(F.col("key"), F.col("value")))


def trimmed_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bounds(records(spark, sf_dir).filter(F.col("offset") >= EARLIEST))


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as commits; one group never commits in partition 3."""
    o = table(spark, sf_dir, "orders")
    c = o.select(
        F.col("o_orderkey").alias("seq"),
        F.col("o_orderpriority").alias("group"),
        F.lit("events").alias("topic"),
        (F.col("o_custkey") % PARTITIONS).cast("int").alias("partition"),
        (F.col("o_orderkey") % 3000).cast("bigint").alias("next_offset"),
    )
    return c.filter(~((F.col("group") == "5-LOW") & (F.col("partition") == 3)))


def rolled(spark: SparkSession, sf_dir: str, topic: str = "events") -> DataFrame:
    return roll_segments(records(spark, sf_dir, topic), SEGMENT_BYTES)


def fnv_sql(key: str, n: int) -> str:
    each = f"list_transform(range(1, length({key}) + 1), lambda i: ascii(substr({key}, i::INT, 1))::HUGEINT)"
    return (
        f"(list_reduce(list_prepend(14695981039346656037::HUGEINT, {each}), "
        f"lambda h, x: (xor(h, x) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT) % {n})::INT"
    )


def records_sql(topic: str = "'events'") -> str:
    """CTEs ending in ``rec``."""
    return f"""arrived AS (
  SELECT event_id AS seq, {topic} AS topic, user_id::VARCHAR AS key, props AS value, epoch_us(ts)::BIGINT * 1000 AS timestamp_unix_ns FROM events
), routed AS (
  SELECT *, {fnv_sql("key", PARTITIONS)} AS partition FROM arrived
), rec AS (
  SELECT *, (row_number() OVER (PARTITION BY topic, partition ORDER BY seq) - 1)::BIGINT AS off,
    (40 + strlen(key) + strlen(value))::BIGINT AS size FROM routed
)"""


BOUNDS_SQL = f"""bounds AS (
  SELECT topic, partition, min(off)::BIGINT AS earliest, (max(off) + 1)::BIGINT AS nxt FROM rec WHERE off >= {EARLIEST} GROUP BY ALL
)"""

COMMITS_SQL = f"""commits AS (
  SELECT o_orderkey AS seq, o_orderpriority AS grp, 'events' AS topic, (o_custkey % {PARTITIONS})::INT AS partition, (o_orderkey % 3000)::BIGINT AS nxt
  FROM orders WHERE NOT (o_orderpriority = '5-LOW' AND o_custkey % {PARTITIONS} = 3)
), latest AS (
  SELECT grp, topic, partition, arg_max(nxt, seq) AS committed FROM commits GROUP BY ALL
)"""


def segments_sql(topic: str = "'events'") -> str:
    """CTEs ending in ``seg``; needs WITH RECURSIVE."""
    return (
        records_sql(topic)
        + f""", fold AS (
  SELECT topic, partition, off, size, timestamp_unix_ns, off AS base, size AS cur FROM rec WHERE off = 0
  UNION ALL
  SELECT r.topic, r.partition, r.off, r.size, r.timestamp_unix_ns,
    CASE WHEN f.cur > 0 AND f.cur + r.size > {SEGMENT_BYTES} THEN r.off ELSE f.base END,
    CASE WHEN f.cur > 0 AND f.cur + r.size > {SEGMENT_BYTES} THEN r.size ELSE f.cur + r.size END
  FROM fold f JOIN rec r ON r.topic = f.topic AND r.partition = f.partition AND r.off = f.off + 1
), seg AS (
  SELECT topic, partition, base, min(off)::BIGINT AS first_offset, max(off)::BIGINT AS last_offset, count(*)::BIGINT AS records,
    sum(size)::BIGINT AS log_bytes, max(timestamp_unix_ns)::BIGINT AS last_ns,
    base = max(base) OVER (PARTITION BY topic, partition) AS active
  FROM fold GROUP BY topic, partition, base
)"""
    )
