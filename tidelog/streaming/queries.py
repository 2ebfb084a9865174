"""Incremental consumption and group liveness as streams that run until their input is read."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidelog.operators import groups
from tidelog.sources.text import offset_log_lines, parse_offset_log


def _folder(spark: SparkSession) -> str:
    """A folder that driver and executors share; a temporary one only where none is set, as in tests. Removed when the driver ends."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="tidelog-stream-")
    folder = f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, folder)
    return folder


def _remove(spark: SparkSession, folder: str) -> None:
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the session may be gone already; the folder is scratch space
        return


def stream_table(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table as a stream."""
    schema = spark.read.parquet(path).schema
    head, _, name = path.rpartition("/")
    return spark.readStream.schema(schema).parquet(f"{head}/{name[:-1]}[{name[-1]}]")


def drain(stream: DataFrame, mode: str = "append", folder: str | None = None) -> DataFrame:
    """Runs the stream over all that is there, with a checkpoint, into a Parquet table; returns that table.

    Each batch overwrites a part of its own, named by its number, so that a
    batch run again after a restart from ``folder`` leaves no row twice. In
    complete mode each batch replaces the table.
    """
    spark = stream.sparkSession
    folder = folder or _folder(spark)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out" if mode == "complete" else f"{folder}/out/_batch={number}")

    stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    if mode == "complete":
        return spark.read.schema(stream.schema).parquet(f"{folder}/out")
    return followed(stream, folder)


def follow(stream: DataFrame, folder: str, every: str = "1 second") -> StreamingQuery:
    """A running stream that waits for records and gives those of each turn to a part of ``folder``; ``followed`` reads them.

    The engine waits, not the reader: a turn that finds nothing writes nothing.
    A part written again after a restart replaces itself.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/_batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(processingTime=every).start()


def followed(stream: DataFrame, folder: str) -> DataFrame:
    """What ``drain``, ``follow`` or ``consume`` have written of ``stream`` so far."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema)
    return stream.sparkSession.read.schema(f"{kinds}, _batch int").option("basePath", f"{folder}/out").parquet(f"{folder}/out/_batch=*").drop("_batch")


def consume(stream: DataFrame, group: str, folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(records, commits) of a group that reads (topic, partition, offset, ...) to its end and commits after each batch.

    Records are written before their commits (group, seq, topic, partition,
    next_offset), both under the batch's number, so a consumer that is run again
    with its ``folder`` goes on after the last commit and repeats nothing. A
    batch that was lost between the two is written again as a whole.
    """
    spark = stream.sparkSession
    folder = folder or _folder(spark)

    def write(batch: DataFrame, number: int) -> None:
        part = f"{folder}/out/_batch={number}"
        batch.write.mode("overwrite").parquet(part)
        commits = spark.read.schema(batch.schema).parquet(part).groupBy("topic", "partition").agg((F.max("offset") + 1).alias("next_offset"))
        lines = offset_log_lines(commits.select(F.lit(group).alias("group"), F.lit(number).cast("bigint").alias("seq"), "topic", "partition", "next_offset"))
        lines.write.mode("overwrite").parquet(f"{folder}/commits/_batch={number}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    lines = spark.read.schema("group string, seq bigint, line string, _batch int").option("basePath", f"{folder}/commits").parquet(f"{folder}/commits/_batch=*")
    return followed(stream, folder), parse_offset_log(lines.drop("_batch"))


def membership(events: DataFrame, folder: str | None = None) -> DataFrame:
    """Outcomes of ``groups.EVENT`` by batches, each with the groups and members that the batch before it has left.

    What a batch leaves is written under its number after its outcomes, so a
    batch run again starts from the same state and replaces what it wrote.
    """
    spark = events.sparkSession
    folder = folder or _folder(spark)

    def write(batch: DataFrame, number: int) -> None:
        work, state = f"{folder}/work", [f"{folder}/{name}/_batch={{}}" for name in ("groups", "members")]

        def keep(df: DataFrame, path: str = f"{work}/rows") -> DataFrame:
            df.write.mode("overwrite").parquet(path)
            return spark.read.schema(df.schema).parquet(path)

        held = (spark.read.schema(groups.GROUP).parquet(state[0].format(number - 1)), spark.read.schema(groups.MEMBER).parquet(state[1].format(number - 1))) if number else None
        told, *left = groups.coordinate(keep(batch, f"{work}/events"), held, keep)
        keep(told, f"{folder}/out/_batch={number}")
        for df, path in zip(left, state, strict=True):
            keep(df, path.format(number))
            _remove(spark, path.format(number - 2))
        _remove(spark, work)

    events.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return followed(spark.createDataFrame([], groups.OUTCOME), folder)


def consumed_offsets(stream: DataFrame, keys: list[str], offset: str) -> DataFrame:
    """Records and the next offset of each key, kept up to date over micro-batches."""
    return drain(stream.groupBy(*keys).agg(F.count(F.lit(1)).alias("records"), (F.max(offset) + 1).alias("next_offset")), "complete")


def group_liveness(beats: DataFrame, timeout_seconds: int) -> DataFrame:
    """Sessions of heartbeats (group, member_id, ts): event-time session windows that a gap of the timeout closes."""
    watched = beats.withWatermark("ts", "0 seconds")
    sessions = watched.groupBy("group", "member_id", F.session_window("ts", f"{timeout_seconds} seconds").alias("session")).agg(F.count(F.lit(1)).alias("beats"))
    return drain(sessions.select("group", "member_id", F.col("session.start").alias("started"), F.col("session.end").alias("expires"), "beats"), "append")
