"""Routing, sequencing, segments and summaries of partitioned logs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidelog.functions import GROUP_ACTIVE, fnv1a_partition, whole
from tidelog.shipping import map_arrow

#: arrivals that are numbered together; a hot partition is numbered in many tasks
BLOCK = 1 << 20


def number_in_order(rows: DataFrame, keys: list[str], seq: str, name: str, block: int = BLOCK) -> DataFrame:
    """``name`` counts the rows of each key from 0 in the order of ``seq``.

    Rows are numbered by blocks of ``seq``; the counts of earlier blocks, a few
    rows a key, are added. No key is ordered in one task.
    """
    blocked = rows.withColumn("_block", F.expr(f"`{seq}` div {block}"))
    counts = blocked.groupBy(*keys, "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*keys).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    bases = counts.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = blocked.withColumn("_at", F.row_number().over(W.partitionBy(*keys, "_block").orderBy(seq)) - 1)
    return inside.join(bases, [*keys, "_block"]).withColumn(name, (F.col("_base") + F.col("_at")).cast("bigint")).drop("_block", "_at", "_base")


def running(rows: DataFrame, key: str, seq: str, folds: dict[str, tuple], start: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """Each name of ``folds``, (F.sum or F.max, column), over a row and the earlier rows of its key in the order of ``seq``, nulls of which come last.

    In blocks as ``number_in_order``; a null key counts as one. ``start`` holds (key, names) to go on from.
    """
    blocked = rows.withColumn("_block", F.expr(f"`{seq}` div {block}"))
    totals = blocked.groupBy(key, "_block").agg(*[fold(column).alias(name) for name, (fold, column) in folds.items()])
    before = W.partitionBy(key).orderBy(F.col("_block").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    bases = totals.select(F.col(key).alias("_k"), F.col("_block").alias("_b"), *[fold(name).over(before).alias(f"_{name}") for name, (fold, _) in folds.items()])
    if start is not None:
        held = start.select(F.col(key).alias("_h"), *[F.col(name).alias(f"_start_{name}") for name in folds])
        bases = bases.join(held, F.col("_k").eqNullSafe(F.col("_h")), "left").drop("_h")
    inside = W.partitionBy(key, "_block").orderBy(F.col(seq).asc_nulls_last()).rowsBetween(W.unboundedPreceding, W.currentRow)
    met = blocked.select("*", *[fold(column).over(inside).alias(name) for name, (fold, column) in folds.items()])
    met = met.join(bases, F.col(key).eqNullSafe(F.col("_k")) & F.col("_block").eqNullSafe(F.col("_b")))
    for name, (fold, _) in folds.items():
        parts = [F.col(c) for c in ([name, f"_{name}"] if start is None else [name, f"_{name}", f"_start_{name}"])]
        met = met.withColumn(name, F.greatest(*parts) if fold is F.max else sum((F.coalesce(c, F.lit(0)) for c in parts[1:]), F.coalesce(parts[0], F.lit(0))))
    return met.select(*rows.columns, *folds)


def route(rows: DataFrame, partitions: int, key: str = "key", seq: str = "seq", topic: str = "topic") -> DataFrame:
    """``partition``: by the key's hash, or in turn over the rows of a topic that have no key."""
    keyless = F.coalesce(F.octet_length(F.col(key)), F.lit(0)) == 0
    turn = number_in_order(rows.filter(keyless), [topic], seq, "_turn")
    turn = turn.withColumn("partition", (F.col("_turn") % partitions).cast("int")).drop("_turn")
    keys = rows.select(F.col(key).alias("_key")).filter(F.octet_length("_key") > 0).distinct()
    hashed = keys.withColumn("partition", fnv1a_partition(F.col("_key"), partitions))
    keyed = rows.filter(~keyless).join(hashed, F.col(key) == F.col("_key")).drop("_key")
    return keyed.unionByName(turn)


def assign_offsets(rows: DataFrame, existing: DataFrame | None = None, seq: str = "seq") -> DataFrame:
    """``offset`` of each record of (topic, partition) in arrival order, after the ``next_offset`` of an existing log.

    One writer a topic is assumed, as the base is read before the write.
    """
    numbered = number_in_order(rows, ["topic", "partition"], seq, "offset")
    if existing is None:
        return numbered
    base = existing.select("topic", "partition", F.col("next_offset").alias("_next"))
    return numbered.join(base, ["topic", "partition"], "left").withColumn("offset", F.col("offset") + F.coalesce("_next", F.lit(0))).drop("_next")


def bounds(records: DataFrame) -> DataFrame:
    """(topic, partition, earliest_offset, next_offset, records, log_bytes)."""
    return records.groupBy("topic", "partition").agg(
        F.min("offset").alias("earliest_offset"),
        (F.max("offset") + 1).alias("next_offset"),
        F.count(F.lit(1)).alias("records"),
        F.sum("encoded_byte_size").alias("log_bytes"),
    )


def roll_segments(records: DataFrame, max_bytes: int, max_age_ns: int = 0) -> DataFrame:
    """``segment_base``: a record that would overfill its segment, or finds it too old, starts the next one.

    A fold with reset in the order of offsets: what fills a segment depends on
    where the one before it ended. Only offsets, sizes and times stream through
    Arrow, sorted by (topic, partition, offset); within a batch each next
    segment is searched in running sums, a step a segment, and one open segment
    is the state. A partition of the log is one task.
    """
    key = ["topic", "partition"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, base, filled, opened = None, 0, 0, 0
        for batch in batches:
            topics, parts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            offsets, sizes, times = (batch.column(j).to_numpy(zero_copy_only=False) for j in (2, 3, 4))
            total = np.concatenate([[0], np.cumsum(sizes)])
            latest = np.maximum.accumulate(times) if len(times) else times
            change = [0, *(k for k in range(1, len(topics)) if (topics[k], parts[k]) != (topics[k - 1], parts[k - 1])), len(topics)]
            out: list[tuple] = []
            for start, end in zip(change[:-1], change[1:], strict=True):
                if start == end:
                    continue
                at = start
                if (topics[start], parts[start]) != name:
                    name, base, filled, opened = (topics[start], parts[start]), int(offsets[start]), 0, int(times[start])
                    out.append((*name, base))
                while at < end:
                    # the first record that does not fit; one that finds its segment empty always does
                    stop = int(np.searchsorted(total, total[at] + max_bytes - filled, "right")) - 1
                    stop = max(stop, at + (filled == 0))
                    if max_age_ns:
                        aged = np.flatnonzero(times[at + (filled == 0) : min(stop, end)] - opened >= max_age_ns) if latest[min(stop, end) - 1] - opened >= max_age_ns else []
                        if len(aged):
                            stop = at + (filled == 0) + int(aged[0])
                    if stop >= end:
                        filled += int(total[end] - total[at])
                        at = end
                    else:
                        base, filled, opened, at = int(offsets[stop]), 0, int(times[stop]), stop
                        out.append((*name, base))
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.int32()), pa.array([o[2] for o in out], pa.int64())], [*key, "segment_base"])

    slim = records.select(F.col("topic").cast("string"), F.col("partition").cast("int"), F.col("offset").cast("bigint"), F.col("encoded_byte_size").cast("bigint"), F.col("timestamp_unix_ns").cast("bigint"))
    starts = map_arrow(slim.repartition(*key).sortWithinPartitions(*key, "offset"), run, "topic string, partition int, segment_base bigint")
    # each segment is one more row before its first record, and records take the last one before them: no join
    upto = W.partitionBy(*key).orderBy("offset", F.col("_starts").desc_nulls_last()).rowsBetween(W.unboundedPreceding, W.currentRow)
    every = records.unionByName(starts.select(*key, F.col("segment_base").alias("offset"), F.col("segment_base").alias("_starts")), allowMissingColumns=True)
    told = every.withColumn("segment_base", F.max("_starts").over(upto)).filter("_starts IS NULL")
    return told.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in records.schema], "segment_base")


def coalesced(records: DataFrame, most: int) -> DataFrame:
    """(topic, partition, drain, records, bytes): appends that each take up to ``most`` waiting records of a partition."""
    drain = F.expr(f"offset div {most}").alias("drain")
    return records.groupBy("topic", "partition", drain).agg(F.count(F.lit(1)).alias("records"), F.sum("encoded_byte_size").alias("bytes"))


def segments(rolled: DataFrame) -> DataFrame:
    """(topic, partition, base_offset, first_offset, last_offset, records, log_bytes, last_ns, active)."""
    summed = rolled.groupBy("topic", "partition", F.col("segment_base").alias("base_offset")).agg(
        F.min("offset").alias("first_offset"),
        F.max("offset").alias("last_offset"),
        F.count(F.lit(1)).alias("records"),
        F.sum("encoded_byte_size").alias("log_bytes"),
        F.max("timestamp_unix_ns").alias("last_ns"),
    )
    newest = F.max("base_offset").over(W.partitionBy("topic", "partition"))
    return summed.withColumn("active", F.col("base_offset") == newest)


def retention(segs: DataFrame, now_ns: int | Column, max_bytes: int = 0, max_age_seconds: int = 0) -> DataFrame:
    """``deleted`` for each segment.

    Walking from the oldest, an inactive segment goes when it is old enough or
    the bytes left exceed the limit. What is left before a segment's turn and
    exceeds the limit is just the suffix from that segment on, so a running sum
    from the end decides it.
    """
    suffix = F.sum("log_bytes").over(W.partitionBy("topic", "partition").orderBy("base_offset").rowsBetween(W.currentRow, W.unboundedFollowing))
    now = F.lit(now_ns) if isinstance(now_ns, int) else now_ns
    old = F.lit(max_age_seconds > 0) & (whole(now - F.col("last_ns"), 1_000_000_000) >= max_age_seconds)
    big = F.lit(max_bytes > 0) & (suffix > max_bytes)
    return segs.withColumn("deleted", ~F.col("active") & (old | big))


def retention_totals(marked: DataFrame) -> DataFrame:
    """Deleted and retained segments and bytes of each partition; null topic and partition hold the whole."""
    pick = lambda c, yes: F.coalesce(F.sum(F.when(F.col("deleted") == yes, c)), F.lit(0)).cast("bigint")
    totals = marked.groupingSets([["topic", "partition"], []], "topic", "partition").agg(
        pick(F.lit(1), True).alias("deleted_segments"),
        pick(F.col("log_bytes"), True).alias("deleted_bytes"),
        pick(F.lit(1), False).alias("retained_segments"),
        pick(F.col("log_bytes"), False).alias("retained_bytes"),
    )
    return totals


def recover(entries: DataFrame) -> DataFrame:
    """``kept`` for each entry of (topic, partition, segment_base, offset, valid): all before the first invalid one."""
    broken = F.min(F.when(~F.col("valid"), F.struct("segment_base", "offset"))).over(W.partitionBy("topic", "partition"))
    return entries.withColumn("kept", F.coalesce(F.struct("segment_base", "offset") < broken, F.lit(True)))


def compact(commits: DataFrame, deleted_topics: DataFrame) -> DataFrame:
    """The latest commit of every (group, topic, partition) whose topic stays."""
    from tidelog.operators.offsets import latest_commits

    return latest_commits(commits).join(deleted_topics.select("topic"), "topic", "left_anti")


def delete_topics(wanted: DataFrame, records: DataFrame, commits: DataFrame, active_groups: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(result, records left, commits left): topics go with their records and commits unless a group that reads them has members.

    ``result`` is (topic, result, partitions, records, log_bytes, groups); ``active_groups`` holds (group, topic).
    """
    from tidelog.operators.offsets import latest_commits

    busy = active_groups.select("topic").distinct().withColumn("_busy", F.lit(True))
    sums = bounds(records).groupBy("topic").agg(F.count(F.lit(1)).alias("partitions"), F.sum("records").alias("records"), F.sum("log_bytes").alias("log_bytes"))
    groups = latest_commits(commits).groupBy("topic").agg(F.countDistinct("group").alias("groups"))
    told = wanted.select("topic").distinct().join(busy, "topic", "left").join(sums, "topic", "left").join(groups, "topic", "left")
    result = F.when(F.col("partitions").isNull(), "unknown_topic").when(F.col("_busy"), GROUP_ACTIVE).otherwise("deleted")
    told = told.select("topic", result.alias("result"), *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("partitions", "records", "log_bytes", "groups")])
    gone = told.filter("result = 'deleted'").select("topic")
    return told, records.join(gone, "topic", "left_anti"), commits.join(gone, "topic", "left_anti")


def create_topics(wanted: DataFrame, existing: DataFrame, max_partitions: int = 128) -> DataFrame:
    """``result`` of each (topic, partition_count): created, exists or topic_conflict, or why it is refused."""
    from tidelog.functions import INVALID_PARTITION, MALFORMED, TOPIC_CONFLICT, valid_name

    have = existing.select("topic", F.col("partition_count").alias("_have"))
    result = (
        F.when(~valid_name(F.col("topic")), MALFORMED)
        .when(~F.col("partition_count").between(1, max_partitions), INVALID_PARTITION)
        .when(F.col("_have").isNull(), "created")
        .when(F.col("_have") == F.col("partition_count"), "exists")
        .otherwise(TOPIC_CONFLICT)
    )
    return wanted.join(have, "topic", "left").withColumn("result", result).drop("_have")
