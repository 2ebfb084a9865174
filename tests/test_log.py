"""Routing, offsets, segments, retention, fetches, recovery, replication."""

from pyspark.sql import functions as F

from tidelog.functions import record_bytes
from tidelog.operators import fetch, log, replication


def entries(spark, rows):
    df = spark.createDataFrame([("trades", 0, o, o * 10**9, k, v) for o, k, v in rows], "topic string, partition int, offset bigint, timestamp_unix_ns bigint, key string, value string")
    return df.withColumn("encoded_byte_size", record_bytes(F.col("key"), F.col("value")))


def test_round_robin_counts_keyless_records_only(spark):
    rows = [(0, "t", ""), (1, "t", "same-key"), (2, "t", ""), (3, "t", "same-key"), (4, "t", ""), (5, "t", None)]
    got = {r.seq: r.partition for r in log.route(spark.createDataFrame(rows, "seq bigint, topic string, key string"), 3).collect()}
    assert [got[k] for k in (0, 2, 4, 5)] == [0, 1, 2, 0] and got[1] == got[3]


def test_offsets_continue_and_blocks_agree(spark):
    rows = spark.range(500).select(F.col("id").alias("seq"), F.lit("t").alias("topic"), (F.col("id") % 3).cast("int").alias("partition"))
    whole = {(r.partition, r.seq): r.offset for r in log.assign_offsets(rows).collect()}
    blocks = {(r.partition, r.seq): r.o for r in log.number_in_order(rows, ["topic", "partition"], "seq", "o", block=7).collect()}
    assert whole == blocks and whole[(2, 5)] == 1
    base = spark.createDataFrame([("t", 1, 100)], "topic string, partition int, next_offset bigint")
    assert log.assign_offsets(rows, base).filter("partition = 1").agg(F.min("offset")).first()[0] == 100


def test_segments_roll_and_retention_keeps_the_active(spark):
    records = entries(spark, [(o, k, "message-" + str(o) * 32) for o, k in enumerate("ABC")])
    for limit in (80, 96):
        rolled = log.roll_segments(records, limit)
        assert [r.segment_base for r in rolled.orderBy("offset").collect()] == [0, 1, 2]
    marked = log.retention(log.segments(rolled), 0, max_bytes=100)
    assert {r.base_offset: r.deleted for r in marked.collect()} == {0: True, 1: True, 2: False}
    by_age = log.retention(log.segments(rolled), 7202 * 10**9, max_age_seconds=3600)
    assert {r.base_offset for r in by_age.filter("deleted").collect()} == {0, 1}
    assert [r.segment_base for r in log.roll_segments(records, 10**6, max_age_ns=2 * 10**9).orderBy("offset").collect()] == [0, 0, 2]


def test_fetch_caps(spark):
    records = entries(spark, [(0, "k", "one"), (1, "k", "two"), (2, "k", "three")])
    ask = lambda o: spark.createDataFrame([("trades", 0, o)], "topic string, partition int, from_offset bigint")
    for start, following in ((0, 1), (1, 2)):
        got = fetch.responses(ask(start), fetch.fetch(records, ask(start), 10, 80)).first()
        assert (got.records, got.next_offset) == (1, following)
    assert fetch.fetch(records, ask(0), 10, 1).count() == 1
    end = fetch.responses(ask(3), fetch.fetch(records, ask(3))).first()
    assert (end.records, end.next_offset) == (0, 3)


def test_selectors(spark):
    limits = spark.createDataFrame([("t", 0, 5, 10)], "topic string, partition int, earliest_offset bigint, next_offset bigint")
    commits = spark.createDataFrame([("g", "t", 0, 7)], "group string, topic string, partition int, next_offset bigint")
    asked = [("g", "committed"), ("new", "committed"), ("g", "beginning"), ("g", "latest"), ("g", "4"), ("g", "11"), ("g", "10"), ("g", "x"), ("g", "")]
    df = spark.createDataFrame([("t", 0, g, s) for g, s in asked], "topic string, partition int, group string, selector string")
    got = {(r.group, r.selector): (r.from_offset, r.error_code) for r in fetch.select_offsets(df, limits, commits).collect()}
    assert got == {
        ("g", "committed"): (7, "none"), ("new", "committed"): (5, "none"), ("g", "beginning"): (5, "none"), ("g", "latest"): (10, "none"), ("g", "4"): (None, "offset_out_of_range"),
        ("g", "11"): (None, "invalid_offset"), ("g", "10"): (10, "none"), ("g", "x"): (None, "malformed_payload"), ("g", ""): (None, "malformed_payload"),
    }


def test_recovery_stops_at_the_first_bad_entry(spark):
    rows = [("t", 0, 0, 0, True), ("t", 0, 0, 1, False), ("t", 0, 2, 2, True), ("t", 1, 0, 0, True)]
    kept = log.recover(spark.createDataFrame(rows, "topic string, partition int, segment_base bigint, offset bigint, valid boolean")).filter("kept")
    assert {(r.partition, r.offset) for r in kept.collect()} == {(0, 0), (1, 0)}


def test_replication(spark):
    leader = entries(spark, [(0, "a", "x"), (1, "b", "y")])
    follower = leader.filter("offset < 1")
    assert replication.replica_lag(leader, follower).first().lag == 1
    assert replication.missing_suffix(leader, follower).first().offset == 1
    assert replication.replica_lag(leader, leader.limit(0)).first().lag == 2
    assert replication.replica_lag(follower, leader).first().state == "follower_ahead"
    assert replication.catch_up_fetches(replication.replica_lag(leader, leader.limit(0)), 1).first().fetches == 2
    modes = {r.mode: r.acknowledged for r in replication.acknowledged(replication.replica_lag(leader, follower), False).collect()}
    assert modes == {"leader": True, "all": False}


def test_create_topics(spark):
    have = spark.createDataFrame([("a", 4)], "topic string, partition_count int")
    want = spark.createDataFrame([("a", 4), ("a", 5), ("b", 1), ("..", 1), ("c", 0), ("c", 129)], "topic string, partition_count int")
    got = {(r.topic, r.partition_count): r.result for r in log.create_topics(want, have).collect()}
    assert got == {("a", 4): "exists", ("a", 5): "topic_conflict", ("b", 1): "created", ("..", 1): "malformed_payload", ("c", 0): "invalid_partition", ("c", 129): "invalid_partition"}
