"""Members, alerts, fetch errors, appends, settings and streams against the cases of the contract."""

import datetime as dt
import json

import duckdb
import pytest
from pyspark.sql import functions as F

from tidelog import config, registry
from tidelog import functions as fn
from tidelog.operators import fetch, groups, log, metrics, store
from tidelog.streaming import queries as streams

T0 = dt.datetime(2024, 1, 1)


def test_whole_numbers_beyond_doubles(spark):
    one = spark.range(1)
    assert one.select(fn.iso_seconds(F.lit(1704067201999999999)).alias("x")).first().x == "2024-01-01T00:00:01Z"
    assert one.select(fn.even_share(F.lit(9007199254740993), F.lit(1), F.lit(0)).alias("x")).first().x == 9007199254740993
    assert one.select(fn.age_seconds(F.lit(1706616000000000000), F.lit(1706615999000000001)).alias("x")).first().x == 0


def events(*rows):
    return [("g", k, at, kind, member, timeout) for k, (at, kind, member, timeout) in enumerate(rows)]


def test_membership(spark):
    def told(rows):
        got = groups.stream_membership(spark.createDataFrame(rows, groups.EVENT)).orderBy("seq").collect()
        return [(r.generation, r.error_code, r.members, list(r.expired)) for r in got]

    rows = events((0, "join", "m1", 1000), (10, "join", "m2", 1000), (15, "join", "m1", 1000), (20, "leave", "m2", 0), (30, "leave", "m2", 0))
    assert told(rows) == [(1, "none", 1, []), (2, "none", 2, []), (2, "none", 2, []), (3, "none", 1, []), (3, "stale_member", 1, [])]
    rows = events((0, "join", "m1", 100), (10, "join", "m2", 100), (50, "heartbeat", "m1", 0), (120, "expire", None, 0), (121, "heartbeat", "m2", 0))
    assert told(rows)[3:] == [(3, "none", 1, ["m2"]), (3, "stale_member", 1, [])]
    rows = events(*[(0, "join", f"m{k}", 100) for k in range(3)], (500, "expire", None, 0))
    assert told(rows)[-1] == (4, "none", 0, ["m0", "m1", "m2"])  # one sweep, one generation


def walked(rows):
    """Members a step an event, by (group, seq): what each is told."""
    state, out = {}, {}
    for group, seq, at, kind, member, timeout in sorted(rows, key=lambda r: r[1]):
        generation, now, members = state.get(group, (0, at, {}))
        now = max(now, at)
        expired = sorted(m for m, (limit, beat) in members.items() if now - beat >= limit)
        for m in expired:
            del members[m]
        generation += bool(expired)
        code = "none"
        if kind == "join":
            generation += member not in members
            members[member] = (timeout, now)
        elif kind != "expire" and member not in members:
            code = "stale_member"
        elif kind == "leave":
            del members[member]
            generation += 1
        elif kind in ("heartbeat", "sync"):
            members[member] = (members[member][0], now)
        state[group] = (generation, now, members)
        out[group, seq] = (generation, code, len(members), expired)
    return out


def some_events(n, seed):
    import random

    r, at, rows = random.Random(seed), 0, []
    for seq in range(n):
        at += r.choice((0, 1, 3, 40, -5))
        kind = r.choice(("join", "join", "heartbeat", "heartbeat", "sync", "leave", "expire", "other"))
        rows.append((r.choice(("g", "h")), seq * (1 << 17), at, kind, None if kind == "expire" else f"m{r.randrange(9)}", r.choice((0, 20, 90, 400, 1 << 40))))
    return rows


def test_membership_equals_a_walk_over_blocks_and_batches(spark, tmp_path):
    """Clocks that run back, time-outs of 0, members that expire between two batches; a batch that was lost runs again from the same state."""
    import shutil

    rows, seen, folder = some_events(600, 3), 0, str(tmp_path / "f")
    want = walked(rows)
    told = lambda df: {(r.group, r.seq): (r.generation, r.error_code, r.members, list(r.expired)) for r in df.collect()}
    assert told(groups.stream_membership(spark.createDataFrame(rows, groups.EVENT))) == want
    (tmp_path / "in").mkdir()
    for name, upto in (("a", 200), ("b", 260), ("c", 600)):
        spark.createDataFrame(rows[seen:upto], groups.EVENT).write.parquet(str(tmp_path / "in" / name))
        seen = upto
        live = spark.readStream.schema(groups.EVENT).parquet(str(tmp_path / "in" / "*"))
        assert told(streams.membership(live, folder)) == {k: v for k, v in want.items() if k[1] < upto * (1 << 17)}
    shutil.rmtree(f"{folder}/state/commits")
    assert told(streams.membership(live, folder)) == want


def test_many_members_are_not_walked_through_in_python(spark):
    """Every event of a group once looked at all its members, and copied them."""
    rows = spark.createDataFrame([("g", 0, 0, "join", "m", 9)], groups.EVENT)
    plan = groups.stream_membership(rows)._jdf.queryExecution().toString()
    assert "Pandas" not in plan and "Window" in plan


def test_one_generation_a_sweep(spark):
    changes = [("g", 0, "join", "a"), ("g", 1, "join", "b"), ("g", 2, "expire", "a"), ("g", 2, "expire", "b"), ("g", 3, "join", "a")]
    got = groups.replay(spark.createDataFrame(changes, "group string, seq bigint, kind string, member_id string"))
    assert [r.generation for r in got.orderBy("seq", "member_id").collect()] == [1, 2, 3, 3, 4]


def test_the_six_alerts(spark):
    flat = {"up": 0, "ready": 0, "consumer_group_lag_records": 10001, "storage_available_bytes": 10, "storage_capacity_bytes": 100}
    rows = [(m, "{}", T0 + dt.timedelta(minutes=k), float(v)) for m, v in flat.items() for k in range(9)]
    rows += [("rejected_requests_total", '{"operation":"produce","reason":"append_queue"}', T0 + dt.timedelta(minutes=k), float(k)) for k in range(8)]
    rows += [("rejected_requests_total", '{"operation":"fetch","reason":"append_queue"}', T0 + dt.timedelta(minutes=k), 0.0) for k in range(8)]
    rows += [("retention_failures_total", "{}", T0 + dt.timedelta(minutes=k), float(v)) for k, v in enumerate([0, 0, 1, 1, 1, 1, 1, 1])]
    told = metrics.alerts(spark.createDataFrame(rows, "metric string, labels string, ts timestamp, value double"))
    fired = {(r.alert, round((r.ts - T0).total_seconds() / 60)) for r in told.filter("firing").collect()}
    for alert, at in (("BrokerDown", 2), ("NotReady", 3), ("AppendOverload", 4), ("ConsumerLagHigh", 6), ("DiskNearlyFull", 6), ("RetentionFailure", 3)):
        assert (alert, at) in fired
    for alert, at in (("BrokerDown", 0), ("NotReady", 1), ("AppendOverload", 2), ("ConsumerLagHigh", 4), ("DiskNearlyFull", 4), ("RetentionFailure", 1)):
        assert (alert, at) not in fired


def test_a_record_that_no_response_holds(spark):
    rows = [("t", 0, o, 5, "k", v, 40 + 1 + len(v)) for o, v in enumerate(["x" * 500, "y"])]
    recs = spark.createDataFrame(rows, "topic string, partition int, offset bigint, timestamp_unix_ns bigint, key string, value string, encoded_byte_size bigint")
    asked = spark.createDataFrame([("t", 0, 0), ("t", 0, 1)], "topic string, partition int, from_offset bigint").withColumn("id", F.col("from_offset"))
    got = {r.from_offset: (r.next_offset, r.records, r.error_code) for r in fetch.responses(asked, fetch.fetch(recs, asked, max_response_bytes=100)).collect()}
    assert got == {0: (None, 0, "invalid_length"), 1: (2, 1, "none")}


def test_appends_follow_each_other(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = lambda *values: spark.createDataFrame([(k, "t", k % 2, 5, "k", v) for k, v in enumerate(values)], "seq bigint, topic string, partition int, timestamp_unix_ns bigint, key string, value string")
    assert {(r.partition, r.base_offset, r.next_offset) for r in store.append(spark, path, rows("a", "b", "c")).collect()} == {(0, 0, 2), (1, 0, 1)}
    store.append(spark, path, rows())
    store.append(spark, path, rows("d", "e"))
    got = sorted((r.partition, r.offset, r.value) for r in store.read_log(spark, path).collect())
    assert got == [(0, 0, "a"), (0, 1, "c"), (0, 2, "d"), (1, 0, "b"), (1, 1, "e")]
    plan = store.read_log(spark, path).filter("topic = 't' AND offset >= 2")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(offset), GreaterThanOrEqual(offset,2)]" in plan
    asked = spark.createDataFrame([("t", 0, 3)], "topic string, partition int, from_offset bigint")
    assert store.wait_for_records(spark, path, asked, 100).first().next_offset == 3


def test_roll_by_age_and_size(spark):
    rows = [("t", p, o, o * 10**9 * (1 + p), "k", "v", 10 + o % 7) for p in range(2) for o in range(200)]
    recs = spark.createDataFrame(rows, "topic string, partition int, offset bigint, timestamp_unix_ns bigint, key string, value string, encoded_byte_size bigint")
    for size, age in ((1, 0), (40, 0), (10**6, 7 * 10**9), (60, 3 * 10**9), (10**6, 0)):
        want, state = {}, {}
        for t, p, o, ns, _, _, n in rows:
            base, filled, opened = state.get(p, (o, 0, ns))
            if filled and (filled + n > size or (age and ns - opened >= age)):
                base, filled, opened = o, 0, ns
            state[p] = (base, filled + n, opened)
            want[p, o] = base
        got = {(r.partition, r.offset): r.segment_base for r in log.roll_segments(recs, size, age).collect()}
        assert got == want, (size, age)


def test_settings_are_strict():
    made = config.from_text(json.dumps({"storage": {"partitions": 8}, "metrics": {"unstable_percent": 20}}))
    assert (made.storage.partitions, made.metrics.unstable_percent, made.limits.max_fetch_records) == (8, 20.0, 100)
    for text, place in (
        ('{"storage": {"partitions": 0}}', "config.storage.partitions"),
        ('{"storage": {"x": 1}}', "config.storage.x"),
        ('{"storage": 3}', "config.storage"),
        ('{"limits": {"max_fetch_bytes": true}}', "config.limits.max_fetch_bytes"),
        ('{"logging": {"level": "loud"}}', "config.logging.level"),
        ('{"storage": {"partitions": 1, "partitions": 2}}', "partitions"),
        ("{", "line 1"),
    ):
        with pytest.raises(config.ConfigError, match=place):
            config.from_text(text)


def test_a_batch_that_runs_again_leaves_no_row_twice(spark, tmp_path):
    (tmp_path / "in").mkdir()
    spark.range(5).write.parquet(str(tmp_path / "in" / "a"))
    live = lambda: spark.readStream.schema("id bigint").parquet(str(tmp_path / "in" / "*"))
    folder = str(tmp_path / "out")
    assert streams.drain(live(), folder=folder).count() == 5
    import shutil

    shutil.rmtree(f"{folder}/state/commits")  # as if the driver had been lost before the commit
    spark.range(5, 7).write.parquet(str(tmp_path / "in" / "b"))
    assert sorted(r.id for r in streams.drain(live(), folder=folder).collect()) == list(range(7))


def test_a_consumer_goes_on_after_its_commits(spark, tmp_path):
    (tmp_path / "in").mkdir()
    folder = str(tmp_path / "reader")

    def run():
        live = spark.readStream.schema("topic string, partition int, offset bigint").parquet(str(tmp_path / "in" / "*"))
        read, commits = streams.consume(live, "g", folder)
        return read.count(), sorted((r.seq, r.topic, r.partition, r.next_offset) for r in commits.collect())

    rows = lambda *at: spark.createDataFrame([("t", p, o) for p, o in at], "topic string, partition int, offset bigint")
    rows((0, 0), (0, 1), (1, 0)).write.parquet(str(tmp_path / "in" / "a"))
    assert run() == (3, [(0, "t", 0, 2), (0, "t", 1, 1)])
    assert run() == (3, [(0, "t", 0, 2), (0, "t", 1, 1)])
    rows((0, 2)).write.parquet(str(tmp_path / "in" / "b"))
    assert run() == (4, [(0, "t", 0, 2), (0, "t", 1, 1), (1, "t", 0, 3)])
    import shutil

    shutil.rmtree(f"{folder}/state/commits")  # lost before the last batches were marked done
    assert run()[0] == 4


def test_a_stream_waits_for_records(spark, tmp_path):
    (tmp_path / "in").mkdir()
    live = spark.readStream.schema("id bigint").parquet(str(tmp_path / "in" / "*"))
    spark.range(3).write.parquet(str(tmp_path / "in" / "a"))
    running = streams.follow(live, str(tmp_path / "f"), "200 milliseconds")
    try:
        running.processAllAvailable()
        assert streams.followed(live, str(tmp_path / "f")).count() == 3
        spark.range(3, 5).write.parquet(str(tmp_path / "in" / "b"))
        running.processAllAvailable()
        assert sorted(r.id for r in streams.followed(live, str(tmp_path / "f")).collect()) == list(range(5))
    finally:
        running.stop()


def test_blocks_of_records_are_decoded_a_few_at_a_time(spark, monkeypatch):
    """A batch of 10,000 blocks was once all Python objects."""
    import tracemalloc

    import pyarrow as pa

    from tidelog.plans import contracts

    caught = []
    monkeypatch.setattr(contracts, "map_arrow", lambda df, run, spec: caught.append(run))
    contracts.log_round_trip(spark, "/root/testdata/sf0.001")
    record = pa.struct([("offset", pa.int64()), ("timestamp_unix_ns", pa.int64()), ("key", pa.binary()), ("value", pa.binary())])
    blocks = [[{"offset": 64 * b + k, "timestamp_unix_ns": k, "key": b"%d" % k, "value": b"x" * 9} for k in range(64)] for b in range(2000)]
    batch = pa.RecordBatch.from_arrays([pa.array(["t"] * 2000), pa.array([0] * 2000, pa.int32()), pa.array(range(2000)), pa.array(blocks, pa.list_(record))], ["topic", "partition", "block", "rows"])
    del blocks
    tracemalloc.start()
    seen, largest = 0, 0
    for part in caught[0](iter([batch])):
        assert part.column(2).to_pylist() == list(range(seen, seen + part.num_rows))
        seen, largest = seen + part.num_rows, max(largest, part.num_rows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert seen == 128_000 and largest <= 8192 and peak < 20e6


@pytest.mark.parametrize("name", ["topic_catalog", "stream_commits", "names_of_codes", "fetch_response_cap", "fetch_committed_groups", "produce_batches", "commit_append", "delete_topics", "stream_membership", "exposition_page", "log_round_trip", "produce_results", "segment_summary"])
def test_queries_equal_their_sql(spark, name):
    c, folder = duckdb.connect(), "/root/testdata/sf0.001"
    for table in ("events", "orders", "lineitem", "conversations", "nation"):
        c.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    got, want = registry.queries()[name](spark, folder).toPandas(), c.sql(registry.oracle_sql()[name]).df()
    cols = sorted(want.columns)
    plain = lambda x: x[cols].astype(str).sort_values(cols).reset_index(drop=True)
    assert cols == sorted(got.columns) and plain(got).equals(plain(want))
