"""Groups, commits, statistics, histograms, rates and alerts."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidelog.operators import groups, log, metrics, offsets, stats
from tidelog.plans import logs, operations

T0 = dt.datetime(2024, 1, 1)


def test_assignment_and_generations(spark):
    members = spark.createDataFrame([("g", "member-000000000002"), ("g", "member-000000000001")], "group string, member_id string")
    got = {}
    for r in groups.assign_ranges(members, 4).collect():
        got.setdefault(r.member_id[-1], set()).add(r.partition)
    assert got == {"1": {0, 1}, "2": {2, 3}}
    changes = [("g", 0, "join", "m1"), ("g", 10, "join", "m2"), ("g", 15, "join", "m1"), ("g", 20, "leave", "m2")]
    replayed = groups.replay(spark.createDataFrame(changes, "group string, seq bigint, kind string, member_id string"))
    assert [r.generation for r in replayed.orderBy("seq").collect()] == [1, 2, 2, 3]


def test_expiry_is_inclusive(spark):
    beats = spark.createDataFrame([("g", "m1", T0 + dt.timedelta(seconds=50)), ("g", "m2", T0 + dt.timedelta(seconds=20))], "group string, member_id string, last_heartbeat timestamp")
    got = {r.member_id: r.expired for r in groups.expiry(beats, F.lit(T0 + dt.timedelta(seconds=120)), 100).collect()}
    assert got == {"m1": False, "m2": True}


def test_fence(spark):
    commits = spark.createDataFrame([("g", "m1", 2, 0), ("g", "m1", 1, 0), ("g", "m2", 2, 0), ("h", "m1", 2, 0)], "group string, member_id string, generation_id int, partition int")
    current = spark.createDataFrame([("g", 2)], "group string, generation_id int")
    owned = spark.createDataFrame([("g", "m1", 0), ("g", "m2", 1)], "group string, member_id string, partition int")
    got = {(r.group, r.member_id, r.generation_id): r.error_code for r in groups.fence(commits, current, owned).collect()}
    assert got == {("g", "m1", 2): "none", ("g", "m1", 1): "stale_member", ("g", "m2", 2): "stale_member", ("h", "m1", 2): "stale_member"}


def test_commits(spark):
    rows = [(1, "dashboard", "trades", 0, 9), (2, "dashboard", "trades", 0, 7), (3, "dashboard", "quotes", 0, 3), (4, "audit", "trades", 1, 9)]
    commits = spark.createDataFrame(rows, "seq bigint, group string, topic string, partition int, next_offset bigint")
    latest = {(r.group, r.topic): r.next_offset for r in offsets.latest_commits(commits).collect()}
    assert latest == {("dashboard", "trades"): 7, ("dashboard", "quotes"): 3, ("audit", "trades"): 9}
    left = log.compact(commits, spark.createDataFrame([("trades",)], "topic string")).collect()
    assert [(r.topic, r.next_offset) for r in left] == [("quotes", 3)]
    limits = spark.createDataFrame([("demo", 0, 0, 25), ("demo", 1, 10, 20)], "topic string, partition int, earliest_offset bigint, next_offset bigint")
    some = spark.createDataFrame([(1, "g", "demo", 0, 10), (2, "g", "gone", 0, 1)], "seq bigint, group string, topic string, partition int, next_offset bigint")
    lags = {r.partition: (r.has_committed_offset, r.lag, r.out_of_range) for r in offsets.describe_groups(offsets.latest_commits(some), limits).collect()}
    assert lags[0] == (True, 15, False) and lags[1][:2] == (False, 10)
    assert offsets.lag_metrics(offsets.latest_commits(some), limits).count() == 1


def test_statistics(spark):
    df = spark.createDataFrame([(x,) for x in (1000, 2000, 3000, 4000)], "v bigint")
    assert tuple(df.agg(*[stats.nearest_rank("v", q, 1000.0) for q in (0.0, 0.5, 0.95, 1.0)]).first()) == (1.0, 2.0, 4.0, 4.0)
    assert df.limit(0).agg(stats.nearest_rank("v", 0.5), stats.median("v")).first()[:] == (0.0, 0.0)
    med = lambda xs: spark.createDataFrame([(x,) for x in xs], "v bigint").agg(stats.median("v"), stats.variation("v")).first()
    assert med([1, 9, 5])[0] == 5 and med([4, 1, 3, 2])[0] == 2.5
    assert med([10, 10, 10])[1] == 0 and med([10])[1] == 0 and med([10, 20])[1] == pytest.approx(47.140452, abs=1e-6)


def test_histogram(spark):
    h = metrics.histogram(spark.createDataFrame([("fetch", 0.004), ("fetch", 99.0)], "operation string, s double"), ["operation"], "s")
    got = {r.le: r.cumulative for r in h.collect()}
    assert got[0.0025] == 0 and got[0.005] == 1 and got[60.0] == 1 and got[None] == 2


def test_rates_and_alerts(spark):
    minute = lambda k: T0 + dt.timedelta(minutes=k)
    series = spark.createDataFrame([("r", minute(k), v) for k, v in enumerate([0, 1, 2, 3, 1, 2])], "s string, ts timestamp, value bigint")
    got = [r.increase for r in metrics.rate(series, ["s"], 120).orderBy("ts").collect()]
    assert got == [0.0, 1.0, 2.0, 2.0, 2.0, 2.0]  # the fall to 1 is a restart
    level = spark.createDataFrame([("l", minute(k), v) for k, v in enumerate([10001] * 9)], "s string, ts timestamp, value bigint")
    fired = [r.firing for r in metrics.firing(level, ["s"], F.col("value") > 10000, 300).orderBy("ts").collect()]
    assert fired == [False] * 5 + [True] * 4
    text = metrics.exposition(spark.createDataFrame([("m", 'a"b', 3)], "metric string, l string, value int"), ["l"]).first().line
    assert text == 'm{l="a\\"b"} 3'


def test_every_query_has_a_column_for_column_oracle(spark):
    import duckdb

    c = duckdb.connect()
    for name in ("events", "orders", "lineitem", "part", "nation", "conversations"):
        c.sql(f"CREATE VIEW {name} AS SELECT * FROM '/root/testdata/sf0.001/{name}.parquet'")
    picked = ("topic_metadata", "fetch_byte_cap", "group_lag_describe", "retention_totals", "stream_offsets")
    every = {**logs.QUERIES, **operations.QUERIES}
    sql = {**logs.SQL, **operations.SQL}
    for name in picked:
        got = every[name](spark, "/root/testdata/sf0.001").toPandas()
        want = c.sql(sql[name]).df()
        cols = sorted(want.columns)
        assert cols == sorted(got.columns)
        plain = lambda x, cols=cols: x[cols].astype(str).sort_values(cols).reset_index(drop=True)
        assert plain(got).equals(plain(want)), name


def test_ranks_are_found_in_ranges(spark):
    """Ranks in whole numbers (0.07 * 100 is above 7 in doubles), a value that fills many ranges, keys and values that are null; no samples are gathered."""
    rows = [("a", float(v)) for v in range(100, 0, -1)] + [("b", 5.0)] * 500 + [("b", float("nan")), ("b", None), (None, 3.0), (None, -1.0), ("c", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = stats.pooled(df, ["k"], "v", {"p7": 0.07, "p50": 0.5, "p100": 1.0})
    told = {r.k: (r.samples, r.p7, r.p50, str(r.p100)) for r in got.collect()}
    assert told == {"a": (100, 7.0, 50.0, "100.0"), "b": (501, 5.0, 5.0, "nan"), None: (2, -1.0, -1.0, "3.0"), "c": (0, 0.0, 0.0, "0.0")}
    assert "percentile" not in got._jdf.queryExecution().toString().lower()
    assert {r.k: r.m for r in stats.ranked(df, ["k"], "v", stats.MIDDLE).select("k", stats.middle().alias("m")).collect()} == {"a": 50.5, "b": 5.0, None: 1.0, "c": 0.0}
    few = spark.createDataFrame([(k % 7, k) for k in range(1000)], "k int, v int")
    assert sorted(stats.ranked(few, [], "v", {"p95": stats.rank_of(0.95)}).collect()[0][:]) == [949, 1000]
    assert stats.ranked(few.limit(0), ["k"], "v", {"p": stats.rank_of(0.5)}).count() == 0
