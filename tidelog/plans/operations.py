"""Queries on groups, metrics, statistics, alerts and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelog.functions import BATCH_BOUNDS, DURATION_BOUNDS
from tidelog.operators import groups, metrics, stats
from tidelog.plans.base import PARTITIONS, fnv_sql, records, records_sql, table
from tidelog.streaming import queries as streams

QUERIES: dict = {}
SQL: dict[str, str] = {}
OWNED = 256
TIMEOUT = 6 * 3600
NOW = "2024-01-25 12:00:00"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _beats(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    return ev.select(F.col("event_id").alias("seq"), F.col("event_type").alias("group"), F.concat(F.lit("member-"), F.lpad(F.col("user_id").cast("string"), 12, "0")).alias("member_id"), F.col("ts").cast("timestamp").alias("ts"), "event_id")


_BEATS = "beats AS (SELECT event_id AS seq, event_type AS grp, 'member-' || lpad(user_id::VARCHAR, 12, '0') AS member_id, ts FROM events)"
_ASSIGN = f"""mem AS (SELECT DISTINCT grp, member_id FROM beats), placed AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY member_id) - 1 AS pos, count(*) OVER (PARTITION BY grp) AS m FROM mem),
own AS (SELECT grp, member_id, unnest(range(pos * ({OWNED} // m) + least(pos, {OWNED} % m), (pos + 1) * ({OWNED} // m) + least(pos + 1, {OWNED} % m)))::INT AS partition FROM placed)"""


@query(f'WITH {_BEATS}, {_ASSIGN} SELECT grp AS "group", member_id, partition FROM own')
def range_assignment(spark, sf_dir):
    return groups.assign_ranges(_beats(spark, sf_dir), OWNED)


@query(f"""WITH {_BEATS} SELECT grp AS "group", member_id, max(ts) AS last_heartbeat, epoch_us(TIMESTAMP '{NOW}') - epoch_us(max(ts)) >= {TIMEOUT * 1000000} AS expired
FROM beats WHERE ts <= TIMESTAMP '{NOW}' GROUP BY ALL""")
def member_expiry(spark, sf_dir):
    beats = _beats(spark, sf_dir).filter(F.col("ts") <= F.lit(NOW).cast("timestamp"))
    told = groups.expiry(groups.last_heartbeats(beats), F.lit(NOW).cast("timestamp"), TIMEOUT)
    return told.withColumn("last_heartbeat", F.col("last_heartbeat").cast("timestamp_ntz"))


@query(f"""WITH {_BEATS} SELECT grp AS "group", member_id, min(seq) AS seq, row_number() OVER (PARTITION BY grp ORDER BY min(seq))::BIGINT AS generation FROM beats GROUP BY grp, member_id""")
def group_generation(spark, sf_dir):
    return groups.generations(_beats(spark, sf_dir))


@query(f"""WITH {_BEATS}, c AS (SELECT seq, grp, member_id, CASE WHEN seq % 5 = 0 THEN 'leave' ELSE 'join' END AS kind FROM beats),
w AS (SELECT *, coalesce(lag(kind) OVER (PARTITION BY grp, member_id ORDER BY seq) = 'join', false) AS was FROM c)
SELECT grp AS "group", seq, kind, member_id, sum(CASE WHEN (kind = 'join') <> was THEN 1 ELSE 0 END) OVER (PARTITION BY grp ORDER BY seq ROWS UNBOUNDED PRECEDING)::BIGINT AS generation FROM w""")
def generation_replay(spark, sf_dir):
    """Joins and leaves in order: only changes of membership raise the generation."""
    c = _beats(spark, sf_dir).select("seq", "group", "member_id", F.when(F.col("seq") % 5 == 0, "leave").otherwise("join").alias("kind"))
    return groups.replay(c).select("group", "seq", "kind", "member_id", "generation")


@query(f"""WITH {_BEATS}, {_ASSIGN}, c AS (SELECT seq, grp, member_id, (seq % {OWNED})::INT AS partition, 1 + seq % 2 AS generation_id FROM beats UNION ALL
  SELECT 1000000 + row_number() OVER (ORDER BY grp, member_id, partition), grp, member_id, partition, 2 FROM own)
SELECT grp AS "group", error_code, count(*)::BIGINT AS commits FROM (SELECT c.grp, CASE WHEN generation_id <> 2 OR o.grp IS NULL THEN 'stale_member' ELSE 'none' END AS error_code
  FROM c LEFT JOIN own o ON o.grp = c.grp AND o.member_id = c.member_id AND o.partition = c.partition) GROUP BY ALL""")
def fence_commits(spark, sf_dir):
    beats = _beats(spark, sf_dir)
    owned = groups.assign_ranges(beats, OWNED)
    tried = beats.select("group", "member_id", (F.col("seq") % OWNED).cast("int").alias("partition"), (1 + F.col("seq") % 2).alias("generation_id"))
    tried = tried.unionByName(owned.withColumn("generation_id", F.lit(2).cast("bigint")))
    current = beats.select("group").distinct().withColumn("generation_id", F.lit(2))
    return groups.fence(tried, current, owned).groupBy("group", "error_code").agg(F.count(F.lit(1)).alias("commits"))


@query(f"""WITH {_BEATS} SELECT grp AS "group", count(*) FILTER (NOT expired)::BIGINT AS active, count(*)::BIGINT AS members FROM
(SELECT grp, member_id, epoch_us(TIMESTAMP '{NOW}') - epoch_us(max(ts)) >= {TIMEOUT * 1000000} AS expired FROM beats WHERE ts <= TIMESTAMP '{NOW}' GROUP BY ALL) GROUP BY grp""")
def active_members(spark, sf_dir):
    told = member_expiry(spark, sf_dir)
    return told.groupBy("group").agg(F.count(F.when(~F.col("expired"), 1)).alias("active"), F.count(F.lit(1)).alias("members"))


@query("""WITH v AS (SELECT * FROM (SELECT unnest(['click', 'error', 'purchase', 'signup', 'view', 'admin']) AS operation), (SELECT unnest(['none', 'overloaded']) AS error_code)),
c AS (SELECT event_type AS operation, CASE WHEN value > 100 THEN 'overloaded' ELSE 'none' END AS error_code, count(*) AS n FROM events GROUP BY ALL)
SELECT v.operation, v.error_code, coalesce(n, 0)::BIGINT AS total FROM v LEFT JOIN c ON c.operation = v.operation AND c.error_code = v.error_code""")
def op_counters(spark, sf_dir):
    """Dense counters: every operation and outcome, seen or not."""
    ev = table(spark, sf_dir, "events").select(F.col("event_type").alias("operation"), F.when(F.col("value") > 100, "overloaded").otherwise("none").alias("error_code"))
    words = spark.createDataFrame([(o, e) for o in ("click", "error", "purchase", "signup", "view", "admin") for e in ("none", "overloaded")], "operation string, error_code string")
    return metrics.counters(ev, ["operation", "error_code"], words)


def _samples(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("operation"), (F.col("value") / 10).alias("seconds"))


_BOUNDS = ", ".join(f"{b}::DOUBLE" for b in DURATION_BOUNDS)
_HIST = f"""s AS (SELECT event_type AS operation, value / 10 AS seconds FROM events), b AS (SELECT unnest([{_BOUNDS}, NULL]) AS le),
h AS (SELECT operation, le, count(*) FILTER (le IS NULL OR seconds <= le)::BIGINT AS cumulative FROM s CROSS JOIN b GROUP BY ALL)"""


@query(f"WITH {_HIST} SELECT operation, coalesce(le::DOUBLE, -1) AS le, cumulative FROM h")
def latency_histogram(spark, sf_dir):
    h = metrics.histogram(_samples(spark, sf_dir), ["operation"], "seconds")
    return h.select("operation", F.coalesce("le", F.lit(-1.0)).alias("le"), "cumulative")


@query("""WITH g AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1), b AS (SELECT unnest([1, 2, 4, 8, 16, 32, 64, 128, 256, 512, 1024]) AS le)
SELECT le::DOUBLE AS le, count(*) FILTER (n <= le)::BIGINT AS cumulative, count(*)::BIGINT AS samples, sum(n)::BIGINT AS total FROM g CROSS JOIN b GROUP BY le""")
def batch_histogram(spark, sf_dir):
    """Orders of a customer as records of a batch."""
    g = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return metrics.histogram(g, [], "n", BATCH_BOUNDS).filter("le IS NOT NULL").select("le", "cumulative", "samples", F.col("total").cast("bigint").alias("total"))


@query(f"""WITH {_HIST}, r AS (SELECT *, 0.95 * max(cumulative) OVER (PARTITION BY operation) AS rank, coalesce(lag(le) OVER w, 0) AS low, coalesce(lag(cumulative) OVER w, 0) AS before FROM h WINDOW w AS (PARTITION BY operation ORDER BY le NULLS LAST))
SELECT operation, round(CASE WHEN le IS NULL THEN low ELSE low + (le - low) * (rank - before) / (cumulative - before) END, 6)::DOUBLE AS quantile FROM r WHERE cumulative >= rank AND before < rank""")
def histogram_quantile(spark, sf_dir):
    h = metrics.histogram(_samples(spark, sf_dir), ["operation"], "seconds")
    return metrics.histogram_quantile(h, ["operation"], 0.95).select("operation", F.round("quantile", 6).alias("quantile"))


def _series(spark, sf_dir):
    """A counter of each operation by hour, restarting every 40 counts."""
    ev = table(spark, sf_dir, "events").select(F.col("event_type").alias("operation"), F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("ts"))
    from pyspark.sql import Window as W

    hourly = ev.groupBy("operation", "ts").agg(F.count(F.lit(1)).alias("n"))
    upto = W.partitionBy("operation").orderBy("ts").rowsBetween(W.unboundedPreceding, W.currentRow)
    return hourly.select("operation", "ts", (F.sum("n").over(upto) % 40).alias("value"))


_SERIES = """hourly AS (SELECT event_type AS operation, date_trunc('hour', ts) AS ts, count(*) AS n FROM events GROUP BY ALL),
series AS (SELECT operation, ts, (sum(n) OVER (PARTITION BY operation ORDER BY ts ROWS UNBOUNDED PRECEDING) % 40)::BIGINT AS value FROM hourly)"""
_DELTA = """d AS (SELECT *, lag(value) OVER (PARTITION BY operation ORDER BY ts) AS prev FROM series), m AS (SELECT operation, ts, value, CASE WHEN prev IS NULL THEN NULL WHEN value < prev THEN value ELSE value - prev END AS delta FROM d)"""


@query(f"""WITH {_SERIES}, {_DELTA} SELECT operation, ts, value, coalesce(sum(delta) OVER w, 0)::DOUBLE AS increase, round(coalesce(sum(delta) OVER w, 0)::DOUBLE / 21600, 9) AS rate
FROM m WINDOW w AS (PARTITION BY operation ORDER BY epoch(ts)::BIGINT RANGE BETWEEN 21599 PRECEDING AND CURRENT ROW)""")
def counter_rate(spark, sf_dir):
    r = metrics.rate(_series(spark, sf_dir), ["operation"], 21600)
    return r.select("operation", F.col("ts").cast("timestamp_ntz").alias("ts"), "value", "increase", F.round("rate", 9).alias("rate"))


@query(f"""WITH {_SERIES}, i AS (SELECT *, sum(CASE WHEN value > 10 THEN 0 ELSE 1 END) OVER (PARTITION BY operation ORDER BY ts ROWS UNBOUNDED PRECEDING) AS island FROM series),
p AS (SELECT operation, ts, value, value > 10 AS condition, CASE WHEN value > 10 THEN min(CASE WHEN value > 10 THEN ts END) OVER (PARTITION BY operation, island) END AS pending_since FROM i)
SELECT *, coalesce(epoch(ts) - epoch(pending_since) >= 18000, false) AS firing FROM p""")
def alert_for(spark, sf_dir):
    """Alerts that fire once a level has been exceeded for five hours."""
    told = metrics.firing(_series(spark, sf_dir), ["operation"], F.col("value") > 10, 18000)
    return told.select("operation", F.col("ts").cast("timestamp_ntz").alias("ts"), "value", "condition", F.col("pending_since").cast("timestamp_ntz").alias("pending_since"), "firing")


@query("""WITH r AS (SELECT o_orderpriority AS volume, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS available, count(*) AS capacity FROM orders GROUP BY 1)
SELECT volume, round(available / capacity::DOUBLE, 9) AS free, available / capacity::DOUBLE < 0.45 AS firing FROM r""")
def alert_ratio(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    r = o.groupBy(F.col("o_orderpriority").alias("volume")).agg(F.count(F.when(F.col("o_orderstatus") == "F", 1)).alias("available"), F.count(F.lit(1)).alias("capacity"))
    free = F.col("available") / F.col("capacity")
    return r.select("volume", F.round(free, 9).alias("free"), (free < 0.45).alias("firing"))


_P = [(0.0, "p0"), (0.5, "p50"), (0.95, "p95"), (0.99, "p99"), (1.0, "p100")]


@query("SELECT event_type, " + ", ".join(f"quantile_disc(value, {q})::DOUBLE AS {n}" for q, n in _P) + ", round(median(value), 6) AS median FROM events GROUP BY 1")
def latency_percentiles(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    found = stats.ranked(ev, ["event_type"], "value", {n: stats.rank_of(q) for q, n in _P} | stats.MIDDLE)
    return found.select("event_type", *[F.coalesce(F.col(n).cast("double"), F.lit(0.0)).alias(n) for _, n in _P], F.round(stats.middle(), 6).alias("median"))


def _runs(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    keys = ["profile", "workload", "run"]
    li = li.select(F.col("l_returnflag").alias("profile"), F.col("l_linestatus").alias("workload"), F.col("l_linenumber").alias("run"), "l_quantity", "l_extendedprice")
    told = li.groupBy(*keys).agg((F.sum(F.col("l_quantity").cast("bigint")) / F.count(F.lit(1))).alias("throughput"), F.max("l_extendedprice").alias("slowest"))
    return stats.beside(told, stats.pooled(li, keys, "l_extendedprice", {"p50": 0.5, "p99": 0.99}).drop("samples"), keys)


_RUNS = """runs AS (SELECT l_returnflag AS profile, l_linestatus AS workload, l_linenumber AS run, sum(l_quantity::BIGINT)::DOUBLE / count(*) AS throughput,
  quantile_disc(l_extendedprice, 0.5) AS p50, quantile_disc(l_extendedprice, 0.99) AS p99, max(l_extendedprice) AS slowest FROM lineitem GROUP BY ALL),
up AS (SELECT profile, workload, median(throughput) AS med, min(throughput) AS least, max(throughput) AS most, CASE WHEN count(*) < 2 OR avg(throughput) = 0 THEN 0 ELSE stddev_samp(throughput) / avg(throughput) * 100 END AS cv,
  median(p50) AS p50, median(p99) AS p99, max(slowest) AS slowest, count(*)::BIGINT AS runs FROM runs GROUP BY ALL)"""


@query(f"WITH {_RUNS} SELECT profile, workload, round(med, 4) AS median, round(least, 4) AS least, round(most, 4) AS most, round(cv, 4) AS cv, round(p50, 4) AS p50, round(p99, 4) AS p99, slowest, runs, cv > 15 AS unstable FROM up")
def throughput_rollup(spark, sf_dir):
    up = stats.roll_up(_runs(spark, sf_dir), ["profile", "workload"])
    return up.select("profile", "workload", *[F.round(c, 4).alias(c) for c in ("median", "least", "most", "cv", "p50", "p99")], "slowest", "runs", "unstable")


@query(f"WITH {_RUNS} SELECT profile, workload, round(med, 4) AS median FROM up ORDER BY med DESC, profile LIMIT 1")
def best_profile(spark, sf_dir):
    return stats.best(stats.roll_up(_runs(spark, sf_dir), ["profile", "workload"])).select("profile", "workload", F.round("median", 4).alias("median"))


@query("""SELECT event_type, count(*)::BIGINT AS records, sum(strlen(props))::BIGINT AS bytes, round(count(*)::DOUBLE / (max(event_id) - min(event_id)), 9) AS records_per_second,
  round(sum(strlen(props))::DOUBLE / (max(event_id) - min(event_id)) / 1048576, 12) AS mebibytes_per_second FROM events GROUP BY 1""")
def throughput(spark, sf_dir):
    ev = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("records"), F.sum(F.octet_length("props")).alias("bytes"), (F.max("event_id") - F.min("event_id")).alias("seconds"))
    return ev.select(
        "event_type",
        "records",
        "bytes",
        F.round(stats.per_second(F.col("records"), F.col("seconds")), 9).alias("records_per_second"),
        F.round(stats.mebibytes_per_second(F.col("bytes"), F.col("seconds")), 12).alias("mebibytes_per_second"),
    )


@query(f"""WITH {records_sql("event_type")}, b AS (SELECT topic, partition, max(off) + 1 AS nxt, sum(size) AS bytes FROM rec GROUP BY ALL)
SELECT 'log_next_offset{{topic="' || topic || '",partition="' || partition || '"}} ' || nxt AS line FROM b
UNION ALL SELECT 'log_bytes{{topic="' || topic || '",partition="' || partition || '"}} ' || bytes FROM b""")
def prometheus_text(spark, sf_dir):
    from tidelog.operators.log import bounds

    b = bounds(records(spark, sf_dir, "event_type"))
    rows = F.inline(F.array(F.struct(F.lit("log_next_offset").alias("metric"), F.col("next_offset").alias("value")), F.struct(F.lit("log_bytes").alias("metric"), F.col("log_bytes").alias("value"))))
    return metrics.exposition(b.select("topic", "partition", rows), ["topic", "partition"]).select("line")


@query("""SELECT n_name, replace(replace(replace(n_name || chr(92) || '"' || chr(10), chr(92), chr(92) || chr(92)), '"', chr(92) || '"'), chr(10), chr(92) || 'n') AS escaped FROM nation""")
def label_escapes(spark, sf_dir):
    from tidelog.functions import escaped_label

    return table(spark, sf_dir, "nation").select("n_name", escaped_label(F.concat("n_name", F.lit('\\"\n'))).alias("escaped"))


@query("""WITH p AS (SELECT unnest([1, 2, 3, 4, 5, 6]) AS round) SELECT round, CASE (round - 1) % 3 WHEN 0 THEN 'a,b,c' WHEN 1 THEN 'b,c,a' ELSE 'c,a,b' END AS profiles FROM p""")
def profile_rotation(spark, sf_dir):
    """The order of three profiles in each round."""
    names = F.array(F.lit("a"), F.lit("b"), F.lit("c"))
    turn = F.pmod(F.col("round") - 1, F.lit(3))
    rotated = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda k: F.get(names, F.pmod(k + turn, F.lit(3))))
    return spark.range(1, 7).select(F.col("id").cast("int").alias("round")).select("round", F.array_join(rotated, ",").alias("profiles"))


@query("""WITH a AS (SELECT event_id AS seq, event_type AS topic, event_id // 50 AS tick FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY topic, tick ORDER BY seq) AS place FROM a)
SELECT topic, count(*) FILTER (place <= 10)::BIGINT AS accepted, count(*) FILTER (place > 10)::BIGINT AS overloaded FROM r GROUP BY topic""")
def queue_admission(spark, sf_dir):
    """A queue of ten that is drained every tick: what is accepted, and what is refused as overloaded."""
    from pyspark.sql import Window as W

    a = table(spark, sf_dir, "events").select(F.col("event_type").alias("topic"), F.col("event_id").alias("seq"), F.floor(F.col("event_id") / 50).alias("tick"))
    r = a.withColumn("place", F.row_number().over(W.partitionBy("topic", "tick").orderBy("seq")))
    return r.groupBy("topic").agg(F.count(F.when(F.col("place") <= 10, 1)).alias("accepted"), F.count(F.when(F.col("place") > 10, 1)).alias("overloaded"))


@query(f"""SELECT partition, count(*)::BIGINT AS records, (max(event_id) + 1)::BIGINT AS next_offset FROM (SELECT event_id, {fnv_sql("user_id::VARCHAR", PARTITIONS)} AS partition FROM events) GROUP BY 1""")
def stream_offsets(spark, sf_dir):
    """Records and next offset a partition, kept by a stream over the events table."""
    from tidelog.functions import fnv1a_partition

    live = streams.stream_table(spark, f"{sf_dir}/events.parquet")
    return streams.consumed_offsets(live.select(fnv1a_partition(F.col("user_id").cast("string"), PARTITIONS).alias("partition"), "event_id"), ["partition"], "event_id")


@query(f"""WITH {_BEATS}, g AS (SELECT *, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER w) >= {TIMEOUT * 1000000}, true) AS new FROM beats WINDOW w AS (PARTITION BY grp, member_id ORDER BY ts, seq)),
i AS (SELECT *, sum(new::INT) OVER (PARTITION BY grp, member_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS s FROM g), x AS (
SELECT grp, member_id, min(ts) AS started, max(ts) + INTERVAL {TIMEOUT} SECOND AS expires, count(*)::BIGINT AS beats FROM i GROUP BY grp, member_id, s)
SELECT grp AS "group", member_id, started, expires, beats FROM x WHERE expires <= (SELECT max(ts) FROM events)""")
def stream_group_state(spark, sf_dir):
    """Sessions that a heartbeat gap has closed, by a stream with event-time state."""
    live = streams.stream_table(spark, f"{sf_dir}/events.parquet")
    beats = live.select(F.col("event_type").alias("group"), F.concat(F.lit("member-"), F.lpad(F.col("user_id").cast("string"), 12, "0")).alias("member_id"), F.col("ts").cast("timestamp").alias("ts"))
    closed = streams.group_liveness(beats, TIMEOUT)
    return closed.select("group", "member_id", F.col("started").cast("timestamp_ntz").alias("started"), F.col("expires").cast("timestamp_ntz").alias("expires"), "beats")
