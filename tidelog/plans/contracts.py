"""Queries on what is written and answered: names, codecs, appends, commits, members, reports and pages."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import functions as F

from tidelog.functions import CODEC_NAMES, ERROR_NAMES, OPERATIONS, codec_name, common_codecs, error_name, frame_name, is_request, is_retryable, joined_assignment, topic_matches
from tidelog.operators import fetch as fetching
from tidelog.operators import groups, log, metrics, offsets, stats, store
from tidelog.plans.base import BOUNDS_SQL, COMMITS_SQL, PARTITIONS, arrivals, commits, records, records_sql, table, trimmed_bounds
from tidelog.plans.operations import _ASSIGN, _BEATS, _SERIES, OWNED, _beats, _series
from tidelog.shipping import map_arrow, sliced
from tidelog.sources import codec, text
from tidelog.streaming import queries as streams

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _list(names: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{n}'" for n in names) + "]"


_FRAMES = ("error_response", *(f"{n}_{k}" for n in OPERATIONS for k in ("request", "response")))


@query(f"""SELECT code::BIGINT AS code, coalesce({_list(ERROR_NAMES)}[code], 'unknown_error') AS error, coalesce({_list(_FRAMES)}[code], 'unknown') AS frame, coalesce({_list(CODEC_NAMES)}[code + 1], 'unknown') AS codec,
  coalesce({_list(_FRAMES)}[code] LIKE '%\\_request' ESCAPE '\\', false) AS is_request, coalesce({_list(ERROR_NAMES)}[code] IN ('overloaded', 'rebalance_required'), false) AS retryable
FROM (SELECT unnest(range(0, 50)) AS code)""")
def names_of_codes(spark, sf_dir):
    c = F.col("code")
    return spark.range(50).select(F.col("id").alias("code")).select("code", error_name(c).alias("error"), frame_name(c).alias("frame"), codec_name(c).alias("codec"), is_request(c).alias("is_request"), is_retryable(error_name(c)).alias("retryable"))


@query("""SELECT mine, theirs, coalesce(CASE WHEN (mine & theirs & 1) = 1 THEN mine & theirs END, -1)::BIGINT AS common, count(*)::BIGINT AS sessions
FROM (SELECT o_custkey % 4 AS mine, o_orderkey % 4 AS theirs FROM orders) GROUP BY ALL""")
def codec_negotiation(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 4).alias("mine"), (F.col("o_orderkey") % 4).alias("theirs"))
    return o.groupBy("mine", "theirs", F.coalesce(common_codecs(F.col("mine"), F.col("theirs")), F.lit(-1)).alias("common")).agg(F.count(F.lit(1)).alias("sessions"))


@query(f"""WITH {_BEATS}, {_ASSIGN} SELECT grp AS "group", member_id, string_agg(partition::VARCHAR, ',' ORDER BY partition) AS assignment FROM own GROUP BY ALL""")
def joined_assignments(spark, sf_dir):
    owned = groups.assign_ranges(_beats(spark, sf_dir), OWNED)
    return owned.groupBy("group", "member_id").agg(joined_assignment(F.collect_list("partition")).alias("assignment"))


@query(f"""WITH {records_sql("event_type")}, w AS (SELECT unnest(['', 'click', 'gone']) AS wanted)
SELECT wanted, topic, count(DISTINCT partition)::BIGINT AS partitions, count(*)::BIGINT AS records FROM rec, w WHERE wanted = '' OR topic = wanted GROUP BY ALL""")
def topic_filter(spark, sf_dir):
    """Listings with an optional topic: an empty one asks for all."""
    b = log.bounds(records(spark, sf_dir, "event_type")).select("*", F.explode(F.array(F.lit(""), F.lit("click"), F.lit("gone"))).alias("wanted"))
    return b.filter(topic_matches(F.col("topic"), F.col("wanted"))).groupBy("wanted", "topic").agg(F.count(F.lit(1)).alias("partitions"), F.sum("records").alias("records"))


_CAPPED = """got AS (
  SELECT b.topic, b.partition, off, size, row_number() OVER w AS n, 26 + strlen(b.topic) + sum(28 + strlen(key) + strlen(value)) OVER w AS response
  FROM bounds b JOIN rec r ON r.topic = b.topic AND r.partition = b.partition AND r.off >= b.earliest AND r.off < b.earliest + 100
  WINDOW w AS (PARTITION BY b.topic, b.partition ORDER BY off ROWS UNBOUNDED PRECEDING)
)"""


@query(f"""WITH {records_sql()}, {BOUNDS_SQL}, {_CAPPED}, c AS (SELECT unnest([60, 75, 1000]) AS cap)
SELECT cap::BIGINT AS cap, topic, partition, coalesce(max(off) FILTER (response <= cap) + 1, -1)::BIGINT AS next_offset, count(*) FILTER (response <= cap)::BIGINT AS records,
  coalesce(sum(size) FILTER (response <= cap), 0)::BIGINT AS bytes, CASE WHEN min(response) > cap THEN 'invalid_length' ELSE 'none' END AS error_code
FROM got, c GROUP BY cap, topic, partition""")
def fetch_response_cap(spark, sf_dir):
    """Fetches from the beginning under caps of the response: one that holds no record is an error."""
    recs = records(spark, sf_dir).filter("offset >= 100")
    requests = log.bounds(recs).select("topic", "partition", F.col("earliest_offset").alias("from_offset"))
    out = None
    for cap in (60, 75, 1000):
        told = fetching.responses(requests, fetching.fetch(recs, requests, 100, 0, cap)).select(F.lit(cap).cast("bigint").alias("cap"), "topic", "partition", F.coalesce("next_offset", F.lit(-1)).alias("next_offset"), "records", "bytes", "error_code")
        out = told if out is None else out.unionByName(told)
    return out


@query(f"""WITH {records_sql()}, {BOUNDS_SQL}, {COMMITS_SQL}, req AS (
  SELECT g.grp, b.topic, b.partition, coalesce(committed, earliest) AS wanted, earliest, nxt FROM (SELECT DISTINCT grp FROM latest) g CROSS JOIN bounds b
  LEFT JOIN latest l ON l.topic = b.topic AND l.partition = b.partition AND l.grp = g.grp
), q AS (SELECT *, CASE WHEN wanted < earliest THEN 'offset_out_of_range' WHEN wanted > nxt THEN 'invalid_offset' ELSE 'none' END AS error_code FROM req),
got AS (SELECT q.grp, q.topic, q.partition, count(*) AS records, sum(size) AS bytes, max(off) + 1 AS nx FROM q JOIN rec r ON r.topic = q.topic AND r.partition = q.partition
  AND r.off >= q.wanted AND r.off < q.wanted + 100 WHERE error_code = 'none' GROUP BY ALL)
SELECT q.grp AS "group", q.topic, q.partition, coalesce(CASE WHEN error_code = 'none' THEN wanted END, -1)::BIGINT AS from_offset, coalesce(CASE WHEN error_code = 'none' THEN coalesce(nx, wanted) END, -1)::BIGINT AS next_offset,
  coalesce(records, 0)::BIGINT AS records, coalesce(bytes, 0)::BIGINT AS bytes, error_code FROM q LEFT JOIN got ON got.grp = q.grp AND got.topic = q.topic AND got.partition = q.partition""")
def fetch_committed_groups(spark, sf_dir):
    """What every group gets from its commits, errors included."""
    recs, c = records(spark, sf_dir).filter("offset >= 100"), offsets.latest_commits(commits(spark, sf_dir))
    limits = log.bounds(recs)
    asked = limits.select("topic", "partition", F.lit("committed").alias("selector")).join(c.select("group", "topic").distinct(), "topic")
    chosen = fetching.select_offsets(asked, limits, c).select("group", "topic", "partition", "from_offset", "error_code")
    able = chosen.filter("error_code = 'none'").drop("error_code")
    told = fetching.responses(chosen, fetching.fetch(recs, able))
    return told.fillna(-1, ["from_offset", "next_offset"]).select("group", "topic", "partition", "from_offset", "next_offset", "records", "bytes", "error_code")


@query(f'WITH {records_sql()} SELECT topic, partition, off AS "offset", timestamp_unix_ns, key, value FROM rec')
def log_round_trip(spark, sf_dir):
    """Blocks of 64 records as entries, single ones and compressed batches in turn, and what decoding the bytes gives back."""
    spec = "topic string, partition int, offset bigint, timestamp_unix_ns bigint, key string, value string"
    row = F.struct("offset", "timestamp_unix_ns", F.col("key").cast("binary").alias("key"), F.col("value").cast("binary").alias("value"))
    blocks = records(spark, sf_dir).groupBy("topic", "partition", F.expr("offset div 64").alias("block")).agg(F.sort_array(F.collect_list(row)).alias("rows"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 64):
            out: list[list] = [[], [], [], [], [], []]
            for b in batch.to_pylist():
                rows, times = b["rows"], {r["offset"]: r["timestamp_unix_ns"] for r in b["rows"]}
                if b["block"] % 2:
                    raw = codec.encode_batch(rows[0]["offset"], rows[0]["timestamp_unix_ns"], [(r["key"], r["value"]) for r in rows])
                else:
                    raw = b"".join(codec.encode_record(r["offset"], r["timestamp_unix_ns"], r["key"], r["value"]) for r in rows)
                for _, _, found, problem in codec.decode_log(raw):
                    if problem:
                        raise ValueError(problem)
                    for offset, _, key, value, _ in found:
                        for c, v in zip(out, (b["topic"], b["partition"], offset, times[offset], key.decode(), value.decode()), strict=True):
                            c.append(v)
            kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], [p.strip().split(" ")[0] for p in spec.split(",")])

    return map_arrow(blocks, run, spec)


@query(f"""WITH {COMMITS_SQL}, bad AS (SELECT grp, min(seq) AS seq FROM commits WHERE seq % 997 = 996 GROUP BY grp)
SELECT c.grp AS "group", c.seq, topic, partition, nxt AS next_offset FROM commits c LEFT JOIN bad ON bad.grp = c.grp WHERE bad.seq IS NULL OR c.seq < bad.seq""")
def offset_log_recovery(spark, sf_dir):
    """The offset log as lines, some of them damaged, and what reading gives: all before the first bad line of each group."""
    lines = text.offset_log_lines(commits(spark, sf_dir))
    damaged = lines.withColumn("line", F.when(F.col("seq") % 997 == 996, F.concat("line", F.lit("0"))).otherwise(F.concat("line", F.lit("\r"))))
    return text.parse_offset_log(damaged)


@query("SELECT event_type AS scrape_id, arg_min(user_id, event_id) AS value FROM events WHERE event_id % 10 <> 0 GROUP BY 1")
def scrape_first_value(spark, sf_dir):
    """The first line of a counter in pages whose every tenth line is another metric's."""
    ev = table(spark, sf_dir, "events")
    line = F.concat(F.when(F.col("event_id") % 10 == 0, "other ").otherwise("users "), F.col("user_id").cast("string"))
    return metrics.scrape(ev.select(F.col("event_type").alias("scrape_id"), F.col("event_id").alias("at"), line.alias("line")), "users")


def _fresh(spark) -> str:
    return f"{streams._folder(spark)}/log"


@query(f"""WITH {records_sql("event_type")} SELECT topic, partition, min(off)::BIGINT AS earliest_offset, (max(off) + 1)::BIGINT AS next_offset, count(*)::BIGINT AS records, sum(size)::BIGINT AS log_bytes FROM rec GROUP BY ALL""")
def log_append(spark, sf_dir):
    """A log that is written in two appends, the second one after the offsets of the first, and read back."""
    path = _fresh(spark)
    routed = log.route(arrivals(spark, sf_dir, "event_type"), PARTITIONS)
    half = routed.agg(F.expr("max(seq) div 2")).first()[0] or 0
    for part in (f"seq <= {half}", f"seq > {half}"):
        store.append(spark, path, routed.filter(part))
    return log.bounds(store.read_log(spark, path))


def _encoded(spark, sf_dir):
    """Conversations as encoded batches; some of a codec that is not offered, of a wrong count, damaged, or for a partition that does not exist."""
    c = table(spark, sf_dir, "conversations").filter("text IS NOT NULL AND text <> ''")
    sets = c.groupBy(F.col("conv_id").alias("batch")).agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("rows"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 64):
            out = []
            for b in batch.to_pylist():
                k, pairs = b["batch"], [(r["role"].encode(), r["text"].encode()) for r in b["rows"]]
                raw = codec.encode_record_set(pairs)
                stored = codec.compress(codec.ZSTD, raw) if k % 11 != 5 else b"damaged"
                out.append((k, "chats", 9 if k % 7 == 3 else k % 4, 2 if k % 5 == 4 else 1, len(pairs) + (k % 13 == 6), len(raw), stored, 0))
            names = [p.strip().split(" ")[0] for p in store.BATCHES.split(",")]
            kinds = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([o[j] for o in out], kinds[j]) for j in range(8)], names)

    return map_arrow(sets, run, store.BATCHES)


@query("""WITH b AS (SELECT conv_id AS batch, count(*) AS n FROM conversations WHERE text IS NOT NULL AND text <> '' GROUP BY 1),
e AS (SELECT batch, CASE WHEN batch % 7 = 3 THEN 9 ELSE batch % 4 END AS partition, n, CASE WHEN batch % 7 = 3 THEN 'invalid_partition' WHEN batch % 5 = 4 THEN 'unsupported_codec'
  WHEN batch % 11 = 5 OR batch % 13 = 6 THEN 'invalid_batch' ELSE 'none' END AS error_code FROM b),
g AS (SELECT batch, n, sum(n) OVER (PARTITION BY partition ORDER BY batch) AS upto FROM e WHERE error_code = 'none')
SELECT e.batch, 'chats' AS topic, e.partition::INT AS partition, error_code, coalesce(upto - g.n, -1)::BIGINT AS base_offset, coalesce(upto, -1)::BIGINT AS next_offset, coalesce(g.n, 0)::BIGINT AS records
FROM e LEFT JOIN g ON g.batch = e.batch""")
def produce_batches(spark, sf_dir):
    """What producers of encoded batches are told; sound ones are appended to the partitions they name."""
    parts = spark.range(4).select(F.lit("chats").alias("topic"), F.col("id").cast("int").alias("partition"))
    return store.append_encoded(spark, _fresh(spark), _encoded(spark, sf_dir), parts).fillna(-1, ["base_offset", "next_offset"])


@query(f"""WITH {records_sql()}, {BOUNDS_SQL}, {COMMITS_SQL}, ok AS (SELECT c.* FROM commits c JOIN bounds b ON b.topic = c.topic AND b.partition = c.partition
  WHERE c.nxt BETWEEN b.earliest AND b.nxt AND grp <> '2-HIGH')
SELECT grp AS "group", topic, partition, arg_max(nxt, seq) AS next_offset FROM ok GROUP BY ALL""")
def commit_append(spark, sf_dir):
    """Commits by hand, fenced where a group has members, appended to the offset log and read back."""
    busy = spark.createDataFrame([("2-HIGH", "events")], "group string, topic string")
    told = offsets.commit(commits(spark, sf_dir), trimmed_bounds(spark, sf_dir), busy)
    path = _fresh(spark)
    store.append_commits(told.filter("error_code = 'none'"), path)
    return offsets.latest_commits(store.read_commits(spark, path))


@query(f"""WITH {records_sql()}, {BOUNDS_SQL}, {COMMITS_SQL} SELECT grp AS "group", CASE WHEN b.nxt IS NULL THEN 'invalid_partition' WHEN grp = '2-HIGH' THEN 'stale_member'
  WHEN c.nxt < earliest THEN 'offset_out_of_range' WHEN c.nxt > b.nxt THEN 'invalid_offset' ELSE 'none' END AS error_code, count(*)::BIGINT AS commits
FROM commits c LEFT JOIN bounds b ON b.topic = c.topic AND b.partition = c.partition GROUP BY ALL""")
def manual_commits(spark, sf_dir):
    """What committers by hand are told."""
    busy = spark.createDataFrame([("2-HIGH", "events")], "group string, topic string")
    return offsets.commit(commits(spark, sf_dir), trimmed_bounds(spark, sf_dir), busy).groupBy("group", "error_code").agg(F.count(F.lit(1)).alias("commits"))


@query(f"""WITH {records_sql("event_type")}, w AS (SELECT unnest(['click', 'view', 'gone']) AS topic), s AS (SELECT topic, count(DISTINCT partition) AS partitions, count(*) AS records, sum(size) AS log_bytes FROM rec GROUP BY topic),
g AS (SELECT CASE o_custkey % 3 WHEN 0 THEN 'click' WHEN 1 THEN 'view' ELSE 'error' END AS topic, count(DISTINCT o_orderpriority) AS groups FROM orders GROUP BY 1)
SELECT w.topic, CASE WHEN s.topic IS NULL THEN 'unknown_topic' WHEN w.topic = 'view' THEN 'group_active' ELSE 'deleted' END AS result, coalesce(partitions, 0)::BIGINT AS partitions,
  coalesce(records, 0)::BIGINT AS records, coalesce(log_bytes, 0)::BIGINT AS log_bytes, coalesce(groups, 0)::BIGINT AS groups FROM w LEFT JOIN s ON s.topic = w.topic LEFT JOIN g ON g.topic = w.topic""")
def delete_topics(spark, sf_dir):
    """Deletes of a topic, of one that a group with members reads, and of one that does not exist."""
    o = table(spark, sf_dir, "orders")
    topic = F.when(F.col("o_custkey") % 3 == 0, "click").when(F.col("o_custkey") % 3 == 1, "view").otherwise("error")
    c = o.select(F.col("o_orderkey").alias("seq"), F.col("o_orderpriority").alias("group"), topic.alias("topic"), F.lit(0).alias("partition"), F.lit(1).alias("next_offset"))
    wanted = spark.createDataFrame([("click",), ("view",), ("gone",)], "topic string")
    busy = spark.createDataFrame([("1-URGENT", "view")], "group string, topic string")
    return log.delete_topics(wanted, records(spark, sf_dir, "event_type"), c, busy)[0]


@query(f"""WITH {records_sql()}, {BOUNDS_SQL}, {COMMITS_SQL}, m AS (SELECT o_orderpriority AS grp, count(DISTINCT o_custkey % 7) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
SELECT g.grp AS "group", b.topic, b.partition, coalesce(committed, 0)::BIGINT AS committed_offset, coalesce(n, 0)::BIGINT AS active_members
FROM (SELECT DISTINCT grp FROM latest) g CROSS JOIN bounds b LEFT JOIN latest l ON l.grp = g.grp AND l.topic = b.topic AND l.partition = b.partition LEFT JOIN m ON m.grp = g.grp""")
def describe_group_members(spark, sf_dir):
    o = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'")
    members = o.select(F.col("o_orderpriority").alias("group"), F.lit("events").alias("topic"), (F.col("o_custkey") % 7).alias("member_id"))
    told = offsets.describe_groups(offsets.latest_commits(commits(spark, sf_dir)), trimmed_bounds(spark, sf_dir))
    return offsets.describe_members(told, members).select("group", "topic", "partition", "committed_offset", "active_members")


@query(f"""WITH {_BEATS}, e AS (SELECT grp, seq, member_id, CASE WHEN seq % 7 = 0 THEN 'leave' WHEN seq % 7 < 3 THEN 'heartbeat' ELSE 'join' END AS kind FROM beats),
w AS (SELECT *, coalesce(last_value(CASE WHEN kind <> 'heartbeat' THEN kind END IGNORE NULLS) OVER (PARTITION BY grp, member_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 'join', false) AS member FROM e)
SELECT grp AS "group", seq, kind, member_id, CASE WHEN kind <> 'join' AND NOT member THEN 'stale_member' ELSE 'none' END AS error_code,
  sum(((kind = 'join' AND NOT member) OR (kind = 'leave' AND member))::INT) OVER (PARTITION BY grp ORDER BY seq ROWS UNBOUNDED PRECEDING)::BIGINT AS generation,
  sum(CASE WHEN kind = 'join' AND NOT member THEN 1 WHEN kind = 'leave' AND member THEN -1 ELSE 0 END) OVER (PARTITION BY grp ORDER BY seq ROWS UNBOUNDED PRECEDING)::BIGINT AS members FROM w""")
def stream_membership(spark, sf_dir):
    """Joins, heartbeats and leaves as a stream with the members of each group as its state."""
    live = streams.stream_table(spark, f"{sf_dir}/events.parquet")
    kind = F.when(F.col("event_id") % 7 == 0, "leave").when(F.col("event_id") % 7 < 3, "heartbeat").otherwise("join")
    member = F.concat(F.lit("member-"), F.lpad(F.col("user_id").cast("string"), 12, "0"))
    asked = live.select(F.col("event_type").alias("group"), F.col("event_id").alias("seq"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms"), kind.alias("kind"), member.alias("member_id"), F.lit(1 << 40).alias("session_timeout_ms"))
    return groups.stream_membership(asked).select("group", "seq", "kind", "member_id", "error_code", "generation", "members")


@query(f"""WITH {_SERIES} SELECT 'sum' AS fold, ts, sum(value)::DOUBLE AS value FROM series GROUP BY ts UNION ALL SELECT 'max', ts, max(value)::DOUBLE FROM series GROUP BY ts""")
def series_folds(spark, sf_dir):
    """Sum and max over all series at each time."""
    s = _series(spark, sf_dir)
    both = [metrics.aggregated(s, how, []).select(F.lit(how).alias("fold"), F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("value").cast("double").alias("value")) for how in ("sum", "max")]
    return both[0].unionByName(both[1])


@query("""SELECT event_type AS operation, CASE WHEN value > 100 THEN 'overloaded' ELSE 'none' END AS error_code, count(*)::BIGINT AS total FROM events WHERE event_type <> 'view' GROUP BY ALL""")
def nonzero_counters(spark, sf_dir):
    """Sparse counters: only what has counted something."""
    ev = table(spark, sf_dir, "events").filter("event_type <> 'view'").select(F.col("event_type").alias("operation"), F.when(F.col("value") > 100, "overloaded").otherwise("none").alias("error_code"))
    words = spark.createDataFrame([(o, e) for o in ("click", "error", "purchase", "signup", "view") for e in ("none", "overloaded")], "operation string, error_code string")
    return metrics.nonzero(metrics.counters(ev, ["operation", "error_code"], words))


@query(f"""WITH {records_sql("event_type")}, b AS (SELECT topic, partition, count(*) AS n, sum(size) AS bytes FROM rec GROUP BY ALL),
s AS (SELECT 'log_records' AS metric, topic, partition, n AS value FROM b UNION ALL SELECT 'log_bytes', topic, partition, bytes FROM b),
x AS (SELECT metric, row_number() OVER (PARTITION BY metric ORDER BY topic, partition) + 1 AS at, metric || '{{topic="' || topic || '",partition="' || partition || '"}} ' || value AS line FROM s)
SELECT metric, at::BIGINT AS "at", line FROM x UNION ALL
SELECT * FROM (VALUES ('log_records', 0, '# HELP log_records Records of a partition.'), ('log_records', 1, '# TYPE log_records gauge'), ('log_bytes', 0, '# HELP log_bytes Bytes of a partition.'), ('log_bytes', 1, '# TYPE log_bytes gauge'))""".replace(" AS at,", ' AS "at",').replace("metric, at::", 'metric, "at"::'))
def exposition_page(spark, sf_dir):
    """A page of gauges with help and type lines, samples in the order of their labels."""
    b = log.bounds(records(spark, sf_dir, "event_type"))
    rows = F.inline(F.array(F.struct(F.lit("log_records").alias("metric"), F.col("records").alias("value")), F.struct(F.lit("log_bytes").alias("metric"), F.col("log_bytes").alias("value"))))
    about = spark.createDataFrame([("log_records", "Records of a partition.", "gauge"), ("log_bytes", "Bytes of a partition.", "gauge")], "metric string, help string, type string")
    return metrics.exposition_text(b.select("topic", "partition", rows), ["topic", "partition"], about)


@query("""SELECT l_returnflag AS profile, count(*)::BIGINT AS samples, quantile_disc(l_extendedprice, 0.5) AS p50, quantile_disc(l_extendedprice, 0.95) AS p95, quantile_disc(l_extendedprice, 0.99) AS p99,
  max(l_shipdate) AS latest FROM lineitem GROUP BY 1""")
def pooled_percentiles(spark, sf_dir):
    """Percentiles over the samples of all runs of a profile, and the time of its latest one."""
    li = table(spark, sf_dir, "lineitem").withColumnRenamed("l_returnflag", "profile")
    up = stats.pooled(li, ["profile"], "l_extendedprice", {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    return stats.beside(up, li.groupBy("profile").agg(F.max("l_shipdate").alias("latest")), ["profile"])


@query("""SELECT l_orderkey % 97 AS run, sum(l_quantity::BIGINT)::BIGINT AS records, sum(l_partkey)::BIGINT AS bytes, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END)::BIGINT AS errors,
  count(*)::BIGINT AS latencies, round(sum(l_quantity::BIGINT) / count(DISTINCT l_linenumber)::DOUBLE, 6) AS mean_batch FROM lineitem GROUP BY 1""")
def thread_merge(spark, sf_dir):
    """Runs from their threads: sums, all latencies together, and the mean of a thread's records."""
    li = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 97).alias("run"), F.col("l_linenumber").alias("thread"), F.col("l_quantity").cast("bigint").alias("records"), F.col("l_partkey").alias("bytes"), F.when(F.col("l_returnflag") == "R", 1).otherwise(0).cast("bigint").alias("errors"), F.col("l_extendedprice").alias("latency"))
    threads = li.groupBy("run", "thread").agg(*[F.sum(c).alias(c) for c in ("records", "bytes", "errors")], F.collect_list("latency").alias("latencies"))
    many = threads.groupBy("run").agg(F.count(F.lit(1)).alias("_threads"))
    merged = stats.merge_threads(threads, ["run"]).join(many, "run")
    return merged.select("run", "records", "bytes", "errors", F.size("latencies").cast("bigint").alias("latencies"), F.round(stats.mean_batch(F.col("records"), F.col("_threads")), 6).alias("mean_batch"))


@query(f"""WITH {records_sql("event_type")} SELECT topic, partition, (off // 32)::BIGINT AS drain, count(*)::BIGINT AS records, sum(size)::BIGINT AS bytes FROM rec GROUP BY ALL""")
def append_coalescing(spark, sf_dir):
    """Appends of at most 32 records of a partition, without waiting for more."""
    return log.coalesced(records(spark, sf_dir, "event_type"), 32)


@query(f"""WITH {records_sql("event_type")} SELECT topic, partition, off AS "offset", key FROM rec ORDER BY topic, partition, off LIMIT 500""")
def consume_until(spark, sf_dir):
    """A consumer that stops after 500 records, in the order of topics, partitions and offsets."""
    return records(spark, sf_dir, "event_type").select("topic", "partition", "offset", "key").orderBy("topic", "partition", "offset").limit(500)


@query("""WITH m AS (SELECT lower(n_name) AS topic, 1 + n_nationkey % 4 AS n FROM nation WHERE n_regionkey > 0), t AS (SELECT topic FROM m UNION SELECT lower(n_name) FROM nation)
SELECT topic, unnest(range(0, coalesce(n, 1)))::INT AS partition, n IS NULL AS migrated FROM t LEFT JOIN m USING (topic)""")
def topic_catalog(spark, sf_dir):
    """Topics by partition; those of one region have no manifest."""
    nation = table(spark, sf_dir, "nation").withColumn("topic", F.lower("n_name"))
    lines = text.manifest_lines(nation.filter("n_regionkey > 0").select("topic", (1 + F.col("n_nationkey") % 4).alias("partition_count"), F.lit("2024-01-01T00:00:00Z").alias("created_at_utc")))
    read = lines.select(F.get_json_object("manifest", "$.topic").alias("topic"), F.get_json_object("manifest", "$.partition_count").cast("int").alias("partition_count"))
    return text.catalog(nation, read)


@query(f"""WITH {records_sql()} SELECT 'reader' AS "group", topic, partition, (max(off) + 1)::BIGINT AS next_offset, count(*)::BIGINT AS records FROM rec GROUP BY topic, partition""")
def stream_commits(spark, sf_dir):
    """A group that reads a written log as a stream: its last commit a partition, and the records it read."""
    path = _fresh(spark)
    store.write_log(records(spark, sf_dir), path)
    live = spark.readStream.schema(store.RECORDS).option("basePath", path).parquet(path)
    read, commits = streams.consume(live, "reader")
    last = commits.groupBy("group", "topic", "partition").agg(F.max_by("next_offset", "seq").alias("next_offset"))
    return last.join(read.groupBy("topic", "partition").agg(F.count(F.lit(1)).alias("records")), ["topic", "partition"])
