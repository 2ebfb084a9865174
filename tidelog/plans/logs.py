"""Queries on routing, offsets, fetches, commits, segments, retention, recovery and replication."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelog.functions import even_share, fnv1a_partition, record_bytes, valid_name
from tidelog.operators import fetch as fetching
from tidelog.operators import log, offsets, replication
from tidelog.plans.base import BOUNDS_SQL, COMMITS_SQL, PARTITIONS, arrivals, commits, fnv_sql, records, records_sql, rolled, segments_sql, table, trimmed_bounds

NOW_NS = 1706616000000000000  # 2024-01-30 12:00:00 UTC
SIZE_LIMIT, AGE_LIMIT = 65536, 20 * 86400
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"""SELECT key_kind, partition, count(*)::BIGINT AS records FROM (
  SELECT 'user_id' AS key_kind, {fnv_sql("user_id::VARCHAR", 7)} AS partition FROM events
  UNION ALL SELECT 'event_type', {fnv_sql("event_type", 7)} FROM events) GROUP BY ALL""")
def route_key_hash(spark, sf_dir):
    """How keys spread over 7 partitions, by hash. Each distinct key is hashed once."""
    ev = table(spark, sf_dir, "events")
    kinds = [ev.select(F.lit(k).alias("key_kind"), F.col(k).cast("string").alias("key")) for k in ("user_id", "event_type")]
    keys = kinds[0].unionByName(kinds[1]).groupBy("key_kind", "key").agg(F.count(F.lit(1)).alias("n"))
    return keys.groupBy("key_kind", fnv1a_partition(F.col("key"), 7).alias("partition")).agg(F.sum("n").alias("records"))


@query(f"""WITH e AS (SELECT event_id, CASE WHEN event_type = 'view' THEN '' ELSE user_id::VARCHAR END AS key FROM events)
SELECT event_id AS seq, {fnv_sql("key", 3)} AS partition FROM e WHERE key <> ''
UNION ALL SELECT event_id, ((row_number() OVER (ORDER BY event_id) - 1) % 3)::INT FROM e WHERE key = ''""")
def route_round_robin(spark, sf_dir):
    """Views have no key and take partitions in turn; the rest go by hash."""
    ev = table(spark, sf_dir, "events")
    keyed = ev.select(F.col("event_id").alias("seq"), F.lit("events").alias("topic"), F.when(F.col("event_type") == "view", "").otherwise(F.col("user_id").cast("string")).alias("key"))
    return log.route(keyed, 3).select("seq", "partition")


@query(f'WITH {records_sql("event_type")} SELECT seq, topic, partition, off AS "offset", size AS encoded_byte_size FROM rec')
def assign_offsets(spark, sf_dir):
    return records(spark, sf_dir, "event_type").select("seq", "topic", "partition", "offset", "encoded_byte_size")


@query(f"""WITH {records_sql("event_type")} SELECT topic, partition, min(off)::BIGINT AS earliest_offset, (max(off) + 1)::BIGINT AS next_offset,
  count(*)::BIGINT AS records, sum(size)::BIGINT AS log_bytes FROM rec GROUP BY ALL""")
def topic_metadata(spark, sf_dir):
    return log.bounds(records(spark, sf_dir, "event_type"))


@query(f"""WITH RECURSIVE {segments_sql("event_type")} SELECT topic, partition, min(first_offset)::BIGINT AS earliest_offset,
  (max(last_offset) + 1)::BIGINT AS next_offset, count(*)::BIGINT AS segments, sum(log_bytes)::BIGINT AS log_bytes FROM seg GROUP BY ALL""")
def describe_topic(spark, sf_dir):
    segs = log.segments(rolled(spark, sf_dir, "event_type"))
    return segs.groupBy("topic", "partition").agg(
        F.min("first_offset").alias("earliest_offset"), (F.max("last_offset") + 1).alias("next_offset"), F.count(F.lit(1)).alias("segments"), F.sum("log_bytes").alias("log_bytes")
    )


@query(f"""WITH {records_sql("event_type")} SELECT topic, count(DISTINCT partition)::BIGINT AS partitions, count(*)::BIGINT AS records,
  sum(size)::BIGINT AS log_bytes FROM rec GROUP BY topic""")
def list_topics(spark, sf_dir):
    b = log.bounds(records(spark, sf_dir, "event_type"))
    return b.groupBy("topic").agg(F.count(F.lit(1)).alias("partitions"), F.sum("records").alias("records"), F.sum("log_bytes").alias("log_bytes"))


@query(f"""WITH {records_sql()} SELECT partition, seq, off AS "offset", size AS encoded_byte_size FROM rec""")
def produce_results(spark, sf_dir):
    """What producers are told of each record: partition, offset, bytes."""
    return records(spark, sf_dir).select("partition", "seq", "offset", "encoded_byte_size")


def _fetched(spark, sf_dir, selector, max_records=100, max_bytes=0):
    recs = records(spark, sf_dir).filter("offset >= 100")
    limits = log.bounds(recs)
    asked = limits.select("topic", "partition", F.lit("1-URGENT").alias("group"), F.lit(selector).alias("selector"))
    chosen = fetching.select_offsets(asked, limits, offsets.latest_commits(commits(spark, sf_dir))).filter("error_code = 'none'")
    requests = chosen.select("topic", "partition", "from_offset")
    return fetching.responses(requests, fetching.fetch(recs, requests, max_records, max_bytes)).drop("error_code")


def _fetch_sql(wanted: str, max_records: int = 100, max_bytes: int = 0) -> str:
    cap = f"AND (n = 1 OR upto <= {max_bytes})" if max_bytes else ""
    return f"""WITH {records_sql()}, {BOUNDS_SQL}, {COMMITS_SQL}, req AS (
  SELECT b.topic, b.partition, {wanted} AS from_offset, earliest, nxt FROM bounds b
  LEFT JOIN latest l ON l.topic = b.topic AND l.partition = b.partition AND l.grp = '1-URGENT'
), ok AS (SELECT * FROM req WHERE from_offset BETWEEN earliest AND nxt), got AS (
  SELECT ok.topic, ok.partition, off, size, row_number() OVER w AS n, sum(size) OVER w AS upto
  FROM ok JOIN rec r ON r.topic = ok.topic AND r.partition = ok.partition AND r.off >= ok.from_offset
  WINDOW w AS (PARTITION BY ok.topic, ok.partition ORDER BY off ROWS UNBOUNDED PRECEDING)
), kept AS (SELECT topic, partition, count(*) AS records, sum(size) AS bytes, max(off) + 1 AS nx FROM got WHERE n <= {max_records} {cap} GROUP BY ALL)
SELECT ok.topic, ok.partition, ok.from_offset::BIGINT AS from_offset, coalesce(nx, ok.from_offset)::BIGINT AS next_offset,
  coalesce(records, 0)::BIGINT AS records, coalesce(bytes, 0)::BIGINT AS bytes
FROM ok LEFT JOIN kept ON kept.topic = ok.topic AND kept.partition = ok.partition"""


@query(_fetch_sql("earliest"))
def fetch_beginning(spark, sf_dir):
    return _fetched(spark, sf_dir, "beginning")


@query(_fetch_sql("nxt"))
def fetch_latest(spark, sf_dir):
    return _fetched(spark, sf_dir, "latest")


@query(_fetch_sql("150"))
def fetch_from_offset(spark, sf_dir):
    return _fetched(spark, sf_dir, "150")


@query(_fetch_sql("coalesce(committed, earliest)"))
def fetch_committed(spark, sf_dir):
    return _fetched(spark, sf_dir, "committed")


@query(_fetch_sql("earliest", 100, 2000))
def fetch_byte_cap(spark, sf_dir):
    return _fetched(spark, sf_dir, "beginning", 100, 2000)


@query(_fetch_sql("earliest", 10))
def fetch_record_cap(spark, sf_dir):
    return _fetched(spark, sf_dir, "beginning", 10)


@query(f"""WITH {records_sql()}, {BOUNDS_SQL}, sel AS (SELECT unnest(['beginning', 'latest', 'committed', '5', '150', '99999999', '-1', 'x1']) AS selector),
q AS (SELECT topic, partition, selector, earliest, nxt, CASE WHEN selector IN ('beginning', 'committed') THEN earliest WHEN selector = 'latest' THEN nxt
  WHEN regexp_full_match(selector, '[0-9]+') THEN try_cast(selector AS BIGINT) END AS wanted FROM bounds, sel)
SELECT topic, partition, selector, CASE WHEN wanted IS NULL THEN 'malformed_payload' WHEN wanted < earliest THEN 'offset_out_of_range'
  WHEN wanted > nxt THEN 'invalid_offset' ELSE 'none' END AS error_code, coalesce(CASE WHEN wanted BETWEEN earliest AND nxt THEN wanted END, -1)::BIGINT AS from_offset FROM q""")
def fetch_selector_errors(spark, sf_dir):
    limits = trimmed_bounds(spark, sf_dir)
    names = F.explode(F.array(*map(F.lit, ["beginning", "latest", "committed", "5", "150", "99999999", "-1", "x1"]))).alias("selector")
    asked = limits.select("topic", "partition", F.lit("nobody").alias("group"), names)
    return fetching.select_offsets(asked, limits, offsets.latest_commits(commits(spark, sf_dir))).select("topic", "partition", "selector", "error_code", F.coalesce("from_offset", F.lit(-1)).alias("from_offset"))


@query(f'WITH {COMMITS_SQL} SELECT grp AS "group", topic, partition, committed AS next_offset FROM latest')
def latest_commit(spark, sf_dir):
    return offsets.latest_commits(commits(spark, sf_dir))


_LAG = "CASE WHEN committed BETWEEN earliest AND nxt THEN nxt - committed ELSE nxt - earliest END::BIGINT"


@query(f"""WITH {records_sql()}, {BOUNDS_SQL}, {COMMITS_SQL}
SELECT g.grp AS "group", b.topic, b.partition, committed IS NOT NULL AS has_committed_offset, coalesce(committed, 0)::BIGINT AS committed_offset,
  earliest AS earliest_offset, nxt AS next_offset, {_LAG} AS lag, coalesce(committed < earliest OR committed > nxt, false) AS out_of_range
FROM (SELECT DISTINCT grp FROM latest) g CROSS JOIN bounds b LEFT JOIN latest l ON l.grp = g.grp AND l.topic = b.topic AND l.partition = b.partition""")
def group_lag_describe(spark, sf_dir):
    return offsets.describe_groups(offsets.latest_commits(commits(spark, sf_dir)), trimmed_bounds(spark, sf_dir))


@query(f"""WITH {records_sql()}, {BOUNDS_SQL}, {COMMITS_SQL}
SELECT grp AS "group", l.topic, l.partition, {_LAG} AS lag_records, (committed < earliest OR committed > nxt) AS out_of_range
FROM latest l JOIN bounds b ON l.topic = b.topic AND l.partition = b.partition""")
def group_lag_metrics(spark, sf_dir):
    return offsets.lag_metrics(offsets.latest_commits(commits(spark, sf_dir)), trimmed_bounds(spark, sf_dir))


@query(f"""WITH {records_sql()}, {BOUNDS_SQL}, {COMMITS_SQL}
SELECT grp AS "group", CASE WHEN b.nxt IS NULL THEN 'invalid_partition' WHEN c.nxt < earliest THEN 'offset_out_of_range' WHEN c.nxt > b.nxt THEN 'invalid_offset' ELSE 'none' END AS error_code,
  count(*)::BIGINT AS commits FROM commits c LEFT JOIN bounds b ON b.topic = c.topic AND b.partition = c.partition GROUP BY ALL""")
def commit_validation(spark, sf_dir):
    told = offsets.validate(commits(spark, sf_dir), trimmed_bounds(spark, sf_dir))
    return told.groupBy("group", "error_code").agg(F.count(F.lit(1)).alias("commits"))


@query(f"""WITH {records_sql()}, {BOUNDS_SQL}, {COMMITS_SQL}, t AS (SELECT unnest([
  {{'g': '1-URGENT', 't': 'beginning'}}, {{'g': '2-HIGH', 't': 'latest'}}, {{'g': '3-MEDIUM', 't': '150'}}, {{'g': '4-NOT SPECIFIED', 't': '7'}}, {{'g': '5-LOW', 't': 'latest'}}], recursive := true)),
q AS (SELECT g AS grp, b.topic, b.partition, l.committed, earliest, nxt, CASE t WHEN 'beginning' THEN earliest WHEN 'latest' THEN nxt ELSE try_cast(t AS BIGINT) END AS wanted
  FROM t CROSS JOIN bounds b LEFT JOIN latest l ON l.grp = t.g AND l.topic = b.topic AND l.partition = b.partition),
r AS (SELECT *, CASE WHEN grp = '2-HIGH' THEN 'group_active' WHEN wanted < earliest THEN 'offset_out_of_range' WHEN wanted > nxt THEN 'invalid_offset' ELSE 'none' END AS error_code FROM q)
SELECT grp AS "group", topic, partition, coalesce(committed, -1)::BIGINT AS previous_offset, coalesce(CASE WHEN error_code = 'none' THEN wanted END, -1)::BIGINT AS new_offset, error_code FROM r""")
def reset_offsets(spark, sf_dir):
    limits = trimmed_bounds(spark, sf_dir)
    wanted = {"1-URGENT": "beginning", "2-HIGH": "latest", "3-MEDIUM": "150", "4-NOT SPECIFIED": "7", "5-LOW": "latest"}
    rows = F.inline(F.array(*[F.struct(F.lit(g).alias("group"), F.lit(t).alias("target")) for g, t in wanted.items()]))
    asked = limits.select("topic", "partition", rows)
    active = spark.createDataFrame([("2-HIGH",)], "group string")
    told = offsets.reset(asked, offsets.latest_commits(commits(spark, sf_dir)), limits, active)
    return told.fillna(-1, ["previous_offset", "new_offset"])


@query(f"""WITH {COMMITS_SQL}, c2 AS (SELECT grp, CASE WHEN partition = 1 THEN 'old' ELSE topic END AS topic, partition, committed FROM latest)
SELECT grp AS "group", topic, partition, committed AS next_offset FROM c2 WHERE topic <> 'old'""")
def compact_offsets(spark, sf_dir):
    """The offset log without a deleted topic."""
    c = commits(spark, sf_dir).withColumn("topic", F.when(F.col("partition") == 1, "old").otherwise(F.col("topic")))
    return log.compact(c, spark.createDataFrame([("old",)], "topic string")).select("group", "topic", "partition", "next_offset")


@query(f'WITH RECURSIVE {segments_sql()} SELECT partition, off AS "offset", base AS segment_base FROM fold')
def segment_roll(spark, sf_dir):
    return rolled(spark, sf_dir).select("partition", "offset", "segment_base")


@query(f"""WITH RECURSIVE {segments_sql()} SELECT topic, partition, base AS base_offset, first_offset, last_offset, records, log_bytes, last_ns, active,
  lpad(base::VARCHAR, 20, '0') || '.log' AS file FROM seg""")
def segment_summary(spark, sf_dir):
    from tidelog.functions import zero_padded

    return log.segments(rolled(spark, sf_dir)).withColumn("file", F.concat(zero_padded(F.col("base_offset"), 20), F.lit(".log")))


_MARK = f"""mark AS (SELECT *, NOT active AND ({{cond}}) AS deleted FROM (SELECT *, sum(log_bytes) OVER (PARTITION BY topic, partition ORDER BY base
  ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS suffix, ({NOW_NS} - last_ns) // 1000000000 AS age FROM seg))"""
_BY_SIZE, _BY_AGE = _MARK.format(cond=f"suffix > {SIZE_LIMIT}"), _MARK.format(cond=f"age >= {AGE_LIMIT}")
_BY_BOTH = _MARK.format(cond=f"suffix > {SIZE_LIMIT} OR age >= {AGE_LIMIT}")


@query(f"WITH RECURSIVE {segments_sql()}, {_BY_SIZE} SELECT topic, partition, base AS base_offset, log_bytes, deleted FROM mark")
def retention_by_size(spark, sf_dir):
    return log.retention(log.segments(rolled(spark, sf_dir)), NOW_NS, SIZE_LIMIT).select("topic", "partition", "base_offset", "log_bytes", "deleted")


@query(f"WITH RECURSIVE {segments_sql()}, {_BY_AGE} SELECT topic, partition, base AS base_offset, log_bytes, deleted FROM mark")
def retention_by_age(spark, sf_dir):
    return log.retention(log.segments(rolled(spark, sf_dir)), NOW_NS, 0, AGE_LIMIT).select("topic", "partition", "base_offset", "log_bytes", "deleted")


@query(f"""WITH RECURSIVE {segments_sql()}, {_BY_BOTH} SELECT coalesce(topic, '*') AS topic, coalesce(partition, -1)::INT AS partition, count(*) FILTER (deleted)::BIGINT AS deleted_segments, coalesce(sum(log_bytes) FILTER (deleted), 0)::BIGINT AS deleted_bytes,
  count(*) FILTER (NOT deleted)::BIGINT AS retained_segments, coalesce(sum(log_bytes) FILTER (NOT deleted), 0)::BIGINT AS retained_bytes
FROM mark GROUP BY GROUPING SETS ((topic, partition), ())""")
def retention_totals(spark, sf_dir):
    totals = log.retention_totals(log.retention(log.segments(rolled(spark, sf_dir)), NOW_NS, SIZE_LIMIT, AGE_LIMIT))
    return totals.fillna("*", ["topic"]).fillna(-1, ["partition"])


@query(f"""WITH RECURSIVE {segments_sql("event_type")} SELECT topic, count(DISTINCT partition)::BIGINT AS partitions, count(*)::BIGINT AS segments,
  sum(log_bytes)::BIGINT AS log_bytes, sum(records)::BIGINT AS records FROM seg GROUP BY topic""")
def delete_topic_stats(spark, sf_dir):
    segs = log.segments(rolled(spark, sf_dir, "event_type"))
    return segs.groupBy("topic").agg(F.countDistinct("partition").alias("partitions"), F.count(F.lit(1)).alias("segments"), F.sum("log_bytes").alias("log_bytes"), F.sum("records").alias("records"))


def _recovered(spark, sf_dir):
    entries = rolled(spark, sf_dir).withColumn("valid", F.col("seq") % 4997 != 4996)
    return log.recover(entries)


_REC = """, ent AS (SELECT f.topic, f.partition, f.base, f.off, f.size, r.seq % 4997 <> 4996 AS valid FROM fold f JOIN rec r ON r.topic = f.topic AND r.partition = f.partition AND r.off = f.off),
rcv AS (SELECT *, sum(CASE WHEN valid THEN 0 ELSE 1 END) OVER (PARTITION BY topic, partition ORDER BY base, off ROWS UNBOUNDED PRECEDING) = 0 AS kept FROM ent)"""


@query(f"""WITH RECURSIVE {segments_sql()}{_REC} SELECT topic, partition, count(*) FILTER (kept)::BIGINT AS records, coalesce(max(off) FILTER (kept) + 1, 0)::BIGINT AS next_offset,
  coalesce(sum(size) FILTER (kept), 0)::BIGINT AS bytes_kept, coalesce(sum(size) FILTER (NOT kept), 0)::BIGINT AS bytes_truncated FROM rcv GROUP BY ALL""")
def recovery_prefix(spark, sf_dir):
    size = lambda kept: F.coalesce(F.sum(F.when(F.col("kept") == kept, F.col("encoded_byte_size"))), F.lit(0)).cast("bigint")
    return _recovered(spark, sf_dir).groupBy("topic", "partition").agg(
        F.count(F.when(F.col("kept"), 1)).alias("records"), F.coalesce(F.max(F.when(F.col("kept"), F.col("offset"))) + 1, F.lit(0)).alias("next_offset"), size(True).alias("bytes_kept"), size(False).alias("bytes_truncated")
    )


@query(f"""WITH RECURSIVE {segments_sql()}{_REC} SELECT count(DISTINCT topic)::BIGINT AS topics, count(DISTINCT (topic, partition, base)) FILTER (kept)::BIGINT AS segments,
  count(*) FILTER (kept)::BIGINT AS records, coalesce(sum(size) FILTER (NOT kept), 0)::BIGINT AS truncated_bytes FROM rcv""")
def recovery_totals(spark, sf_dir):
    r = _recovered(spark, sf_dir)
    per = r.groupBy("topic", "partition", "segment_base").agg(F.count(F.when(F.col("kept"), 1)).alias("records"), F.sum(F.when(~F.col("kept"), F.col("encoded_byte_size"))).alias("cut"))
    return per.agg(F.countDistinct("topic").alias("topics"), F.count(F.when(F.col("records") > 0, 1)).alias("segments"), F.sum("records").alias("records"), F.coalesce(F.sum("cut"), F.lit(0)).cast("bigint").alias("truncated_bytes"))


def _follower(leader):
    half = leader.filter((F.col("offset") < 1000) | (F.col("partition") == 0))
    return half.withColumn("value", F.when(F.col("seq") % 501 == 0, "damaged").otherwise(F.col("value")))


_FOL = ", fol AS (SELECT topic, partition, off, CASE WHEN seq % 501 = 0 THEN 'damaged' ELSE value END AS value FROM rec WHERE off < 1000 OR partition = 0)"


@query(f"""WITH {records_sql()}{_FOL}, l AS (SELECT topic, partition, max(off) + 1 AS n FROM rec GROUP BY ALL), f AS (SELECT topic, partition, max(off) + 1 AS n FROM fol GROUP BY ALL)
SELECT l.topic, l.partition, l.n::BIGINT AS leader_next, f.n::BIGINT AS follower_next, (l.n - f.n)::BIGINT AS lag,
  CASE WHEN l.n < f.n THEN 'follower_ahead' WHEN l.n = f.n THEN 'in_sync' ELSE 'lagging' END AS state, ceil(greatest(l.n - f.n, 0) / 100.0)::BIGINT AS fetches
FROM l JOIN f ON l.topic = f.topic AND l.partition = f.partition""")
def replication_lag(spark, sf_dir):
    leader = records(spark, sf_dir)
    return replication.catch_up_fetches(replication.replica_lag(leader, _follower(leader)), 100)


@query(f"""WITH {records_sql()}{_FOL}, f AS (SELECT topic, partition, max(off) + 1 AS n FROM fol GROUP BY ALL)
SELECT r.topic, r.partition, count(*)::BIGINT AS records, min(off)::BIGINT AS first_offset, max(off)::BIGINT AS last_offset, sum(size)::BIGINT AS bytes
FROM rec r JOIN f ON r.topic = f.topic AND r.partition = f.partition WHERE off >= f.n GROUP BY ALL""")
def replication_suffix(spark, sf_dir):
    leader = records(spark, sf_dir)
    late = replication.missing_suffix(leader, _follower(leader))
    return late.groupBy("topic", "partition").agg(F.count(F.lit(1)).alias("records"), F.min("offset").alias("first_offset"), F.max("offset").alias("last_offset"), F.sum("encoded_byte_size").alias("bytes"))


@query(f"""WITH {records_sql()}{_FOL} SELECT r.topic, r.partition, CASE WHEN f.off IS NULL THEN 'missing' WHEN r.value = f.value THEN 'equal' ELSE 'different' END AS state, count(*)::BIGINT AS records
FROM rec r LEFT JOIN fol f ON r.topic = f.topic AND r.partition = f.partition AND r.off = f.off GROUP BY ALL""")
def replication_compare(spark, sf_dir):
    leader = records(spark, sf_dir)
    return replication.compare(leader, _follower(leader))


@query(f"""WITH {records_sql()}{_FOL}, l AS (SELECT topic, partition, max(off) + 1 AS n FROM rec GROUP BY ALL), f AS (SELECT topic, partition, max(off) + 1 AS n FROM fol GROUP BY ALL)
SELECT l.topic, l.partition, (l.n - f.n)::BIGINT AS lag, mode, (mode = 'leader' OR l.n = f.n) AS acknowledged FROM l JOIN f ON l.topic = f.topic AND l.partition = f.partition, (SELECT unnest(['leader', 'all']) AS mode)""")
def replication_acks(spark, sf_dir):
    leader = records(spark, sf_dir)
    return replication.acknowledged(replication.replica_lag(leader, _follower(leader)), True)


@query("""SELECT conv_id, count(*)::BIGINT AS records, (4 + sum(8 + strlen(role) + strlen(text)))::BIGINT AS logical_bytes, (48 + sum(8 + strlen(role) + strlen(text)))::BIGINT AS entry_bytes
FROM conversations WHERE text IS NOT NULL AND text <> '' GROUP BY conv_id""")
def record_set_sizes(spark, sf_dir):
    from tidelog.functions import BATCH_OVERHEAD, RECORD_SET_ITEM, RECORD_SET_OVERHEAD

    c = table(spark, sf_dir, "conversations").filter("text IS NOT NULL AND text <> ''")
    logical = (RECORD_SET_OVERHEAD + F.sum(RECORD_SET_ITEM + F.octet_length("role") + F.octet_length("text"))).cast("bigint")
    return c.groupBy("conv_id").agg(F.count(F.lit(1)).alias("records"), logical.alias("logical_bytes"), (logical + BATCH_OVERHEAD).alias("entry_bytes"))


@query()
def compression_ratio(spark, sf_dir):
    """Raw and compressed bytes of each conversation as one record set."""
    from tidelog.functions import ratio
    from tidelog.sources.codec import encode_sets

    c = table(spark, sf_dir, "conversations").filter("text IS NOT NULL AND text <> ''")
    return encode_sets(c, ["conv_id"], "turn", "role", "text").withColumn("ratio", ratio(F.col("encoded_bytes"), F.col("logical_bytes")))


@query("""SELECT total, parts, part, (total // parts + CASE WHEN part < total % parts THEN 1 ELSE 0 END)::BIGINT AS share
FROM (SELECT o_orderkey AS total, (o_custkey % 13 + 1)::BIGINT AS parts FROM orders), LATERAL (SELECT unnest(range(0, parts)) AS part)""")
def bulk_even_split(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("total"), (F.col("o_custkey") % 13 + 1).alias("parts"))
    each = o.select("total", "parts", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part"))
    return each.withColumn("share", even_share(F.col("total"), F.col("parts"), F.col("part")))


@query("""SELECT name, coalesce(regexp_full_match(name, '[A-Za-z0-9._-]+') AND name NOT IN ('.', '..'), false) AS valid, count(*)::BIGINT AS uses
FROM (SELECT p_name AS name FROM part UNION ALL SELECT replace(p_name, ' ', '_') FROM part UNION ALL SELECT n_name FROM nation UNION ALL SELECT unnest(['', '.', '..', '../bad', 'bad/name', 'bad\\name'])) GROUP BY ALL""")
def valid_names(spark, sf_dir):
    part, nation = table(spark, sf_dir, "part"), table(spark, sf_dir, "nation")
    names = part.select(F.explode(F.array("p_name", F.replace("p_name", F.lit(" "), F.lit("_")))).alias("name")).union(nation.select("n_name"))
    names = names.union(spark.createDataFrame([(x,) for x in ("", ".", "..", "../bad", "bad/name", "bad\\name")], "name string"))
    return names.groupBy("name").agg(F.count(F.lit(1)).alias("uses")).withColumn("valid", valid_name(F.col("name")))


@query("""WITH want AS (SELECT replace(p_name, ' ', '-') AS topic, (p_size % 5 + 1)::INT AS partition_count, p_partkey FROM part),
have AS (SELECT DISTINCT lower(n_name) AS topic, 3 AS partition_count FROM nation UNION SELECT replace(p_name, ' ', '-'), 3 FROM part WHERE p_partkey % 2 = 0)
SELECT w.topic, w.partition_count, CASE WHEN h.topic IS NULL THEN 'created' WHEN h.partition_count = w.partition_count THEN 'exists' ELSE 'topic_conflict' END AS result, count(*)::BIGINT AS n
FROM want w LEFT JOIN have h ON h.topic = w.topic GROUP BY ALL""")
def create_topics(spark, sf_dir):
    part, nation = table(spark, sf_dir, "part"), table(spark, sf_dir, "nation")
    name = F.replace("p_name", F.lit(" "), F.lit("-")).alias("topic")
    have = nation.select(F.lower("n_name").alias("topic")).union(part.filter("p_partkey % 2 = 0").select(name)).distinct().withColumn("partition_count", F.lit(3))
    want = part.select(name, (F.col("p_size") % 5 + 1).alias("partition_count"))
    return log.create_topics(want, have).groupBy("topic", "partition_count", "result").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT event_id, strftime(to_timestamp(epoch_us(ts) // 1000000) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') AS iso, greatest(0, (1706616000000000 - epoch_us(ts)) // 1000000)::BIGINT AS age_seconds,
  lpad(event_id::VARCHAR, 12, '0') AS member, '{"user":' || user_id || ',"type":"' || event_type || '"}' AS json FROM events""")
def scalar_functions(spark, sf_dir):
    from tidelog.functions import age_seconds, iso_seconds, unix_nanos, zero_padded

    ev = table(spark, sf_dir, "events")
    ns = unix_nanos(F.col("ts"))
    return ev.select(
        "event_id",
        iso_seconds(ns).alias("iso"),
        age_seconds(F.lit(NOW_NS), ns).alias("age_seconds"),
        zero_padded(F.col("event_id"), 12).alias("member"),
        F.to_json(F.struct(F.col("user_id").alias("user"), F.col("event_type").alias("type"))).alias("json"),
    )


@query(f"""SELECT partition, min(key) AS key FROM (SELECT key, {fnv_sql("key", 16)} AS partition
FROM (SELECT chr((97 + c // 26)::INT) || chr((97 + c % 26)::INT) AS key FROM (SELECT unnest(range(0, 676)) AS c))) GROUP BY partition""")
def key_search(spark, sf_dir):
    """The first two-letter key of each of 16 partitions."""
    letter = lambda c: F.char((97 + c).cast("int"))
    keys = spark.range(676).select(F.concat(letter(F.floor(F.col("id") / 26)), letter(F.col("id") % 26)).alias("key"))
    return keys.groupBy(fnv1a_partition(F.col("key"), 16).alias("partition")).agg(F.min("key").alias("key"))


@query(f"""WITH {records_sql()}, b AS (SELECT topic, partition, off // 8 AS batch, count(*) AS n, 44 + 4 + sum(8 + strlen(key) + strlen(value)) AS stored, min(off) AS base FROM rec GROUP BY ALL)
SELECT topic, partition, base::BIGINT AS base_offset, n::BIGINT AS records, stored::BIGINT AS stored_bytes, (stored // n)::BIGINT AS record_bytes, (base % 16 = 0 AND stored <= 400) AS passthrough_eligible FROM b""")
def batch_entries(spark, sf_dir):
    """Batches of eight: stored bytes, the bytes charged to each member, and whether a fetch at every 16th offset could pass a batch on as it is."""
    r = records(spark, sf_dir)
    b = r.groupBy("topic", "partition", F.floor(F.col("offset") / 8).alias("batch")).agg(
        F.min("offset").alias("base_offset"), F.count(F.lit(1)).alias("records"), (48 + F.sum(8 + F.octet_length("key") + F.octet_length("value"))).cast("bigint").alias("stored_bytes")
    )
    eligible = (F.col("base_offset") % 16 == 0) & (F.col("stored_bytes") <= 400)
    return b.select("topic", "partition", "base_offset", "records", "stored_bytes", F.floor(F.col("stored_bytes") / F.col("records")).cast("bigint").alias("record_bytes"), eligible.alias("passthrough_eligible"))


__all__ = ["PARTITIONS", "QUERIES", "SQL", "arrivals", "record_bytes"]
