"""Binary logs, offset logs, reports and the streaming source."""

import json
import os

import pytest

from tidelog.sources import codec, text
from tidelog.sources.stream import LogSource


def write(folder, base, *parts):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, f"{base:020d}.log"), "wb") as f:
        f.write(b"".join(parts))


def record(o, k="AAPL", v="100"):
    return codec.encode_record(o, 5, k.encode(), v.encode())


def test_record_sizes_and_mixed_log(spark, tmp_path):
    assert len(record(0)) == 40 + 4 + 3
    batch = codec.encode_batch(1, 5, [(b"a", b"A" * 256), (b"b", b"A" * 256)])
    assert len(batch) < 2 * 256
    write(tmp_path / "trades" / "000000", 0, record(0, "l", "old"), batch)
    (tmp_path / "trades" / "000000" / "notes.log").write_bytes(b"x")
    got = codec.recover_log(spark, str(tmp_path)).orderBy("offset").collect()
    assert [(r.offset, bytes(r.value)[:3]) for r in got] == [(0, b"old"), (1, b"AAA"), (2, b"AAA")]


def test_recovery_of_damage(spark, tmp_path):
    good, bad = record(0), bytearray(record(1))
    bad[-1] ^= 1
    write(tmp_path / "t" / "000000", 0, good, record(1), b"\0\0")
    write(tmp_path / "t" / "000001", 0, good, bytes(bad))
    write(tmp_path / "t" / "000001", 2, record(2))
    entries = {(r.partition, r.problem): r.entry_bytes for r in codec.read_entries(spark, str(tmp_path)).filter("NOT valid").collect()}
    assert entries == {(0, "torn"): 2, (1, "crc_mismatch"): len(bad)}
    kept = {(r.partition, r.offset) for r in codec.recover_log(spark, str(tmp_path)).collect()}
    assert kept == {(0, 0), (0, 1), (1, 0)}


def test_record_sets():
    raw = codec.encode_record_set([(b"", b"m"), (b"k", b"n")])
    assert codec.decode_record_set(raw, 2) == [(b"", b"m"), (b"k", b"n")]
    for wrong, count in ((raw, 3), (raw + b"x", 2), (codec.encode_record_set([(b"k", b"")]), 1), (raw[:-1], 2)):
        with pytest.raises(ValueError):
            codec.decode_record_set(wrong, count)
    with pytest.raises(ValueError):
        codec.decompress(codec.ZSTD, codec.compress(codec.ZSTD, b"abc"), 2)


def test_offset_log(spark):
    commits = spark.createDataFrame([("dashboard", 0, "trades", 2, 11), ("dashboard", 1, "trades", 2, 9), ("dashboard", 2, "quotes", 0, 3)], "group string, seq bigint, topic string, partition int, next_offset bigint")
    lines = text.offset_log_lines(commits)
    torn = spark.createDataFrame([("dashboard", 1, "trades\t2\t9\tbad"), ("dashboard", 3, "tra")], "group string, seq bigint, line string")
    whole = text.parse_offset_log(lines).collect()
    assert {(r.seq, r.topic, r.partition, r.next_offset) for r in whole} == {(0, "trades", 2, 11), (1, "trades", 2, 9), (2, "quotes", 0, 3)}
    cut = text.parse_offset_log(lines.filter("seq <> 1").unionByName(torn)).collect()
    assert [r.seq for r in cut] == [0]


def test_reports(spark, tmp_path):
    def run(k, rate, errors=0):
        return {"index": k, "records": 1, "bytes": 1, "seconds": 1.0, "records_per_second": rate, "errors": errors, "latency_us": {"p50": rate, "p95": 1.0, "p99": 2.0, "max": 3.0}}

    def write_doc(folder, name, k, rate, errors=0, sha="a", profile="p", more=""):
        os.makedirs(tmp_path / folder, exist_ok=True)
        broker = {"profile": profile, "io_workers": 2, "append_workers": 1}
        doc = {"schema_version": 1, "generated_at_utc": f"2024-01-0{k + 1}", "environment": {"git_sha": sha}, "broker": broker, "workload": {"name": "w"}, "repetitions": [run(k, rate, errors)], "note": more}
        (tmp_path / folder / f"{name}.json").write_text(json.dumps(doc, indent=1))

    for folder in ("good", "errors", "secret", "revisions", "repeated", "profile"):
        write_doc(folder, "0", 0, 10.0)
        write_doc(folder, "1", 1, 20.0)
    rolled = text.report_tables(spark, str(tmp_path / "good"))
    assert (rolled.first()["median"], rolled.first()["runs"], rolled.first()["unstable"]) == (15.0, 2, True)
    lines = [r.line for r in text.report_lines(rolled, text.read_reports(spark, str(tmp_path / "good"))).orderBy("at").collect()]
    assert lines[0] == "Generated 2024-01-02" and lines[3] == "| p | w | 15.00 | 10.00 | 20.00 | 47.14 |"
    write_doc("errors", "2", 2, 99.0, errors=1)
    write_doc("secret", "2", 2, 99.0, more="password: x")
    write_doc("revisions", "2", 2, 99.0, sha="b")
    write_doc("repeated", "2", 1, 99.0)
    for folder, problem in (("errors", "errors"), ("secret", "secret"), ("revisions", "several_revisions"), ("repeated", "repeated_run")):
        assert {r.problem for r in text.report_problems(spark, str(tmp_path / folder)).collect()} == {problem}
        with pytest.raises(ValueError, match=problem):
            text.report_tables(spark, str(tmp_path / folder))
    expected = spark.createDataFrame([("p", 2, 1)], "profile string, io_workers int, append_workers int")
    assert text.report_problems(spark, str(tmp_path / "good"), expected).count() == 0
    write_doc("profile", "2", 2, 99.0, profile="q")
    assert [r.problem for r in text.report_problems(spark, str(tmp_path / "profile"), expected).collect()] == ["profile"]


def test_manifests_and_scrapes(spark, tmp_path):
    from tidelog.operators import metrics

    topics = spark.createDataFrame([("trades", 4, "2024-01-01T00:00:00Z"), ("quotes", 1, "2024-01-02T00:00:00Z")], "topic string, partition_count int, created_at_utc string")
    for r in text.manifest_lines(topics).collect():
        os.makedirs(tmp_path / "topics" / r.topic)
        (tmp_path / "topics" / r.topic / "manifest.json").write_text(r.manifest)
    got = text.read_manifests(spark, str(tmp_path / "topics"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, topics.collect()))
    (tmp_path / "scrape.txt").write_text("# HELP m\n# TYPE m counter\nother 1\nm 7\nm 9\n")
    assert [r.value for r in metrics.scrape(text.read_scrapes(spark, str(tmp_path / "scrape.txt")), "m").collect()] == [7]


def test_stream_source_resumes_by_partition(spark, tmp_path):
    spark.dataSource.register(LogSource)
    logs, out, state = str(tmp_path / "logs"), str(tmp_path / "out"), str(tmp_path / "state")
    write(f"{logs}/t/000000", 0, record(0), record(1))

    def drain():
        q = spark.readStream.format("tidelog").load(logs).writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted((r.partition, r.offset) for r in spark.read.parquet(out).collect())

    assert drain() == [(0, 0), (0, 1)]
    write(f"{logs}/t/000000", 2, record(2))
    write(f"{logs}/t/000001", 0, record(0))
    assert drain() == [(0, 0), (0, 1), (0, 2), (1, 0)]
    assert spark.read.format("tidelog").load(logs).count() == 4
