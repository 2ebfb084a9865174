"""Text formats: offset logs, topic manifests, metrics scrapes, benchmark reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidelog.operators.stats import roll_up

SECRETS = r"(?i)token|secret|password|authorization|api[_-]?key|private[_-]?key"


def parse_offset_log(lines: DataFrame) -> DataFrame:
    """(group, seq, topic, partition, next_offset) of (group, seq, line): valid lines before the first bad one of each group.

    A line is topic, partition, next offset and the CRC-32 of what precedes it,
    separated by tabs; a carriage return at its end is tolerated.
    """
    clean = F.regexp_replace("line", "\r$", "")
    parts = F.split(clean, "\t")
    body = F.regexp_extract(clean, r"\A(.*)\t[^\t]*\z", 1)
    sound = (F.size(parts) == 4) & F.get(parts, F.lit(1)).rlike(r"\A[0-9]+\z") & F.get(parts, F.lit(2)).rlike(r"\A[0-9]+\z") & (F.crc32(body.cast("binary")).cast("string") == F.get(parts, F.lit(3)))
    read = lines.select(
        "group", "seq", F.get(parts, F.lit(0)).alias("topic"), F.get(parts, F.lit(1)).try_cast("int").alias("partition"),
        F.get(parts, F.lit(2)).try_cast("bigint").alias("next_offset"), F.coalesce(sound, F.lit(False)).alias("sound"),
    )
    bad = F.min(F.when(~F.col("sound"), F.col("seq"))).over(W.partitionBy("group"))
    return read.withColumn("_bad", bad).filter("_bad IS NULL OR seq < _bad").drop("_bad", "sound")


def offset_log_lines(commits: DataFrame) -> DataFrame:
    """(group, seq, line) of commits, as ``parse_offset_log`` reads them."""
    body = F.concat_ws("\t", "topic", F.col("partition").cast("string"), F.col("next_offset").cast("string"))
    return commits.select("group", "seq", F.concat_ws("\t", body, F.crc32(body.cast("binary")).cast("string")).alias("line"))


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    """(topic, partition_count, created_at_utc) of JSON manifests below ``path``."""
    found = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.json")
    got = lambda name: F.get_json_object("value", f"$.{name}")
    return found.select(got("topic").alias("topic"), got("partition_count").cast("int").alias("partition_count"), got("created_at_utc").alias("created_at_utc"))


def catalog(folders: DataFrame, manifests: DataFrame) -> DataFrame:
    """(topic, partition, migrated) of all topics that have a folder or a manifest; one without a manifest has one partition and gets a manifest."""
    have = manifests.select("topic", F.col("partition_count").alias("_count"))
    counted = folders.select("topic").unionByName(have.select("topic")).distinct().join(have, "topic", "left")
    return counted.select("topic", F.explode(F.sequence(F.lit(0), F.greatest(F.coalesce("_count", F.lit(1)), F.lit(1)) - 1)).alias("partition"), F.col("_count").isNull().alias("migrated"))


def manifest_lines(topics: DataFrame) -> DataFrame:
    return topics.select("topic", F.to_json(F.struct("topic", "partition_count", "created_at_utc")).alias("manifest"))


def read_scrapes(spark: SparkSession, path: str) -> DataFrame:
    """(scrape_id, at, line) of metrics text files."""
    lines = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("scrape_id"), F.posexplode(F.split("value", "\n")).alias("at", "line"))
    return lines.filter("line <> '' AND NOT startswith(line, '#')")


REPORT = (
    "schema_version int, generated_at_utc string, environment struct<kind:string,build_type:string,git_sha:string>, broker struct<profile:string,io_workers:int,append_workers:int>, workload struct<name:string>, "
    "repetitions array<struct<index:int,records:bigint,bytes:bigint,seconds:double,records_per_second:double,errors:bigint,latency_us:struct<p50:double,p95:double,p99:double,max:double>>>"
)


def report_problems(spark: SparkSession, path: str, expected: DataFrame | None = None) -> DataFrame:
    """(path, problem) of the benchmark documents below ``path``; a set with one is rejected as a whole.

    A document may not hold secrets or errors, must have schema version 1 and a
    revision, and, with ``expected`` (profile, io_workers, append_workers), a
    known profile with just those workers. All share one revision, and none
    repeats another's profile, workload and run.
    """
    raw = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select("value", F.input_file_name().alias("path"))
    docs = raw.select("path", "value", F.from_json("value", REPORT).alias("d"))
    problem = (
        F.when(F.col("value").rlike(SECRETS), "secret")
        .when(F.coalesce(F.col("d.schema_version"), F.lit(0)) != 1, "schema")
        .when(F.coalesce(F.length("d.environment.git_sha"), F.lit(0)) == 0, "revision")
        .when(F.col("d.workload.name").isNull(), "workload")
        .when(F.coalesce(F.size("d.repetitions"), F.lit(0)) < 1, "repetitions")
        .when(F.exists("d.repetitions", lambda r: F.coalesce(r["errors"], F.lit(1)) != 0), "errors")
    )
    told = docs.withColumn("problem", problem)
    if expected is not None:
        want = expected.select(F.col("profile").alias("_profile"), F.col("io_workers").alias("_io"), F.col("append_workers").alias("_append"))
        met = told.join(want, F.col("d.broker.profile") == F.col("_profile"), "left")
        same = F.col("d.broker.io_workers").eqNullSafe(F.col("_io")) & F.col("d.broker.append_workers").eqNullSafe(F.col("_append"))
        told = met.withColumn("problem", F.coalesce("problem", F.when(F.col("_profile").isNull() | ~same, "profile")))
    found = told.filter("problem IS NOT NULL").select("path", "problem")
    several = told.agg(F.countDistinct("d.environment.git_sha").alias("n")).filter("n > 1").select(F.lit("*").alias("path"), F.lit("several_revisions").alias("problem"))
    runs = told.select("path", F.col("d.broker.profile").alias("p"), F.col("d.workload.name").alias("w"), F.explode("d.repetitions.index").alias("i"))
    again = runs.groupBy("p", "w", "i").agg(F.count(F.lit(1)).alias("n"), F.max("path").alias("path")).filter("n > 1").select("path", F.lit("repeated_run").alias("problem"))
    return found.unionByName(several).unionByName(again)


def read_reports(spark: SparkSession, path: str, expected: DataFrame | None = None) -> DataFrame:
    """Runs of a set of benchmark documents; ValueError names the problems of a set that is not sound (``report_problems``)."""
    problems = report_problems(spark, path, expected).orderBy("path", "problem").limit(20).collect()
    if problems:
        raise ValueError("; ".join(f"{p.problem}: {p.path}" for p in problems))
    raw = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    docs = raw.select(F.from_json("value", REPORT).alias("d"))
    runs = docs.select("d.schema_version", "d.environment.git_sha", F.col("d.broker.profile").alias("profile"), F.col("d.workload.name").alias("workload"), "d.generated_at_utc", F.explode("d.repetitions").alias("r"))
    return runs.select(
        "schema_version", "git_sha", "profile", "workload", "generated_at_utc", F.col("r.index").alias("run"), F.col("r.records_per_second").alias("throughput"),
        F.col("r.latency_us.p50").alias("p50"), F.col("r.latency_us.p99").alias("p99"), F.col("r.latency_us.max").alias("slowest"),
    )


def report_tables(spark: SparkSession, path: str, expected: DataFrame | None = None) -> DataFrame:
    return roll_up(read_reports(spark, path, expected), ["profile", "workload"])


def report_lines(rolled: DataFrame, generated: DataFrame) -> DataFrame:
    """(at, line) of the Markdown table of ``report_tables``, headed by the latest time of the runs (``generated``: generated_at_utc)."""
    latest = generated.agg(F.max("generated_at_utc").alias("t")).select(F.lit(0).cast("bigint").alias("at"), F.concat(F.lit("Generated "), "t").alias("line"))
    heads = [(1, "| profile | workload | median | least | most | cv |"), (2, "| --- | --- | --- | --- | --- | --- |")]
    head = latest.unionByName(rolled.sparkSession.createDataFrame(heads, "at bigint, line string"))
    shown = F.concat(F.lit("| "), F.concat_ws(" | ", "profile", "workload", *[F.format_string("%.2f", F.col(c)) for c in ("median", "least", "most", "cv")]), F.lit(" |"))
    at = F.row_number().over(W.orderBy("profile", "workload")) + 2  # a row a profile and workload
    return head.unionByName(rolled.select(at.cast("bigint").alias("at"), shown.alias("line")))
