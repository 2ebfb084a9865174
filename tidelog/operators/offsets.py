"""Consumer offsets: latest commits, lag, validation, resets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions import GROUP_ACTIVE, INVALID_OFFSET, OUT_OF_RANGE, STALE_MEMBER, strict_number

KEY = ["group", "topic", "partition"]


def latest_commits(commits: DataFrame) -> DataFrame:
    """The last commit in the order of ``seq`` wins, even where it moves back."""
    return commits.groupBy(*KEY).agg(F.max_by("next_offset", "seq").alias("next_offset"))


def lag(committed: Column, earliest: Column, following: Column) -> tuple[Column, Column]:
    """Lag, and whether the commit is out of range: then, or without one, all that the log holds."""
    outside = committed.isNotNull() & ((committed < earliest) | (committed > following))
    return F.when(committed.isNull() | outside, following - earliest).otherwise(following - committed).cast("bigint"), outside


def describe_groups(latest: DataFrame, limits: DataFrame) -> DataFrame:
    """Every partition of a topic for every group that has commits in the topic, with its commit or none."""
    groups = latest.select("group", "topic").distinct()
    every = groups.join(limits.select("topic", "partition", "earliest_offset", F.col("next_offset").alias("_end")), "topic")
    met = every.join(latest.withColumnRenamed("next_offset", "_committed"), KEY, "left")
    behind, outside = lag(F.col("_committed"), F.col("earliest_offset"), F.col("_end"))
    return met.select(
        *KEY,
        F.col("_committed").isNotNull().alias("has_committed_offset"),
        F.coalesce("_committed", F.lit(0)).cast("bigint").alias("committed_offset"),
        "earliest_offset",
        F.col("_end").alias("next_offset"),
        behind.alias("lag"),
        outside.alias("out_of_range"),
    )


def lag_metrics(latest: DataFrame, limits: DataFrame) -> DataFrame:
    """Lag of committed partitions that exist."""
    met = latest.withColumnRenamed("next_offset", "_committed").join(limits.select("topic", "partition", "earliest_offset", F.col("next_offset").alias("_end")), ["topic", "partition"])
    behind, outside = lag(F.col("_committed"), F.col("earliest_offset"), F.col("_end"))
    return met.select(*KEY, behind.alias("lag_records"), outside.alias("out_of_range"))


def validate(commits: DataFrame, limits: DataFrame) -> DataFrame:
    """``error_code`` of each commit against the bounds of its partition."""
    met = commits.join(limits.select("topic", "partition", "earliest_offset", F.col("next_offset").alias("_end")), ["topic", "partition"], "left")
    code = (
        F.when(F.col("_end").isNull(), "invalid_partition")
        .when(F.col("next_offset") < F.col("earliest_offset"), OUT_OF_RANGE)
        .when(F.col("next_offset") > F.col("_end"), INVALID_OFFSET)
        .otherwise("none")
    )
    return met.withColumn("error_code", code).drop("earliest_offset", "_end")


def reset(requests: DataFrame, latest: DataFrame, limits: DataFrame, active_groups: DataFrame) -> DataFrame:
    """(group, topic, partition, target) resets of inactive groups: previous and new offset, or an error."""
    met = requests.join(limits.select("topic", "partition", "earliest_offset", F.col("next_offset").alias("_end")), ["topic", "partition"])
    met = met.join(latest.select(*KEY, F.col("next_offset").alias("previous_offset")), KEY, "left")
    met = met.join(active_groups.select("group", F.lit(True).alias("_active")), "group", "left")
    wanted = F.when(F.col("target") == "beginning", F.col("earliest_offset")).when(F.col("target") == "latest", F.col("_end")).otherwise(strict_number(F.col("target")))
    code = (
        F.when(F.col("_active"), GROUP_ACTIVE)
        .when(wanted.isNull(), "malformed_payload")
        .when(wanted < F.col("earliest_offset"), OUT_OF_RANGE)
        .when(wanted > F.col("_end"), INVALID_OFFSET)
        .otherwise("none")
    )
    return met.select(*KEY, "previous_offset", F.when(code == "none", wanted).alias("new_offset"), code.alias("error_code"))


def commit(commits: DataFrame, limits: DataFrame, active_members: DataFrame) -> DataFrame:
    """Commits made by hand: ``error_code`` of each, those of groups with members of a topic (group, topic) being fenced as stale.

    Commits without an error may be appended (``append_commits``).
    """
    met = commits.join(active_members.select("group", "topic").distinct().withColumn("_busy", F.lit(True)), ["group", "topic"], "left")
    told = validate(met, limits)
    known = F.col("error_code") != "invalid_partition"
    return told.withColumn("error_code", F.when(known & F.col("_busy"), STALE_MEMBER).otherwise(F.col("error_code"))).drop("_busy")


def describe_members(described: DataFrame, members: DataFrame) -> DataFrame:
    """``describe_groups`` with ``active_members`` of each (group, topic) beside."""
    counted = members.groupBy("group", "topic").agg(F.countDistinct("member_id").alias("active_members"))
    return described.join(counted, ["group", "topic"], "left").fillna(0, ["active_members"])
