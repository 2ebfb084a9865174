"""Leader and follower logs: lag, missing suffix, comparison, catch-up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.operators.log import bounds


def replica_lag(leader: DataFrame, follower: DataFrame) -> DataFrame:
    ahead = bounds(leader).select("topic", "partition", F.col("next_offset").alias("leader_next"))
    behind = bounds(follower).select("topic", "partition", F.col("next_offset").alias("follower_next"))
    met = ahead.join(behind, ["topic", "partition"], "full").select(
        "topic", "partition", F.coalesce("leader_next", F.lit(0)).cast("bigint").alias("leader_next"), F.coalesce("follower_next", F.lit(0)).cast("bigint").alias("follower_next")
    )
    lag = F.col("leader_next") - F.col("follower_next")
    return met.withColumn("lag", lag).withColumn("state", F.when(lag < 0, "follower_ahead").when(lag == 0, "in_sync").otherwise("lagging"))


def missing_suffix(leader: DataFrame, follower: DataFrame) -> DataFrame:
    """Leader records that the follower has yet to fetch: a range of offsets, one row of bounds a partition."""
    have = bounds(follower).select("topic", "partition", F.col("next_offset").alias("_have"))
    return leader.join(have, ["topic", "partition"], "left").filter(F.col("offset") >= F.coalesce("_have", F.lit(0))).drop("_have")


def catch_up_fetches(lags: DataFrame, max_records: int) -> DataFrame:
    """Fetches of at most ``max_records`` that bring each follower level."""
    return lags.withColumn("fetches", F.when(F.col("lag") > 0, F.ceil(F.col("lag") / max_records)).otherwise(0).cast("bigint"))


def compare(leader: DataFrame, follower: DataFrame) -> DataFrame:
    """Records of either log by how they differ, a partition."""
    key = ["topic", "partition", "offset"]
    a = leader.select(*key, F.struct("timestamp_unix_ns", "key", "value").alias("_a"))
    b = follower.select(*key, F.struct("timestamp_unix_ns", "key", "value").alias("_b"))
    state = F.when(F.col("_b").isNull(), "missing").when(F.col("_a").isNull(), "unexpected").when(F.col("_a") == F.col("_b"), "equal").otherwise("different")
    return a.join(b, key, "full").groupBy("topic", "partition", state.alias("state")).agg(F.count(F.lit(1)).alias("records"))


def acknowledged(lags: DataFrame, follower_available: bool) -> DataFrame:
    """Whether a write is acknowledged under each mode: ``leader`` always, ``all`` once the follower is level."""
    modes = F.explode(F.array(F.lit("leader"), F.lit("all"))).alias("mode")
    told = lags.select("topic", "partition", "lag", modes)
    return told.withColumn("acknowledged", (F.col("mode") == "leader") | (F.lit(follower_available) & (F.col("lag") == 0)))
