"""Offset-addressed, size-capped reads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidelog.functions import INVALID_LENGTH, INVALID_OFFSET, MALFORMED, OUT_OF_RANGE, RESPONSE_ITEM, RESPONSE_OVERHEAD, strict_number

MAX_RECORDS = 100


def select_offsets(requests: DataFrame, limits: DataFrame, commits: DataFrame) -> DataFrame:
    """``from_offset`` and ``error_code`` of (topic, partition, group, selector) requests.

    ``beginning``, ``latest``, ``committed`` (the earliest offset without a
    commit) or a decimal number; numbers outside the log are errors.
    """
    have = requests.join(limits.select("topic", "partition", "earliest_offset", "next_offset"), ["topic", "partition"], "left")
    have = have.join(commits.select("group", "topic", "partition", F.col("next_offset").alias("_committed")), ["group", "topic", "partition"], "left")
    number = strict_number(F.col("selector"))
    wanted = (
        F.when(F.col("selector") == "beginning", F.col("earliest_offset"))
        .when(F.col("selector") == "latest", F.col("next_offset"))
        .when(F.col("selector") == "committed", F.coalesce("_committed", "earliest_offset"))
        .otherwise(number)
    )
    error = (
        F.when(F.col("next_offset").isNull(), "invalid_partition")
        .when(F.col("_wanted").isNull(), MALFORMED)
        .when(F.col("_wanted") < F.col("earliest_offset"), OUT_OF_RANGE)
        .when(F.col("_wanted") > F.col("next_offset"), INVALID_OFFSET)
        .otherwise("none")
    )
    told = have.withColumn("_wanted", wanted).withColumn("error_code", error)
    return told.withColumn("from_offset", F.when(F.col("error_code") == "none", F.col("_wanted"))).drop("_wanted", "_committed")


def fetch(records: DataFrame, requests: DataFrame, max_records: int = MAX_RECORDS, max_bytes: int = 0, max_response_bytes: int = 0) -> DataFrame:
    """Records that each (topic, partition, from_offset) request returns, with its columns beside.

    At most ``max_records``; the first one always, and more while their bytes
    stay within ``max_bytes`` and the response within ``max_response_bytes``
    (0: no limit). Offsets are dense, so the record cap is also a range of
    offsets: it prunes before anything is sorted. A first record that no
    response can hold comes back alone with ``error_code`` invalid_length.
    """
    met = records.join(requests, ["topic", "partition"]).filter((F.col("offset") >= F.col("from_offset")) & (F.col("offset") < F.col("from_offset") + max_records))
    key = [c for c in requests.columns if c != "from_offset"]
    upto = W.partitionBy(*key).orderBy("offset").rowsBetween(W.unboundedPreceding, W.currentRow)
    counted = (
        met.withColumn("_n", F.row_number().over(W.partitionBy(*key).orderBy("offset")))
        .withColumn("_bytes", F.sum("encoded_byte_size").over(upto))
        .withColumn("_response", RESPONSE_OVERHEAD + F.octet_length("topic") + F.sum(RESPONSE_ITEM + F.octet_length("key") + F.octet_length("value")).over(upto))
    )
    keep, code = F.col("_n") <= max_records, F.lit("none")
    if max_bytes:
        keep = keep & ((F.col("_n") == 1) | (F.col("_bytes") <= max_bytes))
    if max_response_bytes:
        keep = keep & ((F.col("_n") == 1) | (F.col("_response") <= max_response_bytes))
        code = F.when(F.col("_response") > max_response_bytes, INVALID_LENGTH).otherwise(code)
    return counted.filter(keep).withColumn("error_code", code).drop("_n", "_bytes", "_response")


def responses(requests: DataFrame, fetched: DataFrame) -> DataFrame:
    """One row a request: records, bytes, the offset to go on from, and an error: then there are no records and no next offset.

    Requests may bring an ``error_code`` of their own (``select_offsets``); it goes first.
    """
    key = [c for c in requests.columns if c not in ("from_offset", "error_code")]
    got = fetched.groupBy(*key).agg(
        F.count(F.lit(1)).alias("_records"),
        F.sum("encoded_byte_size").alias("_bytes"),
        (F.max("offset") + 1).alias("_next"),
        F.max(F.when(fetched["error_code"] != "none", fetched["error_code"])).alias("_late"),
    )
    early = F.when(F.col("error_code") != "none", F.col("error_code")) if "error_code" in requests.columns else F.lit(None)
    out = requests.join(got, key, "left").withColumn("_error", F.coalesce(early, "_late", F.lit("none")))
    fine = F.col("_error") == "none"
    return out.select(
        *key,
        "from_offset",
        F.when(fine, F.coalesce("_next", "from_offset")).alias("next_offset"),
        F.when(fine, F.coalesce("_records", F.lit(0))).otherwise(0).cast("bigint").alias("records"),
        F.when(fine, F.coalesce("_bytes", F.lit(0))).otherwise(0).cast("bigint").alias("bytes"),
        F.col("_error").alias("error_code"),
    )
