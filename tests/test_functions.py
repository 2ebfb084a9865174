"""Scalar expressions against independent loops and known values."""

import zlib

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidelog import functions as fn


def fnv(data: bytes) -> int:
    h = 14695981039346656037
    for b in data:
        h = ((h ^ b) * 1099511628211) % 2**64
    return h


def owners(partitions: int, members: int) -> list[int]:
    out = []
    for m in range(members):
        out += [m] * (partitions // members + (m < partitions % members))
    return out


@pytest.mark.parametrize("n", [1, 3, 4, 7, 128])
def test_fnv_partition(spark, n):
    keys = ["", "a", "same-key", "AAPL", "schlüssel", "日本", "x" * 300]
    got = spark.createDataFrame([(k,) for k in keys], "k string").select("k", fn.fnv1a_partition(F.col("k"), n).alias("p")).collect()
    assert {r.k: r.p for r in got} == {k: fnv(k.encode()) % n for k in keys}


def test_range_owner_and_even_share(spark):
    rows = [(p, P, M) for P in range(1, 14) for M in range(1, 9) for p in range(P)]
    got = spark.createDataFrame(rows, "p int, P_ int, M int").select("p", "P_", "M", fn.range_owner(F.col("p"), F.col("P_"), F.col("M")).alias("o"), fn.even_share(F.col("P_"), F.col("M"), F.col("p") % F.col("M")).alias("s")).collect()
    for r in got:
        assert r.o == owners(r.P_, r.M)[r.p]
        assert r.s == r.P_ // r.M + (r.p % r.M < r.P_ % r.M)


def test_names(spark):
    names = {"": False, ".": False, "..": False, "../bad": False, "bad/name": False, "bad\\name": False, "bad name": False, "ok\n": False, "trades": True, "a.b_c-9": True}
    got = spark.createDataFrame([(n,) for n in names], "n string").select("n", fn.valid_name(F.col("n")).alias("v")).collect()
    assert {r.n: r.v for r in got} == names


def test_numbers_times_and_escapes(spark):
    row = spark.range(1).select(
        fn.zero_padded(F.lit(7), 3).alias("a"),
        fn.zero_padded(F.lit(12345), 3).alias("b"),
        fn.strict_number(F.lit("0012")).alias("c"),
        fn.strict_number(F.lit("-1")).alias("d"),
        fn.strict_number(F.lit("1x")).alias("e"),
        fn.iso_seconds(F.lit(1704067207179575000)).alias("f"),
        fn.age_seconds(F.lit(10**9), F.lit(5 * 10**9)).alias("g"),
        fn.escaped_label(F.lit('a\\b"c\nd')).alias("h"),
        fn.record_bytes(F.lit("AAPL"), F.lit("100")).alias("i"),
        fn.crc_matches(F.lit("topic\t1\t2").cast("binary"), F.lit(zlib.crc32(b"topic\t1\t2"))).alias("j"),
        fn.operation_name(F.lit("fetch_request")).alias("k"),
        fn.ratio(F.lit(1), F.lit(0)).alias("l"),
    ).first()
    assert tuple(row) == ("007", "12345", 12, None, None, "2024-01-01T00:00:07Z", 0, 'a\\\\b\\"c\\nd', 47, True, "fetch", 0.0)


@given(st.lists(st.integers(1, 50), min_size=1, max_size=12), st.integers(1, 120))
def test_retention_suffix_sum_equals_the_walk(sizes, limit):
    total, walked = sum(sizes), []
    for k, s in enumerate(sizes):
        gone = k < len(sizes) - 1 and total > limit
        walked.append(gone)
        total -= s * gone
    closed = [k < len(sizes) - 1 and sum(sizes[k:]) > limit for k in range(len(sizes))]
    # once a segment stays, all later ones do: the walk's total is the suffix
    assert walked == closed
