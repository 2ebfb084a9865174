"""Column expressions: hashing, sizes, names, numbers, times and text escapes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the 64-bit FNV-1a hash, as 32-bit halves: the basis, and the prime 2**40 + 435.
FNV_BASIS_HIGH, FNV_BASIS_LOW, FNV_PRIME_LOW = 3421674724, 2216829733, 435

# Fixed sizes of the log format: bytes of an entry besides key and value, and of a batch entry besides its records.
RECORD_OVERHEAD, BATCH_OVERHEAD, RECORD_SET_OVERHEAD, RECORD_SET_ITEM = 40, 44, 4, 8
RESPONSE_OVERHEAD, RESPONSE_ITEM = 26, 28

# Fixed bounds of the histograms: request seconds, and records of an append batch.
DURATION_BOUNDS = (0.0005, 0.001, 0.0025, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0, 60.0)
BATCH_BOUNDS = (1, 2, 4, 8, 16, 32, 64, 128, 256, 512, 1024)

# Fixed names of error codes that queries return.
MALFORMED, OUT_OF_RANGE, INVALID_OFFSET, INVALID_PARTITION = "malformed_payload", "offset_out_of_range", "invalid_offset", "invalid_partition"
INVALID_LENGTH, INVALID_BATCH, UNSUPPORTED_CODEC, UNKNOWN_TOPIC = "invalid_length", "invalid_batch", "unsupported_codec", "unknown_topic"
STALE_MEMBER, REBALANCE, GROUP_ACTIVE, TOPIC_CONFLICT, OVERLOADED = "stale_member", "rebalance_required", "group_active", "topic_conflict", "overloaded"

# Fixed names of error codes, from 1 on, of codecs, from 0 on, of reasons for rejection and of damage scenarios.
ERROR_NAMES = (
    "invalid_magic", "unsupported_version", "invalid_length", "crc_mismatch", "malformed_payload", "unsupported_request", "not_implemented", "internal_error",
    "reserved_flags", "unauthorized", "unknown_topic", "topic_conflict", "invalid_partition", "invalid_group", "invalid_offset", "overloaded",
    "rebalance_required", "stale_member", "offset_out_of_range", "group_active", "unsupported_codec", "invalid_batch",
)
CODEC_NAMES = ("none", "zstd")
REASON_NAMES = ("append_queue", "long_poll_limit", "connection_limit")
SCENARIO_NAMES = ("torn-record", "partial-batch", "stale-index")
# Fixed operations of the protocol: frame 1 is an error response, then each has a request (even) and a response (odd).
OPERATIONS = (
    "health", "metadata", "produce", "fetch", "offset_commit", "auth", "create_topic", "join_group", "sync_group", "heartbeat", "leave_group",
    "group_offset_commit", "list_topics", "describe_topic", "delete_topic", "run_retention", "describe_group", "reset_group_offset", "produce_batch",
)


def whole(a: Column, b: Column | int) -> Column:
    """The whole quotient of 64-bit integers, exact where a double would round."""
    return F.call_function("div", a.cast("bigint"), (F.lit(b) if isinstance(b, int) else b).cast("bigint"))


def _named(code: Column, names: tuple[str, ...], first: int, other: str) -> Column:
    return F.coalesce(F.get(F.array(*map(F.lit, names)), (code - first).cast("int")), F.lit(other))


def error_name(code: Column) -> Column:
    return _named(code, ERROR_NAMES, 1, "unknown_error")


def frame_name(code: Column) -> Column:
    frames = ["error_response", *(f"{name}_{kind}" for name in OPERATIONS for kind in ("request", "response"))]
    return _named(code, tuple(frames), 1, "unknown")


def codec_name(code: Column) -> Column:
    return _named(code, CODEC_NAMES, 0, "unknown")


def reason_name(code: Column) -> Column:
    return _named(code, REASON_NAMES, 0, "unknown")


def scenario_name(code: Column) -> Column:
    return _named(code, SCENARIO_NAMES, 0, "unknown")


def is_request(code: Column) -> Column:
    """Whether a frame's type asks for something: the even ones of the operations."""
    return F.coalesce(code.between(2, 2 * len(OPERATIONS) + 1) & (code % 2 == 0), F.lit(False))


def is_retryable(error: Column) -> Column:
    return F.coalesce(error.isin(OVERLOADED, REBALANCE), F.lit(False))


def common_codecs(mine: Column, theirs: Column) -> Column:
    """The codecs that both masks offer; null where ``none`` is not among them, as every peer must take it."""
    both = mine.bitwiseAND(theirs)
    return F.when(both.bitwiseAND(F.lit(1)) == 1, both)


def joined_assignment(partitions: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(partitions), lambda p: p.cast("string")), ",")


def topic_matches(topic: Column, wanted: str | Column) -> Column:
    """An optional filter: an empty topic asks for all."""
    name = F.lit(wanted) if isinstance(wanted, str) else wanted
    return (name == "") | (topic == name)


def _bytes(key: Column) -> Column:
    raw = key.cast("binary")
    each = F.transform(F.sequence(F.lit(1), F.octet_length(raw)), lambda i: F.conv(F.hex(F.substring(raw, i, F.lit(1))), 16, 10).cast("bigint"))
    return F.when(F.octet_length(raw) > 0, each).otherwise(F.array().cast("array<bigint>"))


def fnv1a_partition(key: Column, partitions: int) -> Column:
    """FNV-1a of the key's bytes, unsigned, modulo ``partitions``.

    The prime is 2**40 + 435, so a product modulo 2**64 needs only the low
    half times 435 and a shift; no step leaves the signed 64-bit range.
    """
    mask = F.lit(0xFFFFFFFF)

    def step(acc: Column, byte: Column) -> Column:
        low = acc["l"].bitwiseXOR(byte)
        product = low * FNV_PRIME_LOW
        high = acc["h"] * FNV_PRIME_LOW + low * 256 + F.shiftright(product, 32)
        return F.struct(high.bitwiseAND(mask).alias("h"), product.bitwiseAND(mask).alias("l"))

    start = F.struct(F.lit(FNV_BASIS_HIGH).cast("bigint").alias("h"), F.lit(FNV_BASIS_LOW).cast("bigint").alias("l"))
    done = lambda acc: (((acc["h"] % partitions) * ((1 << 32) % partitions) + acc["l"] % partitions) % partitions).cast("int")
    return F.aggregate(_bytes(key), start, step, done)


def record_bytes(key: Column, value: Column) -> Column:
    """Bytes that a record takes in the log."""
    size = lambda c: F.coalesce(F.octet_length(c), F.lit(0))
    return (F.lit(RECORD_OVERHEAD) + size(key) + size(value)).cast("bigint")


def unix_nanos(ts: Column) -> Column:
    return (F.unix_micros(ts.cast("timestamp")) * 1000).cast("bigint")


def nanos_to_timestamp(ns: Column) -> Column:
    return F.timestamp_micros(whole(ns, 1000))


def iso_seconds(ns: Column) -> Column:
    return F.date_format(nanos_to_timestamp(ns), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def age_seconds(now_ns: Column, ns: Column) -> Column:
    """Whole seconds since ``ns``; 0 for times to come."""
    return F.greatest(F.lit(0).cast("bigint"), whole(now_ns - ns, 1_000_000_000))


def zero_padded(number: Column, width: int) -> Column:
    """Decimal digits padded to ``width``, never cut."""
    text = number.cast("string")
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))


def valid_name(name: Column) -> Column:
    """Letters, digits, dots, underscores and hyphens, at least one, and neither "." nor ".."."""
    return F.coalesce(name.rlike(r"\A[A-Za-z0-9._-]+\z") & ~name.isin(".", ".."), F.lit(False))


def strict_number(text: Column) -> Column:
    """A non-negative decimal number, or null."""
    return F.when(text.rlike(r"\A[0-9]+\z"), F.try_to_number(text, F.lit("9" * 19)).cast("bigint"))


def escaped_label(text: Column) -> Column:
    """A label value for text exposition: backslash, quote and newline escaped."""
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))


def operation_name(frame: Column) -> Column:
    return F.regexp_replace(frame, "_request$", "")


def crc_matches(body: Column, crc: Column) -> Column:
    return F.crc32(body) == crc


def even_share(total: Column, parts: Column, part: Column) -> Column:
    """How much of ``total`` part number ``part`` (from 0) gets in an even split."""
    return (whole(total, parts) + F.when(part < total % parts, 1).otherwise(0)).cast("bigint")


def range_owner(partition: Column, partitions: Column, members: Column) -> Column:
    """Index of the member that owns a partition when sorted members take contiguous ranges, the first ones one more."""
    base = whole(partitions, members)
    extra = partitions % members
    wide = extra * (base + 1)
    return F.when(partition < wide, whole(partition, base + 1)).otherwise(extra + whole(partition - wide, F.nullif(base, F.lit(0)))).cast("bigint")


def ratio(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, F.lit(0.0)).otherwise(part / whole).cast("double")


__all__ = [n for n in dir() if not n.startswith("_") and n not in ("annotations", "Column", "F")]
