"""Percentiles, variation and roll-ups of benchmark runs."""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: ranges of about as many samples in which a rank is looked for
RANGES = 64


def nearest_rank(value: str, q: float, scale: float = 1.0) -> Column:
    """The sample of rank ceil(q n), at least the first; 0 without samples."""
    q = min(1.0, max(0.0, q))
    return F.coalesce(F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY {value})").cast("double") / scale, F.lit(0.0))


def median(value: str) -> Column:
    """In one task a key, as ``nearest_rank``: for the few samples of a roll-up; ``ranked`` finds ranks of many."""
    return F.coalesce(F.percentile(value, 0.5), F.lit(0.0)).cast("double")


#: ranks on both sides of the middle, for ``ranked``
MIDDLE = {"_low": lambda n: F.floor((n + 1) / 2), "_high": lambda n: F.floor(n / 2) + 1}


def middle() -> Column:
    """The median from the two ranks of ``MIDDLE``; 0 without samples."""
    return F.coalesce(F.col("_low") * 0.5 + F.col("_high") * 0.5, F.lit(0.0)).cast("double")


def variation(value: str) -> Column:
    """Sample deviation over the mean in per cent; 0 for fewer than two samples or a mean of 0."""
    return F.when((F.count(value) < 2) | (F.avg(value) == 0), F.lit(0.0)).otherwise(F.stddev_samp(value) / F.avg(value) * 100)


def per_second(amount: Column, seconds: Column) -> Column:
    return F.when(seconds > 0, amount / seconds).otherwise(F.lit(0.0)).cast("double")


def mebibytes_per_second(amount: Column, seconds: Column) -> Column:
    return per_second(amount, seconds) / 1048576


def roll_up(runs: DataFrame, keys: list[str], value: str = "throughput", unstable: float = 15.0) -> DataFrame:
    """Median, least, most and variation of the runs' throughput; median of their percentiles, most of their maxima."""
    out = runs.groupBy(*keys).agg(
        median(value).alias("median"),
        F.min(value).alias("least"),
        F.max(value).alias("most"),
        variation(value).alias("cv"),
        median("p50").alias("p50"),
        median("p99").alias("p99"),
        F.max("slowest").alias("slowest"),
        F.count(F.lit(1)).alias("runs"),
    )
    return out.withColumn("unstable", F.col("cv") > unstable)


def merge_threads(threads: DataFrame, keys: list[str]) -> DataFrame:
    """Runs from the results of their threads (records, bytes, errors, latencies): sums, and all latencies together."""
    return threads.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("records", "bytes", "errors")], F.flatten(F.collect_list("latencies")).alias("latencies"))


def rank_of(q: float) -> Callable[[Column], Column]:
    """Rank ceil(q n), at least the first, in whole numbers: products of doubles may pass the next one."""
    part = Fraction(repr(min(1.0, max(0.0, float(q))))).limit_denominator(10**16)
    up, down = (F.lit(str(x)).cast("decimal(17,0)") for x in (part.numerator, part.denominator))
    return lambda n: F.greatest(F.lit(1), F.call_function("div", n.cast("decimal(20,0)") * up + down - 1, down))


def beside(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """The join on keys of which nulls are equal."""
    renamed = right.select(*[F.col(k).alias(f"_r{i}") for i, k in enumerate(keys)], *[c for c in right.columns if c not in keys])
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_r{i}")) for i, k in enumerate(keys)], F.lit(True))
    return left.join(renamed, same, how).drop(*[f"_r{i}" for i in range(len(keys))])


def ranked(samples: DataFrame, keys: list[str], value: str, ranks: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """(keys, samples, names): the sample at each rank, from 1, a function of the key's number of samples; null without samples. Exact.

    Bounds of equally filled ranges of all values, estimated, are read first. The
    counts of ranges tell which of them holds a rank, and only those ranges are
    ordered, a count a distinct value; no key is ordered or gathered in one task.
    The estimate decides how even the ranges are, not what is found.
    """
    at = [k / RANGES for k in range(1, RANGES)]
    bounds = sorted(set(samples.agg(F.percentile_approx(value, at, 10000)).first()[0] or []))

    def place(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(F.col(value) > bounds[middle], place(middle + 1, high)).otherwise(place(low, middle))

    placed = samples.select(*keys, value, place(0, len(bounds)).alias("_range"))
    counts = placed.groupBy(*keys, "_range").agg(F.count(value).alias("_n"))
    each = W.partitionBy(*keys)
    before = F.coalesce(F.sum("_n").over(each.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    summed = counts.select(*keys, "_range", "_n", before.alias("_before"), F.sum("_n").over(each).alias("_all"))
    wanted = summed.select(*keys, "_range", "_n", "_before", F.inline(F.array(*[F.struct(F.lit(name).alias("_name"), rank(F.col("_all")).cast("bigint").alias("_rank")) for name, rank in ranks.items()])))
    wanted = wanted.filter("_rank > _before AND _rank <= _before + _n").select(*keys, "_range", "_name", (F.col("_rank") - F.col("_before")).alias("_rank"))
    ranges = [r[0] for r in wanted.select("_range").distinct().collect()]
    near = placed.filter(F.col("_range").isin(ranges) & F.col(value).isNotNull()).groupBy(*keys, "_range", value).agg(F.count(F.lit(1)).alias("_n"))
    order = W.partitionBy(*keys, "_range").orderBy(value).rowsBetween(W.unboundedPreceding, W.currentRow)
    met = beside(near.withColumn("_upto", F.sum("_n").over(order)), wanted, [*keys, "_range"]).filter("_rank <= _upto AND _rank > _upto - _n")
    rows = met.select(*keys, "_name", value, F.lit(0).cast("bigint").alias("_n")).unionByName(counts.select(*keys, "_n"), allowMissingColumns=True)
    return rows.groupBy(*keys).agg(F.sum("_n").alias("samples"), *[F.max(F.when(F.col("_name") == name, F.col(value))).alias(name) for name in ranks])


def pooled(samples: DataFrame, keys: list[str], value: str, qs: dict[str, float], scale: float = 1.0) -> DataFrame:
    """Percentiles over the samples of all runs together, where ``roll_up`` takes the median of each run's."""
    found = ranked(samples, keys, value, {name: rank_of(q) for name, q in qs.items()})
    return found.select(*keys, "samples", *[F.coalesce(F.col(name).cast("double") / scale, F.lit(0.0)).alias(name) for name in qs])


def mean_batch(records: Column, batches: Column) -> Column:
    """Records of a mean batch; 0 without batches."""
    return F.when(batches > 0, records / batches).otherwise(F.lit(0.0)).cast("double")


def best(rolled: DataFrame, by: str = "median", name: str = "profile") -> DataFrame:
    return rolled.orderBy(F.col(by).desc(), F.col(name)).limit(1)
