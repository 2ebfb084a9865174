"""Counters, histograms, text exposition, rates and alert conditions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidelog.functions import DURATION_BOUNDS, escaped_label


def counters(events: DataFrame, keys: list[str], vocabulary: DataFrame | None = None) -> DataFrame:
    """Counts by label; a vocabulary makes them dense."""
    counted = events.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"))
    if vocabulary is None:
        return counted
    return vocabulary.join(counted, keys, "left").select(*vocabulary.columns, F.coalesce("total", F.lit(0)).cast("bigint").alias("total"))


def histogram(samples: DataFrame, keys: list[str], value: str, bounds: tuple = DURATION_BOUNDS) -> DataFrame:
    """(keys, le, cumulative, samples, total): a row a bound, ``le`` null for infinity.

    One pass of conditional sums over the samples, then an unpivot of the few
    sums; samples are not multiplied by bounds.
    """
    sums = samples.groupBy(*keys).agg(
        F.count(value).alias("samples"),
        F.sum(value).alias("total"),
        *[F.count(F.when(F.col(value) <= b, 1)).alias(f"_b{k}") for k, b in enumerate(bounds)],
    )
    rows = [F.struct(F.lit(float(b)).alias("le"), F.col(f"_b{k}").alias("cumulative")) for k, b in enumerate(bounds)]
    rows.append(F.struct(F.lit(None).cast("double").alias("le"), F.col("samples").alias("cumulative")))
    return sums.select(*keys, "samples", "total", F.inline(F.array(*rows)))


def histogram_quantile(buckets: DataFrame, keys: list[str], q: float) -> DataFrame:
    """Linear interpolation inside the first bucket that holds rank q; the highest finite bound beyond."""
    order = W.partitionBy(*keys).orderBy(F.col("le").asc_nulls_last())
    rank = F.max("cumulative").over(W.partitionBy(*keys)) * q
    told = (
        buckets.withColumn("_rank", rank)
        .withColumn("_low", F.coalesce(F.lag("le").over(order), F.lit(0.0)))
        .withColumn("_before", F.coalesce(F.lag("cumulative").over(order), F.lit(0)))
        .filter((F.col("cumulative") >= F.col("_rank")) & (F.col("_before") < F.col("_rank")))
    )
    inside = F.col("_low") + (F.col("le") - F.col("_low")) * (F.col("_rank") - F.col("_before")) / (F.col("cumulative") - F.col("_before"))
    return told.select(*keys, F.when(F.col("le").isNull(), F.col("_low")).otherwise(inside).alias("quantile"))


def counter_deltas(samples: DataFrame, keys: list[str], ts: str = "ts", value: str = "value") -> DataFrame:
    """``delta`` since the last sample of the series; a fall means a restart from 0."""
    before = F.lag(value).over(W.partitionBy(*keys).orderBy(ts))
    return samples.withColumn("delta", F.when(before.isNull(), F.lit(None)).when(F.col(value) < before, F.col(value)).otherwise(F.col(value) - before))


def rate(samples: DataFrame, keys: list[str], seconds: int, ts: str = "ts", value: str = "value") -> DataFrame:
    """Increase and rate over the trailing window at each sample, without extrapolation to the window's edges."""
    moved = counter_deltas(samples, keys, ts, value).withColumn("_s", F.unix_seconds(ts))
    window = W.partitionBy(*keys).orderBy("_s").rangeBetween(-(seconds - 1), 0)
    increase = F.coalesce(F.sum("delta").over(window), F.lit(0))
    return moved.withColumn("increase", increase.cast("double")).withColumn("rate", F.col("increase") / seconds).drop("_s", "delta")


def firing(conditions: DataFrame, keys: list[str], condition: Column, for_seconds: int, ts: str = "ts") -> DataFrame:
    """``pending_since`` and ``firing``: the condition has held at every sample for that long."""
    order = W.partitionBy(*keys).orderBy(ts)
    marked = conditions.withColumn("condition", F.coalesce(condition, F.lit(False)))
    islands = marked.withColumn("_island", F.sum(F.when(F.col("condition"), 0).otherwise(1)).over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    since = F.min(F.when(F.col("condition"), F.col(ts))).over(W.partitionBy(*keys, "_island"))
    told = islands.withColumn("pending_since", F.when(F.col("condition"), since))
    held = F.unix_seconds(ts) - F.unix_seconds("pending_since") >= for_seconds
    return told.withColumn("firing", F.coalesce(held, F.lit(False))).drop("_island")


def exposition(samples: DataFrame, labels: list[str]) -> DataFrame:
    """``line``: name{label="value",...} value, labels escaped."""
    shown = F.concat_ws(",", *[F.concat(F.lit(f'{label}="'), escaped_label(F.col(label).cast("string")), F.lit('"')) for label in labels])
    return samples.withColumn("line", F.concat(F.col("metric"), F.lit("{"), shown, F.lit("} "), F.col("value").cast("string")))


def exposition_text(samples: DataFrame, labels: list[str], about: DataFrame) -> DataFrame:
    """(metric, at, line) of a page in order: HELP and TYPE of each metric of ``about`` (metric, help, type), then its samples by their labels."""
    lines = exposition(samples, labels)
    order = W.partitionBy("metric").orderBy(*labels)
    shown = lines.withColumn("at", F.row_number().over(order) + 1).select("metric", F.col("at").cast("bigint").alias("at"), "line")
    heads = [F.struct(F.lit(k).cast("bigint").alias("at"), F.concat(F.lit(f"# {word} "), "metric", F.lit(" "), F.col(c)).alias("line")) for k, (word, c) in enumerate((("HELP", "help"), ("TYPE", "type")))]
    return about.select("metric", F.inline(F.array(*heads))).unionByName(shown)


def nonzero(counted: DataFrame, total: str = "total") -> DataFrame:
    """Label rows that have counted something."""
    return counted.filter(F.col(total) > 0)


def aggregated(samples: DataFrame, how: str, by: list[str], ts: str = "ts", value: str = "value") -> DataFrame:
    """``sum by`` and ``max by`` of the series at each time; no labels: over all of them."""
    fold = {"sum": F.sum, "max": F.max, "min": F.min}[how]
    return samples.groupBy(*by, ts).agg(fold(value).alias(value))


#: alert: metric, labels, what is compared, for how long, severity. ``seconds`` is a counter's window, ``over`` a ratio's other metric.
ALERTS = (
    {"alert": "BrokerDown", "metric": "up", "test": lambda v: v == 0, "hold": 60, "severity": "critical"},
    {"alert": "NotReady", "metric": "ready", "test": lambda v: v == 0, "hold": 120, "severity": "critical"},
    {"alert": "AppendOverload", "metric": "rejected_requests_total", "labels": {"operation": "produce", "reason": "append_queue"}, "seconds": 120, "fold": "sum", "test": lambda v: v > 0, "hold": 120, "severity": "warning"},
    {"alert": "ConsumerLagHigh", "metric": "consumer_group_lag_records", "fold": "max", "test": lambda v: v > 10000, "hold": 300, "severity": "warning"},
    {"alert": "DiskNearlyFull", "metric": "storage_available_bytes", "over": "storage_capacity_bytes", "test": lambda v: v < 0.15, "hold": 300, "severity": "critical"},
    {"alert": "RetentionFailure", "metric": "retention_failures_total", "seconds": 300, "test": lambda v: v > 0, "hold": 0, "severity": "warning"},
)


def alerts(samples: DataFrame, rules: tuple[dict, ...] = ALERTS) -> DataFrame:
    """(alert, severity, labels, ts, value, firing) of each rule over (metric, labels, ts, value); ``labels`` are JSON with sorted names, "" where a rule folds series."""
    from functools import reduce

    out = []
    for rule in rules:
        rows = samples.filter(F.col("metric") == rule["metric"])
        for name, wanted in rule.get("labels", {}).items():
            rows = rows.filter(F.get_json_object("labels", f"$.{name}") == wanted)
        rows = rows.select("labels", "ts", F.col("value").cast("double").alias("value"))
        if "seconds" in rule:
            rows = rate(rows, ["labels"], rule["seconds"]).select("labels", "ts", F.col("increase").alias("value"))
        if "over" in rule:
            other = samples.filter(F.col("metric") == rule["over"]).select("labels", "ts", F.col("value").alias("_of"))
            rows = rows.join(other, ["labels", "ts"]).select("labels", "ts", (F.col("value") / F.nullif(F.col("_of"), F.lit(0.0))).alias("value"))
        if "fold" in rule:
            rows = aggregated(rows, rule["fold"], []).select(F.lit("").alias("labels"), "ts", "value")
        told = firing(rows, ["labels"], rule["test"](F.col("value")), rule["hold"])
        out.append(told.select(F.lit(rule["alert"]).alias("alert"), F.lit(rule["severity"]).alias("severity"), "labels", "ts", "value", "firing"))
    return reduce(DataFrame.unionByName, out)


def scrape(lines: DataFrame, name: str) -> DataFrame:
    """The number of the first line ``name number`` of each scrape (scrape_id, at, line)."""
    value = F.regexp_extract("line", rf"^{name} ([0-9]+)$", 1)
    found = lines.withColumn("_v", value).filter("_v <> ''")
    return found.groupBy("scrape_id").agg(F.min_by(F.col("_v").cast("bigint"), "at").alias("value"))
