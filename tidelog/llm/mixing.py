"""Mixing sources to target weights by Pareto order sampling.

Sources weigh 1, 2, 3, repeating, in the code-point order of their names (null
last) unless weights are given, and share all words of the corpus by weight. A
target stops at ``max_repeats`` times its source's words; the excess is shared
among the others by weight until none is above (a water level that the sorted
ratios of size to weight give in closed form).

A source that is due ``r`` times its words takes ``floor(r)`` whole copies of
every document for certain. The rest is an order sample: each document has the
inclusion odds of the fraction left, raised for short and lowered for long
documents so that a single long one does not fill the rest; documents rank by
random odds divided by inclusion odds, and the sample is the top of that order
whose words reach what is left. The document at the border gives just the words
that are missing, so the taken words meet the target to one word.

The border is found without ordering a source in one task: ranks fall into
fixed bins of the key, bins are counted a source, and only the bin that holds
the border is ordered.

Random numbers are hashes of the seed, the id and the text, so reruns agree.
Defined results: a null text has size 0, is taken 0 times and needs nothing;
null sources form the last source; null ids are ordinary; repeated rows have
equal ranks, and rows that tie at the border share its missing words evenly; an
empty table gives an empty table; other columns pass through
``mixed_documents`` unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidelog.llm.common import SPACE_CHARS, SPACES, cut, documents

MAX_REPEATS = 3
BINS = 4096
#: Exponent of the mean size over the size in the inclusion odds.
TILT = 0.5
SEED = 17


def n_words(text: Column) -> Column:
    trimmed = F.trim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, SPACES))).cast("long")


def targets(sizes: DataFrame, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, source_size, n_docs, weight, target) from (source, source_size, n_docs): one row a source."""
    ordered = W.orderBy(F.col("source").asc_nulls_last())
    every = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    weighed = sizes.withColumn("weight", ((F.row_number().over(ordered) - 1) % 3 + 1).cast("double"))
    # with sources sorted by cap / weight, a source is capped when the level that the rest would share exceeds its cap
    by_cap = W.orderBy((F.col("source_size") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = by_cap.rowsBetween(W.unboundedPreceding, -1)
    levels = (
        weighed.withColumn("_total", F.sum("source_size").over(every))
        .withColumn("_weights", F.sum("weight").over(every))
        .withColumn("_left", F.col("_total") - max_repeats * F.coalesce(F.sum("source_size").over(before), F.lit(0)))
        .withColumn("_rest", F.col("_weights") - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("_level", F.col("_left") / F.col("_rest"))
        .withColumn("_free", F.col("_level") * F.col("weight") < max_repeats * F.col("source_size"))
    )
    # the first free source sets the level for itself and all later ones
    level = F.min_by(F.when(F.col("_free"), F.col("_level")), F.when(F.col("_free"), F.col("source_size") / F.col("weight"))).over(every)
    capped = F.col("source_size").cast("double") * max_repeats
    return levels.withColumn("target", F.least(capped, F.coalesce(level * F.col("weight"), capped))).select("source", "source_size", "n_docs", "weight", "target")


def plan(docs: DataFrame, max_repeats: int = MAX_REPEATS, seed: int = SEED, bins: int = BINS) -> tuple[DataFrame, DataFrame]:
    """The measured documents (doc_id, source, size, h), and one row a source that says which of them the mix takes."""
    slim = cut(measured(docs, seed).select("doc_id", "source", "size", "h"))
    per = targets(slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs")), max_repeats)
    per = per.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-12)).otherwise(0).cast("long"))
    per = cut(per.withColumn("rest", F.round(F.col("target") - F.col("whole") * F.col("source_size")).cast("long")).withColumnRenamed("source", "_source"))
    ranked = _ranked(slim, per, bins).filter("size > 0 AND rest > 0")
    counted = ranked.groupBy("source", "bin").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"))
    upto = W.partitionBy("source").orderBy("bin").rowsBetween(W.unboundedPreceding, -1)
    border = (
        counted.withColumn("before", F.coalesce(F.sum("words").over(upto), F.lit(0)))
        .filter("before < rest AND before + words >= rest")
        .select(F.col("source").alias("_s"), F.col("bin").alias("_bin"), "before")
    )
    inside = ranked.join(border, ranked["source"].eqNullSafe(border["_s"]) & (ranked["bin"] == border["_bin"]))
    inside = inside.groupBy("source", "key", "rest", "before").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("tied"))
    earlier = W.partitionBy("source").orderBy("key").rowsBetween(W.unboundedPreceding, -1)
    at = (
        inside.withColumn("missing", F.col("rest") - F.col("before") - F.coalesce(F.sum("words").over(earlier), F.lit(0)))
        .filter("missing > 0 AND missing <= words")
        .select(F.col("source").alias("_s"), F.col("key").alias("border_key"), F.floor(F.col("missing") / F.col("tied")).cast("long").alias("border_words"))
    )
    return slim, cut(per.join(at, per["_source"].eqNullSafe(at["_s"]), "left").drop("_s"))


def measured(docs: DataFrame, seed: int) -> DataFrame:
    """The documents as ``_row`` with id, source, words and hash beside."""
    return docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("_row"),
        docs["doc_id"].alias("doc_id"),
        docs["source"].cast("string").alias("source"),
        n_words(docs["text"]).alias("size"),
        F.xxhash64(F.lit(seed), docs["doc_id"], docs["text"]).alias("h"),
    )


def _ranked(rows: DataFrame, per: DataFrame, bins: int = BINS) -> DataFrame:
    # one row a source: Spark broadcasts it below the session's threshold and splits a hot source's rows otherwise
    joined = rows.join(per, rows["source"].eqNullSafe(per["_source"]), "left").drop("_source")
    u = (F.shiftrightunsigned(F.col("h"), 11).cast("double") + 0.5) / float(1 << 53)
    share = F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), F.col("rest") / F.greatest(F.col("source_size"), F.lit(1))))
    odds = share / (1 - share) * F.pow(F.col("source_size") / F.col("n_docs") / F.greatest(F.col("size"), F.lit(1)), F.lit(TILT))
    keyed = joined.withColumn("key", F.when(F.col("size") > 0, (u / (1 - u)) / odds))
    return keyed.withColumn("bin", F.least(F.floor(F.col("key") / (1 + F.col("key")) * bins), F.lit(bins - 1)).cast("int"))


def _taken(rows: DataFrame, per: DataFrame) -> DataFrame:
    extra = F.when(F.col("key") < F.col("border_key"), F.col("size")).when(F.col("key") == F.col("border_key"), F.least("size", "border_words")).otherwise(0)
    return _ranked(rows, per).withColumn("taken", (F.col("whole") * F.col("size") + extra).cast("long"))


def mix(docs: DataFrame, max_repeats: int = MAX_REPEATS, seed: int = SEED) -> DataFrame:
    """One row a document: doc_id, source, size, source_size, target and taken words."""
    slim, per = plan(docs, max_repeats, seed)
    return _taken(slim, per).select("doc_id", "source", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, max_repeats: int = MAX_REPEATS, seed: int = SEED) -> DataFrame:
    """The mix itself: each document once for every copy, the border document's last copy cut after its share of words."""
    _, per = plan(docs, max_repeats, seed)
    due = _taken(measured(docs, seed), per).filter("taken > 0")
    copies = F.ceil(F.col("taken") / F.col("size")).cast("int")
    out = due.select("_row", F.explode(F.sequence(F.lit(1), copies)).alias("_copy"), F.pmod("taken", "size").cast("int").alias("_part"), copies.alias("_copies"))
    text = F.col("_row.text")
    part = F.array_join(F.slice(F.split(F.trim(text, F.lit(SPACE_CHARS)), SPACES), F.lit(1), F.greatest(F.col("_part"), F.lit(1))), " ")
    shown = F.when((F.col("_copy") == F.col("_copies")) & (F.col("_part") > 0), part).otherwise(text)
    return out.select(*[(shown if c == "text" else F.col("_row")[c]).alias(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")
