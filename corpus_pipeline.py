"""The corpus pipeline: quality rules, near-dedup, personal data, mixing, encoding.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is
written as Parquet and read again as the next one's ``docs``. Every stage works
on all rows that its predecessor kept. All but the last return the columns of
``documents``; where a stage changes a text, ``n_chars`` follows it.

Defined results: quality rules reject null and empty texts and those without
stop words of the languages listed there, so later stages see neither; given
them, near-dedup keeps each text without words, personal data leaves a null
null, mixing takes none of size 0, and encoding gives no ids. Null ids, sources
and languages pass through; different texts under one id, or none, stay apart.
Repeated rows are copies, of which one stays. Very long texts are judged,
redacted and encoded whole. Columns beside those of ``documents`` pass through
all stages but the last, whatever their names. An empty table gives empty ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import bpe, minhash, mixing
from tidelog.llm.common import cut, documents
from tidelog.llm.pii import PersonalData
from tidelog.llm.quality import QualityRules

#: Near-duplicates share five-word shingles at a similarity of 0.8 or more.
SHINGLE_WORDS = 5
SIMILARITY = 80


def _counted(before: DataFrame, after: DataFrame) -> DataFrame:
    """``after`` with ``n_chars`` as long as its text, where the table has that column."""
    if "n_chars" not in before.columns:
        return after
    kind = before.schema["n_chars"].dataType
    return after.select(*[F.when(F.col("text").isNull(), F.col(c)).otherwise(F.char_length("text").cast(kind)).alias(c) if c == "n_chars" else F.col(c) for c in before.columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break a rule go."""
    return QualityRules().filter(docs, docs["text"])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return minhash.keep_one(docs, SHINGLE_WORDS, SIMILARITY)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced by its kind in brackets."""
    return _counted(docs, PersonalData().redact(docs, "text"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated, or left out, so that sources meet their target weights."""
    return _counted(docs, mixing.mixed_documents(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and whether they decode to it."""
    coded = bpe.encode(docs.withColumn("_sha", F.sha2(F.coalesce("text", F.lit("")), 256)), "text", ["doc_id", "lang", "source", "_sha"])
    return coded.select(
        "_row.doc_id",
        "_row.lang",
        "_row.source",
        "ids",
        F.size("ids").cast("long").alias("n_tokens"),
        (F.sha2("decoded", 256) == F.col("_row._sha")).alias("decodes"),
    )


STAGES = [
    ("quality rules", quality_rules),
    ("minhash near-dedup", near_dedup),
    ("pii", personal_data),
    ("mixing sources", mix_sources),
    ("bpe encoding", encode),
]

#: Near-dedup, boosted trees, sampling and encoding have no form in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
