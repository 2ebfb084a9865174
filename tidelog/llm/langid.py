"""Language identification by prediction by partial matching (PPM).

Each language has a context tree over bytes of variable order up to 3. A node's
symbols share ``count / (total + distinct)``; the rest is the escape to the node
one byte shorter, renormalised over the symbols that the longer node has not
seen. The code length of a text under a language is exact for these frozen
statistics: minus the sum of the binary logarithms over its bytes. The language
of the shortest code wins, ties going to the first name; the score is its share
of the languages' probabilities.

Statistics are learned from at most ``TRAIN_DOCS`` labelled documents a
language (the bound of the model; chosen by a hash of id and text, whole texts)
and frozen into one table: context to node, node and symbol to bits in every
language. The ``SYMBOLS`` most frequent bytes have symbols of their own, others
share an escape coded uniformly. Contexts seen once are left to their parents.

Defined results: a null text or one without a letter is ``und`` with score 0; so
is everything where no labelled document can be learned from. Null ids are not
held out. Repeated rows get equal results; an empty table gives an empty table;
extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidelog.llm.common import cut, documents, free, map_arrow

ORDER = 3
TRAIN_DOCS = 1500
SYMBOLS = 127
LEAST_COUNT = 2
#: hashes fall into 2 ** BIN_BITS groups of as many bins, by whose counts the documents to learn from are found
BIN_BITS = 9
_ROWS = 256


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _last_bin(counts: DataFrame, most: int) -> DataFrame:
    """(lang, _upto): the bin in which a language's first ``most`` rows end, by groups of bins and then within one."""
    before = lambda order: F.coalesce(F.sum("_n").over(W.partitionBy("lang").orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    grouped = counts.withColumn("_group", F.shiftright("_bin", BIN_BITS))
    groups = grouped.groupBy("lang", "_group").agg(F.sum("_n").alias("_n")).withColumn("_before", before("_group"))
    last = cut(groups.filter(F.col("_before") < most).groupBy("lang").agg(F.max(F.struct("_group", "_before")).alias("_last")).select("lang", "_last.*"))
    inside = grouped.join(last, ["lang", "_group"]).withColumn("_at", F.col("_before") + before("_bin"))
    return inside.filter(F.col("_at") < most).groupBy("lang").agg(F.max("_bin").alias("_upto"))


def training_sample(docs: DataFrame, per_language: int = TRAIN_DOCS) -> DataFrame:
    """(lang, text) of at most ``per_language`` labelled documents that are not held out."""
    able = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out("doc_id"))
    named = able.select("lang", F.xxhash64("doc_id", "text").alias("h")).withColumn("_bin", F.shiftright("h", 64 - 2 * BIN_BITS))
    # counts of bins of hashes tell which bins hold the first ones, so only those rows are ordered
    counts = cut(named.groupBy("lang", "_bin").agg(F.count(F.lit(1)).alias("_n")))
    upto = cut(_last_bin(counts, per_language))
    free(counts)
    first = named.join(upto, "lang").filter("_bin <= _upto")
    first = first.withColumn("_at", F.row_number().over(W.partitionBy("lang").orderBy("h"))).filter(F.col("_at") <= per_language)
    chosen = cut(first.select(F.col("lang").alias("_lang"), F.col("h").alias("_h")).distinct())
    keyed = able.select("lang", "text", F.xxhash64("doc_id", "text").alias("h"))
    return keyed.join(chosen, (keyed["lang"] == chosen["_lang"]) & (keyed["h"] == chosen["_h"]), "left_semi").select("lang", "text")


def gram_counts(sample: DataFrame) -> DataFrame:
    """(lang, gram, n): counts of byte strings of length ``ORDER`` + 1, as big-endian integers; texts start after zero bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by: dict[str, list[bytes]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by.setdefault(lang, []).append(text.encode())
            for lang, texts in by.items():
                codes = []
                for t in texts:
                    data = np.frombuffer(bytes(ORDER) + t, np.uint8).astype(np.uint32)
                    codes.append(data[:-3] << np.uint32(24) | data[1:-2] << np.uint32(16) | data[2:-1] << np.uint32(8) | data[3:])
                gram, n = np.unique(np.concatenate(codes), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram)), pa.array(gram.astype(np.int64)), pa.array(n)], ["lang", "gram", "n"])

    return map_arrow(sample, run, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class ContextTrees:
    """The frozen model: ``symbol`` of a byte, ``node`` of three symbols, ``bits`` of (node, symbol) in each language."""

    def __init__(self, langs: list[str], lang: np.ndarray, gram: np.ndarray, n: np.ndarray):
        self.langs = langs
        last = gram & 255
        seen = np.bincount(last, weights=n, minlength=256)
        frequent = np.argsort(-seen, kind="stable")[:SYMBOLS]
        frequent = np.sort(frequent[seen[frequent] > 0])
        self.symbol = np.zeros(256, np.int32)
        self.symbol[frequent] = np.arange(1, len(frequent) + 1)
        self.size = size = len(frequent) + 1
        rest = 256 - len(frequent)
        symbols = np.stack([self.symbol[(gram >> s) & 255] for s in (24, 16, 8, 0)], 1).astype(np.int64)
        uniform = np.full(size, 1 / 256)
        uniform[0] = rest / 256
        self.node = np.zeros(size**ORDER, np.int32)
        tables: list[np.ndarray] = []
        parents = where = np.zeros(1, np.int64)  # the table's row of each context of the order below
        for order in range(ORDER + 1):
            context = np.zeros(len(gram), np.int64)
            for j in range(ORDER - order, ORDER):
                context = context * size + symbols[:, j]
            total = np.bincount(context, weights=n, minlength=size**order)
            held = np.flatnonzero(total >= (LEAST_COUNT if order else 0))
            row = np.full(size**order, -1, np.int64)
            row[held] = np.arange(len(held))
            counts = np.zeros((len(held), size, len(langs)), np.float32)
            known = row[context] >= 0
            np.add.at(counts, (row[context[known]], symbols[known, ORDER], lang[known]), n[known])
            if order == 0:
                below = np.broadcast_to(uniform[None, :, None], counts.shape)
            else:
                below = tables[-1][parents[held % (size ** (order - 1))]]
            sums, distinct = counts.sum(1, keepdims=True), (counts > 0).sum(1, keepdims=True)
            unseen = (below * (counts == 0)).sum(1, keepdims=True)
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(sums > 0, distinct / (sums + distinct), 1.0)
                p = np.where(counts > 0, counts / (sums + distinct), escape * below / np.maximum(unseen, 1e-12))
            tables.append(np.where(sums > 0, p / p.sum(1, keepdims=True), below).astype(np.float32))
            # contexts that this order does not hold keep their parent's row, counted over all orders
            offset = sum(len(t) for t in tables[:-1])
            if order:
                where = np.where(row >= 0, row + offset, np.tile(where, size))
            parents, tables = where, [np.concatenate(tables)]
        bits = -np.log2(np.maximum(tables[0], 1e-12))
        bits[:, 0, :] += np.log2(rest) if rest > 1 else 0
        self.bits = bits.reshape(-1, len(langs)).astype(np.float32)
        self.node = where.astype(np.int32)

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each text in each language."""
        out = np.zeros((len(texts), len(self.langs)))
        full = [k for k, t in enumerate(texts) if t]
        if not full:
            return out
        joined = self.symbol[np.frombuffer(b"".join(bytes(ORDER) + texts[k] for k in full), np.uint8)].astype(np.int64)
        context = (joined[:-3] * self.size + joined[1:-2]) * self.size + joined[2:-1]
        at = self.node[context].astype(np.int64) * self.size + joined[3:]
        ends = np.cumsum([len(texts[k]) + ORDER for k in full])
        starts = np.concatenate([[0], ends[:-1]])
        for k, s, e in zip(full, starts.tolist(), ends.tolist(), strict=True):
            out[k] = self.bits[at[s : e - ORDER]].sum(0, dtype=np.float64)
        return out


def train(docs: DataFrame, per_language: int = TRAIN_DOCS) -> ContextTrees | None:
    rows = gram_counts(training_sample(docs, per_language)).toPandas()
    if not len(rows):
        return None
    langs = sorted(rows["lang"].unique())
    return ContextTrees(langs, rows["lang"].map({x: k for k, x in enumerate(langs)}).to_numpy(), rows["gram"].to_numpy(), rows["n"].to_numpy())


def identify(docs: DataFrame, model: ContextTrees | None) -> DataFrame:
    """doc_id, lang_pred, score and bits_per_byte (of the winner) for every text."""
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, _ROWS):
                batch = whole.slice(at, _ROWS)
                able = [bool(x) and trees is not None for x in batch.column(1).to_pylist()]
                texts = [t.encode() if t and a else b"" for t, a in zip(batch.column(2).to_pylist(), able, strict=True)]
                pred, score, rate = ["und"] * len(texts), [0.0] * len(texts), [None] * len(texts)
                if any(able):
                    bits = trees.code_lengths(texts)
                    best = bits.argmin(1)
                    share = 1 / np.exp2(-np.minimum(bits - bits.min(1, keepdims=True), 1000)).sum(1)
                    for k, a in enumerate(able):
                        if a:
                            pred[k], score[k], rate[k] = trees.langs[best[k]], float(share[k]), float(bits[k, best[k]] / len(texts[k]))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(rate, pa.float64())], ["doc_id", "lang_pred", "score", "bits_per_byte"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    slim = docs.select("doc_id", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("able"), "text")
    return map_arrow(slim, run, f"doc_id {kind}, lang_pred string, score double, bits_per_byte double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = identify(docs.select("doc_id", "text"), train(docs.select("doc_id", "text", "lang")))
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score", "bits_per_byte")
