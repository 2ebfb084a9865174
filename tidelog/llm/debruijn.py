"""Substring dedup on words by De Bruijn compaction.

Token k-mers are the edges of a De Bruijn graph, held sparsely: of every window
of 50 words only the edge of least hash stands for it (``windows``), with the
words that all its windows touch as its label. Consecutive edges of a text
overlap by 49 words. Each repeated edge is joined to the next one of its text;
where an edge is always followed by the same one, and that one always comes
after it, the two lie on a repeated nonbranching path, and such paths compact
into one by pointer doubling over Spark joins (``paths``). An occurrence of a
path is one span at its source coordinates and goes as a whole where a smaller
document takes the same path; labels are 128-bit digests of the words. Where
paths branch or end, the branches meet with their words, taken from their source
coordinates, and each window is compared word for word, so that no hash decides
where a repeated span ends. A word goes if a window that covers it also starts in
a document with a smaller id.

Defined results: a null text has no words. A null id is larger than every other
and equal to another null. Rows with the same id never remove words from each
other. Repeated rows, ties and empty tables need nothing special; extra columns
are ignored. White space between words does not count and is one space in what
is kept.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.common import cut, documents, free
from tidelog.llm.windows import Windows, span_columns, window_bodies, without_repeats

SPAN = 50
EDGE = 8


def branches(how: Windows):
    """Which windows of each path also lie on a path that a smaller document is the first to take."""

    def resolve(rows: list[dict]) -> list[np.ndarray]:
        least: dict[tuple, int] = {}
        windows = []
        for row in rows:
            own = [(row["owner"], row["back"] - t, body) for t, body in enumerate(window_bodies(row, how))]
            windows.append(own)
            for w in own:
                least[w] = min(least.get(w, row["first"]), row["first"])
        return [np.array([least[w] < row["first"] for w in own], bool) for row, own in zip(rows, windows, strict=True)]

    return resolve


def paths(runs: DataFrame) -> DataFrame:
    """(tid, ctx, start, run) of the whole occurrences of compacted paths, named by their first edge, that a smaller document takes too.

    ``runs``: a row an occurrence of a repeated edge (tid, seq, ctx, own, first, start, run).
    """
    size = runs.count()
    following = runs.select("tid", (F.col("seq") - 1).alias("seq"), F.col("ctx").alias("next"))
    steps = cut(runs.select("tid", "seq", "ctx").join(following, ["tid", "seq"], "left").select("ctx", "next"))
    out = cut(steps.groupBy("ctx").agg(F.min("next").alias("lo"), F.max("next").alias("hi"), F.count("next").alias("c"), F.count(F.lit(1)).alias("n")))
    into = steps.filter("next IS NOT NULL").groupBy(F.col("next").alias("node")).agg(F.min("ctx").alias("prev"), F.max("ctx").alias("last"), F.count(F.lit(1)).alias("came"))
    only = out.filter("lo = hi AND c = n AND lo <> ctx").select(F.col("ctx").alias("prev"), F.col("lo").alias("node"))
    links = only.join(into.filter("prev = last").select("node", "prev", "came"), ["node", "prev"])
    links = links.join(out.select(F.col("ctx").alias("node"), "n"), "node").filter("came = n")
    at = cut(links.select("node", F.col("prev").alias("head"), F.lit(1).cast("bigint").alias("rank")), size)
    free(steps, out)
    # no path is a ring: the last edge of a text on it would have no next one
    while True:
        up = at.select(F.col("node").alias("head"), F.col("head").alias("up"), F.col("rank").alias("more"))
        hop = at.select("node", "head", "rank").join(up, "head", "left")
        hop = cut(hop.select("node", F.coalesce("up", "head").alias("head"), (F.col("rank") + F.coalesce("more", F.lit(0))).alias("rank"), F.col("up").isNotNull().alias("moved")), size)
        free(at)
        at = hop
        if not hop.filter("moved").take(1):
            break
    placed = runs.join(at.select(F.col("node").alias("ctx"), "head", "rank"), "ctx", "left").filter("own > first")
    head, begin = F.coalesce("head", "ctx").alias("ctx"), (F.col("seq") - F.coalesce("rank", F.lit(0))).alias("_begin")
    return placed.groupBy("tid", head, begin).agg(F.min("start").alias("start"), F.sum("run").alias("run")).drop("_begin")


def remove_repeats(docs: DataFrame, span: int = SPAN, edge: int = EDGE) -> DataFrame:
    """doc_id, n (words), spans (flat starts and ends of removed runs of words), sha (of the kept words)."""
    how = Windows("words", span, edge, earlier=True)
    return without_repeats(docs, how, branches(how), paths)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    removed, _ = span_columns()
    return remove_repeats(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", F.col("n").alias("n_words"), removed.alias("n_removed"), F.col("sha").alias("kept_sha256"))


ORACLE_SQL = """
WITH t AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), g AS (
  SELECT doc_id, unnest(range(0, len(w) - 49)) AS pos, unnest(list_transform(range(1, len(w) - 48), lambda i: md5(array_to_string(w[i:i + 49], ' ')))) AS g FROM t WHERE len(w) >= 50
), f AS (
  SELECT doc_id, pos, min(doc_id) OVER (PARTITION BY g) < doc_id AS again FROM g
), r AS (
  SELECT doc_id, unnest(range(pos, pos + 50)) AS p FROM f WHERE again
), gone AS (
  SELECT doc_id, p FROM r GROUP BY ALL
), words AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(0, len(w))) AS p FROM t
), kept AS (
  SELECT words.doc_id, string_agg(word, ' ' ORDER BY words.p) FILTER (gone.p IS NULL) AS left_over, count(gone.p)::BIGINT AS n_removed
  FROM words LEFT JOIN gone ON gone.doc_id = words.doc_id AND gone.p = words.p GROUP BY words.doc_id
)
SELECT t.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(left_over, '')) AS kept_sha256
FROM t LEFT JOIN kept ON kept.doc_id = t.doc_id
"""
