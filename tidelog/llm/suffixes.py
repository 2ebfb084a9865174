"""Substring dedup on bytes by a hash-compared suffix sort.

The corpus's suffixes are sampled: of every 400-byte window, the k-mer of least
hash stands for it (``windows``). Equal suffixes with equal text before them, told
by 128-bit digests of their bytes, are one entry of the sort with a count; a
count above one makes its windows repeats. Different suffixes that begin with
the same k-mer are sorted by a mergesort whose comparisons find the common
extension of two suffixes by binary search over prefix polynomial hashes, a
number of steps logarithmic in the length. The text before the k-mer is sorted
likewise, backwards. Common extensions of neighbours in both orders are
verified against the bytes; a hash collision is answered by comparing bytes.
Depth by depth the two orders then show which windows are equal: those whose
left and right parts fall into the same class of both.

Defined results: a null text is empty. Repeated rows are repeats of each other.
Null ids, ties and empty tables need nothing special; extra columns are ignored.
"""

from __future__ import annotations

from functools import cmp_to_key

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.common import _tables, documents, prefix_hashes
from tidelog.llm.windows import Windows, span_columns, without_repeats

LENGTH = 400
KMER = 32
_MASK = (1 << 64) - 1


def sort_suffixes(strings: list[bytes], groups: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The order of the strings by group and bytes, and each one's common extension with the one before it (0 across groups)."""
    data = np.frombuffer(b"".join(strings), np.uint8)
    starts = np.cumsum([0, *map(len, strings)])
    prefix = memoryview(prefix_hashes(data))
    powers = memoryview(_tables(len(data))[0])
    at, size = starts[:-1].tolist(), [len(s) for s in strings]

    def extension(i: int, j: int) -> int:
        x, y = at[i], at[j]
        if x > y:
            x, y = y, x
        shift, hx, hy = powers[y - x], prefix[x], prefix[y]
        low, high = 0, min(size[i], size[j])
        while low < high:
            mid = (low + high + 1) >> 1
            # hashes of ranges differ by the power of their distance
            if ((prefix[x + mid] - hx) * shift - (prefix[y + mid] - hy)) & _MASK:
                high = mid - 1
            else:
                low = mid
        return low

    def compare(i: int, j: int) -> int:
        if groups[i] != groups[j]:
            return -1 if groups[i] < groups[j] else 1
        n = extension(i, j)
        a, b = strings[i][n : n + 1], strings[j][n : n + 1]
        return (a > b) - (a < b)

    order = sorted(range(len(strings)), key=cmp_to_key(compare))
    shared = [0] * len(order)
    for k in range(1, len(order)):
        i, j = order[k - 1], order[k]
        if groups[i] == groups[j]:
            n = extension(i, j)
            if strings[i][:n] != strings[j][:n] or strings[i][n : n + 1] > strings[j][n : n + 1]:
                break
            shared[k] = n
    else:
        return np.array(order), np.array(shared)
    # a collision: bytes decide
    order = sorted(range(len(strings)), key=lambda i: (groups[i], strings[i]))
    for k in range(1, len(order)):
        i, j = order[k - 1], order[k]
        n, most = 0, min(size[i], size[j]) if groups[i] == groups[j] else 0
        while n < most and strings[i][n] == strings[j][n]:
            n += 1
        shared[k] = n
    return np.array(order), np.array(shared)


def common_windows(length: int):
    """Which windows of each context also lie in another context of the same owner."""

    def resolve(rows: list[dict]) -> list[np.ndarray]:
        groups = [r["owner"] for r in rows]
        back, run = np.array([r["back"] for r in rows]), np.array([r["run"] for r in rows])
        right, right_shared = sort_suffixes([r["body"][r["back"] :] for r in rows], groups)
        left, left_shared = sort_suffixes([r["body"][: r["back"]][::-1] for r in rows], groups)
        flags = [np.zeros(n, bool) for n in run.tolist()]
        new_right, new_left = np.ones(len(rows), bool), np.ones(len(rows), bool)
        owner = np.array(groups)
        new_right[1:], new_left[1:] = owner[right][1:] != owner[right][:-1], owner[left][1:] != owner[left][:-1]
        of_right, of_left = np.empty(len(rows), np.int64), np.empty(len(rows), np.int64)
        for depth in range(int((back - run + 1).min()), int(back.max()) + 1):
            active = np.flatnonzero((depth <= back) & (depth > back - run))
            if len(active) < 2:
                continue
            of_right[right] = np.cumsum(new_right | (right_shared < length - depth))
            of_left[left] = np.cumsum(new_left | (left_shared < depth))
            key = of_right[active] * (len(rows) + 1) + of_left[active]
            _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
            for i in active[counts[inverse] > 1].tolist():
                flags[i][back[i] - depth] = True
        return flags

    return resolve


def remove_repeats(docs: DataFrame, length: int = LENGTH, kmer: int = KMER) -> DataFrame:
    """doc_id, n (bytes), spans (flat starts and ends of removed runs of bytes), sha (of the kept bytes)."""
    return without_repeats(docs, Windows("bytes", length, kmer, earlier=False), common_windows(length))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    removed, runs = span_columns()
    found = remove_repeats(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", F.col("n").alias("n_bytes"), removed.alias("n_removed"), runs.alias("n_spans"), F.col("sha").alias("kept_sha256"))


ORACLE_SQL = """
WITH t AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents
), c AS (
  SELECT doc_id, unnest(range(0, length(x) // 2 - 399, 512)) AS base, unnest(list_transform(range(0, length(x) // 2 - 399, 512), lambda b: x[2 * b + 1:2 * b + 1822])) AS c FROM t
), g AS (
  SELECT doc_id, base + i AS pos, md5(c[2 * i + 1:2 * i + 800]) AS g FROM (SELECT doc_id, base, c, unnest(range(0, least(512, length(c) // 2 - 399))) AS i FROM c)
), f AS (
  SELECT doc_id, pos, count(*) OVER (PARTITION BY g) > 1 AS again FROM g
), s AS (
  SELECT doc_id, pos, coalesce(pos - lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) > 400, true) AS fresh FROM f WHERE again
), n AS (
  SELECT *, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run FROM s
), spans AS (
  SELECT doc_id, run, min(pos) AS a, max(pos) + 400 AS b FROM n GROUP BY doc_id, run
), per AS (
  SELECT doc_id, count(*)::BIGINT AS n_spans, sum(b - a)::BIGINT AS n_removed, max(b) AS tail, list({'a': a, 'b': b} ORDER BY a) AS l FROM spans GROUP BY doc_id
)
SELECT t.doc_id, (length(x) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(CASE WHEN l IS NULL THEN x ELSE array_to_string(list_transform(range(1, len(l) + 1),
    lambda k: x[2 * (CASE WHEN k = 1 THEN 0 ELSE l[k - 1].b END) + 1:2 * l[k].a]), '') || x[2 * tail + 1:] END)) AS kept_sha256
FROM t LEFT JOIN per ON per.doc_id = t.doc_id
"""
