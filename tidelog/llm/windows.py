"""Repeated windows of fixed length across a corpus, exactly and without all pairs.

Both substring operators ask which windows of ``length`` consecutive units
(bytes or words) also start elsewhere. Documents of equal text are one text with
the least of their ids and a count. Every window is owned by one k-mer of its
own content, the one with the least hash (the leftmost of equals), so equal
windows are owned by equal k-mers at equal distance. Consecutive windows with
the same owner form a run, and all units that a run's windows touch are its
context, named by a 128-bit digest of its bytes and of the owner's place. Only
about two k-mers in ``length - k`` own anything, so a text becomes a few rows:

* owners that occur once are dropped, by a bitmap before anything is shuffled;
* occurrences with the same context repeat as a whole, window by window;
* owners with several contexts meet with the contexts' text, one of each, and
  are told apart window by window (the operators' ``resolve``).

An owner with more contexts than ``LOCAL`` is not gathered: its windows are
hashed and counted by Spark, with partial aggregation, instead. Texts without
repeats are finished where they are read and are not shuffled either.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import cut, free, map_arrow, maybe_in, prefix_hashes, range_hashes, sliding_minimum, word_bounds

#: contexts of one owner that are resolved in one task; 600 bytes each or so
LOCAL = 4000
_ROWS = 256


@dataclass(frozen=True)
class Windows:
    """``unit`` is "bytes" or "words"; ``earlier``: a window counts only if it also starts in a document with a smaller id."""

    unit: str
    length: int
    k: int
    earlier: bool


class Units:
    """A text as bytes, or as words joined by single spaces."""

    def __init__(self, text: str | None, how: Windows):
        raw = (text or "").encode()
        self.how = how
        if how.unit == "words":
            self.raw = b" ".join(raw.split())
            self.starts, self.ends = word_bounds(np.frombuffer(self.raw, np.uint8))
            self.n = len(self.starts)
        else:
            self.raw, self.n = raw, len(raw)

    def slice(self, start: int, end: int) -> bytes:
        if self.how.unit == "bytes":
            return self.raw[start:end]
        return self.raw[self.starts[start] : self.ends[end - 1]] if end > start else b""

    def owners(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Owning k-mers: hash, position, first window and number of windows of each run."""
        length, k = self.how.length, self.how.k
        if self.n < length:
            none = np.zeros(0, np.int64)
            return none, none, none, none
        data = np.frombuffer(self.raw, np.uint8)
        prefix = prefix_hashes(data)
        if self.how.unit == "words":
            prefix = prefix_hashes(range_hashes(prefix, self.starts, self.ends))
        at = np.arange(self.n - k + 1)
        hashes = range_hashes(prefix, at, at + k)
        ranked = (hashes & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)
        owner = (sliding_minimum(ranked, length - k + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.diff(owner, prepend=-1))
        return hashes[owner[first]].view(np.int64), owner[first], first, np.diff(first, append=len(owner))

    def removed(self, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Maximal runs [start, end) of units that windows starting in [start, start + count) cover."""
        if not len(starts):
            return np.zeros((0, 2), np.int64)
        order = np.argsort(starts, kind="stable")
        s, e = starts[order], np.maximum.accumulate((starts + counts - 1 + self.how.length)[order])
        new = np.concatenate([[True], s[1:] > e[:-1]])
        return np.stack([s[new], e[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(s) - 1]])]], 1)

    def kept(self, removed: np.ndarray) -> bytes:
        edges = [0, *removed.ravel().tolist(), self.n]
        parts = [self.slice(a, b) for a, b in zip(edges[::2], edges[1::2], strict=True) if b > a]
        return (b" " if self.how.unit == "words" else b"").join(parts)


def _rows(docs: DataFrame) -> DataFrame:
    """tid (names the text), h (a hash of that), own (the id, null last), doc_id and text."""
    named = docs.select(F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("tid"), F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("own"), "doc_id", "text")
    return named.select("tid", F.xxhash64("tid").alias("h"), "own", "doc_id", "text")


def distinct_texts(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One row a text (tid, h, own, text) with the least of its ids; and (tid, least, copies) of texts that several rows hold.

    Only rows whose text may be repeated are shuffled.
    """
    several = rows.groupBy("tid").agg(F.min("own").alias("least"), F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    several = cut(several)
    hashes = several.select(F.xxhash64("tid").alias("h"))
    slim = rows.select("tid", "h", "own", "text")
    met = maybe_in(slim, "h", hashes).join(several, "tid", "left").filter("least IS NULL OR own = least")
    one = met.select("tid", "h", "own", "text").dropDuplicates(["tid"])
    return maybe_in(slim, "h", hashes, others=True).unionByName(one), several


def owned_runs(rows: DataFrame, how: Windows) -> DataFrame:
    """One row a run: tid, own, seq (its place in the text), owner (hash), ctx (digest of its context and of the owner's place in it), at, back, run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, _ROWS):
                batch = whole.slice(start, _ROWS)
                parts, sizes, contexts = [], [], []
                for text in batch.column(2).to_pylist():
                    units = Units(text, how)
                    hashes, at, first, many = units.owners()
                    sizes.append(len(at))
                    parts.append((hashes, at, at - first, many))
                    for f, m, b in zip(first.tolist(), many.tolist(), (at - first).tolist(), strict=True):
                        digest = hashlib.blake2b(units.slice(f, f + m - 1 + how.length), digest_size=16, salt=b.to_bytes(8, "little"))
                        contexts.append(digest.digest())
                repeat = np.repeat(np.arange(batch.num_rows), sizes)
                cols = [np.concatenate([p[j] for p in parts]) if parts else np.zeros(0, np.int64) for j in range(4)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(repeat)),
                        batch.column(1).take(pa.array(repeat)),
                        pa.array(np.concatenate([np.arange(n) for n in sizes]).astype(np.int32) if sizes else np.zeros(0, np.int32)),
                        pa.array(cols[0], pa.int64()),
                        pa.array(contexts, pa.binary()),
                        *[pa.array(c.astype(np.int32)) for c in cols[1:]],
                    ],
                    ["tid", "own", "seq", "owner", "ctx", "at", "back", "run"],
                )

    return map_arrow(rows.select("tid", "own", "text"), run, "tid binary, own bigint, seq int, owner bigint, ctx binary, at int, back int, run int")


_CONTEXT = "array<struct<owner:bigint,ctx:binary,back:int,run:int,first:bigint,many:bigint,body:binary>>"


_RUN = "array<struct<owner:bigint,ctx:binary,start:int,run:int,back:int,first:bigint,many:bigint,full:boolean,open:boolean,shows:boolean>>"


def _first_pass(listed: DataFrame, how: Windows) -> DataFrame:
    """Finishes texts whose runs are all decided; the others go on with their text, and show the contexts that they stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, _ROWS):
                out: dict[str, list] = {k: [] for k in ("tid", "n", "spans", "sha", "text", "sure", "contexts")}
                for row in whole.slice(start, _ROWS).to_pylist():
                    units = Units(row["text"], how)
                    runs = row["runs"] or []
                    sure = [(r["start"], r["run"]) for r in runs if r["full"]]
                    waits = any(r["open"] for r in runs)
                    removed = units.removed(*(np.array(x, np.int64) for x in zip(*sure, strict=True))) if sure else np.zeros((0, 2), np.int64)
                    shown = [
                        {"owner": r["owner"], "ctx": r["ctx"], "back": r["back"], "run": r["run"], "first": r["first"], "many": r["many"]}
                        | {"body": units.slice(r["start"], r["start"] + r["run"] - 1 + how.length)}
                        for r in runs
                        if r["shows"]
                    ]
                    out["tid"].append(row["tid"])
                    out["n"].append(units.n)
                    out["spans"].append(None if waits else removed.ravel().tolist())
                    out["sha"].append(None if waits else hashlib.sha256(units.kept(removed)).hexdigest())
                    out["text"].append(row["text"] if waits else None)
                    out["sure"].append([x for s in sure for x in s] if waits else None)
                    out["contexts"].append(shown)
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in schema], schema=schema)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    ddl = f"tid binary, n bigint, spans array<bigint>, sha string, text string, sure array<bigint>, contexts {_CONTEXT}"
    schema = to_arrow_schema(_parse_datatype_string(ddl))
    return map_arrow(listed.select("tid", "text", "runs"), run, ddl)


def _second_pass(waiting: DataFrame, how: Windows) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, _ROWS):
                batch = whole.slice(start, _ROWS)
                counts, spans, shas = [], [], []
                for text, sure, more in zip(*(batch.column(j).to_pylist() for j in (2, 3, 4)), strict=True):
                    units = Units(text, how)
                    known = [*zip(sure[::2], sure[1::2], strict=True), *((m["s"], m["c"]) for m in more or [])]
                    removed = units.removed(*(np.array(x, np.int64) for x in zip(*known, strict=True))) if known else np.zeros((0, 2), np.int64)
                    counts.append(units.n)
                    spans.append(removed.ravel().tolist())
                    shas.append(hashlib.sha256(units.kept(removed)).hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array(shas, pa.string())], ["tid", "n", "spans", "sha"])

    return map_arrow(waiting.select("tid", "n", "text", "sure", "more"), run, "tid binary, n bigint, spans array<bigint>, sha string")


_MORE = "array<struct<s:bigint,c:bigint>>"
_RESOLVED = "owner bigint, ctx binary, start int, count int"


def _locally(contexts: DataFrame, resolve: Callable[[list[dict]], list[np.ndarray]]) -> DataFrame:
    """Whole groups of contexts with one owner, in chunks, through ``resolve``: flags of each context's windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def flush(rows: list[dict]) -> pa.RecordBatch:
            cols: list[list] = [[], [], [], []]
            for row, flags in zip(rows, resolve(rows), strict=True):
                edges = np.flatnonzero(np.diff(flags.astype(np.int8), prepend=np.int8(0), append=np.int8(0)))
                for s, e in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
                    for c, v in zip(cols, (row["owner"], row["ctx"], s, e - s), strict=True):
                        c.append(v)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.binary(), pa.int32(), pa.int32()), strict=True)], ["owner", "ctx", "start", "count"])

        for batch in batches:
            for row in batch.to_pylist():
                if held and row["owner"] == held[-1]["owner"] and row["ctx"] == held[-1]["ctx"]:
                    continue
                if len(held) >= LOCAL and row["owner"] != held[-1]["owner"]:
                    yield flush(held)
                    held = []
                held.append(row)
        if held:
            yield flush(held)

    return map_arrow(contexts.repartition("owner").sortWithinPartitions("owner", "ctx"), run, _RESOLVED)


def _by_counting(contexts: DataFrame, how: Windows) -> DataFrame:
    """The same for owners of very many contexts: a row a window, counted by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                bodies = [b for b in window_bodies(row, how)]
                named = [hashlib.blake2b(b, digest_size=16, salt=(row["back"] - t).to_bytes(8, "little", signed=True)).digest() for t, b in enumerate(bodies)]
                n = len(named)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["owner"]] * n, pa.int64()), pa.array([row["ctx"]] * n, pa.binary()), pa.array(range(n), pa.int32()), pa.array([row["first"]] * n, pa.int64()), pa.array(named, pa.binary())],
                    ["owner", "ctx", "start", "first", "name"],
                )

    each = map_arrow(contexts, run, "owner bigint, ctx binary, start int, first bigint, name binary").distinct()
    counted = each.groupBy("owner", "name").agg(F.count(F.lit(1)).alias("n"), F.min("first").alias("least"))
    again = F.col("least") < F.col("first") if how.earlier else F.col("n") > 1
    return each.join(counted, ["owner", "name"]).filter(again).select("owner", "ctx", "start", F.lit(1).alias("count"))


def window_bodies(row: dict, how: Windows) -> Iterator[bytes]:
    body = row["body"]
    if how.unit == "bytes":
        for t in range(row["run"]):
            yield body[t : t + how.length]
    else:
        starts, ends = word_bounds(np.frombuffer(body, np.uint8))
        for s, e in zip(starts[: row["run"]].tolist(), ends[how.length - 1 :].tolist(), strict=True):
            yield body[s:e]


def without_repeats(docs: DataFrame, how: Windows, resolve: Callable[[list[dict]], list[np.ndarray]], compact: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """doc_id, n (units), spans (flat starts and ends of the removed runs of units), sha (SHA-256 of what is kept).

    ``compact`` may join the runs that repeat as a whole into longer ones, given (tid, seq, ctx, own, first, start, run).
    """
    rows = _rows(docs)
    texts, several_rows = distinct_texts(rows)
    runs = cut(owned_runs(texts, how))
    again = F.min("own") < F.max("own") if how.earlier else F.count(F.lit(1)) > 1
    several = cut(runs.groupBy("owner").agg(again.alias("again")).filter("again").select("owner"))
    repeated = cut(maybe_in(runs, "owner", several).join(several, "owner", "left_semi"))
    free(runs)
    kinds = repeated.groupBy("owner", "ctx").agg(F.count(F.lit(1)).alias("n"), F.min("own").alias("first"), F.min(F.struct("tid", "at")).alias("rep"))
    kinds = cut(kinds)
    many = cut(kinds.groupBy("owner").agg(F.count(F.lit(1)).alias("many")).filter("many > 1"))
    kinds = cut(kinds.join(many, "owner", "left").withColumn("many", F.coalesce("many", F.lit(1))))
    told = repeated.join(kinds, ["owner", "ctx"])
    full: Column = F.col("own") > F.col("first") if how.earlier else F.col("n") > 1
    told = told.select(
        "tid", "own", "seq", "owner", "ctx", (F.col("at") - F.col("back")).alias("start"), "run", "back", "first", "many",
        full.alias("full"), (~full & (F.col("many") > 1)).alias("open"),
        ((F.col("many") > 1) & (F.col("rep.tid") == F.col("tid")) & (F.col("rep.at") == F.col("at"))).alias("shows"),
    )
    told = cut(told)
    kept = ["owner", "ctx", "start", "run", "back", "first", "many", "full", "open", "shows"]
    whole = told.select("tid", *kept).filter("full OR open OR shows")
    if compact:
        paths = compact(told.select("tid", "seq", "ctx", "own", "first", "start", "run"))
        alone = {"owner": F.lit(0), "ctx": F.lit(None), "back": F.lit(0), "first": F.lit(0), "many": F.lit(1), "full": F.lit(True), "open": F.lit(False), "shows": F.lit(False)}
        fields = {f.name: f.dataType for f in whole.schema}
        paths = paths.select("tid", *[alone.get(c, F.col(c)).cast(fields[c]).alias(c) for c in kept])
        whole = whole.filter("open OR shows").withColumn("full", F.lit(False)).unionByName(paths)
    listed = cut(whole.groupBy("tid").agg(F.collect_list(F.struct(*kept)).cast(_RUN).alias("runs")))
    hashes = listed.select(F.xxhash64("tid").alias("h"))
    done = _second_pass(maybe_in(texts, "h", hashes, others=True).select("tid", F.lit(0).cast("bigint").alias("n"), "text", F.array().cast("array<bigint>").alias("sure"), F.lit(None).cast(_MORE).alias("more")), how)
    first = cut(_first_pass(maybe_in(texts, "h", hashes).join(listed, "tid", "left"), how))
    contexts = first.filter(F.size("contexts") > 0).select(F.inline("contexts"))
    found = _locally(contexts.filter(F.col("many") <= LOCAL), resolve).unionByName(_by_counting(contexts.filter(F.col("many") > LOCAL), how))
    opened = told.filter("open").select("tid", "owner", "ctx", "start")
    found = found.withColumnRenamed("start", "from")
    more = opened.join(found, ["owner", "ctx"]).groupBy("tid").agg(F.collect_set(F.struct((F.col("from") + F.col("start")).cast("long").alias("s"), F.col("count").cast("long").alias("c"))).alias("more"))
    waiting = first.filter("spans IS NULL").select("tid", "n", "text", "sure").join(more, "tid", "left")
    every = done.unionByName(first.filter("spans IS NOT NULL").select("tid", "n", "spans", "sha")).unionByName(_second_pass(waiting, how))
    by_text = cut(every.join(several_rows, "tid", "left"))
    # copies: all but the least ids are repeats of the least one; where ids don't matter, all are
    met = rows.select("tid", "own", "doc_id").join(by_text, "tid")
    gone = (F.col("n") >= how.length) & F.coalesce(F.col("own") > F.col("least") if how.earlier else F.col("copies") > 1, F.lit(False))
    empty = hashlib.sha256(b"").hexdigest()
    return met.select("doc_id", "n", F.when(gone, F.array(F.lit(0).cast("bigint"), F.col("n"))).otherwise(F.col("spans")).alias("spans"), F.when(gone, F.lit(empty)).otherwise(F.col("sha")).alias("sha"))


def span_columns() -> tuple[Column, Column]:
    """Removed units and removed runs, from the flat spans."""
    at = F.aggregate(F.transform("spans", lambda x, i: F.when(i % 2 == 1, x).otherwise(-x)), F.lit(0).cast("long"), lambda a, x: a + x)
    return at, (F.size("spans") / 2).cast("long")


__all__ = ["Windows", "span_columns", "window_bodies", "without_repeats"]
