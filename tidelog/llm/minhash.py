"""MinHash near-duplicates by bottom-k sketches from one hash function.

1. Every document becomes the set of its distinct word shingles, as 64-bit
   hashes; the ``k`` smallest are its sketch. Documents with equal sets form a
   class and go on as one.
2. Inverted lists of retained values generate overlaps. A list holds the sketches
   that retain the same ``RUN`` values one after the other in hash order; texts
   that share passages only seldom do, linked ones do many times. A pair at the
   threshold has no such run in common about once in 10**10 times, and only one
   about twice in 10**9. Sketches that hold whole sets make lists of single values besides,
   the rarest ones that by the similarity one of must be shared: exactly.
3. Lists emit stars, not pairs: every member meets the list's most popular one.
   The union sketch (the ``k`` smallest of two sketches together) estimates the
   similarity and filters pairs, 6.5 deviations below the threshold; full sets
   from the texts confirm. Links make components by contraction (``components``).
4. What is left are lists whose members, without their hub, are still of several
   components and near enough in size. Only those members go on, with their full
   sets: shingles rank by how many of these sets hold them, and a set that can be
   linked to a partner of some size shares one of its rarest shingles, up to a
   rank that follows from both sizes and the similarity, exactly. Pairs are of
   different components, one side always outside the component that most of a
   list belongs to, and sizes meet by bands, so a family of near copies that are
   linked through its most popular one makes few. The pair that shares most is
   confirmed first for each set; pairs within one component need no look.

Defined results: words are split at spaces and U+0009 to U+000D, A-Z lower-cased.
A document with fewer words than a shingle is its whole sequence as one; without
words, or with a null text, its set is empty and it is linked with nothing (not
even with another empty one). A null id counts as no id: it never becomes a
component's id while another member has one. Repeated rows are copies and link;
all rows of the id that names the component count as kept. An empty table gives
an empty table. Very long texts are one set like others. Extra columns, whatever
their names, are ignored by the query and kept by ``keep_one``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.common import cut, documents, free, map_arrow, maybe_in, mix, prefix_hashes, range_hashes, word_bounds
from tidelog.llm.components import connected_components

K = 64
SIMILARITY = 80  # per cent
#: retained values that follow each other and make a list, and how many such lists a linked pair shares at least
RUN, LEAST_LISTS = 3, 2
#: sizes of sets in one band differ by this factor at most
BAND = 1.05


def least_overlap(k: int, percent: int) -> int:
    p = percent / 100
    return max(1, int(np.floor(k * p - 6.5 * np.sqrt(k * p * (1 - p)))))


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of the word shingles."""
    raw = (text or "").encode().lower()
    data = np.frombuffer(raw, np.uint8)
    starts, ends = word_bounds(data)
    if not len(starts):
        return np.zeros(0, np.int64)
    words = range_hashes(prefix_hashes(data), starts, ends)
    width = min(width, len(words))
    many = len(words) - width + 1
    acc = np.full(many, width, np.uint64)
    for j in range(width):
        acc = acc * np.uint64(0x9FB21C651E98DF25) + words[j : j + many]
    return np.unique(mix(acc).view(np.int64))


def set_name(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = pa.array(np.cumsum([0, *map(len, arrays)]).astype(np.int32))
    return pa.ListArray.from_arrays(ends, pa.array(np.concatenate(arrays) if arrays else np.zeros(0, np.int64)))


def sketches(docs: DataFrame, width: int, k: int) -> DataFrame:
    """doc_id, h (of id and text), n (size of the set), name (of the set), sketch (the k smallest hashes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                sizes, names, kept = [], [], []
                for text in batch.column(2).to_pylist():
                    hashes = shingles(text, width)
                    sizes.append(len(hashes))
                    names.append(set_name(hashes))
                    kept.append(hashes[:k])
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(names, pa.binary()), _lists(kept)], ["doc_id", "h", "n", "name", "sketch"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    slim = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("h"), "text")
    return map_arrow(slim, run, f"doc_id {kind}, h bigint, n bigint, name binary, sketch array<bigint>")


def classes_of(every: DataFrame) -> DataFrame:
    """node (a number), name, n, sketch, least (doc_id) and h (of one document) of each set that is not empty."""
    per = every.filter("n > 0").groupBy("name").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.min("doc_id").alias("least"), F.min("h").alias("h"))
    return per.withColumn("node", F.monotonically_increasing_id())


def _listed_with_others(held: DataFrame) -> DataFrame:
    """(value, node, df): the rows of (value, node) whose value several nodes hold."""
    shared = cut(held.groupBy("value").agg(F.count(F.lit(1)).alias("df")).filter("df > 1"))
    return held.join(shared, "value").select("value", "node", "df")


def inverted_lists(classes: DataFrame, k: int, percent: int) -> DataFrame:
    """(value, node, df): lists of runs of retained values, and of the rarest single values of whole sets."""
    long = classes.filter(F.lit(100) * F.col("n") > percent * k)
    slid = F.arrays_zip(*[F.slice("sketch", 1 + j, k).alias(f"v{j}") for j in range(RUN)])
    runs = long.select("node", F.explode(slid).alias("r")).filter(F.col(f"r.v{RUN - 1}").isNotNull())
    runs = _listed_with_others(runs.select(F.xxhash64("r.*").alias("value"), "node"))
    # one of a set's rarest values must be shared, values that no other whole set holds coming first
    whole = classes.filter(F.col("n") <= k)
    ranked = _listed_with_others(whole.select("node", F.explode("sketch").alias("value")))
    ranked = ranked.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("df", "value"))).alias("vals")).join(whole.select("node", "n"), "node")
    prefix = F.size("vals") - F.ceil(F.col("n") * percent / F.lit(100.0)) + 1
    single = ranked.filter(prefix > 0).select("node", F.explode(F.slice("vals", F.lit(1), prefix.cast("int"))).alias("v"))
    return runs.unionByName(single.select(F.xxhash64("v.value").alias("value"), "node", "v.df"))


def stars(lists: DataFrame, classes: DataFrame) -> DataFrame:
    """(value, node, n, hub, hub_n): every member of a list beside its most popular one, which shares its lists with most."""
    pops = lists.groupBy("node").agg(F.sum("df").alias("pop")).join(classes.select("node", "n"), "node")
    told = lists.select("value", "node").join(cut(pops), "node")
    hubs = told.groupBy("value").agg(F.max(F.struct("pop", "node", "n")).alias("h"), F.count(F.lit(1)).alias("c")).filter("c > 1")
    hubs = cut(hubs.select("value", F.col("h.node").alias("hub"), F.col("h.n").alias("hub_n")))
    return told.join(hubs, "value").filter("node <> hub").select("value", "node", "n", "hub", "hub_n")


def plausible(pairs: DataFrame, classes: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs (a, b) whose union sketch leaves the similarity possible."""
    one = classes.select(F.col("node").alias("a"), F.col("sketch").alias("sa"))
    two = classes.select(F.col("node").alias("b"), F.col("sketch").alias("sb"))
    union = F.slice(F.sort_array(F.array_union("sa", "sb")), 1, k)
    met = pairs.join(one, "a").join(two, "b").select("a", "b", union.alias("u"), F.array_intersect("sa", "sb").alias("both"))
    shared, size = F.size(F.array_intersect("both", "u")), F.size("u")
    # fewer than k values are the whole union
    return met.filter(F.when(size < k, 100 * shared >= percent * size).otherwise(shared >= least_overlap(k, percent))).select("a", "b")


def full_sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(node, n, hashes) of the wanted (node, name, h): the texts are read again and only those of wanted hashes move."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                sets = [shingles(t, width) for t in batch.column(2).to_pylist()]
                # two rows may share h; the name tells whose text this is
                same = pa.array([set_name(s) == n for s, n in zip(sets, batch.column(1).to_pylist(), strict=True)], pa.bool_())
                made = pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), _lists(sets)], ["node", "n", "hashes"])
                yield made.filter(same)

    source = maybe_in(docs.select(F.xxhash64("doc_id", "text").alias("h"), "text"), "h", wanted)
    texts = source.join(wanted, "h").select("node", "name", "text")
    return map_arrow(texts, run, "node bigint, n bigint, hashes array<bigint>").dropDuplicates(["node"])


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are linked."""
    one = sets.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("hashes").alias("sa"))
    two = sets.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("hashes").alias("sb"))
    met = pairs.select("a", "b").join(one, "a").join(two, "b")
    met = met.select("a", "b", (F.col("na") + F.col("nb")).alias("sum"), F.size(F.array_intersect("sa", "sb")).alias("both"))
    return met.filter(F.lit(100) * F.col("both") >= F.lit(percent) * (F.col("sum") - F.col("both"))).select("a", "b")


def _with_component(rows: DataFrame, labels: DataFrame, node: str = "node", name: str = "comp") -> DataFrame:
    known = labels.select(F.col("node").alias(node), F.col("comp").alias("_comp"))
    return rows.join(known, node, "left").withColumn(name, F.coalesce("_comp", node)).drop("_comp")


def unsettled(met: DataFrame, labels: DataFrame, k: int, percent: int) -> DataFrame:
    """Nodes that share lists, not as their hub, with a node of another component and of a size that a link allows: so many lists as linked ones share."""
    size = met.count()
    rows = _with_component(met.select("value", "node", "n"), labels)
    rows = cut(rows.withColumn("q", F.floor(F.log("n") / F.log(F.lit(100 / percent)))), size)
    seen = rows.groupBy("value", "q").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("n").alias("least"), F.max("n").alias("most"))
    seen = cut(seen, size)
    several = cut(seen.groupBy("value").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).filter("lo < hi").select("value"), size)
    near = rows.join(several, "value", "left_semi").select("value", "node", "n", "comp", F.explode(F.array(F.col("q") - 1, F.col("q"), F.col("q") + 1)).alias("q"))
    other = f"(lo <> comp OR hi <> comp) AND 100 * most >= {percent} * n AND 100 * n >= {percent} * least"
    found = near.join(seen, ["value", "q"]).filter(other).select("node", "n", "value").distinct()
    return found.groupBy("node", "n").agg(F.count(F.lit(1)).alias("c")).filter((F.col("n") <= k) | (F.col("c") >= LEAST_LISTS)).select("node")


def _band(n: Column) -> Column:
    return F.floor(F.log(n) / F.log(F.lit(BAND))).cast("int")


def candidates(sets: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """(a, b, shared): pairs of different components that can be linked, by prefixes of full sets; ``shared`` counts the values they meet in.

    Let v be the first value that x and y share in one order of all values, at
    ranks i and j from 0. They share at most |x| - i, and |y| - j, and must share
    p / (100 + p) * (|x| + |y|). So |y| is at most (|x| - i) * (100 + p) / p - |x|,
    the ``reach`` of x at i, and the same holds the other way.
    """
    shown = sets.select("node", F.explode("hashes").alias("value"))
    ranked = _listed_with_others(shown).groupBy("node").agg(F.sort_array(F.collect_list(F.struct("df", "value"))).alias("vals"))
    ranked = _with_component(ranked.join(sets.select("node", "n"), "node"), labels)
    least = F.ceil(F.col("n") * percent / F.lit(100.0)).cast("long")
    alone = F.col("n") - F.size("vals")  # values that no other set holds have the first ranks
    upto = F.col("n") - alone - F.ceil((F.col("n") + least) * percent / F.lit(100.0 + percent)) + 1
    listed = ranked.filter(upto > 0).select("node", "n", "comp", alone.alias("alone"), F.posexplode(F.slice("vals", F.lit(1), upto.cast("int"))).alias("at", "v"))
    reach = F.floor((F.col("n") - F.col("alone") - F.col("at")) * F.lit(100.0 + percent) / F.lit(percent)).cast("long") - F.col("n")
    entries = cut(listed.select("v.value", "node", "n", "comp", reach.alias("reach")).filter(F.col("reach") >= least))
    size = entries.count()
    mixed = entries.groupBy("value", "comp").agg(F.count(F.lit(1)).alias("c")).groupBy("value").agg(F.max_by("comp", F.struct("c", "comp")).alias("major"), F.count(F.lit(1)).alias("many"))
    mixed = cut(mixed.filter("many > 1"), size)
    entries = cut(entries.join(mixed, "value").withColumn("minor", F.col("comp") != F.col("major")).drop("major", "many"), size)
    index = entries.filter("reach >= n").select("value", _band(F.col("n")).alias("band"), *[F.col(c).alias(f"b_{c}") for c in ("node", "n", "comp", "reach", "minor")])
    probe = entries.withColumn("band", F.explode(F.sequence(_band(least), _band(F.least("n", "reach")))))
    able = (
        (F.col("comp") != F.col("b_comp")) & (F.col("b_n") <= F.col("reach")) & (F.col("n") <= F.col("b_reach")) & (100 * F.col("b_n") >= percent * F.col("n"))
        & ((F.col("n") > F.col("b_n")) | ((F.col("n") == F.col("b_n")) & (F.col("node") > F.col("b_node"))))
    )
    keys = ["value", "band"]
    found = probe.filter("minor").join(index, keys).filter(able).unionByName(probe.filter("NOT minor").join(index.filter("b_minor"), keys).filter(able))
    pair = found.select(F.greatest("node", "b_node").alias("a"), F.least("node", "b_node").alias("b"))
    return pair.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))


def _relabelled(labels: DataFrame, links: DataFrame) -> DataFrame:
    return connected_components(labels.select(F.col("node").alias("a"), F.col("comp").alias("b")).unionByName(links))


def _settle(pairs: DataFrame, sets: DataFrame, labels: DataFrame, percent: int, first: int = 2) -> DataFrame:
    """``labels`` after all linked pairs: twice each node's likeliest pair, then every pair that still joins two components."""
    left, turn = cut(pairs), 0
    while True:
        rows = _with_component(_with_component(left, labels, "a", "ca"), labels, "b", "cb").filter("ca <> cb").select("a", "b", "shared")
        open_pairs = cut(rows, left.count())
        free(left)
        size = open_pairs.count()
        if not size:
            free(open_pairs)
            return labels
        asked, left = open_pairs, None
        if turn < first:
            ends = open_pairs.select(F.explode(F.array("a", "b")).alias("node"), F.struct("shared", "a", "b").alias("pair"))
            asked = cut(ends.groupBy("node").agg(F.max("pair").alias("p")).select("p.a", "p.b").distinct(), size)
            left = cut(open_pairs.join(asked, ["a", "b"], "left_anti"), size)
            free(open_pairs)
        links = cut(confirmed(asked, sets, percent))
        if links.take(1):
            labels = _relabelled(labels, links)
        free(asked, links)
        if left is None:
            return labels
        turn += 1


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = SIMILARITY, k: int = K) -> DataFrame:
    """doc_id, h, n_shingles, component_id, kept, comp (names the component, by a set in it): one row a document."""
    every = cut(sketches(docs, width, k))
    classes = cut(classes_of(every))
    lists = cut(inverted_lists(classes, k, percent))
    met = cut(stars(lists, classes))
    free(lists)
    sized = f"100 * n >= {percent} * hub_n AND 100 * hub_n >= {percent} * n"
    entries = met.count()
    pairs = cut(met.filter(sized).select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct(), entries)
    size = pairs.count()
    likely = cut(plausible(pairs, classes, k, percent))
    free(pairs)
    wanted = lambda nodes, most: cut(classes.select("node", "name", "h").join(nodes.distinct(), "node", "left_semi"), most)
    sets = cut(full_sets(docs, wanted(likely.select(F.explode(F.array("a", "b")).alias("node")), 2 * size), width))
    links = cut(confirmed(likely, sets, percent))
    free(sets, likely)
    labels = connected_components(links)
    open_nodes = cut(unsettled(met, labels, k, percent), entries)
    free(met)
    if open_nodes.take(1):
        sets = cut(full_sets(docs, wanted(open_nodes, open_nodes.count()), width))
        labels = _settle(candidates(sets, labels, percent), sets, labels, percent)
        free(sets)
    owner = cut(_with_component(classes.select("node", "name", "least"), labels))
    first = cut(owner.groupBy("comp").agg(F.min("least").alias("component_id")))
    named = owner.join(first, "comp").select("name", "component_id", "comp")
    full = every.select("doc_id", "h", "n", "name").join(named, "name", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return full.select("doc_id", "h", F.col("n").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"), "comp")


def keep_one(docs: DataFrame, width: int = 5, percent: int = SIMILARITY) -> DataFrame:
    """One document of each group of near-duplicates, columns unchanged; documents without words all stay.

    Groups are those of the texts: different texts without an id, or under one id, are groups of their own.
    """
    found = near_duplicates(docs, width, percent)
    single = found.filter("n_shingles = 0").select("h").distinct()
    grouped = found.filter("n_shingles > 0").groupBy("comp").agg(F.min(F.when(F.col("kept"), F.col("h"))).alias("h")).select("h")
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), F.xxhash64(docs["doc_id"], docs["text"]).alias("h"))
    one = rows.join(grouped, "h", "left_semi").dropDuplicates(["h"])
    return one.unionByName(rows.join(single, "h", "left_semi")).select("_row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir).select("doc_id", "text"), width=2).select("doc_id", "n_shingles", "component_id", "kept")


ORACLE_SQL = """
WITH RECURSIVE t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 1 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM t
), x AS (
  SELECT doc_id, len(s)::BIGINT AS n, unnest(s) AS g FROM s
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * a.n >= 80 * b.n AND 100 * b.n >= 80 * a.n
  GROUP BY a.doc_id, a.n, b.doc_id, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), e AS (
  SELECT a, b FROM p UNION ALL SELECT b, a FROM p
), r(doc_id, c) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id WHERE r.c < e.b
)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, m.c AS component_id, m.c = s.doc_id AS kept
FROM s JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id) m ON s.doc_id = m.doc_id
"""
