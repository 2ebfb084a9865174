"""Near-duplicates and repeated windows against brute force."""

import collections
import hashlib
import random
import re

import pytest

from tidelog.llm import debruijn, minhash, suffixes
from tidelog.llm.windows import Windows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus(seed=5):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    rows = [text(rng.randint(1, 150)) for _ in range(60)]
    base, passage = text(120), text(70)
    for k in range(40):  # near copies, more or less edited
        w = base.split()
        for _ in range(k % 14):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        rows.append(" ".join(w))
    rows += [text(20) + " " + passage + "\n" + text(20) for _ in range(12)] + [base, base.upper(), "ab " * 900, "ab " * 60, "ab " * 900, "", None, None, " \n", "A", "a", "b"]
    rng.shuffle(rows)
    return list(enumerate(rows)) + [(3, rows[3]), (None, rows[5]), (None, rows[5])]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), "doc_id bigint, text string").cache()


def components(rows, width):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def shingles(t):
        w = WORD.findall((t or "").translate(low))
        return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()

    sets, up = [shingles(t) for _, t in rows], list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                up[root(i)] = root(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root(k)] = min(least.get(root(k), i), i)
    return [(i, len(s), least.get(root(k)) if s else i) for k, ((i, _), s) in enumerate(zip(rows, sets, strict=True))]


@pytest.mark.parametrize("width", [2, 5])
def test_components(docs, width):
    rows = [tuple(r) for r in docs.collect()]
    got = minhash.near_duplicates(docs, width).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == sorted(components(rows, width), key=str)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_one_of_each_group_stays(docs):
    from pyspark.sql import functions as F

    kept = minhash.keep_one(docs.withColumn("h", F.lit(1)).withColumn("n", F.lit("x")), 2)
    assert kept.columns == ["doc_id", "text", "h", "n"]
    rows = [tuple(r) for r in docs.collect()]
    groups = {c for i, n, c in components(rows, 2) if n}
    assert sorted(r.doc_id for r in kept.filter("trim(text) <> '' AND text <> ' \\n'").collect()) == sorted(groups)
    assert minhash.near_duplicates(docs.limit(0), 2).count() == 0


def test_words_repeated_in_smaller_documents(docs):
    rows = [tuple(r) for r in docs.collect()]
    rank = lambda i: float("inf") if i is None else i
    words, first = {k: WORD.findall(t or "") for k, (_, t) in enumerate(rows)}, {}
    for k, (i, _) in enumerate(rows):
        for p in range(len(words[k]) - 49):
            w = tuple(words[k][p : p + 50])
            first[w] = min(first.get(w, rank(i)), rank(i))
    want = []
    for k, (i, _) in enumerate(rows):
        gone = set()
        for p in range(len(words[k]) - 49):
            if first[tuple(words[k][p : p + 50])] < rank(i):
                gone.update(range(p, p + 50))
        left = " ".join(w for p, w in enumerate(words[k]) if p not in gone)
        want.append((i, len(words[k]), len(gone), hashlib.sha256(left.encode()).hexdigest()))
    for frame in (docs,):
        got = [(r.doc_id, r.n, sum(b - a for a, b in zip(r.spans[::2], r.spans[1::2], strict=True)), r.sha) for r in debruijn.remove_repeats(frame).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    assert debruijn.remove_repeats(docs.limit(0)).count() == 0


def test_bytes_repeated_anywhere(docs, monkeypatch):
    rows = [(i, (t or "").encode()) for i, t in docs.collect()]
    count = collections.Counter(b[p : p + 400] for _, b in rows for p in range(len(b) - 399))
    want = []
    for i, b in rows:
        gone = bytearray(len(b))
        for p in range(len(b) - 399):
            if count[b[p : p + 400]] > 1:
                gone[p : p + 400] = b"\1" * 400
        left = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        want.append((i, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(left).hexdigest()))
    from tidelog.llm import windows

    for limit in (4000, 1):  # the second counts the windows of every owner in Spark
        monkeypatch.setattr(windows, "LOCAL", limit)
        got = [(r.doc_id, r.n, sum(b - a for a, b in zip(r.spans[::2], r.spans[1::2], strict=True)), len(r.spans) // 2, r.sha) for r in suffixes.remove_repeats(docs).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)


def test_suffix_sort_orders_and_extends():
    rng = random.Random(2)
    strings = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 40))) for _ in range(200)]
    groups = [rng.randrange(3) for _ in strings]
    order, shared = suffixes.sort_suffixes(strings, groups)
    keys = [(groups[i], strings[i]) for i in order]
    assert keys == sorted(keys)
    for k in range(1, len(order)):
        (g, a), (h, b) = keys[k - 1], keys[k]
        n = 0
        while g == h and n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        assert shared[k] == n


def test_collisions_of_hashes_are_caught(monkeypatch):
    import numpy as np

    monkeypatch.setattr(suffixes, "prefix_hashes", lambda data: np.zeros(len(data) + 1, np.uint64))
    order, shared = suffixes.sort_suffixes([b"b", b"a", b"ab"], [0, 0, 0])
    assert order.tolist() == [1, 2, 0] and shared.tolist() == [0, 1, 0]


def test_branches_compare_words():
    how = Windows("words", 2, 1, earlier=True)
    rows = [{"owner": 1, "back": 0, "run": 1, "first": 5, "body": b"a b"}, {"owner": 1, "back": 0, "run": 2, "first": 9, "body": b"a b c"}]
    flags = debruijn.branches(how)(rows)
    assert [f.tolist() for f in flags] == [[False], [True, False]]


def meets_brute_force(spark, rows, width=1):
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(df, width).collect()}
    assert got == {i: c for i, _, c in components(rows, width)}


def test_families_with_optional_sections(spark):
    rng, rows = random.Random(11), []
    for f in range(12):
        part = lambda name, n: [f"f{f}{name}{j}" for j in range(n)]  # noqa: B023, E731
        for x in range(14):
            words = part("base", 150) + sum((part(f"s{s}_", 18) for s in range(7) if rng.random() < 0.5), []) + part(f"own{x}_", rng.randint(0, 3))
            rows.append((len(rows), " ".join(words)))
    meets_brute_force(spark, rows)


def test_members_that_share_what_they_lack(spark):
    rng, rows = random.Random(12), []
    for f in range(20):
        page = [f"f{f}w{j}" for j in range(1000)]
        gone = set(rng.sample(page, 140))
        for x in range(20):
            rows.append((len(rows), " ".join(page + [f"f{f}x{x}_{j}" for j in range(rng.randint(1, 20))])))
        for x in range(2):
            rows.append((len(rows), " ".join([w for w in page if w not in gone] + [f"f{f}y{x}_{j}" for j in range(100)])))
    meets_brute_force(spark, rows)


def test_groups_without_an_id_of_their_own(spark):
    rows = [(None, f"{c}1 {c}2 {c}3") for c in "abcd"] + [(None, "a1 a2 a3"), (7, "p q r"), (7, "s t u"), (8, "s t u")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted(map(tuple, minhash.keep_one(df, 1).collect()), key=str)
    assert got == sorted({r for r in rows if r[0] != 8}, key=str)


def test_truncated_copies(spark):
    hub = [f"h{j}" for j in range(61)]
    rows = [" ".join(hub + [f"t{c}"]) for c in range(3)] + [" ".join(hub[:43]), " ".join(hub[:41])]
    rng = random.Random(13)
    for g in range(60):
        page = [f"g{g}w{j}" for j in range(rng.randint(20, 160))]
        for _ in range(12):
            words = page[rng.randint(0, len(page) // 5) : len(page) - rng.randint(0, len(page) // 3)]
            for _ in range(rng.randint(0, max(1, len(page) // 30))):
                words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
            rows.append(" ".join(words))
    for width in (1, 2):
        meets_brute_force(spark, list(enumerate(rows)), width)


def test_a_large_family_of_edited_copies(spark):
    rng = random.Random(14)
    page, rows = [f"w{j}" for j in range(140)], []
    for x in range(700):
        words = list(page)
        for j in rng.sample(range(140), rng.choice((2, 6, 9, 14, 20))):
            words[j] = rng.choice((f"x{x}_{j}", f"c{j}", ""))
        rows.append((x, " ".join(filter(None, words))))
    meets_brute_force(spark, rows, 2)


def test_very_long_texts_and_clashing_columns(spark):
    from pyspark.sql import functions as F

    rng = random.Random(15)
    long = " ".join(f"v{rng.randrange(40000)}" for _ in range(120000))
    rows = [(1, long), (2, long + " tail"), (3, long[: len(long) // 2]), (4, "a b c"), (5, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({c: F.lit(0) for c in ("h", "n", "node", "name", "sketch", "comp", "value")})
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(df, 2).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5}
    assert sorted(r.doc_id for r in minhash.keep_one(df, 2).collect()) == [1, 3, 4, 5]


def test_paths_compact_what_never_branches(spark):
    from tidelog.llm import windows

    rng = random.Random(21)
    how = Windows("words", 5, 2, earlier=True)
    blocks = [" ".join(f"b{k}_{j}" for j in range(rng.randint(4, 30))) for k in range(6)]
    texts = [" ".join(rng.choice(blocks) if rng.random() < 0.8 else f"x{k}_{j}" for j in range(rng.randint(1, 7))) for k in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    runs = windows.owned_runs(windows.distinct_texts(windows._rows(df))[0], how).collect()
    of = collections.defaultdict(list)
    for r in runs:
        of[r.owner].append(r)
    repeated = [r for r in runs if len({x.own for x in of[r.owner]}) > 1]
    first = {}
    for r in repeated:
        first[r.ctx] = min(first.get(r.ctx, r.own), r.own)
    at = {(r.tid, r.seq): r for r in repeated}
    after, before = collections.defaultdict(set), collections.defaultdict(set)
    for (tid, seq), r in at.items():
        following, previous = at.get((tid, seq + 1)), at.get((tid, seq - 1))
        after[r.ctx].add(following and bytes(following.ctx))
        before[r.ctx].add(previous and bytes(previous.ctx))
    joins = lambda a, b: after[a.ctx] == {bytes(b.ctx)} and before[b.ctx] == {bytes(a.ctx)}
    want = []
    for (tid, seq), r in sorted(at.items()):
        if r.own <= first[r.ctx]:
            continue
        if (tid, seq - 1) in at and joins(at[tid, seq - 1], r):
            want[-1][2] += r.run
        else:
            want.append([tid, r.at - r.back, r.run])
    rows = [(r.tid, r.seq, r.ctx, r.own, first[r.ctx], r.at - r.back, r.run) for r in repeated]
    table = spark.createDataFrame(rows, "tid binary, seq int, ctx binary, own bigint, first bigint, start int, run int")
    got = debruijn.paths(table).collect()
    assert sorted((bytes(g.tid), g.start, g.run) for g in got) == sorted((bytes(t), s, n) for t, s, n in want)
    assert any(n > max(r.run for r in runs) for _, _, n in want)


def test_repeats_with_clashing_columns_and_very_long_texts(spark):
    from pyspark.sql import functions as F

    rng = random.Random(22)
    long = " ".join(f"w{rng.randrange(9)}" for _ in range(60000))
    rows = [(1, long), (2, "head " + long[20000:90000]), (3, None), (4, ""), (2, "other text")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({c: F.lit(0) for c in ("tid", "h", "own", "seq", "owner", "ctx", "n", "spans")})
    words = debruijn.remove_repeats(df).collect()
    assert {(r.doc_id, r.n, len(r.spans) // 2) for r in words} == {(1, 60000, 0), (2, len(rows[1][1].split()), 1), (3, 0, 0), (4, 0, 0), (2, 2, 0)}
    found = {(r.doc_id, r.n): r.spans for r in suffixes.remove_repeats(df).collect()}
    assert found[2, len(rows[1][1])] == [5, len(rows[1][1])] and found[1, len(long)] == [20000, 90000]
    assert len(found) == 5 and suffixes.remove_repeats(df.limit(0)).count() == 0
