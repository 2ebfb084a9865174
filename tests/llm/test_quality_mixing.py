"""Quality rules and mixing on small tables with nulls, repeats, ties and clashing columns."""

import pytest
from pyspark.sql import functions as F

from tidelog.llm import mixing
from tidelog.llm.quality import QualityRules, query


def metrics(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered)


TEXTS = [None, "", " \n\t", "a", "a b c a b c x a b c", "é ü ß\né ü ß\n\n é ü ß", "x\x0b\x0cy #*$ <b>|&", "the of and to in " * 30, "word " * 3000, "1 2 3 4 1 2 3", "\n".join(f"the alpha{k} of beta{k} and gamma{k} to delta{k} in epsilon{k} that zeta{k}" for k in range(9))]


def test_quality_metrics(spark, tmp_path):
    rows = [(k, t) for k, t in enumerate(TEXTS)] + [(3, "a"), (None, "a b")]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = query(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for k, t in rows:
        r, n = by[k], metrics(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == n, (k, t)
        assert r.base_failed == (n[0] < 50 or 100 * n[4] > 50 * n[0])
        assert not (r.base_failed and r.kept)
    assert by[10].kept


def test_quality_filter_keeps_columns_and_handles_no_rows(spark):
    rows = spark.createDataFrame([(1, TEXTS[10], 5), (2, "x", 6)], "_row bigint, text string, n_words int")
    kept = QualityRules().filter(rows, rows["text"])
    assert kept.columns == rows.columns and [r["_row"] for r in kept.collect()] == [1]
    assert QualityRules().filter(rows.limit(0), rows["text"]).count() == 0


def water_level(sizes, cap=3):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    total, free, target = sum(sizes.values()), set(names), {}
    left = total
    while True:
        level = left / sum(weight[s] for s in free) if free else 0
        over = {s for s in free if level * weight[s] > cap * sizes[s]}
        if not over:
            return target | {s: level * weight[s] for s in free}
        for s in over:
            target[s] = cap * sizes[s]
            left -= target[s]
        free -= over


def test_targets_and_taken_words(spark):
    rows = [(k, "w " * (k % 17), f"s{k % 5}") for k in range(300)] + [(1000, "z " * 40, None), (1001, None, "s1"), (1002, "q " * 3, "tiny"), (5, "w " * 5, "s0"), (None, "n " * 9, "s2")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    sizes, taken, target = {}, {}, {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r["size"]
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 3 * r["size"]
    want = water_level(sizes)
    for s in sizes:
        assert target[s] == pytest.approx(want[s]) and abs(taken[s] - target[s]) <= 1.5
    again = sorted(map(tuple, mixing.mix(docs).collect()), key=str)
    assert again == sorted(map(tuple, got), key=str)
    mixed = mixing.mixed_documents(docs)
    words = {r.source: r.n for r in mixed.groupBy("source").agg(F.sum(mixing.n_words(F.col("text"))).alias("n")).collect()}
    assert words == {s: n for s, n in taken.items() if n}
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.mix(docs.filter("doc_id = 1001")).first().taken == 0
