"""The pipeline's stages, each on what its predecessor kept."""

import corpus_pipeline as pipeline


def test_stages(spark, tmp_path):
    line = "the alpha{0} of beta{0} and gamma{0} to delta{0} in epsilon{0} that zeta{0}"
    text = lambda k: "\n".join(line.format(k * 100 + j) for j in range(9))
    rows = [(k, text(k) + (" write to me@example.org" if k == 3 else ""), "en", f"s{k % 2}", 1) for k in range(8)]
    rows += [(20, rows[0][1], "en", "s1", 1), (21, "short", "en", "s0", 5), (22, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    seen = []
    for k, (name, stage) in enumerate(pipeline.STAGES):
        docs = stage(spark, docs, None)
        docs.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        seen.append({r.doc_id for r in docs.collect()})
        if k < len(pipeline.STAGES) - 1:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if name == "pii":
            assert docs.filter("doc_id = 3").first().text.endswith("write to [EMAIL]")
            assert all(r.n_chars == len(r.text) for r in docs.collect())
    assert seen[0] == {*range(8), 20} and seen[1] == set(range(8)) and seen[2] == seen[1] and seen[3] <= seen[2] and seen[4] == seen[3]
    assert docs.filter("NOT decodes OR size(ids) <> n_tokens").count() == 0


LINE = "the alpha{0} of beta{0} and gamma{0} to delta{0} in epsilon{0} that zeta{0}"


def page(k, lines=9):
    return "\n".join(LINE.format(k * 1000 + j) for j in range(lines))


def run_stages(spark, docs, folder):
    out = []
    for k, (_, stage) in enumerate(pipeline.STAGES):
        docs = stage(spark, docs, None)
        docs.write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        out.append(docs)
    return out


def test_near_dedup_and_mix_by_brute_force(spark, tmp_path):
    import random

    rng, rows = random.Random(31), []
    for k in range(12):
        base = page(k, 12).split(" ")
        for _ in range(rng.randint(1, 5)):
            words = list(base)
            for _ in range(rng.choice((0, 1, 2, 6))):
                words[rng.randrange(len(words))] = f"edit{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(words), "en", f"s{k % 3}", 1))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    out = run_stages(spark, docs, tmp_path)
    sets = {i: {tuple(w[j : j + 5]) for j in range(len(w) - 4)} for i, w in ((r[0], r[1].lower().split()) for r in rows)}
    root = {i: i for i in sets}
    for i in sets:
        for j in sets:
            if j < i and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = {k: min(a, b) if v in (a, b) else v for k, v in root.items()}
    assert sorted(r.doc_id for r in out[1].collect()) == sorted(set(root.values()))
    words = lambda df: {s: sum(len(r.text.split()) for r in df.collect() if r.source == s) for s in ("s0", "s1", "s2")}
    size = words(out[2])
    total, weight = sum(size.values()), {"s0": 1, "s1": 2, "s2": 3}
    want = {s: total * w / 6 for s, w in weight.items()}
    assert all(w <= 3 * size[s] for s, w in want.items())
    assert all(abs(n - want[s]) <= 2 for s, n in words(out[3]).items())
    ids = out[4].collect()
    assert len(ids) == out[3].count() and all(r.decodes for r in ids)


def test_tables_without_rows_clashing_columns_and_long_texts(spark, tmp_path):
    from pyspark.sql import functions as F

    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    rows = [(1, page(1, 1500), "en", "s", 5), (2, page(2), None, None, None), (2, page(2), None, None, None), (None, page(3), "en", "s", 1), (4, None, None, None, None), (5, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, schema)
    more = docs.withColumns({c: F.lit(7) for c in ("h", "n", "size", "taken", "_q", "_t", "key", "ids", "comp", "spans")})
    out = run_stages(spark, more, tmp_path / "some")
    assert all(df.columns == more.columns for df in out[:-1])
    assert sorted((r.doc_id or 0) for r in out[1].collect()) == [0, 1, 2]
    assert out[4].filter("NOT decodes").count() == 0
    assert all(df.count() == 0 for df in run_stages(spark, docs.limit(0), tmp_path / "none"))
