"""Language identification, quotation linking, personal data, BPE, media."""

import hashlib
import random
import re
import zlib
from array import array

import pytest
from tokenizers import Tokenizer

from tidelog.llm import bpe, langid, media, pii, quotes
from tidelog.llm.boosting import BoostedTrees


def write(spark, folder, rows, schema, name="documents"):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_language_held_out(spark, tmp_path):
    rng = random.Random(3)
    words = {"aa": ["thing", "the", "and", "where", "with"], "bb": ["über", "das", "nicht", "und", "schön"], "cc": ["où", "le", "être", "mais", "çela"]}
    rows = [(k, " ".join(rng.choice(words[lang]) for _ in range(12)), lang) for k in range(240) for lang in [sorted(words)[k % 3]]]
    rows += [(900, None, "aa"), (901, "", "aa"), (902, "123 !", "bb"), (None, "das und nicht", None), (903, "the and " * 20000, None), (5, rows[5][1], rows[5][2])]
    got = langid.query(spark, write(spark, tmp_path, rows, "doc_id bigint, text string, lang string")).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert all(by[i].lang_pred == lang for i, t, lang in rows[:240]) and all(0 <= r.score <= 1 for r in got)
    assert [by[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and by[None].lang_pred == "bb" and by[903].lang_pred == "aa"
    nothing = spark.createDataFrame([(1, "text", None)], "doc_id bigint, text string, lang string")
    assert langid.identify(nothing, langid.train(nothing)).first().lang_pred == "und"


def test_the_documents_to_learn_from_are_the_first_by_hash(spark):
    rows = [(k, f"text {k % 1990}", "ab"[k % 7 == 0]) for k in range(2000)] + [(k, "the same text", "c") for k in range(40)] + [(3, "one row again", "d")] * 50
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    ranked = docs.filter(~langid.held_out("doc_id")).withColumn("h", langid.F.xxhash64("doc_id", "text")).collect()
    for most in (1, 10, 5000):
        want = [(lang, r.text) for lang in "abcd" for r in sorted((r for r in ranked if r.lang == lang), key=lambda r: r.h)[:most]]
        got = [tuple(r) for r in langid.training_sample(docs, most).collect()]
        assert sorted(x for x in got if x[0] != "d") == sorted(x for x in want if x[0] != "d") and {x for x in got if x[0] == "d"} == {x for x in want if x[0] == "d"}


def test_code_lengths_are_of_a_distribution(spark):
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(["abracadabra", "abc abd", "zebra"] * 3)], "doc_id bigint, text string, lang string")
    model = langid.train(docs)
    for context in (b"abr", b"zzz", b"\0\0\0"):
        total = 0.0
        for b in range(256):
            seq = context + bytes([b])
            joined = model.symbol[list(seq)].astype(int)
            node = model.node[(joined[0] * model.size + joined[1]) * model.size + joined[2]]
            total += 2.0 ** -float(model.bits[node * model.size + joined[3], 0])
        assert total == pytest.approx(1, abs=1e-3)


def test_quotes(spark):
    rows = [
        (1, 0, "user", "Shall we meet on Friday at the old bridge?\nBring the maps, please."),
        (1, 1, "assistant", "> Shall we meet on friday at the OLD bridge?\nYes, gladly so.\nAt nine then, is that fine?"),
        (1, 2, "user", "On Monday, Ann wrote:\n>> Shall we meet on Friday at the old bridge?\n> Yes, gladly so.\nGreat news for all of us"),
        (1, 3, "assistant", "> Bring the maps, please.\nI shall bring them all"),
        (2, 0, "user", "> Great news for all of us\nquoted elsewhere"),
        (2, 1, "user", None),
        (2, 2, "user", "> a passage that is said later only"),
        (2, 3, "user", "a passage that is said later only"),
        (None, 1, "user", "> a passage of nobody"),
    ]
    df = spark.createDataFrame(rows + [rows[3]], "conv_id bigint, turn bigint, role string, text string")
    got = quotes.linked_conversations(df).select("_row.conv_id", "_row.turn", "own", "n_quotes", "n_linked", "parent_turn", "thread", "depth").collect()
    assert len(got) == 10
    by = {(r.conv_id, r.turn): tuple(r)[2:] for r in got}
    assert by[(1, 0)] == (rows[0][3], 0, 0, None, 0, 0)
    assert by[(1, 1)] == ("Yes, gladly so.\nAt nine then, is that fine?", 1, 1, 0, 0, 1)
    assert by[(1, 2)] == ("Great news for all of us", 2, 2, 1, 0, 2)
    assert by[(1, 3)] == ("I shall bring them all", 1, 1, 0, 0, 1)
    assert by[(2, 0)] == ("quoted elsewhere", 1, 1, None, 0, 0)
    assert by[(2, 1)] == (None, 0, 0, None, 1, 0) and by[(2, 2)][2] == 0
    assert quotes.linked_conversations(df.limit(0)).count() == 0


def test_quotes_of_several_pieces(spark):
    first = "The first line of the letter\nYes, agreed.\nThe third line of the letter\n\nA paragraph on\ntwo lines here\n\nThe last paragraph of it"
    rows = [
        (1, 0, first),
        (1, 1, "> The first line of the letter\n> Yes, agreed.\ntwo of the lines"),
        (1, 2, "> A paragraph on two\n> lines here\n>\n> The last paragraph of it\ntwo of the paragraphs"),
        (1, 3, "> Yes, agreed.\na short quote"),
        (1, 4, "> Yes, agreed.\n> two of the lines\npieces of two messages"),
        (2, 0, "> The third line of the letter\n> The first line of the letter\nfrom elsewhere"),
        (2, 1, "> Yes, agreed.\nshort, from elsewhere"),
        (3, 0, "Yes\nsame words folded on one line"),
        (3, 1, "Yes same words\nfolded on one line"),
        (3, 2, "Yes same words\nfolded on one line\nand more of it"),
        (3, 3, "> folded on one line\n> Yes same words\nof the second"),
    ]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, text string")
    got = quotes.linked_conversations(df).select("_row.conv_id", "_row.turn", "n_linked", "parent_turn").collect()
    by = {(r.conv_id, r.turn): (r.n_linked, r.parent_turn) for r in got}
    assert [by[(1, t)] for t in range(5)] == [(0, None), (1, 0), (1, 0), (1, 0), (0, None)]
    assert by[(2, 0)] == (1, None) and by[(2, 1)] == (0, None) and by[(3, 3)] == (1, 1)


def test_quotes_from_elsewhere_that_are_said_later_too(spark):
    rows = [(1, 0, "> one passage of the other"), (1, 1, "one passage of the other"), (2, 4, "one passage of the other")]
    rows += [(3, 0, "> the first of two lines\n> and the second of them"), (3, 1, "the first of two lines\nand the second of them\nmore"), (4, 0, "and more\nthe first of two lines\nand the second of them")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, text string")
    got = quotes.linked_conversations(df).select("_row.conv_id", "_row.turn", "n_linked", "parent_turn").collect()
    assert {(r.conv_id, r.turn): (r.n_linked, r.parent_turn) for r in got if r.turn == 0 and r.conv_id < 4} == {(1, 0): (1, None), (3, 0): (1, None)}


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def sound(kind, m):
    digits = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        return 16 <= len(digits) <= 19 and sum(int(c) if i % 2 == 0 else 2 * int(c) - 9 * (int(c) > 4) for i, c in enumerate(reversed(digits))) % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


def test_personal_data(spark, tmp_path):
    texts = [
        "a@b.c_d@e.f x@@y.z @ a@b. a@b.c.d-e. é+49 (30) 1234-5678. 1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.4 4111 1111 1111 1111 4111-1111-1111-1111,5500005555555559",
        'écrire à foo (at) bar (dot) com token = "abc123def456abc123def456" call 555-123-4567 now',
        "clean prose, with a number 1234 and a date 2024-01-02; Is at and. Ereast. commit 8f14e45fceea167a5a36dedd4bea2543c0ffee00",
        None, "", "+", "1 " * 4000 + "a@" + "b." * 4000 + "c " + "a" * 30000 + "@", "+1" + "." * 5000 + "9" * 9,
    ]
    rows = list(enumerate(texts)) + [(0, texts[0])]
    got = pii.query(spark, write(spark, tmp_path, rows, "doc_id bigint, text string")).collect()
    assert len(got) == len(rows)
    for r in got:
        text, base = texts[r.doc_id] or "", []
        for kind, pattern in PATTERNS.items():
            found = [m for m in re.finditer(pattern, text) if sound(kind, m[0])]
            assert getattr(r, f"n_{kind}") == len(found)
            base += [f"{kind}:{m.start()}:{m.end()}" for m in found]
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert set(base) <= set(r.spans.split(",")) | {""} and r.n_spans == len([x for x in r.spans.split(",") if x])
    spans = {r.doc_id: r.spans for r in got}
    assert [s.split(":")[0] for s in spans[1].split(",")] == ["email", "phone", "secret"] and spans[2] == ""
    df = spark.createDataFrame([(1, texts[1], "k"), (2, None, "k")], "_t bigint, text string, base string")
    clean = pii.PersonalData().redact(df)
    assert clean.columns == df.columns
    assert [r.text for r in clean.orderBy("_t").collect()] == ['écrire à [EMAIL] token = "[SECRET]" call [PHONE] now', None]


def test_a_dropped_candidate_drops_no_other(spark, monkeypatch):
    class Scores:
        def __init__(self, sql):
            self.sql = lambda names: sql

    scores = {"email": Scores("0.95D"), "phone": Scores("0D"), "secret": Scores("IF(f.s = 0, 0.99D, 0.9D)")}
    monkeypatch.setattr(pii, "models", lambda spark: {k: (m, 0.8) for k, m in scores.items()})
    df = spark.createDataFrame([("a1" * 12 + " (at) " + "b2" * 12 + " (dot) com",)], "text string")
    assert pii.PersonalData().redact(df).first().text == "[SECRET] (at) [SECRET] (dot) com"


def test_boosted_trees_and_their_sql(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    model = BoostedTrees().fit(x[:300], y[:300]).calibrate(x[300:], y[300:])
    assert ((model.probability(x[300:]) > 0.5) == y[300:]).mean() > 0.9
    df = spark.createDataFrame([tuple(map(float, r)) for r in x[:50]], "a double, b double, c double")
    got = [r.p for r in df.selectExpr(f"{model.sql(['a', 'b', 'c'])} AS p").collect()]
    assert got == pytest.approx(model.probability(x[:50]).tolist())


def test_bpe_equals_the_library(spark, tmp_path):
    rng = random.Random(4)
    texts = ["", None, "Hello  world\n\n x", "don't we'LL 12345 ½ ", "x<|endoftext|>y <|endoftext|>", "the" * 400, "日本語 text 🙂\x00\x85 a", " ", "a​b c", "word " * 5000]
    texts += ["".join(rng.choice("abc déñ 12.,!\n\t") for _ in range(300)) for _ in range(20)]
    rows = list(enumerate(texts)) + [(3, texts[3])]
    got = bpe.query(spark, write(spark, tmp_path, rows, "doc_id bigint, text string")).collect()
    library = Tokenizer.from_file(bpe.default_tokenizer())
    assert len(got) == len(rows)
    for r in got:
        ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(back.encode()).hexdigest()


def test_lexicon_and_merges_agree(tmp_path, monkeypatch):
    path = str(tmp_path / "l.bin")
    bpe.compile_lexicon(bpe.default_tokenizer(), path, ["unseenword", " another"])
    lexicon = bpe.Lexicon(path)
    for w in ("the", " the", "unseenword", " another"):
        assert lexicon.find(w.encode()) == lexicon.merger(w.encode())
    assert lexicon.find(b"zzqx") is None and lexicon.find(b"") is None
    for w in (b"a" * 300, b"the" * 90, bytes(range(65, 91)) * 5):
        assert lexicon.merger._short(list(map(lexicon.merger.byte_ids.__getitem__, w))) == lexicon.merger._long(list(map(lexicon.merger.byte_ids.__getitem__, w)))
    rng = random.Random(8)
    words = [bytes(rng.choice(b" abcdeinrst\xc3\xa9th\0\xff") for _ in range(n)) for n in [*range(1, 90), *[7] * 300]] + [b"aa" * 30, b"the"]
    assert lexicon.merger.many(words) == [array("i", lexicon.merger(w)).tobytes() for w in words] and lexicon.merger.many([]) == []
    texts = ["", "the the unseenword <|endoftext|> zzqx", "<|endoftext|>", " ", "a" * 100, "é ☃ the"] * 3
    apart = [lexicon.encode(t).tolist() for t in texts]
    lexicon.known.clear()
    monkeypatch.setattr(bpe, "TOGETHER", 30)
    assert [x.tolist() for x in lexicon.encode_many(texts)] == apart == [Tokenizer.from_file(bpe.default_tokenizer()).encode(t, add_special_tokens=False).ids for t in texts]
    states, final = bpe.minimal_automaton([b"tap", b"taps", b"top", b"tops"])
    assert len(states) == 5 and sum(final) == 2  # suffixes are shared


def test_media(spark, tmp_path):
    texts = [None, "", "a", "x" * 64, "é" * 100, "x" * 200000, "x" * 64]
    got = media.query(spark, write(spark, tmp_path, list(enumerate(texts)), "doc_id bigint, text string")).collect()
    assert len(got) == len(texts)
    by = {r.doc_id: r for r in got}
    for k, t in enumerate(texts):
        raw = (t or "").encode()
        payload = media.padded(raw)
        assert len(payload) % 64 == 0 and payload.rstrip(b"\0") == raw.rstrip(b"\0")
        r = by[k]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        stored = media.to_png(payload)
        assert media.from_png(stored) == payload and r.media_sha256 == hashlib.sha256(stored).hexdigest() and r.media_bytes == len(stored)
    assert by[3][2:] == by[6][2:] and by[0][1:] == by[1][1:]
    with pytest.raises(ValueError):
        media.from_png(media.to_png(b"\1" * 64)[:-20] + b"\0" * 20)


def test_interleaved_sequences(spark):
    html = "<p>One <b>two</b><script>no</script><figure><img src='sha256:aa' alt='A'><img src='b.png'><figcaption>Both of them</figcaption></figure><p>Three<img src='sha256:aa'>four"
    items = media.parse(html)
    assert [(i["position"], i["kind"], i["text"] or i["ref"], i["caption"]) for i in items] == [
        (0, "text", "One two", None), (1, "media", "sha256:aa", "Both of them"), (2, "media", "b.png", "Both of them"), (3, "text", "Three", None), (4, "media", "sha256:aa", None), (5, "text", "four", None),
    ]
    pages = spark.createDataFrame([(1, html, "k"), (2, None, "k"), (3, "<figcaption>alone", "k")], "page_id bigint, html string, items string")
    store = spark.createDataFrame([("aa", 7)], "digest string, size int")
    got = media.resolve(media.interleave(pages), store).collect()
    assert sorted((r["_row"]["page_id"], r.position, r["size"]) for r in got if r.kind == "media") == [(1, 1, 7), (1, 2, None), (1, 4, 7)]
    assert [r.text for r in got if r["_row"]["page_id"] == 3] == ["alone"]


def test_captions_before_their_media_and_alone():
    first = media.parse("<figure><figcaption>Seen <i>at</i> dawn</figcaption><img src='a'><img src='b'></figure>end")
    assert [(i["kind"], i["ref"], i["caption"], i["text"]) for i in first] == [("media", "a", "Seen at dawn", None), ("media", "b", "Seen at dawn", None), ("text", None, None, "end")]
    twice = media.parse("<figure><figcaption>one</figcaption><img src='a'><figcaption>two</figcaption><figure><img src='b'></figure>")
    assert [(i["ref"], i["caption"]) for i in twice] == [("a", "one two"), ("b", None)]
    assert [i["text"] for i in media.parse("before<figcaption>said</figcaption>after<figure>in<figcaption>alone</figcaption></figure>")] == ["before", "said", "after", "in", "alone"]


def test_malformed_html_and_pages(spark):
    assert [i["text"] for i in media.parse("<![foo[x]]>after")] == ["<![foo[x]]>after"]
    rng = random.Random(6)
    bits = ["<", ">", "<!", "<![", "<![CDATA[", "]]>", "<!DOCTYPE x [", "<?", "&#", "&#x110000;", '"', "=", "/", "img src=a ", "<p>", "</", "<script>", "\0", "<figure>", "<figcaption>", "é"]
    for _ in range(3000):
        media.parse("".join(rng.choice(bits) for _ in range(rng.randint(1, 12))))
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").withColumnRenamed("url", "items")
    found = media.interleave(pages).collect()
    assert len(found) == pages.count() and all([i.position for i in r["items"]] == list(range(len(r["items"]))) for r in found)
    assert any(i.kind == "text" for r in found for i in r["items"])
    store = media.read_back(media.store(spark.createDataFrame([(b"one",), (b"one",), (None,)], "data binary")))
    digest = hashlib.sha256(media.padded(b"one")).hexdigest()
    one = spark.createDataFrame([(1, f"a<img src='sha256:{digest}'>b", 5)], "page_id bigint, html string, digest int")
    got = {r.position: (r.kind, r["text"], r.payload_bytes) for r in media.resolve(media.interleave(one), store).collect()}
    assert got == {0: ("text", "a", None), 1: ("media", None, 64), 2: ("text", "b", None)}


def linked_by_brute_force(rows):
    """(n_linked, parent_turn, thread, depth) of each (conv, turn), by looking through all messages for each passage."""
    told = {(c, t): quotes.parse(x) for c, t, x in rows}
    said = {k: set(quotes.said_hashes(own)) for k, (own, _) in told.items()}
    holds = lambda k, hashes: all(h in said[k] for h in hashes)
    links, parent = {}, {}
    for (conv, turn), (_, passages) in told.items():
        near_of, n = [], 0
        for at, (level, text) in enumerate(passages):
            name = quotes.passage_hash(text)
            if name is None:
                continue
            sets = quotes.piece_sets(text)
            first = []  # of each way to say it, the first message of the conversation; of those, the first
            for wanted in ([name], *(s["set"] for s in sets)):
                first += [min((t for c, t in told if c == conv and holds((c, t), wanted)), default=None)]
            first = [t for t in first if t is not None]
            near = min(first) if first and min(first) < turn else None
            far = False
            for wanted, able in ([[name], quotes.is_long(text)], *([s["set"], s["far"]] for s in sets)):
                far = far or (able and any(c != conv and holds((c, t), wanted) for c, t in told))
            if near is not None:
                near_of.append((level, at, near))
            n += near is not None or far
        links[conv, turn] = n
        if near_of:
            parent[conv, turn] = min(near_of)[2]
    out = {}
    for conv, turn in told:
        root, depth = turn, 0
        while (conv, root) in parent:
            root, depth = parent[conv, root], depth + 1
        out[conv, turn] = (links[conv, turn], parent.get((conv, turn)), root, depth)
    return out


def test_quotes_by_brute_force(spark):
    rng = random.Random(8)
    word = lambda: rng.choice(["Yes", "maps", "bridge", "Friday", "letter", "agreed", "please", "we", "bring"])
    line = lambda: " ".join(word() for _ in range(rng.randint(1, 6)))
    rows, common = [], "a passage that everybody quotes"
    for conv in range(40):
        said = []
        for turn in range(rng.randint(1, 14)):
            own = [line() for _ in range(rng.randint(1, 3))]
            if rng.random() < 0.2:
                own.insert(1, "")
            lines = []
            if conv == 0 and turn == 0:
                own.append(common)
            elif rng.random() < 0.3:
                lines.append(f"> {common}")
            if said and rng.random() < 0.7:
                lines += [f"{'>' * rng.randint(1, 3)} {x}" for x in rng.choice(said)[: rng.randint(1, 3)]]
            rows.append((conv, turn, "\n".join(lines + own)))
            said.append(own)
    rows += [(99, t, f"> step number {t - 1} of the way\nstep number {t} of the way") for t in range(60)]  # a long thread
    rows += [(200 + k, 0, f"> {common}\nthe answer of {k}") for k in range(2000)]
    rows.append((98, 0, "> long " * 1 + "word " * 60000 + "\nshort"))
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, text string").withColumns({c: quotes.F.lit(1) for c in ("mid", "own", "hash", "conv", "said", "thread")})
    got = quotes.linked_conversations(df).select("_row.conv_id", quotes.F.col("_row.turn").alias("at"), "n_linked", "parent_turn", "thread", "depth").collect()
    few = [r for r in rows if r[0] < 210]
    want = linked_by_brute_force(few)
    have = {(r.conv_id, r["at"]): (r.n_linked, r.parent_turn, r.thread, r.depth) for r in got}
    assert len(have) == len(rows) and {k: have[k] for k in want} == want
    assert all(have[200 + k, 0] == (1, None, 0, 0) for k in range(2000)) and have[99, 59] == (1, 58, 0, 59)


def ppm(texts, lang, order=3):
    """Probability of a byte after three others under one language, straight from the definition, for texts of fewer than 128 different bytes."""
    import collections

    counts, totals = collections.Counter(), collections.Counter()
    for name, text in texts:
        data = bytes(order) + text.encode()
        for k in range(order, len(data)):
            for o in range(order + 1):
                counts[name, data[k - o : k], data[k]] += 1
                totals[data[k - o : k]] += 1
    alphabet = sorted({b for _, t in texts for b in t.encode()})
    rest = 256 - len(alphabet)

    def distribution(context):
        if len(context) == 0:
            below = dict.fromkeys(alphabet, 1 / 256) | {None: rest / 256}
        else:
            below = distribution(context[1:])
            if totals[context] < langid.LEAST_COUNT:
                return below
        n = {s: counts[lang, context, s] if s is not None else 0 for s in below}
        total, distinct = sum(n.values()), sum(v > 0 for v in n.values())
        if not total:
            return below
        unseen = sum(p for s, p in below.items() if not n[s])
        p = {s: v / (total + distinct) if v else distinct / (total + distinct) * below[s] / unseen for s, v in n.items()}
        whole = sum(p.values())
        return {s: v / whole for s, v in p.items()}

    def probability(context, byte):
        known = distribution(bytes(b if b in alphabet else 0 for b in context))  # other bytes are one symbol in contexts
        return known[byte] if byte in alphabet else known[None] / rest

    return probability


def test_code_lengths_by_the_definition(spark):
    import math

    texts = [("x", "abracadabra cad"), ("x", "abc abd bra"), ("y", "zebra crab"), ("y", "cab zeb zeb")] * 2
    # no id is held out, so that all of them are learned from
    ids = [k for k in range(100) if zlib.crc32(str(k).encode()) % 3 != 1]
    docs = spark.createDataFrame([(i, t, lang) for i, (lang, t) in zip(ids, texts, strict=False)], "doc_id bigint, text string, lang string")
    model = langid.train(docs)
    for probe in ("abrazeb", "qq crab", "zebra"):
        bits = model.code_lengths([probe.encode()])[0]
        for k, lang in enumerate(model.langs):
            at, data = ppm(texts, lang), bytes(3) + probe.encode()
            assert bits[k] == pytest.approx(sum(-math.log2(at(data[j - 3 : j], data[j])) for j in range(3, len(data))), rel=1e-3)


def test_frequent_words_of_the_corpus(spark):
    df = spark.createDataFrame([(1, "zqxa zqxb zqxa"), (2, None), (3, " zqxa  zqxb zqxc")], "doc_id bigint, text string")
    assert bpe.frequent_words(df, "text", 4) == [" zqxa", " zqxb"] and bpe.frequent_words(df, "text", 3) == [" zqxa"]
    assert bpe.frequent_words(df.limit(0), "text") == []


def test_both_splits_agree():
    import regex

    wide, rng = regex.compile(bpe.PATTERN), random.Random(9)
    for k in range(256):
        assert wide.findall(f"a{chr(k)}1 {chr(k)}") == bpe.NARROW.findall(f"a{chr(k)}1 {chr(k)}"), k
    for _ in range(3000):
        text = "".join(chr(rng.choice((rng.randrange(256), rng.choice(b" \n\t'stdl19aZ")))) for _ in range(rng.randint(1, 40)))
        assert wide.findall(text) == bpe.NARROW.findall(text), text


def test_empty_tables_and_clashing_columns(spark, tmp_path):
    rows = [(1, "the old bridge of the town", "en", "s"), (None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").withColumns({c: quotes.F.lit(0) for c in ("ids", "decoded", "_row", "able", "h", "digest", "items", "spans", "n", "base", "score", "_w")})
    for name, some in (("some", docs), ("none", docs.limit(0))):
        some.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        for op in (langid, pii, bpe, media):
            assert op.query(spark, f"{tmp_path}/{name}").count() == (2 if name == "some" else 0), (op.__name__, name)
