"""Personal data by candidate gradient boosting, in built-in Spark functions.

Base spans (email, ip, card, phone) come from fixed patterns and checks.
High-recall generators then propose further, overlapping spans: written-out
email addresses, runs of digits that may be phone numbers, and long tokens that
may be secrets. Boosted trees score each candidate from its format and the words
around it; a calibrated threshold a generator selects redactions. Candidates
that overlap a base span, or a better candidate, go.

The trees are trained here, once a process, on a seeded set of made-up examples
(``EXAMPLES`` a generator and half); its features are computed by the very SQL
expressions that score documents, and the trees become one SQL expression.

Positions are code points, ends exclusive. Defined results: a null text counts
as empty and has no spans; null ids pass through; repeated rows are treated
alike; an empty table gives an empty table; extra columns pass through
``redact`` unchanged, whatever their names. Patterns use possessive repeats, so
texts of any length and shape are matched in linear time and constant stack.
"""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.boosting import BoostedTrees
from tidelog.llm.common import documents, once

KINDS = ("email", "ip", "card", "phone", "secret")

#: Java patterns equal to the base ones; look-behind and \G only skip starts that cannot match.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
BASE_NEEDS = {"email": "instr(_t, '@') > 0", "ip": "_digits", "card": "_digits", "phone": "instr(_t, '+') > 0"}
BASE_VALID = {
    "email": "true",
    "ip": r"x.m rlike '^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])(?:[.]|$)){4}$'",
    "card": """length(translate(x.m, ' -', '')) BETWEEN 16 AND 19 AND aggregate(
        transform(split(reverse(translate(x.m, ' -', '')), ''), (d, i) -> if(i % 2 = 0, int(d), if(int(d) > 4, 2 * int(d) - 9, 2 * int(d)))),
        0, (a, v) -> a + coalesce(v, 0)) % 10 = 0""",
    "phone": "length(regexp_replace(x.m, '[^0-9]', '')) BETWEEN 8 AND 15",
}

GENERATORS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{2,64}+(?:\x20?(?:\(at\)|\[at\])\x20?[A-Za-z0-9-]{2,64}+(?:\x20?(?:\.|\(dot\)|\[dot\]|\x20dot\x20)\x20?[A-Za-z]{2,24}+){1,4}+|\x20at\x20[A-Za-z0-9-]{2,64}+(?:\x20dot\x20[A-Za-z]{2,24}+){1,4}+)",
    "phone": r"(?<![0-9A-Za-z.])\(?[0-9](?:[\x20().\-/]{0,2}[0-9]){6,15}+(?![0-9A-Za-z])",
    "secret": r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{20,}+",
}
GENERATOR_NEEDS = {"email": "instr(_t, '(at)') > 0 OR instr(_t, '[at]') > 0 OR instr(_t, ' dot ') > 0", "phone": "_digits", "secret": "_digits"}

WORDS = {
    "phone": r"tel|phone|call|mobile|fax|whatsapp|sms|appel|anruf|llam|dial|contact",
    "mail": r"mail|contact|write|reach|address|correo|courriel|adresse",
    "secret": r"token|secret|passw|api|credential|bearer|private|auth|clave|clé|schlüssel",
    "other": r"order|invoice|isbn|version|page|date|id\b|no\.|sha|commit|md5|hash|checksum|build|serial|total|price|zip|ref|uuid|slug|http|www",
}
#: name -> SQL on the candidate x (m, before, after)
FEATURES = {
    "length": "double(length(x.m))",
    "digits": "double(length(regexp_replace(x.m, '[^0-9]', '')))",
    "uppers": "double(length(regexp_replace(x.m, '[^A-Z]', '')))",
    "lowers": "double(length(regexp_replace(x.m, '[^a-z]', '')))",
    "breaks": "double(length(regexp_replace(x.m, '[A-Za-z0-9]', '')))",
    "groups": "double(size(split(x.m, '[^A-Za-z0-9]+')))",
    "switches": "double(length(x.m) - length(regexp_replace(x.m, '(?<=[0-9])[A-Za-z]|(?<=[A-Za-z])[0-9]', '')))",
    "hex": "if(x.m rlike '^[0-9a-f]+$', 1D, 0D)",
    "marked": r"if(x.m rlike '[(\\[](?:at|dot)[)\\]]', 1D, 0D)",
    "assigned": "if(x.before rlike '[=:][ \"\\']*$', 1D, 0D)",
    "quoted": "if(x.before rlike '[\"\\']$' AND x.after rlike '^[\"\\']', 1D, 0D)",
    **{f"near_{k}": f"if(lower(x.before) rlike '{v}', 1D, 0D)" for k, v in WORDS.items()},
}
EXAMPLES = 900
PRECISION = 0.99
LEAST = 0.8


def _spans(pattern: str, needs: str, name: str) -> dict[str, Column]:
    """The matches and the pieces between them, where the cheap test holds."""
    none = F.array().cast("array<string>")
    found = F.expr(needs)
    return {
        f"_m_{name}": F.when(found, F.regexp_extract_all("_t", F.lit(pattern), F.lit(0))).otherwise(none),
        f"_p_{name}": F.when(found, F.split("_t", pattern, -1)).otherwise(none),
    }


def _placed(name: str, kind: str) -> Column:
    """Matches with positions and neighbouring text."""
    m, p = f"_m_{name}", f"_p_{name}"
    start = "named_struct('at', 0, 'out', cast(array() AS array<struct<kind:string,s:int,e:int,m:string,before:string,after:string>>))"
    return F.expr(
        f"""if(size({m}) = 0, cast(array() AS array<struct<kind:string,s:int,e:int,m:string,before:string,after:string>>),
        aggregate(sequence(0, size({m}) - 1), {start}, (a, i) -> named_struct(
          'at', a.at + length(get({p}, i)) + length(get({m}, i)),
          'out', array_append(a.out, named_struct('kind', '{kind}', 's', a.at + length(get({p}, i)), 'e', a.at + length(get({p}, i)) + length(get({m}, i)),
            'm', get({m}, i), 'before', right(get({p}, i), 40), 'after', left(get({p}, i + 1), 12)))), a -> a.out))"""
    )


def _example(rng: random.Random, kind: str) -> tuple[str, str, str, int]:
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rng.choice(["th", "er", "on", "an", "re", "ed", "en", "ou", "ti", "es", "st"]) for _ in range(rng.randint(1, 4)))
    prose = lambda n=3: " ".join(word() for _ in range(n))
    tail = rng.choice([" ", ".", ", ", "\n"]) + prose(1)
    if kind == "email":
        name, host = f"{word()}{rng.choice(['.', '_', ''])}{word()}", word() + word()
        if rng.random() < 0.5:
            at, dot = rng.choice([(" (at) ", " (dot) "), ("(at)", "(dot)"), (" [at] ", " [dot] "), ("[at]", "."), (" at ", " dot ")])
            return rng.choice(["email ", "contact: ", "write to ", prose() + " "]), f"{name}{at}{host}{dot}{rng.choice(['com', 'org', 'net', 'de', 'fr'])}", tail, 1
        at, dot = rng.choice([(" (at) ", ". "), (" [at] ", ". "), (" at ", " dot "), ("(at)", ". ")])
        return prose() + rng.choice([" look ", " the ", ". ", " meet "]), f"{word()}{at}{word()}{dot}{word().title()[:24]}", tail, 0
    if kind == "phone":
        shape = rng.choice(["(ddd) ddd-dddd", "ddd-ddd-dddd", "dddd ddddddd", "dd dd dd dd dd", "ddd.ddd.dddd", "dddd-dddddd", "ddd ddd ddd"])
        other = rng.choice(["dd-dd-dddd dd", "ddd-d-dd-dddddd-d", "dddddddddd", "dddd-dddd", "d.dddddddd", "dddd.dd.dd dd", "dddddddd", "dd/dd/dddd", shape])
        if rng.random() < 0.5:
            return prose(2) + " " + rng.choice(["tel ", "phone: ", "call me ", "mobile ", "Telefon ", "appel au ", "fax: ", "llame al "]), "".join(digits(1) if c == "d" else c for c in shape), tail, 1
        return prose(2) + " " + rng.choice(["order ", "isbn ", "invoice no. ", "version ", "page ", "", "", "total "]), "".join(digits(1) if c == "d" else c for c in other), tail, 0
    pool = rng.choice(["0123456789abcdef", "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"])
    token = "".join(rng.choice(pool) for _ in range(rng.choice([20, 24, 32, 40, 40, 64])))
    if rng.random() < 0.5:
        mark = rng.choice(['"', "'", ""])
        return f"{prose(2)} {rng.choice(['token', 'api_key', 'secret', 'password', 'auth token', 'private_key'])}{rng.choice([' = ', '=', ': '])}{mark}", token, mark + tail, 1
    return rng.choice(
        [
            (prose(2) + " ", "".join(word() for _ in range(8))[:60] + word() * 5, tail, 0),
            (prose(2) + " ", "-".join(word() for _ in range(6)) + "-and-more-2024", tail, 0),
            (prose(1) + " commit ", "".join(rng.choice("0123456789abcdef") for _ in range(40)), tail, 0),
            (prose(1) + " sha ", token, tail, 0),
            (prose(1) + " order ", digits(24), tail, 0),
            (prose(2) + " ", "_".join(word() for _ in range(7)) + "_value_of_it", tail, 0),
        ]
    )


_models: dict[str, tuple[BoostedTrees, float]] = {}


def models(spark: SparkSession) -> dict[str, tuple[BoostedTrees, float]]:
    """Each generator's trees and its threshold: the least calibrated probability with ``PRECISION`` on unseen examples, ``LEAST`` or more."""
    if not _models:
        rng = random.Random(71)
        rows = [(kind, k, *_example(rng, kind)) for kind in GENERATORS for k in range(EXAMPLES * 3 // 2)]
        table = spark.createDataFrame(rows, "kind string, k int, before string, m string, after string, y int")
        table = table.select("kind", "k", "y", F.struct(F.expr("right(before, 40)").alias("before"), "m", F.expr("left(after, 12)").alias("after")).alias("x"))
        got = table.select("kind", "k", "y", *[F.expr(sql).alias(name) for name, sql in FEATURES.items()]).collect()
        for kind in GENERATORS:
            own = sorted((r for r in got if r["kind"] == kind), key=lambda r: r["k"])
            x, y = np.array([[r[f] for f in FEATURES] for r in own]), np.array([float(r["y"]) for r in own])
            model = BoostedTrees().fit(x[:EXAMPLES], y[:EXAMPLES]).calibrate(x[EXAMPLES:], y[EXAMPLES:])
            p, seen = model.probability(x[EXAMPLES:]), y[EXAMPLES:]
            order = np.argsort(-p)
            good = np.flatnonzero(np.cumsum(seen[order]) / np.arange(1, len(order) + 1) >= PRECISION)
            _models[kind] = (model, max(LEAST, float(p[order][good[-1]])) if len(good) else 1.0)
    return _models


class PersonalData:
    """Finds spans; ``spans`` keeps them as arrays, ``redact`` replaces them in the text."""

    def spans(self, rows: DataFrame, text: Column) -> DataFrame:
        """``_row``, ``_t`` (the text), ``base`` and ``added``: arrays of (kind, s, e), base in order of kind and start."""
        first = rows.select(F.struct(*[rows[c] for c in rows.columns]).alias("_row"), F.coalesce(text, F.lit("")).alias("_t"))
        first = once(first, _digits=F.col("_t").rlike("[0-9]"))
        cols: dict[str, Column] = {}
        for kind in BASE:
            cols |= _spans(BASE[kind], BASE_NEEDS[kind], f"b_{kind}")
        for kind in GENERATORS:
            cols |= _spans(GENERATORS[kind], GENERATOR_NEEDS[kind], f"g_{kind}")
        cut_up = once(first, **cols)
        placed = once(cut_up, **{f"_b_{k}": _placed(f"b_{k}", k) for k in BASE}, _cand=F.concat(*[_placed(f"g_{k}", k) for k in GENERATORS]))
        checked = ", ".join(f"filter(_b_{k}, x -> {BASE_VALID[k]})" for k in BASE)
        placed = once(placed.select("_row", "_t", "_cand", *[f"_b_{k}" for k in BASE]), _base=F.expr(f"concat({checked})")).select("_row", "_t", "_base", "_cand")
        found = models(rows.sparkSession)
        free = F.expr("filter(_cand, x -> NOT exists(_base, b -> b.s < x.e AND x.s < b.e))")
        placed = once(placed, _free=free)
        features = ", ".join(f"'{k}', {v}" for k, v in FEATURES.items())
        scored = once(placed, _f=F.expr(f"transform(_free, x -> named_struct('kind', x.kind, 's', x.s, 'e', x.e, {features}))"))
        names = [f"f.{k}" for k in FEATURES]
        score = "CASE " + " ".join(f"WHEN f.kind = '{k}' THEN {m.sql(names)}" for k, (m, _) in found.items()) + " END"
        bound = "CASE " + " ".join(f"WHEN f.kind = '{k}' THEN {t!r}D" for k, (_, t) in found.items()) + " END"
        scored = once(scored, _s=F.expr(f"filter(transform(_f, f -> named_struct('kind', f.kind, 's', f.s, 'e', f.e, 'p', {score}, 't', {bound})), f -> f.p >= f.t)"))
        # from the best on, each that overlaps none kept so far; of equals the first, then the longest
        ranked = "array_sort(transform(_s, x -> named_struct('p', -x.p, 's', x.s, 'r', -x.e, 'kind', x.kind, 'e', x.e)))"
        kept = "aggregate(_r, cast(array() AS array<struct<kind:string,s:int,e:int>>), (a, x) -> if(exists(a, y -> y.s < x.e AND x.s < y.e), a, array_append(a, named_struct('kind', x.kind, 's', x.s, 'e', x.e))))"
        scored = once(scored, _r=F.expr(ranked))
        added = F.expr(kept)
        base = F.expr("transform(_base, x -> named_struct('kind', x.kind, 's', x.s, 'e', x.e))")
        return once(scored, base=base, added=added).select("_row", "_t", "base", "added")

    def redact(self, rows: DataFrame, text: str = "text") -> DataFrame:
        """``rows`` with each span of personal data in the text replaced by its kind in brackets; null texts stay null."""
        found = self.spans(rows, rows[text])
        # overlapping spans of several kinds become one, named by the first
        merged = F.expr(
            """aggregate(array_sort(concat(transform(base, x -> named_struct('s', x.s, 'e', x.e, 'kind', x.kind)), transform(added, x -> named_struct('s', x.s, 'e', x.e, 'kind', x.kind)))),
            cast(array() AS array<struct<s:int,e:int,kind:string>>),
            (a, x) -> if(size(a) > 0 AND x.s < get(a, size(a) - 1).e,
              array_append(slice(a, 1, size(a) - 1), named_struct('s', get(a, size(a) - 1).s, 'e', greatest(get(a, size(a) - 1).e, x.e), 'kind', get(a, size(a) - 1).kind)),
              array_append(a, x)))"""
        )
        found = once(found, _cuts=merged)
        clean = F.expr(
            """if(size(_cuts) = 0, _t, concat(
            array_join(transform(_cuts, (x, i) -> concat(substring(_t, coalesce(get(_cuts, i - 1).e, 0) + 1, x.s - coalesce(get(_cuts, i - 1).e, 0)), '[', upper(x.kind), ']')), ''),
            substring(_t, get(_cuts, size(_cuts) - 1).e + 1)))"""
        )
        shown = F.when(F.col("_row")[text].isNotNull(), clean)
        return found.select(*[(shown if c == text else F.col("_row")[c]).alias(c) for c in rows.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = PersonalData().spans(docs, docs["text"])
    joined = "array_join(transform({}, x -> concat(x.kind, ':', x.s, ':', x.e)), ',')"
    rank = "CASE kind " + " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(KINDS)) + " END"
    ordered = F.expr(f"array_sort(transform(concat(base, added), x -> named_struct('r', {rank.replace('kind ', 'x.kind ', 1)}, 's', x.s, 'e', x.e, 'kind', x.kind)))")
    out = once(found, _all=ordered)
    counts = [F.expr(f"bigint(size(filter(base, x -> x.kind = '{k}')))").alias(f"n_{k}") for k in BASE]
    return out.select("_row.doc_id", *counts, F.sha2(F.expr(joined.format("base")), 256).alias("base_sha256"), F.expr(joined.format("_all")).alias("spans"), F.size("_all").cast("bigint").alias("n_spans"))
