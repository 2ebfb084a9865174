"""Quality rules: a table of thresholds compiled into one Spark projection.

``QualityRules`` turns a table of ``Rule`` rows (metric, relation, threshold)
into one projection of length, symbol, stop-word, repetition and line metrics
and a verdict. Only built-in Spark functions are evaluated, so the whole
operator stays in the JVM and needs no shuffle.

Defined results: a null or empty text has no words, every count is 0,
``base_failed`` is true and ``kept`` is false. Null ids pass through. Repeated
rows are judged alike, one by one. An empty table gives an empty table. Extra
columns pass through ``filter`` unchanged, whatever their names.

Repeated three-word windows are found by sorting (64-bit hash, position)
structs inside the row, n log n in the words of a document.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.common import SPACE_CHARS, SPACES, documents, once

#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the of to and a in that is was for it with as on be at by this have from or an are not which but had "
    "le la les de des du un une et que qui pour dans est au par sur pas avec en "
    "der die das und den von zu mit sich auf ist im dem nicht ein eine als auch "
    "el los las del y por con para una su al lo como más se no"
).split()

SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """Rejects a document when ``metric relation threshold`` holds, over ``of`` where that is set (a ratio)."""

    name: str
    metric: str
    relation: str  # "<" or ">"
    threshold: float
    of: str | None = None

    def broken(self) -> Column:
        value = F.col(f"_q.{self.metric}").cast("double")
        bound = F.lit(float(self.threshold)) * F.col(f"_q.{self.of}").cast("double") if self.of else F.lit(float(self.threshold))
        return value < bound if self.relation == "<" else value > bound


BASE_RULES = (
    Rule("too_short", "n_words", "<", 50),
    Rule("repeats_itself", "n_repeat_words", ">", 0.5, "n_words"),
)

PRODUCTION_RULES = (
    *BASE_RULES,
    Rule("words_too_short", "word_chars", "<", 2.5, "n_words"),
    Rule("words_too_long", "word_chars", ">", 15, "n_words"),
    Rule("symbols", "n_symbols", ">", 0.25, "n_words"),
    Rule("few_stop_words", "n_stop_words", "<", 2),
    Rule("stop_word_ratio", "n_stop_words", "<", 0.01, "n_words"),
    Rule("duplicate_lines", "n_dup_lines", ">", 0.3, "n_lines"),
)


class QualityRules:
    def __init__(self, rules: tuple[Rule, ...] = PRODUCTION_RULES, stop_words: tuple[str, ...] | list[str] = STOP_WORDS):
        self.rules, self.stop_words = tuple(rules), list(stop_words)

    def metrics(self, rows: DataFrame, text: Column) -> DataFrame:
        """``rows`` as the struct ``_row`` and the metrics as the struct ``_q``."""
        first = rows.select(F.struct(*[rows[c] for c in rows.columns]).alias("_row"), F.coalesce(text, F.lit("")).alias("_t"))
        trimmed = F.trim(F.col("_t"), F.lit(SPACE_CHARS))
        words = once(first, _w=F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACES)))
        lines = F.filter(F.split("_t", "\n"), lambda x: F.trim(x, F.lit(SPACE_CHARS)) != "")
        hashed = F.when(
            F.size("_w") < 3,
            F.array().cast("array<struct<h:bigint,i:int>>"),
        ).otherwise(
            F.transform(
                F.sequence(F.lit(0), F.size("_w") - 3),
                lambda i: F.struct(F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2)).alias("h"), i.alias("i")),
            )
        )
        step = once(words, _s=F.sort_array(hashed), _l=lines)
        same = lambda a, b: F.get("_s", a)["h"] == F.get("_s", b)["h"]
        again = F.transform(
            F.filter(
                F.transform(F.col("_s"), lambda x, i: F.struct(x["i"].alias("i"), F.coalesce(same(i, i - 1), F.lit(False)).alias("p"), F.coalesce(same(i, i + 1), F.lit(False)).alias("n"))),
                lambda x: x["p"] | x["n"],
            ),
            lambda x: x["i"],
        )
        step = once(step, _p=again)
        shifted = lambda k: F.transform("_p", lambda x: x + k)
        length = F.char_length("_t").cast("long")
        return once(
            step,
            _q=F.struct(
                F.size("_w").cast("long").alias("n_words"),
                F.char_length(F.translate("_t", SPACE_CHARS, "")).cast("long").alias("word_chars"),
                (length - F.char_length(F.translate("_t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
                F.size("_l").cast("long").alias("n_lines"),
                (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
                F.when(F.size("_p") == 0, 0).otherwise(F.size(F.array_distinct(F.concat("_p", shifted(1), shifted(2))))).cast("long").alias("n_repeat_words"),
                F.size(F.filter("_w", lambda w: F.lower(w).isin(self.stop_words))).cast("long").alias("n_stop_words"),
            ),
        ).select("_row", "_q")

    def judge(self, rows: DataFrame, text: Column) -> DataFrame:
        """``_row``, ``_q``, and the structs' verdicts: ``_base_failed`` and ``_kept``."""
        base = [r.broken() for r in BASE_RULES]
        rest = [r.broken() for r in self.rules if r not in BASE_RULES]
        failed = base[0] | base[1]
        broken = failed
        for r in rest:
            broken = broken | r
        return once(self.metrics(rows, text), _base_failed=failed, _kept=~broken)

    def filter(self, rows: DataFrame, text: Column) -> DataFrame:
        """The rows that break no rule, columns unchanged."""
        return self.judge(rows, text).filter("_kept").select("_row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    judged = QualityRules().judge(docs, docs["text"])
    return judged.select("_row.doc_id", *[f"_q.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], F.col("_base_failed").alias("base_failed"), F.col("_kept").alias("kept"))


_STOP_SQL = ", ".join(f"'{w}'" for w in STOP_WORDS)

ORACLE_SQL = f"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), l AS (
  SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l,
    list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) AS g
  FROM t
), x AS (
  SELECT doc_id, unnest(g) AS g, unnest(range(1, len(g) + 1)) AS i FROM l
), y AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM x
), z AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM y, (SELECT unnest([0, 1, 2]) AS k) WHERE c > 1 GROUP BY doc_id
), m AS (
  SELECT l.doc_id, len(w)::BIGINT AS n_words,
    length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g'))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, len(l) AS n_lines,
    coalesce(z.n, 0)::BIGINT AS n_repeat_words,
    len(list_filter(w, lambda x: lower(x) IN ({_STOP_SQL}))) AS n_stop_words
  FROM l LEFT JOIN z ON l.doc_id = z.doc_id
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR word_chars < 2.5 * n_words OR word_chars > 15 * n_words
    OR n_symbols > 0.25 * n_words OR n_stop_words < 2 OR n_stop_words < 0.01 * n_words OR n_dup_lines > 0.3 * n_lines) AS kept
FROM m
"""
