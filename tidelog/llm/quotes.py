"""Chat formatting by quotation linking.

Messages are parsed line by line: ``>`` marks at the start of a line give its
quote level, nested levels included; lines of one level that follow each other
make a passage. A passage is normalised (case, punctuation and white space
folded) and hashed. What a message says itself is hashed likewise: as a whole,
by paragraph and by line. A passage is said by a message if its hash is among
those, or if all its lines, or all its paragraphs, are. Each quoted passage is
joined to the message that said it: the first one in its conversation, before
the quoting one, or else the first one anywhere in the corpus. Both sides are
reduced to one row a hash before they join, so a passage that many messages
quote or say costs no pairs. Passages of several pieces are reduced to one row
a set of pieces, and meet the messages that say their rarest piece; of messages
that say the same, only the first one takes part.

A message replies to the message that its outermost linked passage quotes, in
its own conversation; a thread is all that replies, directly or not, to one
message (pointer doubling over replies). Ordered by (conv_id, thread, turn) the
messages form reply-ordered conversations, with quotes and their attribution
lines removed.

Defined results: a null text has no passages and stays null. Null conversations
or turns take no part in links. A message that quotes itself, or a later turn,
is not linked to it. Repeated rows and ties are linked alike, each on its own;
the first of equals is the least (conv_id, turn). An empty table gives an empty
table; extra columns pass through ``_row``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.llm.common import cut, free, map_arrow

_MARKS = regex.compile(r"^(?:[ \t]{0,3}>)++[ \t]?")
_ATTRIBUTION = regex.compile(r"(?i)^\s*(?:on\b.*\bwrote|am\b.*\bschrieb\b.*|le\b.*\ba écrit|el\b.*\bescribió|.{1,80}\b(?:wrote|said))\s*:\s*$")
_BLANK = regex.compile(r"\n[ \t\r]*\n")
_FOLD = regex.compile(r"[\p{P}\p{S}\s]++")
#: passages of fewer characters are linked in their own conversation only; so are those whose pieces are all shorter
LEAST_CHARS = 12


def normal(text: str) -> str:
    return _FOLD.sub(" ", text.casefold()).strip()


def passage_hash(text: str) -> bytes | None:
    folded = normal(text)
    return hashlib.blake2b(folded.encode(), digest_size=16).digest() if folded else None


def is_long(text: str) -> bool:
    return len(normal(text)) >= LEAST_CHARS


def piece_sets(text: str) -> list[dict]:
    """The hashes of a passage's lines and of its paragraphs, where there are several, and whether a piece is long."""
    found = {}
    for pieces in (text.split("\n"), _BLANK.split(text)):
        hashes = sorted({h for p in pieces if (h := passage_hash(p))})
        if len(hashes) > 1:
            found[tuple(hashes)] = any(map(is_long, pieces))
    return [{"set": list(hashes), "far": far} for hashes, far in found.items()]


def parse(text: str | None) -> tuple[str | None, list[tuple[int, str]]]:
    """What a message says itself, and its quoted passages as (level, text) in order."""
    if text is None:
        return None, []
    own, quoted, level, held = [], [], 0, []
    for line in text.split("\n"):
        marks = _MARKS.match(line)
        depth = marks[0].count(">") if marks else 0
        if depth != level:
            if level:
                quoted.append((level, "\n".join(held)))
            elif depth and held and _ATTRIBUTION.match(held[-1]):
                own.pop()
            level, held = depth, []
        rest = line[marks.end() :] if marks else line
        held.append(rest)
        if not depth:
            own.append(line)
    if level:
        quoted.append((level, "\n".join(held)))
    said = "\n".join(own)
    return (said.strip("\n") if quoted else text), quoted


def said_hashes(own: str | None) -> list[bytes]:
    if not own:
        return []
    pieces = dict.fromkeys([own, *_BLANK.split(own), *own.split("\n")])
    return list(dict.fromkeys(h for p in pieces if (h := passage_hash(p))))


def parsed(messages: DataFrame) -> DataFrame:
    """``_row``, mid (names the row), conv, turn, own (text without quotes), quoted (level, hash, long, text, sets of pieces), said (hashes)."""
    packed = messages.select(
        F.struct(*[messages[c] for c in messages.columns]).alias("_row"),
        messages["conv_id"].cast("long").alias("conv"),
        messages["turn"].cast("long").alias("turn"),
        messages["text"].alias("_text"),
    )
    schema = T.StructType([*packed.schema.fields[:3], *T._parse_datatype_string("own string, quoted array<struct<level:int,hash:binary,long:boolean,text:string,sets:array<struct<set:array<binary>,far:boolean>>>>, said array<binary>").fields])
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [to_arrow_type(f.dataType) for f in schema.fields[3:]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                got = [parse(t) for t in batch.column(3).to_pylist()]
                quoted = [[{"level": k, "hash": passage_hash(q), "long": is_long(q), "text": q, "sets": piece_sets(q)} for k, q in quotes] for _, quotes in got]
                said = [said_hashes(own) for own, _ in got]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), *[pa.array(v, k) for v, k in zip(([o for o, _ in got], quoted, said), kinds, strict=True)]], schema.names)

    return map_arrow(packed, run, schema)


def _firsts(said: DataFrame, key: str) -> DataFrame:
    """(key, first, second): the first (conv, said_turn) of each key, and the first one of another conversation."""
    at = said.select(key, F.struct("conv", "said_turn").alias("at"))
    first = at.groupBy(key).agg(F.min("at").alias("first"))
    second = at.join(first, key).filter(F.col("at.conv") != F.col("first.conv")).groupBy(key).agg(F.min("at").alias("second"))
    return first.join(second, key, "left")


def _said_in_pieces(keyed: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The first message that says all pieces of a set: (conv, set, set_turn) in the conversation, and (set, set_first, set_second) in the corpus, in two conversations."""
    sets = cut(sets)
    known = sets.select(F.explode("set").alias("hash")).distinct()
    # messages of a conversation that say the same are one, the first
    own = keyed.filter("size(said) > 0").select("conv", "turn", F.xxhash64("said").alias("whole"), "said")
    first = own.groupBy("conv", "whole").agg(F.min("turn").alias("turn"))
    said = own.join(first, ["conv", "whole", "turn"], "left_semi").select("conv", "whole", "turn", F.explode("said").alias("hash"))
    said = cut(said.join(known, "hash", "left_semi").distinct())

    def matched(said: DataFrame, wanted: DataFrame, scope: list[str]) -> DataFrame:
        """The messages (by ``scope`` and whole) that say all of a set."""
        name = [*scope, "set"]
        often = said.groupBy(*scope, "hash").agg(F.count(F.lit(1)).alias("df"))
        counted = wanted.select(*name, F.explode("set").alias("hash")).join(often, [*scope, "hash"])
        rare = counted.groupBy(*name).agg(F.min(F.struct("df", "hash")).alias("rare"), F.count(F.lit(1)).alias("c")).filter(F.col("c") == F.size("set"))
        met = rare.select(*name, F.col("rare.hash").alias("hash")).join(said, [*scope, "hash"]).select(*name, "whole", F.explode("set").alias("hash"))
        held = met.join(said, [*scope, "whole", "hash"], "left_semi")
        return held.groupBy(*name, "whole").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") == F.size("set")).drop("k")

    in_conv = matched(said, sets.select("conv", "set").distinct(), ["conv"]).join(first, ["conv", "whole"])
    in_conv = in_conv.groupBy("conv", "set").agg(F.min("turn").alias("set_turn"))
    anywhere = matched(said.select("whole", "hash").distinct(), sets.filter("far").select("set").distinct(), [])
    firsts = _firsts(first.withColumnRenamed("turn", "said_turn"), "whole")
    both = anywhere.join(firsts, "whole").select("set", F.explode(F.array("first", "second")).alias("at")).filter("at IS NOT NULL").select("set", "at.conv", "at.said_turn")
    anywhere = _firsts(both, "set").withColumnsRenamed({"first": "set_first", "second": "set_second"})
    tables = cut(in_conv), cut(anywhere)
    free(sets, said)
    return tables


def linked_conversations(messages: DataFrame) -> DataFrame:
    """One row a message: ``_row``, own, n_quotes, n_linked, parent_turn, thread, depth."""
    # the text a message says itself is kept beside its row only where quotes were taken out of it
    slim = F.transform("quoted", lambda q: q.dropFields("text"))
    every = cut(parsed(messages).withColumn("own", F.when(F.size("quoted") > 0, F.col("own"))).withColumn("quoted", slim))
    keyed = every.filter("conv IS NOT NULL AND turn IS NOT NULL")
    wanted = keyed.select("conv", "turn", F.posexplode("quoted").alias("at", "q")).select("conv", "turn", "at", "q.level", "q.hash", "q.long", "q.sets").filter("hash IS NOT NULL").distinct()
    wanted = cut(wanted)
    hashes = wanted.groupBy("hash").agg(F.max("long").alias("long"))
    # only passages that somebody quotes are kept of what is said, one row a conversation and hash
    said = cut(keyed.select("conv", "turn", F.explode("said").alias("hash")).join(hashes, "hash").groupBy("conv", "hash", "long").agg(F.min("turn").alias("said_turn")))
    corpus = _firsts(said.filter("long"), "hash")
    near = wanted.join(said.drop("long"), ["conv", "hash"], "left")
    links = near.join(corpus, "hash", "left")
    pieces = wanted.select("conv", "turn", "at", "hash", F.inline("sets"))
    in_conv, anywhere = _said_in_pieces(keyed, pieces.select("conv", "set", "far").distinct())
    found = pieces.join(in_conv, ["conv", "set"], "left").join(anywhere, "set", "left")
    found = found.groupBy("conv", "turn", "at", "hash").agg(F.min("set_turn").alias("set_turn"), *[F.min(F.when(F.col("far") & (F.col(f"set_{c}.conv") != F.col("conv")), F.col(f"set_{c}"))).alias(f"set_{c}") for c in ("first", "second")])
    links = links.join(found, ["conv", "turn", "at", "hash"], "left").withColumn("said_turn", F.least("said_turn", "set_turn"))
    links = links.withColumn("near", F.when(F.col("said_turn") < F.col("turn"), F.col("said_turn")))
    other = [F.when(F.col(f"{c}.conv") != F.col("conv"), F.col(c)) for c in ("first", "second")]
    links = links.withColumn("far", F.when(F.col("near").isNull(), F.least(*other, "set_first", "set_second")))
    found = F.col("near").isNotNull() | F.col("far").isNotNull()
    per = cut(
        links.groupBy("conv", "turn").agg(
            F.count(F.when(found, 1)).alias("n_linked"),
            F.min(F.when(F.col("near").isNotNull(), F.struct("level", "at", "near")))["near"].alias("parent_turn"),
        )
    )
    free(wanted, said, in_conv, anywhere)
    # follow replies to the message that opened the thread
    up = cut(per.filter("parent_turn IS NOT NULL").select("conv", "turn", F.col("parent_turn").alias("root"), F.lit(1).cast("long").alias("depth")))
    moved = bool(up.take(1))
    while moved:
        above = up.select(F.col("conv").alias("c"), F.col("turn").alias("t"), F.col("root").alias("next"), F.col("depth").alias("more"))
        step = cut(
            up.join(above, (up["conv"] == above["c"]) & (up["root"] == above["t"]), "left").select(
                "conv", "turn", F.coalesce("next", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("next").isNotNull().alias("moved")
            )
        )
        free(up)
        up, moved = step, bool(step.filter("moved").take(1))
    told = per.join(up.select("conv", "turn", "root", "depth"), ["conv", "turn"], "left")
    # messages without quotes reply to nothing: their texts do not move
    quoting = every.filter("size(quoted) > 0").join(told, ["conv", "turn"], "left")
    plain = every.filter("size(quoted) = 0").withColumn("own", F.col("_row.text"))
    whole = quoting.unionByName(plain, allowMissingColumns=True)
    return whole.select(
        "_row",
        "own",
        F.size("quoted").cast("long").alias("n_quotes"),
        F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
        "parent_turn",
        F.coalesce("root", "turn").alias("thread"),
        F.coalesce("depth", F.lit(0)).cast("long").alias("depth"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linked_conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return found.select("_row.conv_id", "_row.turn", "_row.role", "n_quotes", "n_linked", "parent_turn", "thread", "depth", F.col("own").alias("text"))
