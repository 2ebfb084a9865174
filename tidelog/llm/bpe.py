"""Byte-level BPE by a minimal acyclic transducer lexicon.

``compile_lexicon`` turns frequent words (those that make up one word in
``FREQUENT_WORDS`` or more of the corpus, counted over all of it, and the entries of the tokenizer's own
vocabulary) into one file: a shared-suffix automaton whose paths number the
words, the ids that each numbered word is encoded as, and the merge table. The
file's size is bounded by the vocabulary and that number. It reaches executors with
``SparkContext.addFile``, is memory-mapped there, and words outside the lexicon
are merged exactly by the merge table. Both ways give the ids of the tokenizer.

``encode`` adds the ids and the text decoded from them. Defined results: a null
or empty text has no ids and decodes to the empty string; the special token's
string in a text becomes its id, as the tokenizers library has it; null ids of
documents, ties and repeated rows are handled row by row; an empty table gives
an empty table; extra columns pass through. Words of any length are merged in
n log n steps; short ones are merged in NumPy, many at once. A worker remembers words up to ``MEMORY_WORDS`` and then starts
afresh, so memory is bounded and results do not depend on it.
"""

from __future__ import annotations

import heapq
import json
import mmap
import os
import re
import struct
import tempfile
from array import array
from collections.abc import Iterable, Iterator
from itertools import filterfalse

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.llm.common import cut, documents, free, map_arrow

#: The byte-level pre-tokenizer's pattern (fixed value of the public vocabulary format).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: The same for texts of code points below 256, with the classes written out, for the faster of two regex engines.
_LETTER, _NUMBER, _WHITE = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
NARROW = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^{_WHITE}{_LETTER}{_NUMBER}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+")
MEMORY_WORDS = 400_000
#: the corpus's words that go into the lexicon: those that make up one in so many, or more, so at most so many; ids do not depend on it
FREQUENT_WORDS = 20_000
BATCH_ROWS = 256
#: characters whose words a worker looks up together
TOGETHER = 1 << 20
_MAGIC = b"TLEX0001"
_NONE = 1 << 40


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Merger:
    """Exact byte-pair merging: the pair of lowest rank first, the leftmost of equals."""

    def __init__(self, byte_ids: list[int], ranks: dict[int, int], made: list[int]):
        self.byte_ids, self.ranks, self.made = byte_ids, ranks, made
        self._keys: np.ndarray | None = None

    def __call__(self, word: bytes) -> list[int]:
        ids = list(map(self.byte_ids.__getitem__, word))
        return self._short(ids) if len(ids) <= 64 else self._long(ids)

    def many(self, words: list[bytes]) -> list[bytes]:
        """The packed ids of each word: words of like length are merged together, one pair a word and step."""
        out: list[bytes] = [b""] * len(words)
        by: dict[int, list[int]] = {}
        for k, word in enumerate(words):
            by.setdefault(0 if len(word) > 64 else len(word) + 3 & ~3, []).append(k)
        for k in by.pop(0, ()):
            out[k] = array("i", self(words[k])).tobytes()
        for width, places in by.items():
            raw = b"".join(words[k].ljust(width, b"\0") for k in places)
            sizes = np.array([len(words[k]) for k in places])
            ids, lengths = self._together(np.frombuffer(raw, np.uint8).reshape(-1, width), sizes)
            ends = (4 * np.cumsum(lengths)).tolist()
            packed = ids[np.arange(width) < lengths[:, None]].astype("<i4").tobytes()
            for k, start, end in zip(places, [0, *ends], ends, strict=False):
                out[k] = packed[start:end]
        return out

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
        return np.where(self._keys[at] == key, self._order[at], _NONE)

    def _together(self, raw: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self._keys is None:
            keys = np.array([*self.ranks.keys(), -1], np.int64)
            order = np.argsort(keys)
            self._keys, self._order = keys[order], np.array([*self.ranks.values(), _NONE], np.int64)[order]
            self._made, self._of = np.array([*self.made, 0], np.int64), np.array(self.byte_ids, np.int64)
            self._pairs = self._ranks(np.repeat(self._of, 256), np.tile(self._of, 256))
        m, width = raw.shape
        column = np.arange(width)
        done, lengths = self._of[raw], sizes.copy()
        # the rank of a place is that of it and the next one
        ranks = np.full((m, width), _NONE)
        ranks[:, :-1] = self._pairs[raw[:, :-1].astype(np.int64) << 8 | raw[:, 1:]]
        ranks[column >= sizes[:, None] - 1] = _NONE
        live, ids = np.arange(m), done
        while len(live):
            at = ranks.argmin(1)
            best = ranks[np.arange(len(live)), at]
            going = best < _NONE
            if not going.all():
                done[live[~going]] = ids[~going]
                live, ids, ranks, at, best = live[going], ids[going], ranks[going], at[going], best[going]
                if not len(live):
                    break
            rows = np.arange(len(live))
            lengths[live] -= 1
            left = lengths[live]
            after = np.minimum(column + (column > at[:, None]), width - 1)
            ids, ranks = np.take_along_axis(ids, after, 1), np.take_along_axis(ranks, after, 1)
            ids[rows, at] = self._made[best]
            ranks[rows, left - 1] = _NONE
            for first, able in ((at, at + 1 < left), (at - 1, at > 0)):
                r, f = rows[able], first[able]
                ranks[r, f] = self._ranks(ids[r, f], ids[r, f + 1])
        return done, lengths

    def _short(self, ids: list[int]) -> list[int]:
        get, made, none = self.ranks.get, self.made, 1 << 40
        ranks = [get(a << 32 | b, none) for a, b in zip(ids, ids[1:], strict=False)]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            k = ranks.index(best)
            ids[k : k + 2] = [made[best]]
            del ranks[k]
            if k:
                ranks[k - 1] = get(ids[k - 1] << 32 | ids[k], none)
            if k < len(ranks):
                ranks[k] = get(ids[k] << 32 | ids[k + 1], none)
        return ids

    def _long(self, ids: list[int]) -> list[int]:
        n, get = len(ids), self.ranks.get
        after, before, dead = list(range(1, n + 1)), list(range(-1, n - 1)), bytearray(n)
        heap = [(r, k, ids[k], ids[k + 1]) for k in range(n - 1) if (r := get(ids[k] << 32 | ids[k + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, k, a, b = heapq.heappop(heap)
            nxt = after[k]
            if dead[k] or nxt >= n or ids[k] != a or ids[nxt] != b:
                continue
            ids[k], dead[nxt], after[k] = self.made[rank], 1, after[nxt]
            if after[k] < n:
                before[after[k]] = k
            for left in (before[k], k):
                if left >= 0 and (right := after[left]) < n and (r := get(ids[left] << 32 | ids[right])) is not None:
                    heapq.heappush(heap, (r, left, ids[left], ids[right]))
        return [x for k, x in enumerate(ids) if not dead[k]]


def minimal_automaton(words: list[bytes]) -> tuple[list[list[tuple[int, int]]], list[bool]]:
    """The minimal acyclic automaton of sorted distinct words: edges and final marks of each state, state 0 the start."""
    edges: list[dict[int, int]] = [{}]
    final = [False]
    register: dict[tuple, int] = {}
    path: list[tuple[int, int]] = []  # (parent, label) of the states not yet shared
    last = b""

    def share(down_to: int) -> None:
        while len(path) > down_to:
            parent, label = path.pop()
            child = edges[parent][label]
            key = (final[child], tuple(edges[child].items()))
            edges[parent][label] = register.setdefault(key, child)

    for word in words:
        same = 0
        while same < min(len(word), len(last)) and word[same] == last[same]:
            same += 1
        share(same)
        state = edges[path[-1][0]][path[-1][1]] if path else 0
        for label in word[same:]:
            edges.append({})
            final.append(False)
            edges[state][label] = len(edges) - 1
            path.append((state, label))
            state = len(edges) - 1
        final[state] = True
        last = word
    share(0)
    number, order, stack = {0: 0}, [0], [0]
    while stack:
        for child in edges[stack.pop()].values():
            if child not in number:
                number[child] = len(order)
                order.append(child)
                stack.append(child)
    return [[(label, number[child]) for label, child in sorted(edges[s].items())] for s in order], [final[s] for s in order]


def compile_lexicon(tokenizer: str, target: str, extra_words: Iterable[str] = ()) -> None:
    """Writes the lexicon of a byte-level BPE tokenizer file (tokenizers JSON) to ``target``."""
    with open(tokenizer, encoding="utf-8") as f:
        spec = json.load(f)
    vocab, alphabet = spec["model"]["vocab"], byte_alphabet()
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    token_bytes = {i: bytes(alphabet[c] for c in t) if t not in special else t.encode() for t, i in vocab.items()}
    token_bytes |= {i: t.encode() for t, i in special.items()}
    pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
    table = [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs]
    byte_ids = [0] * 256
    for c, b in alphabet.items():
        byte_ids[b] = vocab[c]
    merger = Merger(byte_ids, {a << 32 | b: rank for rank, (a, b, _) in enumerate(table)}, [new for _, _, new in table])
    splits = regex.compile(PATTERN)
    words = {w for i, w in token_bytes.items() if i not in special.values()}
    words = {w for w in words if (t := w.decode("utf-8", "replace")).encode() == w and splits.findall(t) == [t]}
    words |= {w.encode() for w in extra_words if splits.findall(w) == [w]}
    ordered = sorted(words)
    states, final = minimal_automaton(ordered)
    below = [0] * len(states)  # words that end at or beyond a state
    seen, stack = set(), [(0, False)]
    while stack:
        s, ready = stack.pop()
        if ready:
            below[s] = final[s] + sum(below[t] for _, t in states[s])
        elif s not in seen:
            seen.add(s)
            stack += [(s, True), *((t, False) for _, t in states[s] if t not in seen)]
    first, labels, skip, to = [0], bytearray(), [], []
    for s, edges in enumerate(states):
        passed = int(final[s])
        for label, t in edges:
            labels.append(label)
            skip.append(passed)
            to.append(t)
            passed += below[t]
        first.append(len(to))
    outputs = [merger(w) for w in ordered]
    size = max(token_bytes) + 1
    texts = [token_bytes.get(i, b"") for i in range(size)]
    header = json.dumps({"special": special}).encode()
    columns = [
        np.array(first, "<u4"), np.frombuffer(bytes(labels), "u1"), np.array(skip, "<u4"), np.array(to, "<u4"), np.array(final, "u1"),
        np.cumsum([0, *map(len, outputs)]).astype("<u4"), np.array([i for o in outputs for i in o], "<u4"),
        np.array(byte_ids, "<u4"), np.array(table, "<u4").ravel(), np.cumsum([0, *map(len, texts)]).astype("<u4"), np.frombuffer(b"".join(texts), "u1"), np.frombuffer(header, "u1"),
    ]
    with open(target, "wb") as f:
        f.write(_MAGIC + struct.pack("<I", len(columns)))
        for c in columns:
            raw = c.tobytes()
            f.write(struct.pack("<Q", len(raw)) + raw + b"\0" * (-len(raw) % 4))


class Lexicon:
    """The memory-mapped lexicon: looks words up and merges those that it lacks."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        if self.map[:8] != _MAGIC:
            raise ValueError(f"{path} is no lexicon")
        view, at, spans = memoryview(self.map), 12, []
        for _ in range(struct.unpack_from("<I", self.map, 8)[0]):
            (n,) = struct.unpack_from("<Q", self.map, at)
            spans.append((at + 8, at + 8 + n))
            at += 8 + n + -n % 4
        ints = [view[a:b].cast("I") if k not in (1, 4, 10, 11) else None for k, (a, b) in enumerate(spans)]
        self.first, self.skip, self.to, self.ends, self.outputs = ints[0], ints[2], ints[3], ints[5], ints[6]
        self.labels, self.final = spans[1][0], view[slice(*spans[4])]
        rows = np.frombuffer(view[slice(*spans[8])], "<u4").reshape(-1, 3).tolist()
        self.merger = Merger(list(ints[7]), {a << 32 | b: rank for rank, (a, b, _) in enumerate(rows)}, [new for _, _, new in rows])
        texts, bounds = bytes(view[slice(*spans[10])]), list(ints[9])
        self.texts = [texts[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]
        self.special = json.loads(bytes(view[slice(*spans[11])]))["special"]
        self.by_special = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.splits = regex.compile(PATTERN)
        self.known: dict[str, bytes] = {}  # packed ids of the words that a worker has met

    def find(self, word: bytes) -> list[int] | None:
        state, number, first, find, base = 0, 0, self.first, self.map.find, self.labels
        for k in range(len(word)):
            edge = find(word[k : k + 1], base + first[state], base + first[state + 1]) - base
            if edge < 0:
                return None
            number += self.skip[edge]
            state = self.to[edge]
        return list(self.outputs[self.ends[number] : self.ends[number + 1]]) if self.final[state] else None

    def word(self, word: str) -> list[int]:
        raw = word.encode()
        found = self.find(raw)
        return self.merger(raw) if found is None else found

    def _split(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.splits.findall(text)
        return NARROW.findall(text)

    def learn(self, words: Iterable[str]) -> None:
        """Remembers the ids of words: those in the lexicon from there, the others merged together."""
        unseen = []
        for w in words:
            found = self.find(raw := w.encode())
            if found is None:
                unseen.append((w, raw))
            else:
                self.known[w] = array("i", found).tobytes()
        if unseen:
            self.known.update(zip([w for w, _ in unseen], self.merger.many([raw for _, raw in unseen]), strict=True))

    def _pieces(self, text: str) -> list[list[str] | int]:
        """The words between special tokens, and the ids of those."""
        if self.by_special is None or not self.by_special.search(text):
            return [self._split(text)]
        found, at = [], 0
        for m in self.by_special.finditer(text):
            found += [self._split(text[at : m.start()]), self.special[m[0]]]
            at = m.end()
        return [*found, self._split(text[at:])]

    def encode_many(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; the words of many texts, up to ``TOGETHER`` characters or one text, are looked up together."""
        out: list[np.ndarray] = []
        at = 0
        while at < len(texts):
            end, size = at + 1, len(texts[at])
            while end < len(texts) and size + len(texts[end]) <= TOGETHER:
                size += len(texts[end])
                end += 1
            if len(self.known) >= MEMORY_WORDS:
                self.known.clear()
            group = [self._pieces(t) for t in texts[at:end]]
            missing: set[str] = set()
            for pieces in group:
                for piece in pieces:
                    if not isinstance(piece, int):
                        missing.update(filterfalse(self.known.__contains__, piece))
            self.learn(missing)
            for pieces in group:
                packed = b"".join([array("i", [p]).tobytes() if isinstance(p, int) else b"".join(map(self.known.__getitem__, p)) for p in pieces])
                out.append(np.frombuffer(packed, np.int32))
            at = end
        return out

    def encode(self, text: str) -> np.ndarray:
        return self.encode_many([text])[0]

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.texts.__getitem__, ids.tolist())).decode("utf-8", "replace")


_open: dict[str, Lexicon] = {}


def lexicon_file(spark: SparkSession, tokenizer: str | None = None, extra_words: Iterable[str] = ()) -> str:
    """Compiles a lexicon on the driver and sends it to every executor; returns its name there."""
    folder = tempfile.mkdtemp(prefix="lexicon-")
    path = os.path.join(folder, f"{os.path.basename(folder)}.bin")
    compile_lexicon(tokenizer or default_tokenizer(), path, extra_words)
    spark.sparkContext.addFile(path)
    return os.path.basename(path)


def frequent_words(rows: DataFrame, text: str, most: int = FREQUENT_WORDS) -> list[str]:
    """The words between spaces, with the space before them, that make up at least one in ``most`` of the words of all texts."""
    counted = cut(rows.select(F.explode(F.split(rows[text], " ")).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")))
    total = counted.agg(F.sum("n")).first()[0] or 0
    found = counted.filter((F.col("n") * most >= total) & (F.col("w") != "")).select("w").collect()
    free(counted)
    return sorted(f" {r.w}" for r in found)


def encode(rows: DataFrame, text: str, keep: list[str], tokenizer: str | None = None, frequent: int = FREQUENT_WORDS) -> DataFrame:
    """``_row`` (the kept columns), ``ids`` array<int>, and ``decoded``, the text that the ids decode to."""
    name = lexicon_file(rows.sparkSession, tokenizer, frequent_words(rows, text, frequent))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _open:
            _open[name] = Lexicon(SparkFiles.get(name))
        lexicon = _open[name]
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH_ROWS):
                batch = whole.slice(at, BATCH_ROWS)
                ids = lexicon.encode_many([t or "" for t in batch.column(1).to_pylist()])
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int32())), pa.array([lexicon.decode(x) for x in ids], pa.string())],
                    ["_row", "ids", "decoded"],
                )

    packed = rows.select(F.struct(*[rows[c] for c in keep]).alias("_row"), rows[text].alias("_text"))
    schema = T.StructType([packed.schema["_row"], T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])
    return map_arrow(packed, run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode(documents(spark, sf_dir), "text", ["doc_id"])
    return coded.select(
        "_row.doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
