"""Media columns as interleaved document sequences.

``interleave`` parses HTML into ordered structs of text and media references:
position, kind, text, reference, alternative text and caption. A figure's
caption stays with its image, and positions count text and media alike.
``resolve`` joins references to a media table by digest; that table holds each
payload once, so the join is many-to-one and Spark may split a hot digest's
references over tasks.

``store`` keeps payloads losslessly as 8-bit grey PNG images, 64 samples a row,
and ``read_back`` decodes the stored bytes and computes features from what it
read: samples, mean, deviation, entropy, roughness and a 16-bin histogram.

Defined results: a null text is empty and its payload 64 zero bytes. Null HTML
has no items. Malformed HTML is parsed as far as it goes, unclosed elements
included, and marked sections are text; scripts and styles hold no text. References without a payload resolve
to nulls. Repeated rows share a payload; equal texts give equal values. An empty
table gives an empty table; extra columns pass through ``interleave``.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.llm.common import cut, documents, map_arrow

SAMPLES = 64
_PNG = b"\x89PNG\r\n\x1a\n"
_BREAKS = {"p", "div", "br", "li", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "article", "section", "figure", "figcaption", "table", "tr", "nav", "footer", "header", "blockquote", "pre"}
_MEDIA = {"img", "video", "audio", "source", "embed"}
ITEM = "array<struct<position:int,kind:string,text:string,ref:string,alt:string,caption:string>>"


def padded(raw: bytes) -> bytes:
    return raw + bytes(SAMPLES - len(raw) % SAMPLES if len(raw) % SAMPLES or not raw else 0)


def to_png(payload: bytes) -> bytes:
    rows = np.frombuffer(payload, np.uint8).reshape(-1, SAMPLES)
    lines = np.zeros((len(rows), SAMPLES + 1), np.uint8)  # each line begins with filter 0
    lines[:, 1:] = rows
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    header = struct.pack(">IIBBBBB", SAMPLES, len(rows), 8, 0, 0, 0, 0)
    return _PNG + chunk(b"IHDR", header) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 3)) + chunk(b"IEND", b"")


def from_png(media: bytes) -> bytes:
    if media[:8] != _PNG:
        raise ValueError("not a PNG")
    at, packed, height = 8, [], 0
    while at < len(media):
        (n,) = struct.unpack_from(">I", media, at)
        kind, data = media[at + 4 : at + 8], media[at + 8 : at + 8 + n]
        if zlib.crc32(kind + data) != struct.unpack_from(">I", media, at + 8 + n)[0]:
            raise ValueError("damaged PNG")
        if kind == b"IHDR":
            width, height, depth, colour = struct.unpack_from(">IIBB", data)
            if (width, depth, colour) != (SAMPLES, 8, 0):
                raise ValueError("not a payload's PNG")
        elif kind == b"IDAT":
            packed.append(data)
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, SAMPLES + 1)
    return lines[:, 1:].tobytes()


def features(payload: bytes) -> str:
    x = np.frombuffer(payload, np.uint8)
    histogram = np.bincount(x, minlength=256)
    share = histogram[histogram > 0] / len(x)
    rough = np.abs(np.diff(x.astype(np.int16))).mean() if len(x) > 1 else 0.0
    bins = histogram.reshape(16, 16).sum(1)
    return f"{len(x)},{x.mean():.4f},{x.std():.4f},{-(share * np.log2(share)).sum() + 0.0:.4f},{rough:.4f}," + ",".join(map(str, bins.tolist()))


class _Items(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.text: list[str] = []
        self.hidden = 0
        self.figure: list[int] | None = None
        self.caption: list[str] | None = None
        self.said: list[str] = []

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """Marked sections of any keyword, or none, are text, as far as the next ``>``."""
        end = self.rawdata.find(">", i)
        if end < 0:
            return -1
        self.handle_data(self.rawdata[i : end + 1])
        return end + 1

    def end_text(self) -> None:
        text = " ".join("".join(self.text).split())
        self.text = []
        if text:
            self.items.append({"kind": "text", "text": text, "ref": None, "alt": None, "caption": None})

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("script", "style"):
            self.hidden += 1
        elif tag == "figcaption":
            self.end_caption()
            self.end_text()
            self.caption = []
        elif tag in _BREAKS:
            self.end_text()
            if tag == "figure":
                self.end_figure()
                self.figure = []
        elif tag in _MEDIA:
            got = dict(attrs)
            if got.get("src"):
                self.end_text()
                self.items.append({"kind": "media", "text": None, "ref": got["src"], "alt": got.get("alt"), "caption": None})
                if self.figure is not None:
                    self.figure.append(len(self.items) - 1)

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style"):
            self.hidden = max(0, self.hidden - 1)
        elif tag == "figcaption":
            self.end_caption()
        elif tag == "figure":
            self.end_figure()
        elif tag in _BREAKS:
            self.end_text()

    def end_caption(self) -> None:
        """A caption waits for the end of its figure, whose media may follow it; outside of one it is text."""
        if self.caption is not None:
            said, self.caption = " ".join("".join(self.caption).split()), None
            if said and self.figure is not None:
                self.said.append(said)
            elif said:
                self.items.append({"kind": "text", "text": said, "ref": None, "alt": None, "caption": None})

    def end_figure(self) -> None:
        """All media of a figure bear its caption; without media the caption is text."""
        self.end_caption()
        self.end_text()
        said, self.said = " ".join(self.said), []
        if said and self.figure:
            for k in self.figure:
                self.items[k]["caption"] = said
        elif said:
            self.items.append({"kind": "text", "text": said, "ref": None, "alt": None, "caption": None})
        self.figure = None

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            (self.text if self.caption is None else self.caption).append(data)


def parse(html: str | None) -> list[dict]:
    reader = _Items()
    reader.feed(html or "")
    reader.close()
    reader.end_figure()
    return [{"position": k, **item} for k, item in enumerate(reader.items)]


def interleave(pages: DataFrame, html: str = "html") -> DataFrame:
    """``_row`` (the other columns) and ``items``: ordered text and media references."""
    packed = pages.select(F.struct(*[pages[c] for c in pages.columns if c != html]).alias("_row"), pages[html].alias("_html"))
    kind = T._parse_datatype_string(f"items {ITEM}").fields[0]
    from pyspark.sql.pandas.types import to_arrow_type

    arrow = to_arrow_type(kind.dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([parse(h) for h in batch.column(1).to_pylist()], arrow)], ["_row", "items"])

    return map_arrow(packed, run, T.StructType([packed.schema["_row"], kind]))


def store(payloads: DataFrame) -> DataFrame:
    """(digest, media) of each ``data`` (binary), padded; written to the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                payloads = [padded(x or b"") for x in whole.slice(at, 256).column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([hashlib.sha256(p).hexdigest() for p in payloads]), pa.array([to_png(p) for p in payloads], pa.binary())], ["digest", "media"])

    return cut(map_arrow(payloads.select("data"), run, "digest string, media binary"))


def read_back(stored: DataFrame) -> DataFrame:
    """One row a digest: measures of the stored bytes and of the payload read from them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                media = whole.slice(at, 256).column(1).to_pylist()
                payloads = [from_png(m) for m in media]
                sha = [hashlib.sha256(p).hexdigest() for p in payloads]
                if sha != whole.slice(at, 256).column(0).to_pylist():
                    raise ValueError("a payload differs from its digest")
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(sha),
                        pa.array([len(p) for p in payloads], pa.int64()),
                        pa.array([zlib.crc32(p[-SAMPLES:]) for p in payloads], pa.int64()),
                        pa.array([len(m) for m in media], pa.int64()),
                        pa.array([hashlib.sha256(m).hexdigest() for m in media]),
                        pa.array([features(p) for p in payloads]),
                    ],
                    ["digest", "payload_bytes", "tail_crc32", "media_bytes", "media_sha256", "feature"],
                )

    read = map_arrow(stored, run, "digest string, payload_bytes bigint, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")
    return read.dropDuplicates(["digest"])


def resolve(sequences: DataFrame, media: DataFrame, prefix: str = "sha256:") -> DataFrame:
    """A row an item, with the columns of its payload beside media items whose reference is a digest."""
    items = sequences.select("_row", F.inline("items"))
    digest = F.when((F.col("kind") == "media") & F.col("ref").startswith(prefix), F.substring("ref", len(prefix) + 1, 64))
    keyed = items.withColumn("_digest", digest)
    return keyed.join(media, keyed["_digest"] == media["digest"], "left").drop("_digest")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    raw = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    media = cut(read_back(store(docs.select(raw.alias("data")))))
    n = F.octet_length(raw)
    zeros = F.when(n == 0, F.lit(SAMPLES)).otherwise(F.pmod(-n, F.lit(SAMPLES)))
    digest = F.sha2(F.concat(raw, F.unhex(F.repeat(F.lit("00"), zeros))), 256)
    page = F.concat(F.lit('<article><figure><img src="sha256:'), digest, F.lit('" alt="payload"><figcaption>'), n.cast("string"), F.lit(" bytes</figcaption></figure></article>"))
    sequences = interleave(docs.select("doc_id", n.cast("long").alias("n_bytes"), page.alias("html")))
    found = resolve(sequences, media).filter("kind = 'media'")
    return found.select("_row.doc_id", "_row.n_bytes", "payload_bytes", F.col("digest").alias("payload_sha256"), "tail_crc32", "media_bytes", "media_sha256", "feature")
