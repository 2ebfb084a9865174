"""What the operators share: reading documents, cutting lineage, hashing text in NumPy."""

from __future__ import annotations

import atexit
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.shipping import map_arrow  # noqa: F401  the operators take it from here

#: Characters that separate words: space and U+0009 to U+000D.
SPACE_CHARS = " \t\n\x0b\x0c\r"
SPACES = r"[\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is set, as in tests."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="tidelog-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


_written: list[str] = []


def _remove(spark: SparkSession, path: str) -> None:
    try:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may be gone already; the folder is scratch space
        return


#: rows of a file, where a bound of a table's rows is known
FILE_ROWS = 100_000


def cut(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df`` written as a Parquet table in the shared folder and read back.

    Cuts the lineage so that a lost executor costs a reread, and keeps the
    table columnar and compressed. ``rows``, a bound of narrow rows that is
    known, keeps a small table from becoming a file a shuffle partition.
    Tables are removed when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tidelog-{uuid.uuid4().hex}"
    if rows is not None and rows // FILE_ROWS < int(spark.conf.get("spark.sql.shuffle.partitions")):
        df = df.coalesce(1 + rows // FILE_ROWS)
    df.write.option("compression", "zstd").parquet(path)
    if not _written:
        atexit.register(lambda: [_remove(spark, p) for p in _written])
    _written.append(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._cut_path = path
    return table


def free(*tables: DataFrame) -> None:
    """Removes tables that ``cut`` wrote and that nothing will read again."""
    for table in tables:
        _written.remove(table._cut_path)
        _remove(table.sparkSession, table._cut_path)


#: bits of the largest ``maybe_in`` filter: 16 MB
MOST_BITS = 1 << 27


def maybe_in(rows: DataFrame, key: str, wanted: DataFrame, others: bool = False) -> DataFrame:
    """The rows whose 64-bit hash ``key`` may be among ``wanted``'s: a bitmap of bounded size, broadcast, so that others are not shuffled.

    False hits grow with the number of wanted hashes and are left to the exact
    join that follows; a true one is never lost. ``others``: the rest of the rows.
    """
    bits = min(MOST_BITS, 1 << max(15, (16 * wanted.count()).bit_length()))
    slot = lambda k: F.pmod(F.col(k), F.lit(bits)).cast("long")
    maps = wanted.select(F.shiftright(slot(key), 15).alias("_m"), (slot(key) % 32768).alias("_at")).groupBy("_m").agg(F.bitmap_construct_agg("_at").alias("_bits"))
    byte = F.conv(F.hex(F.substring(F.col("_bits"), (slot(key) % 32768 / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.floor(byte / F.pow(F.lit(2), slot(key) % 8)) % 2 == 1
    return rows.join(F.broadcast(maps), (F.shiftright(slot(key), 15) == F.col("_m")) & hit, "left_anti" if others else "left_semi")


def once(df: DataFrame, **cols: Column) -> DataFrame:
    """Adds columns behind a one-element generator.

    The optimizer neither inlines the expressions into later projections nor
    pushes predicates on them below, so each is evaluated once a row.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(k) for k, c in cols.items()]))))


_BASE = 0x9E3779B97F4A7C15 | 1
_BASE = (_BASE & ~0x7) | 0x5  # 5 mod 8: the multiplicative order is the largest there is
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)
#: one random odd 64-bit value for each byte value
_CODES = np.random.default_rng(20240501).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n + 1 powers of the base and of its inverse modulo 2**64."""
    global _powers, _inverses
    if len(_powers) <= n:
        size = max(1 << 16, 1 << int(n + 1).bit_length())
        with np.errstate(over="ignore"):
            for name, base in (("_powers", _BASE), ("_inverses", _INVERSE)):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                globals()[name] = np.multiply.accumulate(steps)
    return _powers, _inverses


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Prefix polynomial hashes modulo 2**64 of bytes, or of 64-bit values: n + 1 values."""
    powers, _ = _tables(len(data))
    values = _CODES[data] if data.dtype == np.uint8 else data
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values * powers[: len(data)], out=out[1:])
    return out


def range_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The polynomial hash of each range, as if it began at 0, and mixed."""
    _, inverses = _tables(len(prefix))
    return mix((prefix[ends] - prefix[starts]) * inverses[starts])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in UTF-8 bytes."""
    inside = (data != 32) & ((data < 9) | (data > 13))
    edges = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    return edges[0::2], edges[1::2]


def sliding_minimum(x: np.ndarray, w: int) -> np.ndarray:
    """The minimum of each w consecutive values."""
    out, have = x, 1
    while have * 2 <= w:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    if have < w:
        out = np.minimum(out[: len(x) - w + 1], out[w - have : w - have + len(x) - w + 1])
    return out
