"""Shared helpers: Arrow text buffers, word hashing, scratch tables.

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, found on UTF-8 bytes, so
texts never become Python objects.  A word's identity is a 64-bit hash; two
different words of one comparison collide with probability 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import remove, scratch_path

U64 = np.uint64
#: Bytes hashed at a time (they fit a core's cache) and bytes of text worked on at a time.
BLOCK = 1 << 17
SLICE_BYTES = 6 << 20

_BASE = U64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """Bijective 64-bit scrambler (xor-shift-multiply), vectorised."""
    z = np.asarray(x, dtype=U64) + U64((seed * 0x632BE59BD9B4E019 + 0x9E3779B97F4A7C15) & (2**64 - 1))
    z = (z ^ (z >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> U64(27))) * U64(0x94D049BB133111EB)
    return z ^ (z >> U64(31))


def _byte_table() -> np.ndarray:
    t = mix(np.arange(256, dtype=U64), 7)
    t[65:91] = t[97:123]
    return t


_TABLE = _byte_table()
#: Byte values where case counts.
EXACT = mix(np.arange(256, dtype=U64), 7)


def _powers(n: int, base: U64) -> np.ndarray:
    p = np.full(n, base, dtype=U64)
    p[0] = U64(1)
    return np.cumprod(p, dtype=U64)


_INVERSE = U64(pow(int(_BASE), -1, 2**64))
_POW = _powers(BLOCK + 1, _BASE)
_INV = _powers(BLOCK + 1, _INVERSE)


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    off = np.frombuffer(col.buffers()[1], dtype=np.int64 if wide else np.int32)
    off = off[col.offset:col.offset + len(col) + 1].astype(np.int64) if len(col) else np.zeros(1, np.int64)
    data = col.buffers()[2]
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[off[0]:off[-1]], off - off[0]


def separators(buf: np.ndarray) -> np.ndarray:
    return (buf == 32) | ((buf >= 9) & (buf <= 13))


def word_spans(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and the first word of each text
    (``len(off)`` entries: text d owns words first[d]:first[d + 1])."""
    word = ~separators(buf)
    before = np.zeros(len(buf) + 1, dtype=bool)
    before[1:] = word
    edges = off[(off >= 0) & (off <= len(buf))]
    before[edges] = False
    starts = np.flatnonzero(word & ~before[:-1])
    after = np.zeros(len(buf) + 1, dtype=bool)
    after[:-1] = word
    after[edges] = False
    ends = np.flatnonzero(word & ~after[1:]) + 1
    return starts, ends, np.searchsorted(starts, off)


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray = _TABLE) -> np.ndarray:
    """64-bit hash of the bytes of each span, lower-cased unless ``table`` is
    ``EXACT`` (spans ascending and disjoint): a polynomial prefix sum over
    blocks that end between spans."""
    out = np.empty(len(starts), dtype=U64)
    k = 0
    while k < len(starts):
        lo = starts[k]
        j = max(int(np.searchsorted(ends, lo + BLOCK, side="right")), k + 1)
        size = int(ends[j - 1] - lo)
        pw, inv = (_POW, _INV) if size <= BLOCK else (_powers(size + 1, _BASE), _powers(size + 1, _INVERSE))
        acc = np.zeros(size + 1, dtype=U64)
        np.cumsum(table[buf[lo:lo + size]] * pw[:size], dtype=U64, out=acc[1:])
        a, b = starts[k:j] - lo, ends[k:j] - lo
        out[k:j] = (acc[b] - acc[a]) * inv[a]
        k = j
    return mix(out)


def words(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of a text column and the first word of each text."""
    buf, off = utf8(col)
    starts, ends, first = word_spans(buf, off)
    return span_hashes(buf, starts, ends), first


def shingles(h: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n words and the first run of each text; a text
    with 1 to n-1 words has its whole sequence as its one run."""
    count = np.diff(first)
    runs = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    begin = np.zeros(len(count) + 1, dtype=np.int64)
    np.cumsum(runs, out=begin[1:])
    owner = np.repeat(np.arange(len(count)), runs)
    at = first[:-1][owner] + np.arange(begin[-1]) - begin[:-1][owner]
    last = first[1:][owner]
    acc = np.zeros(len(at), dtype=U64)
    for i in range(n):
        have = at + i < last
        w = h[np.minimum(at + i, max(len(h) - 1, 0))] if len(h) else acc
        acc = np.where(have, (acc ^ w) * U64(0xD6E8FEB86659FD93) + U64(i + 1), acc)
        acc ^= acc >> U64(32)
    return mix(acc, 3), begin


def distinct_per_text(x: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each text and the first of each text."""
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((x, owner))
    x, owner = x[order], owner[order]
    keep = np.ones(len(x), dtype=bool)
    keep[1:] = (x[1:] != x[:-1]) | (owner[1:] != owner[:-1])
    x, owner = x[keep], owner[keep]
    return x, np.searchsorted(owner, np.arange(len(first)))


def _lean() -> None:
    """In a task: let Arrow give freed memory back (its own pool keeps it)."""
    if TaskContext.get() is not None and pa.default_memory_pool().backend_name != "system":
        pa.set_memory_pool(pa.system_memory_pool())


def slices(batch: pa.RecordBatch, col: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into pieces of at most ``most`` bytes of text (one row at least)."""
    _lean()
    if not batch.num_rows:
        return
    _, off = utf8(batch.column(col))
    at = 0
    while at < batch.num_rows:
        to = max(int(np.searchsorted(off, off[at] + most, side="right")) - 1, at + 1)
        yield batch.slice(at, to - at)
        at = to


#: Bytes of one Arrow batch between the JVM and a Python worker.
BATCH_BYTES = 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's limit on Arrow batches to ``BATCH_BYTES`` (a lower
    one stays): with long texts the default of 64 MB, doubled while a batch is
    built, is the largest single use of memory on either side."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = str(spark.conf.get(key)).lower().removesuffix("b")
    size = int(now[:-1]) << {"k": 10, "m": 20, "g": 30}[now[-1]] if now[-1] in "kmg" else int(now)
    if size <= 0 or size > BATCH_BYTES:
        spark.conf.set(key, f"{BATCH_BYTES}b")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def saved(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write to the shared checkpoint folder and read back, so a
    lost executor costs a re-read and never a recomputation with other rows."""
    spark = df.sparkSession
    bound_batches(spark)
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def drop_saved(*tables: DataFrame) -> None:
    """Delete tables of ``saved`` that no later step reads."""
    for df in tables:
        remove(df.sparkSession, df.scratch)


def text_of(c: str = "text"):
    return F.coalesce(F.col(c), F.lit(""))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
