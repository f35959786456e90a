"""Order MinHash fingerprints: signatures that are sensitive to edit distance.

A text's k-mers are runs of ``k`` words, each numbered by its occurrence in
the text.  For every one of ``m`` hash functions the ``l`` k-mers of smallest
hash are selected, put back into text order, and their tuple is hashed to one
16-bit sketch.  The likeness of two fingerprints is the share of equal
sketches; moving text changes tuples even where it keeps the k-mer set.

Rows: null text counts as empty; a text without words has a fingerprint of
zeros, like only to others of that kind (likeness 1); one with fewer than k
words has its whole sequence as its one k-mer; texts with fewer than l k-mers
use all they have; equal texts have equal fingerprints; an empty table gives
an empty result; other columns pass through, columns named like an output are
replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, mix, shingles, shuffle_partitions, slices, words

K, L, M = 2, 2, 64
#: Bytes of text per step: its k-mer arrays stay in the CPU's cache.
STEP = 3 << 19
POSITION_BITS = 24
ALL = U64(2**64 - 1)
MULTIPLIERS = mix(np.arange(1024, dtype=U64), 11) | U64(1)


def occurrences(x: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Occurrence number (from 0) of each k-mer within its text."""
    owner = np.repeat(np.arange(len(begin) - 1, dtype=U64), np.diff(begin))
    key = x ^ mix(owner, 5)
    order = np.argsort(key)
    s = key[order]
    same = np.zeros(len(s) + 1, dtype=bool)
    same[1:-1] = s[1:] == s[:-1]
    out = np.zeros(len(x), dtype=U64)
    many = np.flatnonzero(same[:-1] | same[1:])  # members of groups of two or more
    if len(many):
        group = np.cumsum(~same[:-1][many])
        at = order[many]
        by = np.lexsort((at, group))
        group, at = group[by], at[by]
        start = np.searchsorted(group, group, side="left")
        out[at] = (np.arange(len(at)) - start).astype(U64)
    return out


def sketches(col: pa.Array, k: int = K, l: int = L, m: int = M) -> np.ndarray:
    """uint16 matrix: a row of m sketches for each text."""
    h, first = words(col)
    x, begin = shingles(h, first, k)
    out = np.zeros((len(col), m), dtype=np.uint16)
    if not len(x):
        return out
    count = np.diff(begin)
    if count.max() >= 1 << POSITION_BITS and len(col) > 1:
        return np.vstack([sketches(col.slice(i, 1), k, l, m) for i in range(len(col))])
    x = mix(x + occurrences(x, begin) * U64(0xA24BAED4963EE407))
    bits = U64(POSITION_BITS if count.max() < 1 << POSITION_BITS else 40)
    low = (U64(1) << bits) - U64(1)
    full = np.flatnonzero(count)
    start = begin[full]
    pos = (np.arange(len(x)) - np.repeat(begin[:-1], count)).astype(U64)
    key = np.empty_like(x)
    for j in range(m):
        np.multiply(x, MULTIPLIERS[j], out=key)
        np.bitwise_and(key, ~low, out=key)
        np.bitwise_or(key, pos, out=key)
        chosen = np.empty((len(full), l), dtype=np.int64)
        for i in range(l):
            least = np.minimum.reduceat(key, start)
            at = start + (least & low).astype(np.int64)
            chosen[:, i] = np.where(least == ALL, -1, at)
            if i + 1 < l:
                key[at[least != ALL]] = ALL
        chosen.sort(axis=1)
        acc = np.zeros(len(full), dtype=U64)
        for i in range(l):
            acc = mix(acc + np.where(chosen[:, i] < 0, U64(i), x[chosen[:, i]]), 13)
        out[full, j] = (acc % U64(65535)).astype(np.uint16) + 1
    return out


def to_hex(s: np.ndarray) -> list[str]:
    return [r.tobytes().hex() for r in s.astype(">u2")]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).mean(axis=1)


def fingerprint(df: DataFrame, text: str = "text", out: str = "fingerprint",
                k: int = K, l: int = L, m: int = M) -> DataFrame:
    """Add ``out`` string: m sketches of four hex digits each."""
    rest = [c for c in df.columns if c != out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, text, STEP):
                fp = to_hex(sketches(part.column(text), k, l, m))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in rest), pa.array(fp)], [*rest, out])

    return df.mapInArrow(run, df.drop(out).withColumn(out, F.lit("")).schema)


def with_next(df: DataFrame, key: str, columns: list[str]) -> tuple[DataFrame, str, str]:
    """Deal the rows into ranges of descending key (null last) so that every
    range ends with a copy of the row that follows it (of the first row, for
    the last range): one exchange, and no task needs another's rows.

    Adds ``__range``, ``__tail`` (1 for that copy); sorted within partitions.
    """
    ids = df.select(F.coalesce(F.col(key).cast("long"), F.lit(-(2**63))).alias("id"))
    n = shuffle_partitions(df.sparkSession)
    cuts = np.unique(np.array(ids.approxQuantile("id", [i / n for i in range(1, n)], 1 / (4 * n)), dtype=np.float64))

    @F.pandas_udf("int")
    def bucket(i: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, i.to_numpy().astype(np.float64), side="left").astype(np.int32))

    tops = {r["b"]: r["top"] for r in ids.groupBy(bucket("id").alias("b")).agg(F.max("id").alias("top")).collect()}
    order = sorted(tops)
    # the row on top of a bucket also ends the bucket above it, and the whole
    # table's first row ends the lowest bucket
    above = {tops[b]: order[(i + 1) % len(order)] for i, b in enumerate(order)}

    @F.pandas_udf("int")
    def ends(i: pd.Series) -> pd.Series:
        return i.map(above).astype("Int32")

    row = F.coalesce(F.col(key).cast("long"), F.lit(-(2**63)))
    own = F.struct(F.col("__b").alias("range"), F.lit(0).alias("tail"))
    copy = F.struct(F.col("__e").alias("range"), F.lit(1).alias("tail"))
    dealt = df.select(*columns, row.alias("__id"), bucket(row).alias("__b"), ends(row).alias("__e")).withColumn(
        "__x", F.explode(F.when(F.col("__e").isNull(), F.array(own)).otherwise(F.array(own, copy))))
    dealt = dealt.select(*columns, "__id", F.col("__x.range").alias("__range"), F.col("__x.tail").alias("__tail"))
    return dealt.repartition(n, "__range")


def compare_with_next(df: DataFrame, key: str = "doc_id", text: str = "text",
                      k: int = K, l: int = L, m: int = M) -> DataFrame:
    """Fingerprint every text and its edited text, whose last floor(n/2)
    code points are the first as many of the next row's (descending key)."""
    new = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    rest = [c for c in df.columns if c not in new]
    schema = df.select(*rest).schema
    for name, kind in zip(new, ("long", "string", "string", "string", "double", "double")):
        schema = schema.add(name, kind)
    dealt = with_next(df.withColumn(text, F.coalesce(F.col(text), F.lit(""))), key, rest).sortWithinPartitions(
        "__range", "__tail", F.col("__id").desc(), F.xxhash64(text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row so far, whose next one is yet to come
        for b in batches:
            for part in slices(b, text, STEP):
                if held is not None:
                    part = pa.Table.from_batches([held, part]).combine_chunks().to_batches()[0]
                last = part.num_rows - 1
                held = part.slice(last, 1)
                where = part.column("__range").to_numpy()
                own = np.flatnonzero((part.column("__tail").to_numpy()[:-1] == 0) & (where[:-1] == where[1:]))
                if not len(own):
                    continue
                t = part.column(text).to_pylist()
                size = [len(t[i]) for i in own]
                edited = [t[i][:n - n // 2] + t[i + 1][:n // 2] for i, n in zip(own, size)]
                a = sketches(part.column(text), k, l, m)
                e = sketches(pa.array(edited, pa.string()), k, l, m)
                mine = part.take(pa.array(own))
                yield pa.RecordBatch.from_arrays(
                    [*(mine.column(c) for c in rest), pa.array(size, pa.int64()),
                     pa.array([hashlib.sha256(x.encode()).hexdigest() for x in edited]),
                     pa.array(to_hex(a[own])), pa.array(to_hex(e)),
                     pa.array(likeness(a[own], e)), pa.array(likeness(a[own], a[own + 1]))], [*rest, *new])

    return dealt.mapInArrow(run, schema)
