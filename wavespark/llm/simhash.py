"""SimHash near-duplicate detection by deletion-variant signatures.

A text's fingerprint has 64 bits: a bit is set if more than half of the XXH64
hashes (seed 42) of the text's word shingles, repeats included, have it set.
Fingerprints link when at most ``distance`` bits differ.

The bits are cut into ``distance // 2 + 1`` segments, just enough that two
fingerprints that link differ by at most one bit in some segment.  The index
has every segment once for each of its bits, with that bit left out (a
wildcard); fingerprints that agree in a segment but for one bit have such a
variant in common, so an equality join on (segment, wildcard, other bits) finds
every link.  In a bucket of that join only pairs that differ at the wildcard
are compared; pairs of equal segments, which meet under every wildcard, are
left to the first one.

Equal fingerprints are one entry of the index, whatever the number of texts.
A bucket of up to ``BUCKET`` entries is one task's work; larger ones are cut
into blocks, and each pair of blocks is a unit of work of its own.  Only the
links that hold the verified pairs together leave a task (one for each entry
and component), never all pairs of a bucket.

Rows: null, empty and wordless texts have fingerprint zero and link like any
other; texts of fewer than n words have their word sequence as their one
shingle; a row of null id takes part but names no component that has other
ids; repeated rows stay rows of their own; an empty table gives an empty
result; other columns pass through, columns named like an output are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.util import bounded_broadcast
from .common import U64, drop_saved, saved, slices, utf8, word_spans
from .components import connected_components
from .groups import forest

BITS, DISTANCE, SEED, SHINGLE = 64, 3, 42, 3
#: Entries of a bucket that one task compares, and bytes of text per step.
BUCKET = 1024
STEP = 2 << 20
#: Hashes whose bits are summed at a time.
PIECE = 1 << 16

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingle_hashes(col: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of all runs of n words, A-Z lower-cased and joined by one space,
    and the first run of each text."""
    buf, off = utf8(col)
    starts, ends, first = word_spans(buf, off)
    # the words of all texts, one byte apart: a shingle is a slice
    size = ends - starts
    at = np.cumsum(size + 1) - size - 1
    inside = np.repeat(np.arange(len(size)), size)
    nth = np.arange(len(inside)) - np.repeat(np.cumsum(size) - size, size)
    flat = np.full(int(at[-1] + size[-1]) if len(at) else 0, 32, dtype=np.uint8)
    flat[at[inside] + nth] = _LOWER[buf[starts[inside] + nth]]
    count = np.diff(first)
    runs = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    begin = np.concatenate([[0], np.cumsum(runs)])
    owner = np.repeat(np.arange(len(runs)), runs)
    a = first[:-1][owner] + np.arange(begin[-1]) - begin[:-1][owner]
    z = np.minimum(a + n, first[1:][owner]) - 1
    data, digest = flat.tobytes(), xxhash.xxh64_intdigest
    spans = zip(at[a].tolist(), (at[z] + size[z]).tolist())
    return np.fromiter((digest(data[i:j], SEED) for i, j in spans), dtype=U64, count=len(a)), begin


def fingerprints(col: pa.Array, n: int = SHINGLE) -> np.ndarray:
    """uint64 fingerprint of each text."""
    h, begin = shingle_hashes(col, n)
    out = np.zeros((len(col), 8), dtype=np.uint8)
    for d in np.flatnonzero(np.diff(begin)):
        a, b = int(begin[d]), int(begin[d + 1])
        total = np.zeros(BITS, dtype=np.int64)
        for i in range(a, b, PIECE):
            bits = np.unpackbits(h[i:min(i + PIECE, b)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            total += bits.sum(axis=0, dtype=np.uint32)
        out[d] = np.packbits(total * 2 > b - a, bitorder="little")
    return out.view(U64).ravel()


def fingerprint(docs: DataFrame, text: str = "text", out: str = "fingerprint", n: int = SHINGLE) -> DataFrame:
    """Add ``out`` long: the fingerprint's bits."""
    rest = [c for c in docs.columns if c != out]
    schema = docs.select(*rest, F.lit(0).cast("long").alias(out)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, text, STEP):
                f = fingerprints(part.column(text), n)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in rest), pa.array(f.view(np.int64))], [*rest, out])

    return docs.select(*rest).mapInArrow(run, schema)


def segments(distance: int) -> list[tuple[int, int]]:
    """(lowest bit, bits) of each segment: two fingerprints that differ in at
    most ``distance`` bits cannot differ in two bits of every one."""
    parts = distance // 2 + 1
    cuts = [BITS * i // parts for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def variants(entries: DataFrame, distance: int) -> DataFrame:
    """wild (the bit left out, which also tells the segment), others (the
    segment's other bits) and entry: one row for each of the 64 bits."""
    rows: list[Column] = []
    for low, size in segments(distance):
        whole = F.shiftrightunsigned("entry", low) if low else F.col("entry")
        for w in range(size):
            mask = ((1 << size) - 1) ^ (1 << w)
            rows.append(F.struct(F.lit(low + w).alias("wild"), whole.bitwiseAND(
                F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("long")).alias("others")))
    return entries.select("entry", F.explode(F.array(*rows)).alias("v")).select("v.wild", "v.others", "entry")


def _near(a: np.ndarray, b: np.ndarray, distance: int) -> np.ndarray:
    return np.bitwise_count(a[:, None] ^ b[None, :]) <= distance


def _tie(entry: np.ndarray, ok: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that hold the accepted pairs together: one for each entry that is
    not the first of its component."""
    label = forest(ok)
    at = np.flatnonzero(label != np.arange(len(entry)))
    return entry[at], entry[label[at]]


def _unit_links(entry: np.ndarray, side: np.ndarray, own: np.ndarray, first: bool, distance: int):
    """Links of one unit of work: entries of different blocks, or all of the
    one block; of different sides, unless ``first``."""
    ok = _near(entry, entry, distance)
    np.fill_diagonal(ok, False)
    if not first:
        ok &= side[:, None] != side[None, :]
    if own.min() != own.max():
        ok &= own[:, None] != own[None, :]
    return _tie(entry, ok)


def _compare(rows: DataFrame, unit: list[str], distance: int) -> DataFrame:
    """Links (a, b) found in all units of work (rows: unit, own block, entry)."""
    lows = np.array([low for low, _ in segments(distance)])
    wild_at = unit.index("wild")

    def links(cols: list[np.ndarray], new: np.ndarray) -> pa.RecordBatch:
        entry, own = cols[-1].view(U64), cols[-2]
        wild = cols[wild_at]
        side = (entry >> wild.astype(U64)) & U64(1)
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, len(entry)))
        up = np.add.reduceat(side.astype(np.int64), start)
        first = np.isin(wild[start], lows)
        # one entry has no pair; nor has one side where only the two sides are compared
        work = np.flatnonzero((size > 1) & (first | ((up > 0) & (up < size))))
        two = start[work[size[work] == 2]]
        ok = np.bitwise_count(entry[two] ^ entry[two + 1]) <= distance
        a, b = [entry[two + 1][ok]], [entry[two][ok]]
        for k in work[size[work] > 2].tolist():
            at = slice(int(start[k]), int(start[k] + size[k]))
            p, q = _unit_links(entry[at], side[at], own[at], bool(first[k]), distance)
            a.append(p)
            b.append(q)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(v).view(np.int64)) for v in (a, b)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # the last unit so far, which may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            cols = [np.concatenate(c) for c in zip(held, cols)] if held else cols
            new = np.ones(len(cols[0]), dtype=bool)
            new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in cols[:len(unit)]])
            last = int(np.flatnonzero(new)[-1])
            if last:
                yield links([c[:last] for c in cols], new[:last])
            held = [c[last:].copy() for c in cols]
        if held:
            yield links(held, np.arange(len(held[0])) == 0)

    return rows.repartition(*unit).sortWithinPartitions(*unit).select(*unit, "own", "entry").mapInArrow(run, "a long, b long")


def links(entries: DataFrame, distance: int = DISTANCE, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) that join entries within ``distance`` bits of each other
    into the right components.  ``entries``: distinct longs, column ``entry``."""
    index, at = variants(entries, distance), ["wild", "others"]
    sizes = index.groupBy(*at).agg(F.count("*").alias("n"), F.sum(F.expr("getbit(entry, wild)").cast("long")).alias("up"))
    both = F.col("wild").isin([low for low, _ in segments(distance)]) | ((F.col("up") > 0) & (F.col("up") < F.col("n")))
    large = saved(sizes.where((F.col("n") > bucket) & both), "simhash-large")
    keys = bounded_broadcast(large.select(*at))
    small = _compare(index.join(keys, at, "left_anti").withColumn("own", F.lit(0)), at, distance)
    if not large.limit(1).count():
        return small
    half = max(bucket // 2, 1)
    blocks = large.select(*at, F.ceil((F.col("n") - F.col("up")) / half).cast("int").alias("below"),
                          F.ceil(F.col("up") / half).cast("int").alias("above"))
    # blocks 0 to below - 1 have the wildcard bit unset, the next ``above`` ones have it set
    rows = index.join(bounded_broadcast(blocks), at)
    set_, shift = F.expr("getbit(entry, wild) = 1"), F.xxhash64("entry", F.lit(5))
    own = F.when(set_, F.col("below") + F.pmod(shift, F.col("above"))).otherwise(F.pmod(shift, F.col("below"))).cast("int")
    first = F.col("wild").isin([low for low, _ in segments(distance)])
    least = F.when(first | set_, F.lit(0)).otherwise(F.col("below"))
    most = F.when(first | ~set_, F.col("below") + F.col("above")).otherwise(F.col("below"))
    units = rows.select(*at, "entry", own.alias("own"), F.explode(F.sequence(least, most - 1)).alias("other")).select(
        *at, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "entry")
    return small.union(_compare(units, [*at, "i", "j"], distance))


def link_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = SHINGLE,
                   distance: int = DISTANCE, bucket: int = BUCKET) -> DataFrame:
    """Per row: ``key``, fingerprint (16 hex digits) and component_id, the
    smallest key that links reach.  Other columns are left out."""
    frame = docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    rows = saved(fingerprint(frame, "text", "entry", n).drop("text"), "simhash-texts")
    entries = saved(rows.groupBy("entry").agg(F.min("id").alias("least"), F.count("*").alias("n")), "simhash-entries")
    found = saved(links(entries.select("entry"), distance, bucket), "simhash-links")
    roots = connected_components(found)
    linked = roots.join(entries, F.col("node") == F.col("entry")).select("entry", "root", "least")
    names = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    # only texts that share a fingerprint or have a link need a name that is not their own
    copies = entries.where("n > 1").join(bounded_broadcast(roots.select(F.col("node").alias("entry"))), "entry", "left_anti")
    named = saved(linked.join(bounded_broadcast(names), "root").select("entry", "component_id").union(
        copies.select("entry", "least")), "simhash-names")
    done = rows.join(bounded_broadcast(named), "entry", "left").select(
        F.col("id").alias(key), F.lpad(F.lower(F.hex("entry")), 16, "0").alias("fingerprint"),
        F.coalesce("component_id", "id").alias("component_id"))
    drop_saved(entries, found)
    return done
