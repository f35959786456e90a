"""Sharding by histogram sort: equal bytes per shard, one exchange.

Documents are ordered by (hash of the text, id), so equal texts lie side by
side and a group of copies of any size can still be cut by id.  Splitters are
found iteratively: every round each task counts the exact bytes and rows of
its keys below the candidate boundaries, the sums narrow a bracket around
every target, and new probes subdivide the brackets until a boundary is within
tolerance or one row fills its bracket.  Only sums (a bounded number of probes
a round) reach the driver; the documents move once, into ranges that are cut
finer than shards so that no task holds a whole shard.

Rows: null text has size ``overhead`` and the key of the empty text; a null id
sorts first; rows equal in text and id share a key and stay together (their
slots are dealt in any order); an empty table gives an empty result; a table
of fewer rows than shards leaves some shards empty; other columns pass
through, columns named like an output (size, shard, slot) are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

#: Probes of one round over all targets, and bytes of one range.
PROBES = 20_000
RANGE_BYTES = 16 << 20
LOW = -(2**63)


def _below(hi, lo, size, probe_hi, probe_lo):
    """Rows and bytes of keys strictly below each probe."""
    order = np.lexsort((lo, hi))
    hi, lo = hi[order], lo[order]
    at = np.searchsorted(hi, probe_hi, side="left")
    to = np.searchsorted(hi, probe_hi, side="right")
    for i in np.flatnonzero(at < to):
        at[i] += np.searchsorted(lo[at[i]:to[i]], probe_lo[i], side="left")
    total = np.zeros(len(hi) + 1, dtype=np.int64)
    np.cumsum(size[order], out=total[1:])
    return at, total[at]


def _count_below(keys: DataFrame, probe_hi: np.ndarray, probe_lo: np.ndarray) -> dict[int, tuple[int, int]]:
    n = len(probe_hi)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for b in batches:
            r, s = _below(*(b.column(c).to_numpy(zero_copy_only=False) for c in ("hi", "lo", "size")),
                          probe_hi, probe_lo)
            rows += r
            size += s
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n, dtype=np.int32)), pa.array(rows), pa.array(size)],
                                         ["probe", "rows", "size"])

    sums = keys.mapInArrow(run, "probe int, rows long, size long").groupBy("probe").agg(
        F.sum("rows").alias("rows"), F.sum("size").alias("size"))
    return {r["probe"]: (r["rows"], r["size"]) for r in sums.collect()}


def splitters(keys: DataFrame, targets: int, tolerance: int) -> tuple[list[tuple[int, int]], list[int], list[int]]:
    """``targets - 1`` boundaries (hi, lo) that cut the bytes of ``keys`` (hi,
    lo, size) into equal parts, with the exact rows and bytes below each."""
    t = keys.agg(F.sum("size").alias("size"), F.count("*").alias("rows"), F.min("hi").alias("h0"),
                 F.max("hi").alias("h1"), F.min("lo").alias("l0"), F.max("lo").alias("l1")).first()
    span = t["l1"] - t["l0"] + 1
    whole = (lambda hi, lo: (hi - t["h0"]) * span + (lo - t["l0"]))
    parts = (lambda k: (k // span + t["h0"], k % span + t["l0"]))
    first, last = (0, 0, 0), (whole(t["h1"], t["l1"]) + 1, t["rows"], t["size"])
    goals = [t["size"] * j // targets for j in range(1, targets)]
    best = [min(first, last, key=lambda k: abs(k[2] - g)) for g in goals]
    known = {first[0]: first, last[0]: last}
    brackets = [(first, last)] * len(goals)
    while True:
        open_ = [j for j, (a, b) in enumerate(brackets)
                 if abs(best[j][2] - goals[j]) > tolerance and b[1] - a[1] > 1 and b[0] - a[0] > 1]
        if not open_:
            break
        each = max(4, min(64, PROBES // len(open_)))
        wanted = set()
        for j in open_:
            a, b = brackets[j]
            guess = a[0] + (b[0] - a[0]) * (goals[j] - a[2]) // max(b[2] - a[2], 1)
            wanted |= {a[0] + (b[0] - a[0]) * i // (each + 1) for i in range(1, each + 1)} | {guess, guess + 1}
        probes = sorted(wanted - known.keys())
        if not probes:
            break
        cut = [parts(k) for k in probes]
        got = _count_below(keys, np.array([c[0] for c in cut], np.int64), np.array([c[1] for c in cut], np.int64))
        for i, k in enumerate(probes):
            known[k] = (k, *got[i])
        ladder = sorted(known.values())
        place = np.array([k[2] for k in ladder], dtype=np.int64)
        for j in open_:
            i = int(np.searchsorted(place, goals[j], side="right"))
            a, b = ladder[max(i - 1, 0)], ladder[min(i, len(ladder) - 1)]
            brackets[j] = (a, b)
            best[j] = min(best[j], a, b, key=lambda k: (abs(k[2] - goals[j]), k[0]))
        used = {k[0] for ab in brackets for k in ab}
        known = {k: v for k, v in known.items() if k in used}
    return [parts(k[0]) for k in best], [k[1] for k in best], [k[2] for k in best]


def shard_documents(docs: DataFrame, shards: int = 40, key: str = "doc_id", text: str = "text",
                    overhead: int = 16, tolerance: float = 0.0005, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Add size, shard (0 to shards-1) and slot (gapless from 0 within the
    shard, in key order) so that the shards' bytes are nearly equal."""
    keep = [c for c in docs.columns if c not in ("size", "shard", "slot")]
    size = (F.coalesce(F.octet_length(text), F.lit(0)) + overhead).cast("long")
    hi, lo = F.xxhash64(F.coalesce(F.col(text), F.lit(""))), F.coalesce(F.col(key).cast("long"), F.lit(LOW))
    keys = saved(docs.select(hi.alias("hi"), lo.alias("lo"), size.alias("size")), "shard-keys")
    total = keys.agg(F.sum("size")).first()[0] or 0
    fine = max(1, -(-total // (shards * range_bytes)))
    if total:
        cuts, rows, _ = splitters(keys, shards * fine, max(1, int(tolerance * total / shards)))
    else:
        cuts, rows = [(0, 0)] * (shards * fine - 1), [0] * (shards * fine - 1)
    cut_hi, cut_lo = (np.array([c[i] for c in cuts], dtype=np.int64) for i in (0, 1))
    start = np.array([0, *rows], dtype=np.int64)
    base = start - np.repeat(start[::fine], fine)

    @F.pandas_udf("struct<part int, base long>")
    def place(h: pd.Series, l: pd.Series) -> pd.DataFrame:
        h, l = h.to_numpy(), l.to_numpy()
        at, to = np.searchsorted(cut_hi, h, side="left"), np.searchsorted(cut_hi, h, side="right")
        for i in np.flatnonzero(at < to):
            at[i] += np.searchsorted(cut_lo[at[i]:to[i]], l[i], side="right")
        return pd.DataFrame({"part": at.astype(np.int32), "base": base[at]})

    tagged = docs.select(*keep, size.alias("size"), hi.alias("__hi"), lo.alias("__lo"))
    tagged = tagged.withColumn("__p", place("__hi", "__lo")).withColumn("__part", F.col("__p.part"))
    order = Window.partitionBy("__part").orderBy("__hi", "__lo")
    return tagged.withColumn("__n", F.row_number().over(order)).select(
        *keep, "size", F.floor(F.col("__part") / fine).cast("int").alias("shard"),
        (F.col("__p.base") + F.col("__n") - 1).alias("slot"))
