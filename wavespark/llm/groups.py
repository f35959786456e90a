"""Verified links within groups of candidates, without emitting all pairs.

Items that share a key are candidates.  Each key names its most central item
the leader; the items that share any key with a leader form its group, so two
items with a common key always meet in a group.  Groups are cut into blocks of
bounded size, every pair of blocks goes to a task, and the task compares all
pairs of its blocks by matrices of common elements.  Only the links that hold
the verified pairs together leave the task: one for each item and component,
so output grows with the items and not with their pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_partitions

#: Items and elements of their sets in one block.
BLOCK_ITEMS, BLOCK_ELEMENTS = 768, 1 << 19


def block_pairs(postings: DataFrame, items: int = BLOCK_ITEMS, elements: int = BLOCK_ELEMENTS) -> DataFrame:
    """(leader, i, j, own, node): the tasks that each node takes part in.

    ``postings``: key, node, rank (the smallest leads, then the smallest
    node), n (size of the node's set).
    """
    leaders = postings.groupBy("key").agg(F.min(F.struct("rank", "node"))["node"].alias("leader"),
                                          F.count("*").alias("c")).where("c > 1").drop("c")
    members = postings.join(leaders, "key").select("leader", "node", "n").distinct()
    blocks = members.groupBy("leader").agg(F.greatest(
        F.ceil(F.count("*") / items), F.ceil(F.sum("n") / elements)).cast("int").alias("blocks"),
        F.count("*").alias("c")).where("c > 1").drop("c")
    own = F.pmod(F.xxhash64("node", F.lit(7)), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    return members.join(blocks, "leader").select("leader", "node", own.alias("own"), other.alias("other")).select(
        "leader", "node", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))


def common_elements(sets: list[np.ndarray]) -> np.ndarray:
    """Matrix of the sizes of all pairwise intersections (sets of distinct values)."""
    g = len(sets)
    if g <= 4:
        out = np.zeros((g, g), dtype=np.int64)
        for a in range(g):
            for b in range(a):
                out[a, b] = out[b, a] = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
        return out
    x = np.concatenate(sets)
    who = np.repeat(np.arange(g), [len(s) for s in sets])
    order = np.argsort(x, kind="stable")
    x, who = x[order], who[order]
    start = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)
    size = np.diff(np.append(start, len(x)))
    out = np.zeros((g, g), dtype=np.int32)
    rare = np.repeat((size > 1) & (size <= 12), size)
    w, k = who[rare], np.repeat(np.arange(len(size)), size)[rare]
    for d in range(1, 12):  # pairs d apart within one element's list
        same = k[d:] == k[:-d]
        if same.any():
            out += np.bincount(w[:-d][same] * g + w[d:][same], minlength=g * g).reshape(g, g).astype(np.int32)
    out += out.T
    often = np.flatnonzero(size > 12)
    for at in range(0, len(often), 4096):
        cols = often[at:at + 4096]
        m = np.zeros((g, len(cols)), dtype=np.float32)
        for c, e in enumerate(cols):
            m[who[start[e]:start[e] + size[e]], c] = 1
        out += np.rint(m @ m.T).astype(np.int32)
    return out


def share_any(sets: list[np.ndarray]) -> np.ndarray:
    return common_elements(sets) > 0


def forest(linked: np.ndarray) -> np.ndarray:
    """For each item the smallest item of its component (symmetric matrix)."""
    label = np.arange(len(linked))
    while True:
        new = np.where(linked, label[None, :], len(linked)).min(axis=1, initial=len(linked))
        new = np.minimum(label, new)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def link_blocks(pairs: DataFrame, sets: DataFrame, verify: Callable[[dict[str, list]], np.ndarray]) -> DataFrame:
    """Links (a, b) of the pairs that ``verify`` accepts.

    ``pairs``: block_pairs(); ``sets``: node and list columns, one row a node.
    ``verify`` gets the list columns of a task's items and returns the matrix
    of accepted pairs.
    """
    cols = [c for c in sets.columns if c != "node"]
    task = ["leader", "i", "j"]
    shipped = pairs.join(sets, "node").repartition(shuffle_partitions(pairs.sparkSession), *task).sortWithinPartitions(*task)

    def links(rows: list[tuple]) -> pa.RecordBatch:
        node, first = np.unique(np.array([r[0] for r in rows], dtype=np.int64), return_index=True)
        rows = [rows[i] for i in first]
        ok = verify({c: [r[2 + i] for r in rows] for i, c in enumerate(cols)})
        own = np.array([r[1] for r in rows])
        if own.min() != own.max():  # within a block its own task compares
            ok &= own[:, None] != own[None, :]
        label = forest(ok)
        a = np.flatnonzero(label != np.arange(len(node)))
        return pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[label[a]])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = [], None
        for b in batches:
            keys = list(zip(*(b.column(c).to_pylist() for c in task)))
            nodes, owns = b.column("node").to_pylist(), b.column("own").to_pylist()
            lists = []
            for c in cols:
                col = b.column(c)
                off = col.offsets.to_numpy()
                lists.append((col.values.to_numpy(zero_copy_only=False), off))
            for r, k in enumerate(keys):
                if k != key:
                    if len(held) > 1:
                        yield links(held)
                    held, key = [], k
                held.append((nodes[r], owns[r], *(v[o[r]:o[r + 1]] for v, o in lists)))
        if len(held) > 1:
            yield links(held)

    return shipped.mapInArrow(run, "a long, b long")
