"""N-gram Jaccard self-join by several global token orders.

Two texts link when the Jaccard similarity of their sets of n-word shingles is
at least ``num / den``.  If so, they share a shingle among the first
``p = size - ceil(t * size) + 1`` of their sets under any global order of
shingles.  ``ORDERS`` orders are used, all of which put rare shingles first
(by the power of two of their document frequency) and differ in how they deal
ties; a pair is compared only if it shares a prefix shingle under every order.

Frequencies are needed only for a fixed share of the shingles, those of small
hash (class A); the others rank after them by hash.  A text that has partners
holds at most p - 1 shingles that no other text holds, so the count of such
shingles drops texts without partners before any candidate is formed.

Equal sets form one class at once and are compared as one.  Candidates meet in
groups of bounded blocks (``groups``), so no group is listed pair by pair.

Sets are compared by 64-bit shingle hashes; equal sets are recognised by 128
bits and texts by a 64-bit hash of id and text.

Rows: null, empty and wordless texts have an empty set and link with nothing;
texts of fewer than n words have their word sequence as their one shingle;
rows that repeat id and text are one document; a null id takes part like any
other and never names a component that has other ids; an empty table gives an
empty result; other columns pass through ``keep_one``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.util import bounded_broadcast
from .common import U64, distinct_per_text, drop_saved, mix, saved, shingles, slices, words
from .components import connected_components
from .groups import block_pairs, common_elements, link_blocks, share_any

ORDERS = 3
STEP = 3 << 20


def text_key(key: str, text: str):
    return F.xxhash64(F.col(key).cast("string"), F.coalesce(F.col(text), F.lit("")))


def _sets(col: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    h, first = words(col)
    return distinct_per_text(*shingles(h, first, n))


def _lists(values: np.ndarray, begin: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(values.view(np.int64)))


def class_a(num: int, den: int) -> U64:
    """Hashes below this are class A: up to twice the p - 1 shingles of a set
    that may be its own, so that a text without partners stands out, but no
    more than 30 % of a set (at least a quarter more than p - 1)."""
    own = (den - num) / den
    return U64(min(int(max(min(2 * own, 0.3), 1.25 * own) * 2**64), 2**64 - 1))


def _required(size: np.ndarray, num: int, den: int) -> np.ndarray:
    """Elements that a set shares with any partner at least."""
    return -(-size * num // den)


def signatures(docs: DataFrame, key: str, text: str, n: int, num: int, den: int) -> DataFrame:
    """node, id, size, s1, s2 (the set), in_a (shingles of class A) and the
    ``held`` shingles ``low``: class A and, where needed, the next by hash."""
    edge = class_a(num, den)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, "text", STEP):
                x, begin = _sets(part.column("text"), n)
                size = np.diff(begin)
                full = np.flatnonzero(size)
                s1, s2 = np.zeros(len(size), U64), np.zeros(len(size), U64)
                if len(full):
                    s1[full] = np.add.reduceat(mix(x, 1), begin[full])
                    s2[full] = np.add.reduceat(mix(x, 2), begin[full]) + size[full].astype(U64)
                owner = np.repeat(np.arange(len(size)), size)
                in_a = np.bincount(owner[x < edge], minlength=len(size))
                p = size - _required(size, num, den) + 1
                take = np.maximum(in_a, np.minimum(size, p + np.maximum(p // 4, 1)))
                keep = np.arange(len(x)) - begin[:-1][owner] < take[owner]
                yield pa.RecordBatch.from_arrays(
                    [part.column("node"), part.column("id"), pa.array(size), pa.array(s1.view(np.int64)),
                     pa.array(s2.view(np.int64)), pa.array(in_a.astype(np.int64)), pa.array(take * (size > 0)),
                     _lists(x[keep], np.concatenate([[0], np.cumsum(take * (size > 0))]))],
                    ["node", "id", "size", "s1", "s2", "in_a", "held", "low"])

    frame = docs.select(text_key(key, text).alias("node"), F.col(key).cast("long").alias("id"),
                        F.coalesce(F.col(text), F.lit("")).alias("text"))
    return saved(frame.mapInArrow(run, "node long, id long, size long, s1 long, s2 long, in_a long, "
                                  "held long, low array<long>"),
                 "ngram-sets")


def prefixes(shingled: DataFrame, table: DataFrame, copies: DataFrame, num: int, den: int) -> DataFrame:
    """node, size, rank and the prefix p0, p1, ... under each order, of the
    classes that can have partners.  ``table`` is ``shingled`` without its
    lists, ``copies`` the nodes that another one of their class stands for."""
    edge = class_a(num, den)
    narrow = table.select("node", "size", "in_a", "held")
    if _has_repeats(table):  # rows that repeat a document have equal content
        shingled, narrow = shingled.dropDuplicates(["node"]), narrow.dropDuplicates(["node"])
    alone = shingled.where("size > 0").select("node", "low").join(bounded_broadcast(copies), "node", "left_anti")
    rows = alone.select("node", F.explode("low").alias("token"))  # as narrow as can be: most rows of all
    often = rows.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    shared = rows.join(often, "token").groupBy("node").agg(F.collect_list(F.struct("token", "df")).alias("t"))
    shared = shared.join(narrow, "node")
    alone = F.col("held") - F.size("t")
    alive = shared.where(alone <= F.col("size") - F.ceil(F.col("size") * num / den)).select(
        "node", "size", "in_a", alone.cast("long").alias("rank"), F.col("t.token").alias("token"), F.col("t.df").alias("df"))
    names = [f"p{j}" for j in range(ORDERS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, in_a = (b.column(c).to_numpy(zero_copy_only=False) for c in ("size", "in_a"))
            tok = b.column("token").flatten().to_numpy(zero_copy_only=False).view(U64)
            df = b.column("df").flatten().to_numpy(zero_copy_only=False)
            count = b.column("token").value_lengths().to_numpy(zero_copy_only=False)
            owner = np.repeat(np.arange(b.num_rows), count)
            begin = np.concatenate([[0], np.cumsum(count)])
            is_a = tok < edge
            p = size - _required(size, num, den) + 1
            alone_a = in_a - np.bincount(owner[is_a], minlength=b.num_rows)
            level = np.floor(np.log2(df)).astype(np.int64)
            out = []
            for j in range(ORDERS):
                order = np.lexsort((mix(tok, 21 + j), level, ~is_a, owner))
                nth = np.arange(len(tok)) - begin[:-1][owner]
                keep = (in_a < p)[owner] | (is_a[order] & (nth < (p - alone_a)[owner]))
                n = np.bincount(owner[keep], minlength=b.num_rows)
                out.append(_lists(tok[order][keep], np.concatenate([[0], np.cumsum(n)])))
            yield pa.RecordBatch.from_arrays([b.column("node"), b.column("size"), b.column("rank"), *out],
                                             ["node", "size", "rank", *names])

    schema = "node long, size long, rank long, " + ", ".join(f"{c} array<long>" for c in names)
    return saved(alive.mapInArrow(run, schema), "ngram-prefixes")


def _has_repeats(table: DataFrame) -> bool:
    return bool(table.groupBy("node").count().where("count > 1").limit(1).count())


def verifier(num: int, den: int):
    def verify(c: dict[str, list]) -> np.ndarray:
        size = np.array([len(s) for s in c["tokens"]])
        ok = (np.minimum.outer(size, size) * den >= np.maximum.outer(size, size) * num)
        np.fill_diagonal(ok, False)
        for j in range(ORDERS):
            if ok.any():
                ok &= share_any(c[f"p{j}"])
        left = np.flatnonzero(ok.any(axis=1))
        out = np.zeros_like(ok)
        if len(left):
            both = common_elements([c["tokens"][i] for i in left])
            total = np.add.outer(size[left], size[left]) - both
            out[np.ix_(left, left)] = ok[np.ix_(left, left)] & (both * den >= total * num)
        return out
    return verify


def near_sets(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5,
              num: int = 80, den: int = 100) -> DataFrame:
    """node, id, size and root (of the node's component) of every row."""
    shingled = signatures(docs, key, text, n, num, den)
    table = saved(shingled.drop("low"), "ngram-documents")
    classes = table.where("size > 0").groupBy("s1", "s2", "size").agg(F.min("node").alias("node"))
    copies = table.join(classes.withColumnRenamed("node", "class"), ["s1", "s2", "size"]).where(
        "node <> class").select("node").distinct()
    pre = prefixes(shingled, table, copies, num, den)
    drop_saved(shingled)
    postings = pre.select("node", "rank", F.col("size").alias("n"), F.explode("p0").alias("key"))
    pairs = saved(block_pairs(postings), "ngram-blocks")
    wanted = pairs.select("node").distinct()

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, "text", STEP):
                yield pa.RecordBatch.from_arrays([part.column("node"), _lists(*_sets(part.column("text"), n))],
                                                 ["node", "tokens"])

    chosen = docs.select(text_key(key, text).alias("node"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(
        bounded_broadcast(wanted), "node", "left_semi")
    full = chosen.mapInArrow(sets, "node long, tokens array<long>").join(pre.drop("size", "rank"), "node")
    roots = connected_components(link_blocks(pairs, full, verifier(num, den)))
    done = saved(table.join(classes.withColumnRenamed("node", "class"), ["s1", "s2", "size"], "left").join(
        roots.select(F.col("node").alias("class"), "root"), "class", "left").select(
        "node", "id", "size", F.coalesce("root", "class", "node").alias("root")), "ngram-roots")
    drop_saved(table, pre, pairs)
    return done


def link_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5,
                   num: int = 80, den: int = 100) -> DataFrame:
    """id (as ``key``), n_shingles and component_id: the smallest id that links reach."""
    rows = near_sets(docs, key, text, n, num, den)
    # a document alone in its component names it itself; only the others are joined
    least = rows.where("size > 0").groupBy("root").agg(F.min("id").alias("component_id"), F.count("*").alias("c")).where(
        "c > 1").drop("c")
    return rows.join(bounded_broadcast(least), "root", "left").select(
        F.col("id").alias(key), F.col("size").alias("n_shingles"),
        F.when(F.col("size") > 0, F.coalesce("component_id", "id")).otherwise(F.col("id")).alias("component_id"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5,
             num: int = 80, den: int = 100) -> DataFrame:
    """The documents without near duplicates of a smaller id, columns as given."""
    rows = near_sets(docs, key, text, n, num, den)
    best = rows.where("size > 0").groupBy("root").agg(
        F.min(F.struct(F.coalesce("id", F.lit(2**63 - 1)), "node"))["node"].alias("best"), F.count("*").alias("c"))
    gone = rows.where("size > 0").join(best.where("c > 1"), "root").where("node <> best").select("node").distinct()
    frame = docs.withColumn("__node", text_key(key, text))
    left = frame.join(bounded_broadcast(gone.withColumnRenamed("node", "__node")), "__node", "left_anti")
    twice = rows.where("size > 0").groupBy("node").count().where("count > 1").select(F.col("node").alias("__node"))
    if twice.limit(1).count():  # rows that repeat a document
        twice = bounded_broadcast(twice)
        left = left.join(twice, "__node", "left_anti").unionByName(
            left.join(twice, "__node", "left_semi").dropDuplicates(["__node"]))
    return left.select(*docs.columns)
