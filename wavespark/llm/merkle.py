"""Merkle manifest of a dataset, with membership proofs.

Every row is a leaf (``H`` of its encoded fields); the leaves of a group ascend
by key, every ``FAN`` consecutive nodes have their ``H`` as parent, and the
groups' roots form one more tree.  ``H`` is the lower-case hex SHA-256 of its
inputs' concatenation, digests as hex text.

Blocks of ``BLOCK`` consecutive nodes, aligned to the tree, are rows.  A block
keeps each level as one string of 64 hex digits a node, so the run of a parent
is a substring at a fixed place, and the siblings of a node are the substrings
to its left and right in that run.  The roots of the blocks are the nodes of
the next height, until every group has one; the number of jobs grows with the
logarithm of the rows.  On the way back a block hands the siblings above it to
the nodes in it, so a proof needs one join by block and never the whole tree.

No task holds more than a block's nodes, however large a group is: ranks come
from a range partitioning by (group, key).

Rows: a null field is encoded ``-`` and any other by its size in bytes, so null
and empty differ; null groups and null keys come first; rows of equal key are
ordered by their digest, so repeated rows are leaves of their own; very long
texts are hashed where they are read and never move; an empty table has no
leaves, groups or root, and gives an empty result.  Other columns are ignored
and may have any name.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.indexing import dense_index
from ..operators.util import BROADCAST_MAX_BYTES, bounded_broadcast
from .common import drop_saved, saved

#: Children of a node (2 ** BITS), hex digits of a digest, levels and nodes of a block.
BITS, DIGEST, DEPTH = 3, 64, 3
FAN = 1 << BITS
BLOCK = FAN ** DEPTH
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<left:string,right:string>>"
#: Columns that name a block: its group and its number in the group.
AT = ["g", "b"]

PARENTS = (f"array_join(transform(sequence(0, cast((octet_length({{level}}) - 1) div {FAN * DIGEST} as int)), "
           f"r -> sha2(substr({{level}}, r * {FAN * DIGEST} + 1, {FAN * DIGEST}), 256)), '')")
FLANKS = (f"named_struct('left', substr({{level}}, ({{at}} - {{at}} % {FAN}) * {DIGEST} + 1, {{at}} % {FAN} * {DIGEST}), "
          f"'right', substr({{level}}, ({{at}} + 1) * {DIGEST} + 1, ({FAN - 1} - {{at}} % {FAN}) * {DIGEST}))")


def encoded(value: Column) -> Column:
    v = value.cast("string")
    return F.when(v.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v))


def leaf_digest(fields: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*(encoded(f) for f in fields)), 256)


def column(name: str) -> Column:
    return F.col(f"`{name}`")


def folded(start: str, path: str) -> Column:
    """The root that a leaf's digest and its siblings lead to."""
    return F.expr(f"aggregate({path}, {start}, (h, s) -> sha2(concat(s.left, h, s.right), 256))")


def proof_digest(path: str) -> Column:
    """``H`` of all siblings, level by level, left to right."""
    return F.sha2(F.expr(f"array_join(transform({path}, s -> concat(s.left, s.right)), '')"), 256)


@dataclass
class Manifest:
    """Block tables by height (the leaves' blocks first) of the trees of all
    groups, and of the tree over the groups' roots."""
    groups: list[DataFrame]
    top: list[DataFrame]

    def root(self) -> str | None:
        row = self.top[-1].select("node").first()
        return row and row[0]

    def subroots(self) -> DataFrame:
        """group and subroot, one row a group."""
        return self.groups[-1].select(F.col("g").alias("group"), F.col("node").alias("subroot"))

    def drop(self) -> None:
        drop_saved(*self.groups, *self.top)


def _blocks(nodes: DataFrame, carry: list[str], name: str) -> DataFrame:
    """One row a block of ``nodes`` (g, i: rank in the group, node): g, b, many
    (whether the group has other blocks), items, the levels that have a level
    above them, and the block's root ``node``."""
    sizes = nodes.groupBy("g").agg((F.max("i") >= BLOCK).alias("many")).withColumnRenamed("g", "__g")
    rows = nodes.groupBy("g", F.expr(f"i div {BLOCK}").alias("b")).agg(F.sort_array(F.collect_list(F.struct(
        F.expr(f"cast(i % {BLOCK} as int)").alias("at"), "node", *carry))).alias("items"))
    rows = rows.join(bounded_broadcast(sizes), F.col("g").eqNullSafe(F.col("__g"))).drop("__g")
    rows = rows.withColumn("h0", F.array_join("items.node", ""))
    for k in range(DEPTH):
        level = f"h{k}"
        rows = rows.withColumn(f"h{k + 1}", F.when(F.col("many") | (F.octet_length(level) > DIGEST),
                                                   F.expr(PARENTS.format(level=level))))
    below = [F.when(F.col(f"h{k + 1}").isNotNull(), F.col(f"h{k}")).alias(f"l{k}") for k in range(DEPTH)]
    root = F.coalesce(*(f"h{k}" for k in range(DEPTH, -1, -1)))
    return saved(rows.select(*AT, "many", "items", *below, root.alias("node")), name)


def _tree(nodes: DataFrame, carry: list[str], name: str) -> list[DataFrame]:
    heights = [_blocks(nodes, carry, name)]
    while heights[-1].where("many").limit(1).count():
        heights.append(_blocks(heights[-1].select("g", F.col("b").alias("i"), "node"), [], name))
    return heights


def _below(blocks: DataFrame, above: DataFrame, keep: list[str]) -> DataFrame:
    """The nodes of all blocks with the siblings on their way to the root.
    ``above``: g, b and ``path`` of each block, and columns to hand down."""
    steps = ", ".join(f"if(l{k} is null, null, {FLANKS.format(level=f'l{k}', at=f'shiftright(x.at, {BITS * k})')})"
                      for k in range(DEPTH))
    own = F.expr(f"transform(items, x -> struct(x as item, filter(array({steps}), s -> s is not null) as own))")
    up = bounded_broadcast(above, max_bytes=BROADCAST_MAX_BYTES // 8)  # a step holds half a kilobyte
    up = up.withColumnsRenamed({c: f"__{c}" for c in AT})
    rest = [c for c in above.columns if c not in (*AT, "path")]
    rows = blocks.join(up, F.col("g").eqNullSafe(F.col("__g")) & (F.col("b") == F.col("__b"))).select(
        *AT, "path", *rest, F.explode(own).alias("x"))
    return rows.select("g", (F.col("b") * BLOCK + F.col("x.item.at")).alias("b"), *(F.col(f"x.item.{c}").alias(c) for c in keep),
                       *rest, F.concat("x.own", "path").alias("path"))


def build(docs: DataFrame, key: str = "doc_id", group: str = "lang", fields: Sequence[str] = FIELDS,
          presented: Sequence[Column] | None = None, where: Column | None = None) -> Manifest:
    """Manifest of ``docs``.  ``presented``: values of the fields as somebody
    else presents them (of the rows ``where`` holds, else of all); ``prove``
    gives their digests beside the leaves, for ``folded``."""
    if presented is None:
        shown = F.lit(None).cast("string")
    else:
        shown = F.when(F.coalesce(where, F.lit(False)) if where is not None else F.lit(True), leaf_digest(presented))
    leaves = saved(docs.select(column(group).cast("string").alias("g"), column(key).alias("id"),
                               leaf_digest([column(f) for f in fields]).alias("node"), shown.alias("shown")), "merkle-leaves")
    ranked = dense_index(leaves, by=["g"], order=["id", "node"])
    groups = _tree(ranked, ["id", "shown"], "merkle-blocks")
    drop_saved(leaves, ranked)
    roots = dense_index(groups[-1].select(F.lit("").alias("g"), F.col("g").alias("member"), "node"), by=["g"], order=["member"])
    top = _tree(roots, ["member"], "merkle-top")
    drop_saved(roots)
    return Manifest(groups, top)


def prove(manifest: Manifest, key: str = "doc_id", group: str = "lang") -> DataFrame:
    """Per row: key, group, leaf, presented (the leaf where nothing else was
    presented), subroot, root and ``siblings``: (left, right) of every level,
    from the leaf's run to the root's."""
    way = manifest.top[-1].select(*AT, F.expr(f"cast(array() as {PATH})").alias("path"), F.col("node").alias("root"))
    for blocks in reversed(manifest.top[1:]):
        way = _below(blocks, way, [])
    members = _below(manifest.top[0], way, ["member", "node"])
    way = members.select(F.col("member").alias("g"), F.lit(0).cast("long").alias("b"), "path",
                         F.col("node").alias("subroot"), "root")
    for blocks in reversed(manifest.groups[1:]):
        way = _below(blocks, way, [])
    rows = _below(manifest.groups[0], way, ["id", "node", "shown"])
    return rows.select(F.col("id").alias(key), F.col("g").alias(group), F.col("node").alias("leaf"),
                       F.coalesce("shown", "node").alias("presented"), "subroot", "root", F.col("path").alias("siblings"))
