"""Connected components of a table of links, by large-star and small-star.

Alternating rounds point every node at the smallest node it knows of; each
round is two joins and two aggregates with partial sums, and is written to the
shared checkpoint folder.  Links and labels stay distributed.  Rows with a
null end and self links are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_saved, saved


def _sum(links: DataFrame):
    h = F.xxhash64("a", "b").cast("decimal(20,0)")
    r = links.agg(F.count("*").alias("n"), F.sum(h).alias("h")).first()
    return r["n"], r["h"]


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Links point from the larger node (a) to the smaller (b)."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    rest = links.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return rest.union(least.select("a", F.col("m").alias("b"))).distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) of every node that has a link; root: the smallest node of
    its component.  ``links`` has two long columns a and b, in any direction."""
    start = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = saved(start, "links")
    mark = _sum(now)
    while mark[0]:
        new = saved(_small_star(_large_star(now)), "links")
        after = _sum(new)
        drop_saved(now)
        now = new
        if after == mark:
            break
        mark = after
    roots = now.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
