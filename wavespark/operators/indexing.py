"""Dense per-group sample numbering without a hot task.

``row_number() over (partition by g order by o)`` sends a whole group to one
task; a trace can hold a third of all rows.  Here the rows are range
partitioned on (g, o) -- a hot group spans many tasks -- and each row's index
is its position in its partition plus the row count of the same group in the
earlier partitions (a prefix sum over a table of one row per (partition,
group)).

The tagged rows are written once to the shared checkpoint folder and read
back: the range partitioner samples with a seed that depends on the RDD, so
two evaluations of the same plan can draw different bounds, and a lost
executor must not renumber rows.  Both the counts and the final join read the
same files.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path
from .util import bounded_broadcast

_POS_BITS = 33  # monotonically_increasing_id = partition << 33 | row in partition


def dense_index(df: DataFrame, by: list[str], order: list[Column | str],
                index_col: str = "i", num_partitions: int | None = None) -> DataFrame:
    """Add ``index_col`` = 0-based rank of each row inside its ``by`` group.

    ``order`` must be a total order within a group (ties get distinct but
    arbitrary numbers, as with ``row_number``).
    """
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c) if isinstance(c, str) else c for c in [*by, *order]]
    ranged = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    mid = F.monotonically_increasing_id()
    tagged = (ranged.withColumn("_mid", mid)
              .withColumn("_pid", F.shiftright("_mid", _POS_BITS))
              .withColumn("_pos", F.col("_mid").bitwiseAND((1 << _POS_BITS) - 1))
              .drop("_mid"))
    path = scratch_path(spark, "dense-index")
    tagged.write.mode("overwrite").parquet(path)
    tagged = spark.read.parquet(path)
    counts = tagged.groupBy("_pid", *by).agg(F.min("_pos").alias("_first"),
                                            F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*by).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (counts.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0)))
               .drop("_n"))
    # one row per (partition, group): broadcast when bounded, else a shuffle
    # join on (partition, group), which spreads even a hot group
    o = bounded_broadcast(offsets).alias("_o")
    t = tagged.alias("_t")
    cond = reduce(lambda a, b: a & b,
                  [F.col(f"_t.{c}").eqNullSafe(F.col(f"_o.{c}")) for c in ["_pid", *by]])
    joined = t.join(o, cond, "inner")
    cols = [F.col(f"_t.{c}") for c in df.columns]
    out = joined.select(*cols, (F.col("_o._off") + F.col("_t._pos") - F.col("_o._first"))
                        .cast("bigint").alias(index_col))
    out.scratch = path  # for callers that drop it once the result is written
    return out
