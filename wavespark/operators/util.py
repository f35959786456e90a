"""Small shared helpers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Upper bounds on an explicitly broadcast side.  Above either the join is left
# to the planner (sort-merge / shuffled hash, or AQE's own runtime size check).
BROADCAST_MAX_ROWS = 500_000
BROADCAST_MAX_BYTES = 64 << 20


def _bytes(c: Column, kind: T.DataType) -> Column:
    """Estimated size of a value: strings by their bytes, lists by their
    length (16 bytes an element, 64 where the element is itself nested)."""
    if isinstance(kind, T.StringType | T.BinaryType):
        size = F.octet_length(c)
    elif isinstance(kind, T.ArrayType):
        size = F.size(c) * (64 if isinstance(kind.elementType, T.StructType | T.ArrayType | T.MapType) else 16)
    elif isinstance(kind, T.MapType):
        size = F.size(c) * 64
    elif isinstance(kind, T.StructType):
        size = reduce(lambda a, b: a + b, [_bytes(c[f.name], f.dataType) for f in kind.fields], F.lit(0))
    else:
        return F.lit(8).cast("long")
    return F.greatest(F.coalesce(size, F.lit(0)), F.lit(0)).cast("long") + 8


def bounded_broadcast(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS,
                      max_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """Broadcast hint only behind a proven bound: rows and estimated bytes, as
    partial sums per task in one job (no rows move).

    For derived inputs (aggregates, exploded specs).  Stored metadata tables
    (registry, captures, projects) are not hinted: the planner's own check of
    their file-size statistics against ``autoBroadcastJoinThreshold``
    broadcasts them while they are small and falls back to a sort-merge join
    beyond it, without an extra job.
    """
    size = reduce(lambda a, b: a + b, [_bytes(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields], F.lit(16))
    got = df.agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("b")).first()
    return F.broadcast(df) if got["n"] <= max_rows and (got["b"] or 0) <= max_bytes else df


def fail(msg: str):
    """Column that raises with ``msg`` when evaluated."""
    return F.raise_error(F.lit(msg))
