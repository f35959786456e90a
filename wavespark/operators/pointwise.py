"""Multi-trace pointwise operators J1-J4 (add, subtract, multiply, divide).

Traces are "joined" by sample index inside one version.  Instead of n-1
chained joins we tag every source row with its position in the source list
(a literal table of n rows, broadcast) and aggregate by (project, version, i):
one shuffle for any n, map-side partial aggregation, and groups of exactly n
rows, so a huge trace is spread over all tasks by ``i``.  A source listed twice
contributes twice.  Output length is that of the shortest source: only indexes
present in every source are kept.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import fail

GROUP = ["project", "version", "i"]


def _tagged(df: DataFrame, sources: list[str]) -> DataFrame:
    spark = df.sparkSession
    pos = spark.createDataFrame([(k, s) for k, s in enumerate(sources)],
                                "_pos int, trace string")
    return (df.where(F.col("trace").isin(sorted(set(sources))))
            .join(F.broadcast(pos), "trace"))


def _finish(agg: DataFrame, n: int, out_trace: str, domain: str = "TIME") -> DataFrame:
    return (agg.where(F.col("_n") == n)
            .select("project", "version", F.lit(out_trace).alias("trace"), "i",
                    "x", "y", F.lit(domain).alias("domain")))


def _y(pos: int):
    return F.max(F.when(F.col("_pos") == pos, F.col("y")))


def _x0():
    # x of the first source (its time axis).
    return F.max(F.when(F.col("_pos") == 0, F.col("x"))).alias("x")


def _fold(sources: list[str], op) -> list:
    """One aggregate per source position (exactly one value each), folded
    left to right in source order afterwards: bit-identical whatever the
    partitioning, and the reference's fold order.  A null operand (empty
    cell) gives null."""
    return [_y(k).alias(f"_y{k}") for k in range(len(sources))], \
        reduce(op, [F.col(f"_y{k}") for k in range(len(sources))])


def _combine(df: DataFrame, sources: list[str], out_trace: str, op) -> DataFrame:
    n = len(sources)
    aggs, folded = _fold(sources, op)
    agg = _tagged(df, sources).groupBy(*GROUP).agg(_x0(), *aggs, F.count(F.lit(1)).alias("_n"))
    return _finish(agg.withColumn("y", folded), n, out_trace)


def check_sources(function: str, sources: list[str]) -> None:
    if function in ("subtract", "divide") and len(sources) != 2 or not sources:
        raise ValueError(f"{function} cannot take {len(sources)} sources")


def add(df: DataFrame, sources: list[str], out_trace: str = "add") -> DataFrame:
    """Sum of n traces (left fold from the first source)."""
    if not sources:
        raise ValueError("Add needs at least one source")
    return _combine(df, sources, out_trace, lambda a, b: a + b)


def multiply(df: DataFrame, sources: list[str], out_trace: str = "multiply") -> DataFrame:
    """Product of n traces (left fold)."""
    if not sources:
        raise ValueError("Multiply needs at least one source")
    return _combine(df, sources, out_trace, lambda a, b: a * b)


def subtract(df: DataFrame, sources: list[str], out_trace: str = "subtract") -> DataFrame:
    """y0 - y1; exactly two sources."""
    if len(sources) != 2:
        raise ValueError(f"a difference takes two sources, got {len(sources)}")
    agg = _tagged(df, sources).groupBy(*GROUP).agg(
        _x0(), (_y(0) - _y(1)).alias("y"), F.count(F.lit(1)).alias("_n"))
    return _finish(agg, 2, out_trace)


def divide(df: DataFrame, sources: list[str], out_trace: str = "divide",
           on_zero: str = "error") -> DataFrame:
    """y0 / y1; exactly two sources.  A zero divisor raises (default) or
    gives null with ``on_zero='null'``."""
    if len(sources) != 2:
        raise ValueError(f"a quotient takes two sources, got {len(sources)}")
    if on_zero not in ("error", "null"):
        raise ValueError(f"on_zero must be 'error' or 'null', not {on_zero!r}")
    num, den = _y(0), _y(1)
    zero = fail(f"trace {sources[1]} is zero where it should divide {sources[0]}") if on_zero == "error" else F.lit(None).cast("double")
    q = F.when(den == 0, zero).otherwise(num / den)
    agg = _tagged(df, sources).groupBy(*GROUP).agg(
        _x0(), q.alias("y"), F.count(F.lit(1)).alias("_n"))
    return _finish(agg, 2, out_trace)
