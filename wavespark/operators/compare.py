"""Version operators: resolve (P1), version list (P11), comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def resolve_versions(requests: DataFrame, captures: DataFrame) -> DataFrame:
    """(project, requested) -> resolved ``version``.

    0 -> none; negative counts from the end (-1 = latest); anything outside
    1..latest -> none (null).  ``requests`` has columns (project, requested).
    """
    latest = captures.groupBy("project").agg(F.max("version").alias("_latest"))
    r = F.col("requested")
    v = F.when(r < 0, F.col("_latest") + 1 + r).otherwise(r)
    return (requests.join(latest, "project", "left")
            .withColumn("version", F.when(v.between(F.lit(1), F.col("_latest")), v)
                        .cast("int"))
            .drop("_latest"))


def version_list(captures: DataFrame) -> DataFrame:
    """Versions per project, newest first, with their position."""
    return (captures.select("project", "version").distinct()
            .withColumn("rank", F.dense_rank().over(
                Window.partitionBy("project").orderBy(F.desc("version"))).cast("int")))


def compare_versions(sig: DataFrame, captures: DataFrame, version_a: int, version_b: int,
                     align: str = "trigger") -> DataFrame:
    """One trace at two versions side by side.

    Rows are aligned on ``k = i - t0_index`` (each version has its own
    trigger) or on ``i`` (``align='index'``); a sample that only one version
    has keeps its row, with the other side null.  Output (project, trace, k,
    y_a, y_b, diff).  One aggregate with a column per version instead of a
    join: both versions are read in one scan and meet in one exchange on
    (project, trace, k), which is fine-grained and has no hot key.
    """
    if version_a == version_b:
        raise ValueError("need two different versions")
    rows = sig.where(F.col("version").isin(version_a, version_b))
    if align == "trigger":
        cap = captures.select("project", "version", "t0_index")  # planner size check
        rows = rows.join(cap, ["project", "version"], "left")
        k = F.col("i") - F.coalesce("t0_index", F.lit(0))
    elif align == "index":
        k = F.col("i")
    else:
        raise ValueError("align must be 'trigger' or 'index'")
    side = (lambda v: F.max(F.when(F.col("version") == v, F.col("y"))))
    return (rows.groupBy("project", "trace", k.alias("k")).agg(side(version_a).alias("y_a"), side(version_b).alias("y_b"))
            .withColumn("diff", F.col("y_b") - F.col("y_a")))


def latest_and_previous(sig: DataFrame, captures: DataFrame, project: str) -> tuple[int, int]:
    """Versions shown by the comparison shortcut (latest, previous); raises
    if the project has a single version."""
    vs = [r[0] for r in captures.where(F.col("project") == project)
          .select("version").distinct().orderBy(F.desc("version")).limit(2).collect()]
    if len(vs) < 2:
        raise ValueError(f"project [{project}] has only one version")
    return vs[0], vs[1]
