"""Raw traces -> signal frames: trigger (S9), linear transform (P5), time axis
(P6), domain type (P7).

Signal frame: (project, version, trace, i, x, y, domain); ``i`` carries the
sample order so no operator depends on physical row order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


KEY = ["project", "version", "trace"]


def trigger_index(samples: DataFrame, trigger_trace: str = "TRIGGER",
                  exact: bool = False) -> DataFrame:
    """(project, version, t0_index) for versions that have a trigger column.

    The first row r >= 1 whose trigger value is non-zero gives t0 = r - 1
    (r with ``exact=True``); row 0 is never considered; no such row, or a
    column of at most two rows, gives 0.  Null never triggers.  One partial +
    final aggregate; no ordering needed because ``i`` is explicit.
    """
    shift = 0 if exact else 1
    hit = F.when((F.col("i") >= 1) & (F.col("y_raw") != 0), F.col("i") - shift)
    agg = (samples.where(F.col("trace") == trigger_trace)
           .groupBy("project", "version")
           .agg(F.min(hit).alias("_t0"), F.count(F.lit(1)).alias("_n")))
    return agg.select("project", "version",
                      F.when(F.col("_n") > 2, F.coalesce("_t0", F.lit(0)))
                      .otherwise(F.lit(0)).cast("bigint").alias("t0_index"))


def capture_summary(samples: DataFrame, trigger_trace: str = "TRIGGER") -> DataFrame:
    """(project, version, n_samples, t0_index) derived from a samples table."""
    n = (samples.groupBy("project", "version", "trace").agg(F.count(F.lit(1)).alias("_n"))
         .groupBy("project", "version").agg(F.max("_n").cast("bigint").alias("n_samples")))
    t0 = trigger_index(samples, trigger_trace)
    return (n.join(t0, ["project", "version"], "left")
            .select("project", "version", "n_samples",
                    F.coalesce("t0_index", F.lit(0)).cast("bigint").alias("t0_index")))


def linear_transform(df: DataFrame, registry: DataFrame, value_col: str = "y_raw",
                     out_col: str = "y") -> DataFrame:
    """P5: ``y = y_scale * value + y_offset`` per registered trace.

    Traces missing from the registry keep scale 1.0 / offset 0.0.  The result
    is always DOUBLE.
    """
    reg = registry.select("project", "trace", "y_scale", "y_offset")  # planner size check
    return (df.join(reg, ["project", "trace"], "left")
            .withColumn(out_col, F.coalesce("y_scale", F.lit(1.0))
                        * F.col(value_col).cast("double")
                        + F.coalesce("y_offset", F.lit(0.0)))
            .drop("y_scale", "y_offset"))


def apply_scale_offset(df: DataFrame, y_scale: float, y_offset: float) -> DataFrame:
    """P5 with literal coefficients (derivative traces: after the function)."""
    if y_scale == 1.0 and y_offset == 0.0:
        return df
    return df.withColumn("y", F.lit(float(y_scale)) * F.col("y") + F.lit(float(y_offset)))


def time_axis(df: DataFrame, captures: DataFrame, projects: DataFrame) -> DataFrame:
    """``x = implied_dt * (i - t0_index)`` in project units (negative
    before the trigger).  Versions without a capture row use t0 = 0 and
    projects without a row use the default step 1.0."""
    cap = captures.select("project", "version", "t0_index")  # planner size check
    prj = projects.select("project", "implied_dt")
    return (df.join(cap, ["project", "version"], "left")
            .join(prj, ["project"], "left")
            .withColumn("x", F.coalesce("implied_dt", F.lit(1.0))
                        * (F.col("i") - F.coalesce("t0_index", F.lit(0))).cast("double"))
            .drop("t0_index", "implied_dt"))


def domain_of(function: Column) -> Column:
    """FREQUENCY iff the trace is a Fourier-transform derivative."""
    return F.when(function == F.lit("fourier_transform"), F.lit("FREQUENCY")).otherwise(F.lit("TIME"))


def signal_frame(samples: DataFrame, registry: DataFrame, captures: DataFrame,
                 projects: DataFrame) -> DataFrame:
    """Raw samples -> (project, version, trace, i, x, y, domain)."""
    y = linear_transform(samples, registry)
    xy = time_axis(y, captures, projects)
    return xy.select("project", "version", "trace", "i", "x", "y",
                     F.lit("TIME").alias("domain"))


def with_x_unit(df: DataFrame, registry: DataFrame, projects: DataFrame) -> DataFrame:
    """Q28: add ``x_unit``: the project's time unit for TIME traces, the
    display frequency unit of the Fourier derivative for FREQUENCY traces
    (in single plots and views alike).  Needs (project, trace, domain)."""
    reg = registry.select("project", "trace",
                          F.col("derivative.params")["display_frequency_unit"].alias("_fu"))
    prj = projects.select("project", F.col("dt_unit").alias("_tu"))  # planner size check
    out = df.join(reg, ["project", "trace"], "left").join(prj, "project", "left")
    unit = F.when(F.col("domain") == "FREQUENCY", F.col("_fu")).otherwise(F.coalesce("_tu", F.lit("ms")))
    return out.withColumn("x_unit", unit).drop("_fu", "_tu")
