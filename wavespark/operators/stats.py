"""Per-trace statistics A1-A7.

All five statistics are computed in one grouped aggregate with partial
(map-side) and final phases; population standard deviation is decomposable,
so a hot trace never lands in one task.

Stored samples have block statistics beside them (:func:`block_stats`): count,
extremes, mean and sum of squared deviations of every ``BLOCK`` samples.  They
merge exactly, and a linear transform (P5) can be applied to them, so the
statistics and triggers of raw traces need no sample.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .util import bounded_broadcast

# Statistic names, in the order the configuration dialog lists
# them, and the legend symbols shown for each (must equal the reference's).
STAT_FUNCTIONS = ["min", "max", "range", "mean", "stdev"]
STAT_SYMBOLS = {
    "min": r"Y_{-}",
    "max": r"Y^{+}",
    "range": r"\Delta",
    "mean": r"\overline{Y}",
    "stdev": r"\sigma",
}

KEY = ["project", "version", "trace"]
#: Samples that one row of block statistics stands for.
BLOCK = 1 << 16


def trace_stats(sig: DataFrame, value_col: str = "y") -> DataFrame:
    """A1-A5 per (project, version, trace): min, max, range, mean, stdev
    (population).  Nulls are skipped."""
    y = F.col(value_col)
    return (sig.groupBy(*KEY)
            .agg(F.min(y).alias("min"), F.max(y).alias("max"),
                 F.avg(y).alias("mean"), F.stddev_pop(y).alias("stdev"),
                 F.count(y).alias("n"))
            .withColumn("range", F.col("max") - F.col("min"))
            .select(*KEY, "n", *STAT_FUNCTIONS))


def block_stats(samples: DataFrame, block: int = BLOCK) -> DataFrame:
    """(KEY, block, rows, n, low, high, mean, m2, first_set) of raw samples: n
    values that are not null, m2 their sum of squared deviations from the
    block's mean, first_set the least index from 1 on whose value is not 0."""
    y = F.col("y_raw").cast("double")
    return (samples.groupBy(*KEY, F.floor(F.col("i") / block).cast("bigint").alias("block"))
            .agg(F.count(F.lit(1)).alias("rows"), F.count(y).alias("n"), F.min(y).alias("low"), F.max(y).alias("high"),
                 F.avg(y).alias("mean"), (F.var_pop(y) * F.count(y)).alias("m2"),
                 F.min(F.when((F.col("i") >= 1) & (y != 0), F.col("i"))).alias("first_set")))


def stats_of_blocks(blocks: DataFrame, registry: DataFrame) -> DataFrame:
    """A1-A5 of raw traces from their block statistics, after P5: the same rows
    as ``trace_stats`` of the signal frame.  Deviations are taken from the mean
    of the whole trace (blocks are joined with one row a trace), so nothing
    cancels."""
    whole = blocks.groupBy(*KEY).agg(F.sum("n").alias("_n"), (F.sum(F.col("mean") * F.col("n")) / F.sum("n")).alias("_mean"))
    apart = F.col("m2") + F.col("n") * (F.col("mean") - F.col("_mean")) ** 2
    out = (blocks.join(bounded_broadcast(whole), KEY).groupBy(*KEY, "_n", "_mean")
           .agg(F.min("low").alias("_low"), F.max("high").alias("_high"), F.sum(apart).alias("_m2")))
    reg = registry.select("project", "trace", "y_scale", "y_offset")  # planner size check
    a, b = F.coalesce("y_scale", F.lit(1.0)), F.coalesce("y_offset", F.lit(0.0))
    ends = a * F.col("_low") + b, a * F.col("_high") + b
    return (out.join(reg, ["project", "trace"], "left")
            .select(*KEY, F.col("_n").alias("n"), F.least(*ends).alias("min"), F.greatest(*ends).alias("max"),
                    (a * F.col("_mean") + b).alias("mean"), (F.abs(a) * F.sqrt(F.col("_m2") / F.col("_n"))).alias("stdev"))
            .withColumn("range", F.col("max") - F.col("min"))
            .select(*KEY, "n", *STAT_FUNCTIONS))


def trigger_of_blocks(blocks: DataFrame, trigger_trace: str = "TRIGGER") -> DataFrame:
    """S9 from block statistics: the rows of ``signal.trigger_index``."""
    agg = blocks.where(F.col("trace") == trigger_trace).groupBy("project", "version").agg(
        F.min("first_set").alias("_first"), F.sum("rows").alias("_n"))
    return agg.select("project", "version", F.when(F.col("_n") > 2, F.coalesce(F.col("_first") - 1, F.lit(0)))
                      .otherwise(F.lit(0)).cast("bigint").alias("t0_index"))


def check_stat_names(names: list[str]) -> None:
    bad = [n for n in names if n not in STAT_FUNCTIONS]
    if bad:
        raise RuntimeError(f"no statistic is called {bad[0]!r}; known: {STAT_FUNCTIONS}")


def selected_stats(stats: DataFrame, registry: DataFrame) -> DataFrame:
    """Only the statistics listed in each trace's ``stat_functions``, in
    list order -> (project, version, trace, stat_pos, stat, value).  An unknown
    name raises when evaluated."""
    reg = registry.select("project", "trace", "stat_functions").where(F.size("stat_functions") > 0)
    long = stats.unpivot(KEY, STAT_FUNCTIONS, "stat", "value")
    listed = reg.select("project", "trace",
                        F.posexplode("stat_functions").alias("stat_pos", "stat"))
    known = F.array(*[F.lit(s) for s in STAT_FUNCTIONS])
    listed = listed.withColumn(
        "stat", F.when(F.array_contains(known, F.col("stat")), F.col("stat"))
        .otherwise(F.raise_error(F.concat(F.lit("no statistic is called "), F.col("stat")))))
    return (long.join(listed, ["project", "trace", "stat"], "inner")
            .select(*KEY, F.col("stat_pos").cast("int").alias("stat_pos"), "stat", "value"))


def two_significant(value) -> Column:
    """Text of ``float(f"{v:.2g}")`` as Python prints it: positional for
    1e-4 <= |v| < 1e16 ("1200.0", "0.00012"), else "1.2e-05" / "1e+16"."""
    v = F.col(value) if isinstance(value, str) else value
    s = F.format_string("%.1e", v)
    pat = r"^(-?)(\d)\.(\d)e([+-]\d+)$"
    sign, d1, d2 = (F.regexp_extract(s, pat, k) for k in (1, 2, 3))
    e = F.regexp_extract(s, pat, 4).cast("int")
    digits = F.when(d2 == "0", d1).otherwise(F.concat(d1, d2))
    nd = F.length(digits)
    pos_big = F.when(nd - 1 <= e, F.concat(digits, F.repeat(F.lit("0"), e - nd + 1), F.lit(".0"))) \
        .otherwise(F.concat(d1, F.lit("."), d2))
    pos_small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -e - 1), digits)
    mant = F.when(nd == 2, F.concat(d1, F.lit("."), d2)).otherwise(d1)
    sci = F.concat(mant, F.lit("e"), F.when(e < 0, F.lit("-")).otherwise(F.lit("+")),
                   F.when(F.abs(e) < 10, F.concat(F.lit("0"), F.abs(e).cast("string")))
                   .otherwise(F.abs(e).cast("string")))
    body = F.when((e >= 0) & (e < 16), pos_big).when((e < 0) & (e >= -4), pos_small).otherwise(sci)
    out = F.when(v == 0, F.lit("0.0")).otherwise(F.concat(sign, body))
    return (F.when(F.isnan(v), F.lit("nan"))
            .when(v == float("inf"), F.lit("inf")).when(v == float("-inf"), F.lit("-inf"))
            .otherwise(out))


def _symbols():
    return F.create_map(*[c for k, v in STAT_SYMBOLS.items() for c in (F.lit(k), F.lit(v))])


def legend_text(selected: DataFrame, registry: DataFrame, style: str = "view",
                show_version: bool = False) -> DataFrame:
    """Legend line per (project, version, trace).

    ``style='plot'``: ``label`` (``label # version`` when ``show_version``) and
    values rounded to 2 decimals; ``style='view'``: ``label V:version`` and
    values to 2 significant digits.
    """
    if style == "plot":
        # Python rounds half to even; bround does the same on the decimal form.
        v = F.bround("value", 2).cast("string")
    elif style == "view":
        v = two_significant("value")
    else:
        raise ValueError("style must be 'plot' or 'view'")
    part = F.concat(F.lit(", $"), _symbols()[F.col("stat")], F.lit("="), v, F.lit("$"))
    per = selected.withColumn("_part", F.struct("stat_pos", part.alias("s")))
    agg = per.groupBy(*KEY).agg(F.array_sort(F.collect_list("_part")).alias("_parts"))
    reg = registry.select("project", "trace", "label")  # planner size check
    if style == "view":
        head = F.concat(F.col("label"), F.lit(" V:"), F.col("version").cast("string"))
    elif show_version:
        head = F.concat(F.col("label"), F.lit(" # "), F.col("version").cast("string"))
    else:
        head = F.col("label")
    return (agg.join(reg, ["project", "trace"], "inner")
            .select(*KEY, F.concat(head, F.array_join(F.transform("_parts", lambda p: p["s"]), ""))
                    .alias("legend")))
