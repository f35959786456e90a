"""Capture CSV scan (S1-S3) and trace-source dispatch.

A capture file: line 0 = column names, optional line 1 = radix row, then one
sample per line.  Exactly-empty lines are dropped before numbering.

Files are read line-split (``spark.read.text``), so a large capture is read
by many tasks.  A line's number in its file is its position inside its input
split plus the number of kept lines in the earlier splits of the same file
(prefix sum over a table of one row per split).  File scans are
deterministic, so a lost task re-reads the same lines with the same numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import radix as R
from ..operators.util import bounded_broadcast
from ..session import scratch_path

_POS_BITS = 33


def read_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, mtime, line_no, value) for every non-empty line; ``line_no``
    counts kept lines from 0 in each file."""
    raw = spark.read.text(paths)
    return number_lines(raw)


def number_lines(raw: DataFrame) -> DataFrame:
    """Number the lines of a ``text`` DataFrame (batch or micro-batch)."""
    lines = (raw.select("value", F.col("_metadata.file_path").alias("file"),
                        F.col("_metadata.file_block_start").alias("blk"),
                        F.col("_metadata.file_modification_time").alias("mtime"))
             .where(F.col("value") != ""))
    mid = F.monotonically_increasing_id()
    tagged = (lines.withColumn("_mid", mid)
              .withColumn("_pid", F.shiftright("_mid", _POS_BITS))
              .withColumn("_pos", F.col("_mid").bitwiseAND((1 << _POS_BITS) - 1))
              .drop("_mid"))
    splits = tagged.groupBy("file", "blk", "_pid").agg(F.min("_pos").alias("_first"),
                                                       F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy("file").orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("_off", F.coalesce(F.sum("_n").over(w), F.lit(0))).drop("_n")
    # this narrow pass runs once; later uses of the lines scan the text only
    path = scratch_path(raw.sparkSession, "line-offsets")
    splits.write.mode("overwrite").parquet(path)
    splits = raw.sparkSession.read.schema(splits.schema).parquet(path)
    # one row per input split: broadcast (bounded) so the lines are not shuffled
    return (tagged.join(bounded_broadcast(splits), ["file", "blk", "_pid"])
            .select("file", "mtime",
                    (F.col("_off") + F.col("_pos") - F.col("_first")).alias("line_no"), "value"))


def capture_heads(lines: DataFrame) -> DataFrame:
    """One row per file: column names, radix words, first data line (S2) and
    number of data lines.

    Line 1 is a radix row iff it contains "Radix"; otherwise it is data and
    every column is base 10.  A header-only file and a radix row whose word
    count differs from the column count raise.
    """
    head = (lines.groupBy("file", "mtime")
            .agg(F.max(F.when(F.col("line_no") == 0, F.col("value"))).alias("header"),
                 F.max(F.when(F.col("line_no") == 1, F.col("value"))).alias("line1"),
                 F.max("line_no").alias("last")))
    names = R.split_csv_line(F.col("header"))
    has = R.is_radix_row(F.col("line1"))
    words = F.when(has, R.radix_words(F.col("line1"))).otherwise(
        F.transform(names, lambda n: F.lit("DEC")))
    err_short = F.raise_error(F.concat(F.lit("capture has no data rows: "), F.col("file")))
    err_count = F.raise_error(F.concat(F.lit("radix count differs from column count: "), F.col("file")))
    return head.select(
        "file", "mtime", names.alias("names"),
        F.when(F.col("line1").isNull(), err_short)
        .when(F.size(words) != F.size(names), err_count)
        .otherwise(words).alias("radix"),
        F.when(has, F.lit(2)).otherwise(F.lit(1)).cast("bigint").alias("first_data"),
        F.when(has, F.col("last") - 1).otherwise(F.col("last")).alias("n_data"))


def decode_captures(lines: DataFrame, heads: DataFrame | None = None, keep: list[str] | None = None) -> DataFrame:
    """(file, mtime, trace, i, y_raw BIGINT) long samples (S1 + S3); with
    ``keep``, these columns of ``heads`` instead of file and mtime (what a file
    is known by is then looked up for each line, not for each sample).

    The per-file heads join the data lines by file name.  A sort-merge join
    on ``file`` would send every line of a huge capture to one task, so the
    heads (one row per file) are broadcast behind a row bound; only an
    enormous file count falls back to a shuffle join.
    """
    heads = heads if heads is not None else capture_heads(lines)
    keep = keep or ["file", "mtime"]
    per_file = heads.select(*dict.fromkeys(["file", *[c for c in keep if c != "mtime"]]), "first_data", "names", F.transform(
        F.arrays_zip("names", "radix"), lambda c: F.struct(c["names"].alias("name"), R.base_of(c["radix"]).alias("base"))).alias("_cols"))
    data = lines.where(F.col("line_no") >= 1).join(bounded_broadcast(per_file), "file")
    data = data.where(F.col("line_no") >= F.col("first_data"))
    data = data.withColumn("_cells", R.split_csv_line(F.col("value")))
    cells = F.col("_cells")
    err = F.raise_error(F.concat(F.lit("wrong number of cells in line "),
                                 F.col("line_no").cast("string"), F.lit(" of "), F.col("file")))
    checked = F.when(F.size(cells) == F.size("names"), cells).otherwise(err)
    z = F.arrays_zip(F.col("_cols").alias("col"), checked.alias("cell"))
    long = data.select(*keep, (F.col("line_no") - F.col("first_data")).alias("i"), F.explode(z).alias("c"))
    cell = F.col("c.cell")
    out = long.select(*keep, F.col("c.col.name").alias("trace"), "i", R.decode(cell, F.col("c.col.base"), cell).alias("y_raw"))
    # Files without data rows never reach the decode above; evaluating their
    # head (one row per file) makes a header-only file or a bad radix row
    # raise instead of vanishing.  Valid heads produce no rows here.
    bad = heads.where(F.size("radix") < 0).select(
        *keep, F.lit(None).cast("string").alias("trace"), F.lit(None).cast("bigint").alias("i"),
        F.lit(None).cast("bigint").alias("y_raw"))
    return out.unionByName(bad)


def column_specs(heads: DataFrame) -> DataFrame:
    """(file, columns ARRAY<STRUCT<name, radix>>) for the captures table."""
    return heads.select("file", F.arrays_zip(F.col("names").alias("name"),
                                             F.col("radix").alias("radix")).alias("columns"))


# --------------------------------------------------------------------------
# Trace sources

NULL_SOURCE = {"type": "NullTraceSource"}


def source_from_config(cfg: dict) -> dict:
    """Validate a trace-source config (``NullTraceSource`` | ``CSVFile``)."""
    t = cfg.get("type")
    if t == "NullTraceSource":
        return {"type": t}
    if t == "CSVFile":
        return {"type": t, "path": cfg["path"], "last_modified": cfg.get("last_modified")}
    raise RuntimeError(f"no trace source has the type {t!r}")


def load_source(spark: SparkSession, cfg: dict) -> DataFrame:
    """Scan a configured source; the null source has no data."""
    src = source_from_config(cfg)
    if src["type"] == "NullTraceSource":
        raise RuntimeError("the project has no source yet, so there is nothing to load")
    return decode_captures(read_lines(spark, src["path"]))


def check_source_change(current: dict, new_path: str, latest_version: int) -> dict:
    """S5 rule: a source may be set while unset or at version 0; setting the
    same path again is a no-op; a different path raises."""
    if current.get("type") == "NullTraceSource" or latest_version == 0:
        return {"type": "CSVFile", "path": new_path, "last_modified": None}
    if current.get("path") != new_path:
        raise RuntimeError(f"versions were loaded from {current.get('path')!r}; {new_path!r} needs a project of its own")
    return current
