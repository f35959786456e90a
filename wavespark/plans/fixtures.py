"""Signal tables derived from the driver's tables (FIXTURES.md, part B).

F1 ``events``: 5 traces (event types) x 3 versions (day 1-10, 11-20, 21-31).
F2 ``lineitem``: 5 traces (4 values + TRIGGER) x 7 versions (ship year).
F3 ``embeddings``: one 64-sample trace per vector, version 1.

The sample index ``i`` comes from :func:`dense_index` (range partitioned), not
from a window over a handful of huge partitions.  The tables are written once
per (session, input folder) in the long layout under the checkpoint folder
and read back with partition pruning, like any ingested store.
"""

from __future__ import annotations

import json
import threading
from functools import reduce

import pandas as pd
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..operators.indexing import dense_index
from ..operators.signal import capture_summary
from ..operators.stats import block_stats
from ..session import qualified, scratch_path
from ..sources.store import write_samples, write_version

EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]
LINEITEM_VALUES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LINEITEM_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
                  "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
                  "l_shipdate"]

# Project settings of the fixture projects: (project, implied_dt, dt_unit, description).
PROJECTS = [
    ("events", 0.5, "ms", "event values per type, versions by day of month"),
    ("lineitem", 2.0, "us", "line item measures, versions by ship year"),
    ("embeddings", 1.0, "ns", "one short signal per embedding vector"),
]

# Registry rows of F1/F2: (project, trace, label, state, y_scale, y_offset,
# stat_functions, derivative function, sources, params, ord).
_REG = [
    ("events", "click", "Click", "Active", 2.0, 0.5, ["mean", "stdev"], None, None, None, 0),
    ("events", "error", "Error", "Active", 1.0, -1.0, ["min", "max", "range"], None, None, None, 1),
    ("events", "purchase", "Purchase", "Active", 0.1, 0.0, ["stdev", "min"], None, None, None, 2),
    ("events", "signup", "Signup", "Inactive", 1.0, 0.0, [], None, None, None, 3),
    ("events", "view", "View", "Active", -1.0, 10.0,
     ["max", "mean", "range", "stdev", "min"], None, None, None, 4),
    ("events", "click_plus_view", "Click+View", "Active", 1.0, 0.0, ["mean"],
     "add", ["click", "view"], {}, 5),
    ("events", "click_spectrum", "Click spectrum", "Active", 1.0, 0.0, [],
     "fourier_transform", ["Click"],
     {"frequency_min": "0.0 MHz", "frequency_max": "None", "display_frequency_unit": "Hz"}, 6),
    ("events", "click_lp", "Click low-pass", "Active", 1.0, 0.0, [],
     "lowpass_filter", ["click"], {"cutoff_frequency": "100.0 Hz"}, 7),
    ("lineitem", "l_quantity", "Quantity", "Active", 1.0, 0.0, ["mean"], None, None, None, 0),
    ("lineitem", "l_extendedprice", "Price", "Active", 0.001, 0.0, ["min", "max"], None, None, None, 1),
    ("lineitem", "l_discount", "Discount", "Active", 100.0, 0.0, ["mean", "stdev"], None, None, None, 2),
    ("lineitem", "l_tax", "Tax", "Active", 100.0, 1.0, ["range"], None, None, None, 3),
    ("lineitem", "TRIGGER", "TRIGGER", "Inactive", 1.0, 0.0, [], None, None, None, 4),
    ("lineitem", "discount_amount", "Discount amount", "Active", 1.0, 0.0, ["mean"],
     "multiply", ["l_extendedprice", "l_discount"], {}, 5),
    ("lineitem", "net_price", "Net price", "Active", 2.0, -1.0, ["max"],
     "subtract", ["l_extendedprice", "discount_amount"], {}, 6),
    ("lineitem", "unit_price", "Unit price", "Active", 1.0, 0.0, ["mean"],
     "divide", ["l_extendedprice", "l_quantity"], {}, 7),
]


def registry_rows():
    out = []
    for (p, t, lab, st, sc, off, stats, fn, srcs, params, o) in _REG:
        deriv = None if fn is None else (fn, params, srcs)
        out.append((p, t, lab, st, sc, off, ("None", None, None, None), stats, deriv, o))
    return out


def events_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = (spark.read.parquet(f"{sf_dir}/events.parquet")
          .select("event_id", "ts", "event_type", "value")
          .withColumn("version", F.when(F.dayofmonth("ts") <= 10, 1)
                      .when(F.dayofmonth("ts") <= 20, 2).otherwise(3)))
    idx = dense_index(ev, ["version", "event_type"], ["event_id"])
    return idx.select(F.lit("events").alias("project"), F.col("version").cast("int"),
                      F.col("event_type").alias("trace"), "i",
                      F.col("value").cast("double").alias("y_raw"))


def lineitem_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = (spark.read.parquet(f"{sf_dir}/lineitem.parquet")
          .withColumn("version", (F.year("l_shipdate") - 1994).cast("int")))
    idx = dense_index(li, ["version"], LINEITEM_ORDER)
    wide = idx.select("version", "i", *[F.col(c).cast("double") for c in LINEITEM_VALUES],
                      F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0).alias("TRIGGER"))
    # a scan for each trace, not one unpivot: a task of the sink then sorts the
    # samples of one trace in its split, not five times as many rows
    return reduce(DataFrame.unionByName, [
        wide.select(F.lit("lineitem").alias("project"), "version", F.lit(c).alias("trace"), "i", F.col(c).alias("y_raw"))
        for c in LINEITEM_VALUES + ["TRIGGER"]])


def embeddings_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of the one version, sorted by (trace, i) in each task: vectors
    are sorted before they become 64 rows each."""
    em = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").cast("string").alias("trace"), "embedding")
    return em.sortWithinPartitions("trace").select("trace", F.posexplode("embedding").alias("i", "y_raw")) \
        .select("trace", F.col("i").cast("bigint"), F.col("y_raw").cast("double"))


def embeddings_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One registry row per vector, derived from the table: Savitzky-Golay
    overlay of 7 points, mean/stdev statistics."""
    em = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id")
    ov = F.struct(F.lit("Savitzky–Golay").alias("filter_name"), F.lit(None).cast("string").alias("frequency"),
                  F.lit("7").alias("window_length"), F.lit(2).alias("polyorder"))
    return em.select(F.lit("embeddings").alias("project"), F.col("vec_id").cast("string").alias("trace"),
                     F.concat(F.lit("vec "), F.col("vec_id").cast("string")).alias("label"),
                     F.lit("Active").alias("state"), F.lit(1.0).alias("y_scale"),
                     F.lit(0.0).alias("y_offset"), ov.alias("overlay"),
                     F.array(F.lit("mean"), F.lit("stdev")).alias("stat_functions"),
                     F.lit(None).cast(schemas.DERIVATIVE).alias("derivative"),
                     F.col("vec_id").cast("int").alias("ord"))


@dataclass(frozen=True)
class FixtureStore:
    """Paths of the materialised fixture tables."""
    root: str

    def samples(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.root}/samples")

    def block_stats(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.root}/block_stats")

    def captures(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.root}/captures")

    def registry(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.root}/registry")

    def projects(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.root}/projects")


_LOCK = threading.Lock()
_STORES: dict[tuple[str, str], FixtureStore] = {}


def fixture_store(spark: SparkSession, sf_dir: str) -> FixtureStore:
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"))
    with _LOCK:
        if key in _STORES:
            return _STORES[key]
        root = scratch_path(spark, "fixtures")
        samples = events_samples(spark, sf_dir).unionByName(lineitem_samples(spark, sf_dir))
        write_samples(samples, f"{root}/samples")  # the store's shuffle-free sink
        write_version(embeddings_samples(spark, sf_dir), f"{root}/samples", "embeddings", 1)
        stored = spark.read.parquet(f"{root}/samples")
        block_stats(stored).write.mode("overwrite").parquet(f"{root}/block_stats")
        capture_summary(stored).write.mode("overwrite").parquet(f"{root}/captures")
        reg = spark.createDataFrame(registry_rows(), schemas.REGISTRY)
        reg.unionByName(embeddings_registry(spark, sf_dir)) \
            .write.mode("overwrite").parquet(f"{root}/registry")
        spark.createDataFrame(PROJECTS, schemas.PROJECTS).write.mode("overwrite") \
            .parquet(f"{root}/projects")
        st = FixtureStore(root)
        _STORES[key] = st
        return st


# --------------------------------------------------------------------------
# capture files generated from ``orders``

CAPTURE_ROWS_PER_FILE = 4096
# Capture columns: (header text, radix word).
CAPTURE_COLUMNS = [
    ("Sample in Buffer", "UNSIGNED"),
    ("Sample in Window", "UNSIGNED"),
    ("TRIGGER", "UNSIGNED"),
    ("orders/key[31:0]", "HEX"),
    ("orders/cust[15:0]", "OCTAL"),
    ("orders/price", "BIN"),
    ("orders/neg_cust", "SIGNED"),
    ('"orders/cust,copy"', "unsigned"),
]


def capture_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(bucket, idx, o_orderkey, o_custkey, price, trig): one capture per
    block of CAPTURE_ROWS_PER_FILE consecutive order keys (bounded groups)."""
    from pyspark.sql import Window
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        "o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")
    o = o.withColumn("bucket", F.floor(F.col("o_orderkey") / CAPTURE_ROWS_PER_FILE).cast("bigint"))
    w = Window.partitionBy("bucket").orderBy("o_orderkey")
    return o.select("bucket", (F.row_number().over(w) - 1).cast("bigint").alias("idx"),
                    "o_orderkey", "o_custkey",
                    F.floor("o_totalprice").cast("bigint").alias("price"),
                    F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).cast("bigint").alias("trig"))


def write_order_captures(spark: SparkSession, sf_dir: str, dest: str) -> str:
    """Write one capture CSV per bucket under ``dest/bucket=NNNNN/``: header,
    radix row, data rows, and an empty line before every 1000th row."""
    fr = capture_frame(spark, sf_dir)
    header = ",".join(h for h, _ in CAPTURE_COLUMNS)
    radix = "Radix - " + ",".join(r for _, r in CAPTURE_COLUMNS)
    data = F.concat_ws(",", F.col("idx").cast("string"), F.col("idx").cast("string"),
                       F.col("trig").cast("string"), F.hex("o_orderkey"),
                       F.conv(F.col("o_custkey").cast("string"), 10, 8), F.bin("price"),
                       (-F.col("o_custkey")).cast("string"), F.col("o_custkey").cast("string"))
    rows = fr.select("bucket", (F.col("idx") * 2).alias("seq"), data.alias("value"))
    blanks = fr.where(F.col("idx") % 1000 == 500).select(
        "bucket", (F.col("idx") * 2 - 1).alias("seq"), F.lit("").alias("value"))
    buckets = fr.select("bucket").distinct()
    heads = buckets.select("bucket", F.lit(-3).cast("bigint").alias("seq"), F.lit(header).alias("value")) \
        .unionByName(buckets.select("bucket", F.lit(-2).cast("bigint").alias("seq"),
                                    F.lit(radix).alias("value")))
    lines = rows.unionByName(blanks).unionByName(heads).withColumn(
        "bucket", F.lpad(F.col("bucket").cast("string"), 5, "0"))
    (lines.repartition("bucket").sortWithinPartitions("bucket", "seq").select("bucket", "value")
     .write.mode("overwrite").partitionBy("bucket").text(dest))
    return dest


def write_legacy_snapshots(spark: SparkSession, sf_dir: str, project_dir: str, alternate: bool = False) -> str:
    """Legacy project folder ``project_dir/data/NNNNN/traces.parquet.lz4``: one
    wide lz4 Parquet file per capture block of ``orders`` (bounded size),
    written by the task that holds the block through the filesystem named by
    the folder's URI (local path, ``file:``, ``hdfs://``, ``s3a://``...).
    ``alternate``: odd and even versions lack a column each, and every version
    has a ``trigger.json`` (t0 = its block)."""
    import pyarrow as pa
    import pyarrow.parquet as pq
    from pyarrow import fs as pafs

    fr = capture_frame(spark, sf_dir)
    uri = qualified(spark, project_dir)

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        version = int(pdf["bucket"].iloc[0]) + 1
        filesystem, root = pafs.FileSystem.from_uri(uri)
        d = f"{root}/data/{version:05}"
        filesystem.create_dir(d, recursive=True)
        cols = {"TRIGGER": pdf["trig"], "orders/key[31:0]": pdf["o_orderkey"],
                "orders/cust[15:0]": pdf["o_custkey"], "orders/price": pdf["price"]}
        if alternate:
            del cols["orders/cust[15:0]" if version % 2 == 0 else "orders/price"]
            with filesystem.open_output_stream(f"{d}/trigger.json") as out:
                out.write(f'{{"t0_index": {version - 1}}}'.encode())
        t = pa.table({k: pa.array(v.to_numpy(), pa.int64()) for k, v in cols.items()})
        pq.write_table(t, f"{d}/traces.parquet.lz4", compression="lz4", row_group_size=1000,
                       filesystem=filesystem)
        return pd.DataFrame({"version": [version], "rows": [len(pdf)]})

    fr.groupBy("bucket").applyInPandas(write, "version int, rows long").write.format("noop").mode("overwrite").save()
    return project_dir


def write_legacy_notes(spark: SparkSession, sf_dir: str, project_dir: str) -> str:
    """``project_dir/data/NNNNN/config.json`` of every capture block: a note
    on two traces, and a trace without one."""
    from pyarrow import fs as pafs

    uri = qualified(spark, project_dir)

    def write(frames):
        filesystem, root = pafs.FileSystem.from_uri(uri)
        for pdf in frames:
            for version, n in zip(pdf["version"], pdf["n"]):
                d = f"{root}/data/{version:05}"
                filesystem.create_dir(d, recursive=True)
                note = {"note": f"{n} orders"}
                with filesystem.open_output_stream(f"{d}/config.json") as out:
                    out.write(json.dumps({"TRIGGER": note, "orders/key[31:0]": note, "orders/price": {}}).encode())
            yield pdf

    n = capture_frame(spark, sf_dir).groupBy((F.col("bucket") + 1).cast("int").alias("version")).agg(F.count("*").alias("n"))
    n.mapInPandas(write, "version int, n long").write.format("noop").mode("overwrite").save()
    return project_dir


def copy_over(pairs: DataFrame) -> None:
    """Write each ``source`` over its ``target`` (small files, URIs of the
    cluster's file systems), in tasks."""
    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(frames):
        from pyarrow import fs
        for pdf in frames:
            for source, target in zip(pdf["source"], pdf["target"]):
                (a, path), (b, to) = fs.FileSystem.from_uri(source), fs.FileSystem.from_uri(target)
                with a.open_input_stream(path) as held, b.open_output_stream(to) as out:
                    while block := held.read(1 << 20):
                        out.write(block)
            yield pdf[["target"]]

    pairs.select("source", "target").repartition(n, "target").mapInPandas(run, "target string").write.format("noop").mode(
        "overwrite").save()
