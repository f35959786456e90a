"""Session helpers: scratch/checkpoint location and the local test session."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

# Spark settings this library relies on.  AQE re-plans joins with runtime
# sizes (a broadcast only happens under the measured threshold) and splits
# skewed shuffle partitions.
RECOMMENDED_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.compression.codec": "lz4_raw",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "wavespark") -> SparkSession:
    """Local session for tests and benchmarks (UI off, no server ports)."""
    b = (SparkSession.builder.master(f"local[{cores}]").appName(app)
         .config("spark.ui.enabled", "false")
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
         .config("spark.driver.memory", "8g")
         .config("spark.ui.showConsoleProgress", "false"))
    for k, v in RECOMMENDED_CONF.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    distribute(spark)
    return spark


def distribute(spark: SparkSession) -> None:
    """Send this package to the Python workers (``addPyFile``).  Needed where
    it is on the driver's path only; not where it is installed on the
    executors or on their PYTHONPATH."""
    here = Path(__file__).resolve().parent
    if str(spark.conf.get("wavespark.distributed", "")) == str(here):
        return
    zipped = Path(tempfile.mkdtemp(prefix="wavespark-zip-")) / "wavespark.zip"
    with zipfile.ZipFile(zipped, "w") as z:
        for f in sorted(here.rglob("*.py")):
            z.write(f, f.relative_to(here.parent))
    spark.sparkContext.addPyFile(str(zipped))
    spark.conf.set("wavespark.distributed", str(here))


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Only when the session has none (local tests) do we set our own, in a fresh
    temporary folder; on a cluster a machine-local folder would be wrong, so a
    non-local master without the setting is an error.
    """
    sc = spark.sparkContext
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if d:
        return d.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder for this cluster")
    d = tempfile.mkdtemp(prefix="wavespark-ckpt-")
    spark.conf.set("spark.checkpoint.dir", d)
    sc.setCheckpointDir(d)
    return d


def _hadoop(spark: SparkSession, path: str):
    """(file system, path) as the cluster resolves ``path``, which may name no
    scheme: the driver's own file system is never asked."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _hadoop(spark, path)
    return fs.exists(p)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch path of this library's own making."""
    fs, p = _hadoop(spark, path)
    fs.delete(p, True)


def qualified(spark: SparkSession, path: str) -> str:
    """The path as a full URI, as tasks need it outside Spark's readers."""
    fs, p = _hadoop(spark, path)
    uri = fs.makeQualified(p).toString()
    return "file://" + uri.removeprefix("file:") if uri.startswith("file:/") and not uri.startswith("file://") else uri


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique folder under the shared checkpoint folder."""
    path = f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    fs, p = _hadoop(spark, path)
    fs.mkdirs(p)
    return path


def create_exclusive(spark: SparkSession, path: str, text: str) -> bool:
    """Create a small file with its content in one step; False if the path is
    taken.  The content is written beside it first; what then puts it in place
    fails if the name exists: a hard link on a local (or mounted) file system,
    a rename elsewhere, which needs a store with such a rename (HDFS has it;
    Spark's own checkpoints ask for the same)."""
    fs, p = _hadoop(spark, path)
    fs.mkdirs(p.getParent())
    beside = spark._jvm.org.apache.hadoop.fs.Path(p.getParent(), f".{uuid.uuid4().hex}")
    out = fs.create(beside, False)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        if fs.getScheme() == "file":
            os.link(beside.toUri().getPath(), p.toUri().getPath())
            return True
        files = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), spark._jsc.hadoopConfiguration())
        how = spark.sparkContext._gateway.new_array(getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        files.rename(beside, p, how)
        return True
    except Exception:
        if fs.exists(p):
            return False
        raise
    finally:
        fs.delete(beside, False)


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = _hadoop(spark, path)
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()
