"""Versioned sample store: ingest sink (S6, S7, S9-S11), snapshot scans
and the project catalogue (S13).

Layout under ``root``::

    samples/project=P/version=V/*.parquet   (trace, i, y_raw), sorted by trace, i
    block_stats/ statistics of every 65,536 samples of a trace (A1-A6 read no sample)
    captures/    one row per (project, version): source, change id, t0, size, columns
    registry/    trace registry rows (bootstrapped at a project's first load)
    notes/       (project, version, trace, note)
    projects/    project settings
    claims/P/    which load has which versions (:mod:`claims`)

The captures row is written last: it is the commit marker of a version.  Loads
may run at once: each claims its versions before it writes, and adds its rows
to captures, registry and notes in a folder of its own.  A retry after a
failure takes the claim over and overwrites the half-written sample partitions
(dynamic partition overwrite), so ingest is idempotent.
"""

from __future__ import annotations

import hashlib
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from urllib.parse import quote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..operators.indexing import dense_index
from ..operators.stats import block_stats, trigger_of_blocks
from ..operators.util import BROADCAST_MAX_ROWS, bounded_broadcast
from ..session import exists, remove, scratch_path
from . import capture, claims


@dataclass(frozen=True)
class Store:
    root: str

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def _read(self, spark: SparkSession, table: str, schema) -> DataFrame:
        """A stored table with its declared types: a project called 007 stays a
        string although it is a folder name (partition value) on disk."""
        p = self.path(table)
        if not exists(spark, p):
            return spark.createDataFrame([], schema)
        reader = spark.read.schema(schema)
        if table != "samples":  # every load adds a folder
            reader = reader.option("recursiveFileLookup", "true")
        return reader.parquet(p)

    def add(self, df: DataFrame, table: str, load: str) -> None:
        """Rows of one load, in its own folder: loads that end at once do not
        touch each other's uncommitted files, and a retry replaces its own."""
        df.write.mode("overwrite").parquet(f"{self.path(table)}/load-{load}")

    def added(self, spark: SparkSession, table: str, load: str, schema) -> DataFrame:
        return spark.read.schema(schema).parquet(f"{self.path(table)}/load-{load}")

    def samples(self, spark: SparkSession, committed: bool = True) -> DataFrame:
        """Samples of committed versions (those that have a captures row)."""
        rows = self._read(spark, "samples", schemas.SAMPLES)
        if not committed:
            return rows
        return rows.join(self.captures(spark).select("project", "version"), ["project", "version"], "left_semi")

    def block_stats(self, spark: SparkSession) -> DataFrame:
        """Block statistics of committed versions."""
        rows = self._read(spark, "block_stats", schemas.BLOCK_STATS)
        return rows.join(self.captures(spark).select("project", "version"), ["project", "version"], "left_semi").dropDuplicates(
            ["project", "version", "trace", "block"])  # a retry after a crash wrote them again

    def captures(self, spark: SparkSession) -> DataFrame:
        return self._read(spark, "captures", schemas.CAPTURES)

    def registry(self, spark: SparkSession) -> DataFrame:
        return self._read(spark, "registry", schemas.REGISTRY)

    def notes(self, spark: SparkSession) -> DataFrame:
        return self._read(spark, "notes", schemas.NOTES)

    def projects(self, spark: SparkSession) -> DataFrame:
        return self._read(spark, "projects", schemas.PROJECTS)


def write_samples(df: DataFrame, path: str) -> None:
    """Long-layout sink partitioned by (project, version).  No shuffle: each
    task sorts its own rows by (trace, i) before writing, so every file's row
    groups cover narrow trace ranges and Parquet statistics skip the other
    traces.  Only the partitions present in ``df`` are replaced."""
    (df.sortWithinPartitions("project", "version", "trace", "i")
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("project", "version").parquet(path))


def write_version(df: DataFrame, path: str, project: str, version: int) -> None:
    """Rows (trace, i, y_raw) of one version, sorted by (trace, i) in each task
    already, into its folder of the layout of :func:`write_samples`: as no
    partition column varies, nothing is sorted here."""
    df.write.mode("overwrite").parquet(f"{path}/project={quote(project, safe='')}/version={version}")


def changed_files(files: DataFrame, captures: DataFrame, reference: DataFrame | None = None) -> DataFrame:
    """Files whose modification time differs from the change id last
    recorded for that source (inequality, not "newer than"); files never seen
    are new.  ``reference`` (project, file, change_id) replaces the recorded
    ids, like the reference's caller-given change id."""
    if reference is not None:
        last = reference.select("project", "file", F.col("change_id").alias("_last"))
        return (files.join(last, ["project", "file"], "left")
                .where(F.col("_last").isNull() | (F.col("_last") != F.col("mtime")))
                .drop("_last"))
    last = captures.groupBy("project", F.col("source_uri").alias("file")).agg(
        F.max_by("change_id", "version").alias("_last"))
    return (files.join(last, ["project", "file"], "left")
            .where(F.col("_last").isNull() | (F.col("_last") != F.col("mtime")))
            .drop("_last"))


def ingest(spark: SparkSession, store: Store, lines: DataFrame,
           project: str | Column) -> DataFrame:
    """Load changed capture files as new versions.

    ``lines`` comes from :func:`capture.read_lines` (or a streaming
    micro-batch through :func:`capture.number_lines`); ``project`` names the
    project of each file (a literal or an expression over ``file``).  Each
    changed file becomes the next version of its project, in (mtime, path)
    order.  Returns the committed captures rows.
    """
    pcol = F.lit(project) if isinstance(project, str) else project
    with claims.load() as load:
        return _ingest(spark, store, lines, pcol, load)


def list_captures(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, mtime) of capture files, from the listing alone."""
    meta = spark.read.format("binaryFile").load(paths)
    return meta.select(F.col("_metadata.file_path").alias("file"),
                       F.col("_metadata.file_modification_time").alias("mtime"))


def ingest_changed(spark: SparkSession, store: Store, paths: str | list[str], project: str | Column) -> DataFrame:
    """S6 + S7 on files: the listing is compared with the recorded change ids
    first, and only new and changed files are opened, so a poll that finds
    nothing reads no data.  (Paths of the changed files reach the driver, as
    in any file scan.)"""
    pcol = F.lit(project) if isinstance(project, str) else project
    listed = list_captures(spark, paths).withColumn("project", pcol)
    changed = [r["file"] for r in changed_files(listed, store.captures(spark)).select("file").collect()]
    if not changed:
        return spark.createDataFrame([], schemas.CAPTURES)
    return ingest(spark, store, capture.read_lines(spark, changed), project)


WRITTEN_MEANWHILE = "the capture was written again while it was loaded: "


#: Claims that a load makes at a time.
CLAIMS_AT_ONCE = 16


def _versions(spark: SparkSession, store: Store, new: DataFrame, load: str) -> DataFrame:
    """(project, before): versions of the load's files are before + 1, + 2, ...
    One row a project that has new files goes to the driver, to be claimed;
    projects whose change another load is at are left to it."""
    latest = store.captures(spark).groupBy("project").agg(F.max("version").alias("latest"))
    each = new.groupBy("project").agg(F.count("*").alias("count"), F.sum(
        F.xxhash64("file", "mtime").cast("decimal(38,0)")).cast("string").alias("change"))

    def claim(r):
        change = hashlib.sha256(f"{r['change']} {r['count']}".encode()).hexdigest()
        folder = f"{store.path('claims')}/{quote(r['project'], safe='')}"
        return r["project"], claims.claim(spark, folder, load, change, r["latest"] or 0, r["count"])

    # a claim waits for the file system: many projects' are made at once
    with ThreadPoolExecutor(CLAIMS_AT_ONCE) as pool:
        rows = [(p, first - 1) for p, first in pool.map(claim, each.join(latest, "project", "left").collect()) if first is not None]
    return spark.createDataFrame(rows, "project string, before int")


def _ingest(spark: SparkSession, store: Store, lines: DataFrame, pcol: Column, load: str) -> DataFrame:
    # one pass over the text for the heads, one for the samples
    heads_at = scratch_path(spark, "capture-heads")
    heads = capture.capture_heads(lines).withColumn("project", pcol)
    heads.write.mode("overwrite").parquet(heads_at)
    heads = spark.read.schema(heads.schema).parquet(heads_at)
    caps = store.captures(spark)
    new = changed_files(heads.select("project", "file", "mtime"), caps)
    # many files of one project may be new at once: numbered without a task per project
    new = dense_index(new, ["project"], ["mtime", "file"], "_nth")
    ranked = new.scratch
    new = new.join(_versions(spark, store, new, load), "project").select(
        "project", "file", "mtime", (F.col("before") + F.col("_nth") + 1).cast("int").alias("version"))
    # The new-file table (one row per file) is the plan of this ingest; it is
    # written once so every later step sees the same version numbers.
    staging = scratch_path(spark, "ingest-plan")
    new.join(capture.column_specs(heads), "file").join(heads.select("file", "n_data"), "file").write.mode(
        "overwrite").parquet(staging)
    remove(spark, ranked)
    plan = spark.read.parquet(staging)
    n_new = plan.count()
    if n_new == 0:
        return spark.createDataFrame([], schemas.CAPTURES)
    plan_b = plan.select("file", F.col("mtime").alias("_mtime"), "project", "version")
    plan_b = F.broadcast(plan_b) if n_new <= BROADCAST_MAX_ROWS else plan_b

    # project and version go with the heads: a lookup for each line, none for each sample
    mine = heads.drop("project", "mtime").join(plan_b, "file")
    same = F.when(F.col("mtime") == F.col("_mtime"), F.col("line_no")).otherwise(
        F.raise_error(F.concat(F.lit(WRITTEN_MEANWHILE), "file")))
    told = lines.join(plan_b.select("file", "_mtime"), "file").withColumn("line_no", same).drop("_mtime")
    data = capture.decode_captures(told, mine, ["project", "version"])
    write_samples(data.select("project", "version", "trace", "i", "y_raw"), store.path("samples"))

    # one pass over the columns just written gives the block statistics, and
    # these the triggers
    written = store.samples(spark, committed=False).join(plan_b.select("project", "version"), ["project", "version"], "left_semi")
    store.add(block_stats(written).select(*[F.col(f.name).cast(f.dataType) for f in schemas.BLOCK_STATS.fields]), "block_stats", load)
    t0 = trigger_of_blocks(store.added(spark, "block_stats", load, schemas.BLOCK_STATS))
    rows = (plan.join(t0, ["project", "version"], "left")
            .select("project", "version", F.col("file").alias("source_uri"),
                    F.col("mtime").alias("change_id"),
                    F.coalesce("t0_index", F.lit(0)).cast("bigint").alias("t0_index"),
                    F.col("n_data").alias("n_samples"), "columns"))
    rows = rows.select(*[F.col(f.name).cast(f.dataType) for f in schemas.CAPTURES.fields])

    _bootstrap_registry(spark, store, plan, load)
    _carry_notes(spark, store, plan, load)
    store.add(rows, "captures", load)  # commit marker
    remove(spark, heads_at)
    if n_new > BROADCAST_MAX_ROWS:
        return store.captures(spark).join(plan.select("project", "version"), ["project", "version"], "left_semi")
    keys = spark.createDataFrame([tuple(r) for r in plan.select("project", "version").collect()],
                                 "project string, version int")
    remove(spark, staging)
    return store.captures(spark).join(keys, ["project", "version"], "left_semi")


def _bootstrap_registry(spark: SparkSession, store: Store, plan: DataFrame, load: str) -> None:
    """A project's registry is written once, from the columns of its
    first loaded version: one Active entry per column, label = name.  Of
    several first loads at once, that with version 1 writes it."""
    reg = store.registry(spark)
    known = store.captures(spark).select("project").distinct().withColumn("_known", F.lit(True))
    first = (plan.groupBy("project").agg(F.min("version").alias("version"), F.min_by("columns", "version").alias("columns"))
             .join(known, "project", "left").where((F.col("version") == 1) | F.col("_known"))
             .join(reg.select("project").distinct(), "project", "left_anti"))
    rows = first.select("project", F.posexplode("columns").alias("ord", "c")).select(
        "project", F.col("c.name").alias("trace"), F.col("c.name").alias("label"),
        F.lit("Active").alias("state"), F.lit(1.0).alias("y_scale"), F.lit(0.0).alias("y_offset"),
        F.lit(None).cast(schemas.OVERLAY).alias("overlay"),
        F.array().cast("array<string>").alias("stat_functions"),
        F.lit(None).cast(schemas.DERIVATIVE).alias("derivative"), F.col("ord").cast("int"))
    store.add(rows, "registry", load)


def _carry_notes(spark: SparkSession, store: Store, plan: DataFrame, load: str) -> None:
    """New versions start with the notes of the latest existing version;
    a first load starts with empty notes for every column."""
    notes = store.notes(spark)
    done = store.captures(spark).select("project", "version")
    lastv = done.groupBy("project").agg(F.max("version").alias("version"))
    prev = notes.join(lastv, ["project", "version"], "left_semi").drop("version")
    firsts = (plan.groupBy("project").agg(F.min_by("columns", "version").alias("columns"))
              .join(prev.select("project").distinct(), "project", "left_anti")
              .select("project", F.explode("columns.name").alias("trace"), F.lit("").alias("note")))
    base = prev.unionByName(firsts)
    out = plan.select("project", "version").join(base, "project")
    # a load that failed after this step left its rows: add none twice
    out = out.join(notes.select("project", "version", "trace"), ["project", "version", "trace"], "left_anti")
    store.add(out.select("project", "version", "trace", "note"), "notes", load)


def set_note(notes: DataFrame, project: str, version: int, trace: str, note: str) -> DataFrame:
    """Note update (anti-join + union)."""
    key = (F.col("project") == project) & (F.col("version") == version) & (F.col("trace") == trace)
    row = notes.sparkSession.createDataFrame([(project, version, trace, note)], schemas.NOTES)
    return notes.where(~key).unionByName(row)


# --------------------------------------------------------------------------
# Snapshot scans

def read_version(spark: SparkSession, store: Store, project: str, version: int,
                 traces: list[str] | None = None) -> DataFrame:
    """One version of a project (partition pruned; trace filter pushed to
    Parquet)."""
    df = store.samples(spark).where((F.col("project") == project) & (F.col("version") == version))
    if traces is not None:
        df = df.where(F.col("trace").isin(traces))
    return df


def read_legacy_project(spark: SparkSession, project_dir: str, project: str) -> DataFrame:
    """Wide per-version snapshots ``data/NNNNN/traces.parquet.lz4`` -> long
    samples.  The sample index is the Parquet row index inside the file.

    Versions may hold different columns.  The scan takes the union of all
    files' columns; which of them a version really has comes from the files'
    footers, read in tasks, so a column that a version lacks adds no rows
    while a null cell of one it has stays a null sample."""
    reader = (spark.read.format("parquet").option("pathGlobFilter", "traces.parquet.lz4")
              .option("recursiveFileLookup", "true"))
    df = reader.option("mergeSchema", "true").load(f"{project_dir}/data")
    cols = list(df.columns)
    version = F.regexp_extract(F.col("_metadata.file_path"), LEGACY_VERSION, 1).cast("int").alias("version")
    base = df.select(version, F.col("_metadata.row_index").alias("i"),
                     *[F.col(f"`{c}`").cast("bigint").alias(c) for c in cols])
    if not cols:
        return spark.createDataFrame([], schemas.SAMPLES)
    long = base.unpivot(["version", "i"], [F.col(f"`{c}`") for c in cols], "trace", "y_raw")
    has = bounded_broadcast(legacy_columns(spark, project_dir))
    return long.join(has, ["version", "trace"], "left_semi").select(
        F.lit(project).alias("project"), "version", "trace", "i", "y_raw")


LEGACY_VERSION = r"/(\d{5})/[^/]+$"


def legacy_columns(spark: SparkSession, project_dir: str) -> DataFrame:
    """(version, trace): the columns in the footer of each snapshot file."""
    files = (spark.read.format("binaryFile").option("pathGlobFilter", "traces.parquet.lz4")
             .option("recursiveFileLookup", "true").load(f"{project_dir}/data").select("path"))

    def footers(batches):
        import pyarrow.parquet as pq
        from pyarrow import fs
        for pdf in batches:
            out = []
            for path in pdf["path"]:
                uri = "file://" + path.removeprefix("file:") if path.startswith("file:/") and "://" not in path else path
                store, name = fs.FileSystem.from_uri(uri)
                out += [(path, c) for c in pq.read_schema(name, filesystem=store).names]
            yield pd.DataFrame(out, columns=["path", "trace"])

    return files.mapInPandas(footers, "path string, trace string").select(
        F.regexp_extract("path", LEGACY_VERSION, 1).cast("int").alias("version"), "trace")


def read_legacy_captures(spark: SparkSession, project_dir: str, project: str) -> DataFrame:
    """(project, version, t0_index) from each version's ``trigger.json``; a
    version without one has t0 = 0 by the left join in the time axis."""
    rows = (spark.read.schema("t0_index bigint").option("multiLine", "true").option("pathGlobFilter", "trigger.json")
            .option("recursiveFileLookup", "true").json(f"{project_dir}/data"))
    return rows.select(F.lit(project).alias("project"),
                       F.regexp_extract(F.col("_metadata.file_path"), LEGACY_VERSION, 1).cast("int").alias("version"),
                       "t0_index")


def read_legacy_notes(spark: SparkSession, project_dir: str, project: str) -> DataFrame:
    """Notes rows from each version's ``config.json`` (trace -> note)."""
    text = (spark.read.option("wholetext", "true").option("pathGlobFilter", "config.json")
            .option("recursiveFileLookup", "true").text(f"{project_dir}/data"))
    version = F.regexp_extract(F.col("_metadata.file_path"), LEGACY_VERSION, 1)
    rows = text.where(version != "").select(
        version.cast("int").alias("version"),
        F.explode(F.from_json("value", "map<string, struct<note: string>>")).alias("trace", "v"))
    return rows.select(F.lit(project).alias("project"), "version", "trace",
                       F.coalesce("v.note", F.lit("")).alias("note"))


# --------------------------------------------------------------------------
# Project catalogue

def list_projects(projects: DataFrame) -> DataFrame:
    return projects.select("project").distinct().orderBy("project")


def create_project(projects: DataFrame, name: str) -> DataFrame:
    """New project with defaults (dt 1, unit ms); error if it exists."""
    if projects.where(F.col("project") == name).limit(1).count() > 0:
        raise RuntimeError(f"there is a project {name!r} already")
    row = projects.sparkSession.createDataFrame([(name, 1.0, "ms", "")], schemas.PROJECTS)
    return projects.unionByName(row)


def set_project(projects: DataFrame, name: str, implied_dt: float | None = None,
                dt_unit: str | None = None, description: str | None = None) -> DataFrame:
    """Set step, unit or description; the step must be > 0."""
    out = projects
    me = F.col("project") == name
    if implied_dt is not None:
        if not implied_dt > 0:
            raise ValueError("time step must be positive")
        out = out.withColumn("implied_dt", F.when(me, F.lit(float(implied_dt))).otherwise(F.col("implied_dt")))
    if dt_unit is not None:
        from ..functions.units import TIME_UNITS
        u = {t.lower(): t for t in TIME_UNITS}.get(dt_unit.strip().lower())
        if u is None:
            raise RuntimeError(f"{dt_unit!r} is no time unit; known: {TIME_UNITS}")
        out = out.withColumn("dt_unit", F.when(me, F.lit(u)).otherwise(F.col("dt_unit")))
    if description is not None:
        out = out.withColumn("description", F.when(me, F.lit(description)).otherwise(F.col("description")))
    return out


def create_projects(projects: DataFrame, names: DataFrame) -> DataFrame:
    """S13 in bulk: ``names`` (project) become projects with defaults; any
    existing name raises."""
    clash = names.join(projects.select("project"), "project", "left_semi")
    hit = clash.limit(1).collect()
    if hit:
        raise RuntimeError(f"there is a project {hit[0][0]!r} already")
    new = names.select("project", F.lit(1.0).alias("implied_dt"), F.lit("ms").alias("dt_unit"),
                       F.lit("").alias("description"))
    return projects.unionByName(new)
