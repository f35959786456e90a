"""Capture files written again (S14): changes as a stream, and the decision on
each of them as keyed state.

Spark's file source takes a path once; a logic analyser writes the same file
over and over.  :class:`CaptureChanges` is a streaming source whose offset is
the set of (path, modification time), so writing a path again is a new row;
its rows are narrow (path and time), the data is read by the batch scan.

A change is not loaded by itself: somebody accepts or declines it.  The state
of a source is its reference change id, and the change that waits for a
decision if there is one.  Accepting passes the change on and makes it the
reference; declining makes it the reference only, so no version comes of it
and nothing is asked again until the file is written once more.  Both are
stateful operators of one streaming query whose checkpoint holds the offsets
and the references, so a restart neither repeats nor forgets a decision.
"""

from __future__ import annotations

from collections.abc import Iterator
from fnmatch import fnmatch

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery

from ..session import qualified
from ..sources import capture
from ..sources.store import WRITTEN_MEANWHILE, Store, ingest

EVENTS = "file string, change_id bigint"
STATE = "reference bigint, pending bigint"
ACCEPT, DECLINE = "accept", "decline"
#: Times a batch reads files that are written meanwhile.
ATTEMPTS = 3
_WILD = "*?["


def listed(pattern: str) -> dict[str, int]:
    """Modification time in ns of each file that a path, folder or pattern
    (``*``, ``?`` and ``[]`` within path parts) names, from listings alone.
    Names that start with a dot or underscore are skipped."""
    from pyarrow import fs

    parts = pattern.rstrip("/").split("/")
    at = next((i for i, p in enumerate(parts) if any(c in p for c in _WILD)), len(parts))
    base = "/".join(parts[:at])
    store, path = fs.FileSystem.from_uri(base) if "://" in base else (fs.LocalFileSystem(), base or "/")
    head = base.removesuffix(path)
    shown = (lambda f: f.base_name[:1] not in (".", "_"))

    def children(f: fs.FileInfo) -> list[fs.FileInfo]:
        return store.get_file_info(fs.FileSelector(f.path)) if f.type == fs.FileType.Directory else []

    found = [store.get_file_info(path)]
    for part in parts[at:]:
        found = [f for d in found for f in children(d) if shown(f) and fnmatch(f.base_name, part)]
    found += [f for d in found for f in children(d)]  # the files of named folders
    return {head + f.path: f.mtime_ns for f in found if f.type == fs.FileType.File and shown(f)}


class _Part(InputPartition):
    def __init__(self, rows: list[tuple[str, int]]):
        self.rows = rows


class ChangeReader(DataSourceStreamReader):
    """Offsets are ``{"files": {path: mtime}}``: one entry a watched file, on
    the driver, as with Spark's own file source.  The rows between two offsets
    are the entries of the later one that the earlier one has not, so a replay
    gives the same rows without another listing."""

    PART_ROWS = 10_000

    def __init__(self, pattern: str):
        self.pattern = pattern

    def initialOffset(self) -> dict:
        return {"files": {}}

    def latestOffset(self) -> dict:
        return {"files": listed(self.pattern)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        rows = sorted((f, m) for f, m in end["files"].items() if start["files"].get(f) != m)
        return [_Part(rows[i:i + self.PART_ROWS]) for i in range(0, len(rows), self.PART_ROWS)]

    def read(self, partition: _Part) -> Iterator[tuple[str, int]]:
        yield from partition.rows

    def commit(self, end: dict) -> None:
        pass

    def stop(self) -> None:
        pass


class CaptureChanges(DataSource):
    """``spark.readStream.format("capture_changes").load(path)``"""

    @classmethod
    def name(cls) -> str:
        return "capture_changes"

    def schema(self) -> str:
        return EVENTS

    def streamReader(self, schema) -> ChangeReader:
        return ChangeReader(self.options["path"])


def change_stream(spark: SparkSession, landing: str) -> DataFrame:
    """Streaming (file, change_id): a row whenever a file is new or written again."""
    spark.dataSource.register(CaptureChanges)
    return spark.readStream.format("capture_changes").load(qualified(spark, landing))


def resolve(reference: int | None, pending: int | None, changes: list[int], decisions: list[str]):
    """One source, one batch: changes come first, then decisions in order.
    Gives the change ids to load and the new (reference, pending)."""
    out = []
    for change in changes:
        pending = change if change != reference else None  # back as it was: nothing to decide
    for what in decisions:
        if what not in (ACCEPT, DECLINE):
            raise ValueError(f"a decision is {ACCEPT!r} or {DECLINE!r}, not {what!r}")
        if pending is not None:  # without a change there is nothing to decide
            if what == ACCEPT:
                out.append(pending)
            reference, pending = pending, None
    return out, reference, pending


def accepted(changes: DataFrame, decisions: DataFrame | None = None) -> DataFrame:
    """(file, change_id) of the accepted changes.

    ``decisions``: a stream of (file, at, decision) by which ``accept`` and
    ``decline`` are ordered (``at``, any sortable type); a decision without a
    waiting change is ignored.  Without it every change is accepted.
    """
    automatic = decisions is None
    events = changes.select("file", "change_id", F.lit(None).cast("string").alias("decision"), F.lit("").alias("at"))
    if not automatic:
        events = events.unionByName(decisions.select(
            "file", F.lit(None).cast("bigint").alias("change_id"), "decision", F.col("at").cast("string").alias("at")))

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        reference, pending = state.get if state.exists else (None, None)
        rows = pd.concat(list(frames))
        seen = rows[rows["decision"].isna()]["change_id"].astype("int64").tolist()
        said = rows[rows["decision"].notna()].sort_values("at")["decision"].tolist()
        load, reference, pending = resolve(reference, pending, seen, [ACCEPT] if automatic else said)
        state.update((reference, pending))
        yield pd.DataFrame({"file": [key[0]] * len(load), "change_id": pd.Series(load, dtype="int64")})

    return events.groupBy("file").applyInPandasWithState(step, EVENTS, STATE, "append", "NoTimeout")


def decision_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Decisions from JSON files (one object a line: file, at, decision); a
    file's name is any of its URI's forms."""
    rows = spark.readStream.schema("file string, at string, decision string").json(folder)
    return rows.withColumn("file", F.regexp_replace("file", "^(file:)?/*(?=/)", "file://"))


def write_decisions(spark: SparkSession, folder: str, decisions: DataFrame) -> None:
    decisions.select("file", "at", "decision").write.mode("append").json(folder)


def start_watch(spark: SparkSession, landing: str, store: Store, project: str | Column, checkpoint: str,
                decisions: str | None = None, available_now: bool = True,
                processing_time: str = "1 second") -> StreamingQuery:
    """Watch ``landing`` and load accepted changes as new versions.

    ``project`` as in :func:`wavespark.sources.store.ingest`; ``decisions``: a
    folder of decision files (see :func:`decision_stream`), else every change
    is accepted.  A file is read as it is when its batch runs; if it was
    written once more since, that is what the version holds, and the next
    change id, being loaded already, adds none.  One written while it is read
    is read again.
    """
    def batch(rows: DataFrame, epoch_id: int) -> None:
        paths = [r["file"] for r in rows.select("file").distinct().collect()]
        for more in range(ATTEMPTS - 1, -1, -1) if paths else ():
            try:
                ingest(spark, store, capture.read_lines(spark, paths), project)
                return
            except Exception as e:
                if not more or WRITTEN_MEANWHILE not in str(e):
                    raise

    said = None if decisions is None else decision_stream(spark, decisions)
    w = accepted(change_stream(spark, landing), said).writeStream.foreachBatch(batch)
    w = w.outputMode("append").option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=processing_time)
    return w.start()
