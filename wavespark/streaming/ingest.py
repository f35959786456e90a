"""Continuous ingest (S14): a landing folder of capture files becomes new
versions as files arrive.

The reference polls one file's modification time every second and asks the
user; here a file-source stream lists new files, each micro-batch is ingested
with the batch sink (:func:`wavespark.sources.store.ingest`) through
``foreachBatch``, and the checkpoint makes restarts resume.  Re-processing a
batch is harmless: change detection (S6) anti-joins files already committed.

Landing convention: one new file per capture, moved into place whole (the
file source never re-reads an overwritten path; overwritten sources go
through the batch ingest).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..sources import capture
from ..sources.store import Store, ingest


def capture_stream(spark: SparkSession, landing: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming DataFrame of capture lines with their file metadata."""
    r = spark.readStream.format("text")
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", int(max_files_per_trigger))
    return r.load(landing).select("value", "_metadata")


def start_ingest(spark: SparkSession, landing: str, store: Store, project: str | Column,
                 checkpoint: str, available_now: bool = True,
                 processing_time: str = "1 second") -> StreamingQuery:
    """Start the ingest query: ``availableNow`` drains what is there and
    stops; otherwise poll every ``processing_time`` (the reference's 1 s)."""
    def batch(df: DataFrame, epoch_id: int) -> None:
        lines = capture.number_lines(df)
        ingest(df.sparkSession, store, lines, project)

    w = capture_stream(spark, landing).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=processing_time)
    return w.start()
