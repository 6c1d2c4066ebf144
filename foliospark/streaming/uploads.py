"""Upload log as a stream: last write per session, kept in parts that are merged and expired as they grow."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from foliospark.operators.retention import latest_upload, without_expired
from foliospark.sinks import snapshots, tables

STAGED_DDL = """
session_id string, upload_id bigint, created_at timestamp, file_name string, file_format string,
word_count bigint
"""
COLUMNS = [part.split()[0] for part in STAGED_DDL.split(",")]
TIME = "created_at"


def newest(state: snapshots.Snapshot) -> dt.datetime | None:
    """The latest upload of all live parts: the log's own time, by which rows expire."""
    times = [p.bounds[TIME][1] for p in state.parts if p.bounds.get(TIME, [None, None])[1]]
    return max(map(dt.datetime.fromisoformat, times), default=None)


def folded(rows: DataFrame, as_of: dt.datetime | None) -> DataFrame:
    """One row per session, without those that are older than a staged upload may be."""
    latest = latest_upload(rows).drop("writes")
    return latest if as_of is None else without_expired(latest, as_of)


def batch_writer(folder: str, checkpoint: str, fan: int | None = None, expire: bool = True):
    """Add one part with a row per session; a repeated batch replaces its own part.

    A full level is merged in the same step: last writes win and, with ``expire``, rows that the log's own
    time has left behind go, so the log follows the live sessions. A reader keeps the state it began with.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = latest_upload(batch).select(*COLUMNS)
        state = snapshots.append(rows, folder, tables.batch_number(checkpoint, batch_id), [TIME])
        as_of = newest(state) if expire else None
        snapshots.merge(spark, folder, STAGED_DDL, lambda df: folded(df, as_of).select(*COLUMNS), fan, [TIME])

    return write


def staged(spark: SparkSession, folder: str, expire: bool = True, state: snapshots.Snapshot | None = None) -> DataFrame:
    """Current row per session of the newest or a given state; with ``expire`` as of the newest upload it knows."""
    state = state or snapshots.snapshot(spark, folder)
    return folded(state.read(spark, STAGED_DDL), newest(state) if expire else None)


def start(uploads: DataFrame, folder: str, checkpoint: str, available_now: bool = False, expire: bool = True) -> StreamingQuery:
    writer = uploads.select(*COLUMNS).writeStream.foreachBatch(batch_writer(folder, checkpoint, expire=expire))
    writer = writer.option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
