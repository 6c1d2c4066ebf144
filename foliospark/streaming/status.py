"""Order status as a stream: changes in the order of their times, and orders that stand still become failed.

Changes may arrive in any order. They wait in state until the watermark has passed them, are then applied by time,
and each leaves a row with the state before it and whether the step is legal. State belongs to lanes, hashes of order
ids, since every call to it costs the same for one order as for many: a lane holds the changes that wait, in blocks,
the last state of its orders, and one event-time timer for the next moment at which any of them has a change to apply or
has stood still for too long. State lies in RocksDB; a lane holds what happened to its orders within the watermark's delay
and one short entry per order. The number of lanes is fixed for a checkpoint.

A change that arrives behind the watermark is not in the stream's result; the log it came from has it, and
``operators.status.with_timeouts`` folds that log to the same rows.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from foliospark.operators.status import CHANGE, FAILED, OPEN, TIMEOUT, legal_step
from foliospark.session import SETTINGS
from foliospark.sinks import tables

STEPS_DDL = "order_id bigint, changed_at timestamp, change_id bigint, previous string, status string, legal boolean, cause string"
OUT = "order_id bigint, at bigint, change_id bigint, previous string, status string, cause string"
BATCH = "batch_id"
LANES = 4096
BLOCK = 4096  # rows in a record of state
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def millis(at: int) -> int:
    """The first millisecond that is not before a time. State counts microseconds since 1970, Spark's timers milliseconds."""
    return -(-at // 1000)


def blocks(rows: list[tuple]) -> list[tuple]:
    """Rows as records of a few columns each, so that state is called per block and not per row."""
    return [tuple(list(c) for c in zip(*rows[at : at + BLOCK])) for at in range(0, len(rows), BLOCK)]


class StatusProcessor(StatefulProcessor):
    """Applies the changes of one lane's orders behind the watermark and fails orders whose time is up."""

    def __init__(self, timeout: dt.timedelta):
        self.timeout = timeout // dt.timedelta(microseconds=1)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getListState("last", "order_id array<bigint>, status array<string>, at array<bigint>")
        self.waiting = handle.getListState("waiting", "order_id array<bigint>, at array<bigint>, change_id array<bigint>, status array<string>")
        self.moment = handle.getValueState("moment", "at bigint")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        new = [(r.order_id, r.at, r.change_id, r.status) for r in rows]
        moment = self.moment.get()[0] if self.moment.exists() else None
        if moment is not None and moment <= timerValues.getCurrentWatermarkInMs():
            self.handle.deleteTimer(moment)
            return self.advance(new, timerValues.getCurrentWatermarkInMs())
        self.waiting.appendList(blocks(new))
        first = millis(min(r[1] for r in new))
        if moment is None or first < moment:
            if moment is not None:
                self.handle.deleteTimer(moment)
            self.wake(first)
        return iter(())

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        return self.advance([], timerValues.getCurrentWatermarkInMs())

    def wake(self, moment: int) -> None:
        self.moment.update((moment,))
        self.handle.registerTimer(moment)

    def held(self, state) -> list[tuple]:
        return [row for block in state.get() for row in zip(*block)] if state.exists() else []

    def advance(self, new: list[tuple], watermark: int) -> Iterator[Row]:
        """Apply what is due at the watermark, keep the rest and set the timer for the lane's next moment."""
        now = watermark * 1000
        last = {order: (status, at) for order, status, at in self.held(self.last)}
        due, later, out = {}, [], []
        for row in {*self.held(self.waiting), *new}:
            if row[1] <= now:
                due.setdefault(row[0], []).append(row[1:])
            else:
                later.append(row)

        def time_out(order, before: int) -> None:
            status, at = last.get(order, (None, None))
            if status in OPEN and at + self.timeout < before:
                last[order] = (FAILED, at + self.timeout)
                out.append(Row(order_id=order, at=at + self.timeout, change_id=None, previous=status, status=FAILED, cause=TIMEOUT))

        for order, changes in due.items():
            for then, change, state in sorted(changes):
                time_out(order, then)
                previous = last[order][0] if order in last else None
                out.append(Row(order_id=order, at=then, change_id=change, previous=previous, status=state, cause=CHANGE))
                last[order] = (state, then)
        for order in last:
            time_out(order, now + 1)
        if out:
            self.last.put(blocks([(order, *state) for order, state in last.items()]))
        if due or new:
            self.waiting.put(blocks(later)) if later else self.waiting.clear()
        moments = [r[1] for r in later] + [at + self.timeout for status, at in last.values() if status in OPEN]
        if moments:
            self.wake(millis(min(moments)))
        else:
            self.moment.clear()
        return iter(out)

    def close(self) -> None:
        pass


def steps(changes: DataFrame, timeout: dt.timedelta, delay: str, lanes: int = LANES) -> DataFrame:
    """Streaming changes (order_id, status, changed_at, change_id) to rows of STEPS_DDL."""
    timed = changes.select(
        F.pmod(F.xxhash64(F.col("order_id").cast("bigint")), F.lit(lanes)).alias("lane"), F.col("order_id").cast("bigint").alias("order_id"), "status", F.col("change_id").cast("bigint").alias("change_id"),
        F.col("changed_at").cast("timestamp").alias("changed_at"), F.unix_micros(F.col("changed_at").cast("timestamp")).alias("at"),
    )
    by_lane = timed.withWatermark("changed_at", delay).groupBy("lane")
    found = by_lane.transformWithState(StatusProcessor(timeout), OUT, "Append", "EventTime")
    legal = legal_step(F.col("previous"), F.col("status"))
    return found.select("order_id", F.timestamp_micros("at").alias("changed_at"), "change_id", "previous", "status", legal.alias("legal"), "cause")


def prepare(spark: SparkSession, folder: str) -> None:
    tables.ensure(spark, folder, STEPS_DDL, BATCH)


def stored_steps(spark: SparkSession, folder: str) -> DataFrame:
    return tables.read(spark, folder, STEPS_DDL, BATCH)


def start(changes: DataFrame, folder: str, checkpoint: str, timeout: dt.timedelta, delay: str, available_now: bool = False) -> StreamingQuery:
    """Start the job; each micro-batch replaces its own rows in ``folder``, so a repeated batch adds nothing."""

    def write(batch: DataFrame, batch_id: int) -> None:
        tables.write_run(batch, folder, tables.batch_number(checkpoint, batch_id), BATCH)

    spark = changes.sparkSession
    spark.conf.set(PROVIDER, SETTINGS[PROVIDER])  # this kind of state needs RocksDB
    writer = steps(changes, timeout, delay).writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
