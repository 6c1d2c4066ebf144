"""Order status as an append-only log: latest state, legal transitions, orders that stopped."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.operators.scan import lag_by_key

# Fixed value: the states an order may move to; None is a new order.
LEGAL = {
    None: ("pending",),
    "pending": ("processing",),
    "processing": ("completed", "failed"),
    "completed": (),
    "failed": ("processing",),
}
FAILED = "failed"
OPEN = tuple(state for state, after in LEGAL.items() if FAILED in after)  # states in which an order may run out of time
CHANGE, TIMEOUT = "change", "timeout"  # causes


def latest_status(log: DataFrame) -> DataFrame:
    """Current status per order from rows (order_id, status, changed_at, change_id).

    ``completed_at`` is the time of the last completion. Partial aggregation reduces a hot order
    to one row per task before the shuffle.
    """
    at = F.struct("changed_at", "change_id")
    done = F.col("status") == "completed"
    return log.groupBy("order_id").agg(
        F.max_by("status", at).alias("status"),
        F.max("changed_at").alias("updated_at"),
        F.max(F.when(done, F.col("changed_at"))).alias("completed_at"),
        F.count("*").alias("changes"),
    )


def transitions(log: DataFrame) -> DataFrame:
    """Every status change with the status before it and whether the step is legal."""
    stepped = lag_by_key(log, ["order_id"], "changed_at", "change_id", "status", "previous")
    return stepped.withColumn("legal", legal_step(F.col("previous"), F.col("status")))


def legal_step(previous: Column, status: Column) -> Column:
    legal = F.lit(False)
    for before, allowed in LEGAL.items():
        here = previous.isNull() if before is None else previous == before
        legal = F.when(here, status.isin(*allowed) if allowed else F.lit(False)).otherwise(legal)
    return legal


def with_timeouts(log: DataFrame, timeout: dt.timedelta, until: dt.datetime | Column) -> DataFrame:
    """The log up to a time, and a step to ``failed`` for every order that stood still for longer than ``timeout``.

    Rows (order_id, changed_at, change_id, previous, status, legal, cause). Only states that may fail run out of time;
    a change at the very last moment counts as progress. A change that is delivered again is one change, rows
    without a time are none. This is the batch form of ``streaming.status``, with the watermark as ``until``.
    """
    changes = log.select("order_id", "status", "changed_at", "change_id").filter(F.col("changed_at") <= until).distinct()
    stepped = lag_by_key(changes, ["order_id"], "changed_at", "change_id", ["status", "changed_at"], "_before")
    due = F.col("_before.changed_at") + F.lit(timeout)
    out_of_time = F.coalesce(F.col("_before.status").isin(*OPEN) & (F.col("changed_at") > due), F.lit(False))
    nothing = F.lit(None).cast(changes.schema["change_id"].dataType)
    row = ["order_id", "changed_at", "change_id", "previous", "status", "cause"]
    told = stepped.withColumn("previous", F.when(out_of_time, FAILED).otherwise(F.col("_before.status"))).withColumn("cause", F.lit(CHANGE))
    between = stepped.filter(out_of_time).select(
        "order_id", due.alias("changed_at"), nothing.alias("change_id"), F.col("_before.status").alias("previous"), F.lit(FAILED).alias("status"), F.lit(TIMEOUT).alias("cause")
    )
    last = changes.groupBy("order_id").agg(F.max(F.struct("changed_at", "change_id", "status")).alias("last"))
    due = F.col("last.changed_at") + F.lit(timeout)
    at_end = last.filter(F.col("last.status").isin(*OPEN) & (due <= until)).select(
        "order_id", due.alias("changed_at"), nothing.alias("change_id"), F.col("last.status").alias("previous"), F.lit(FAILED).alias("status"), F.lit(TIMEOUT).alias("cause")
    )
    every = told.select(*row).unionByName(between).unionByName(at_end)
    return every.withColumn("legal", legal_step(F.col("previous"), F.col("status")))


def illegal_transitions(log: DataFrame) -> DataFrame:
    """Illegal steps counted per (previous, status)."""
    return (
        transitions(log)
        .filter(~F.col("legal"))
        .groupBy(F.coalesce("previous", F.lit("")).alias("previous"), "status")
        .agg(F.count("*").alias("changes"), F.countDistinct("order_id").alias("orders"))
    )


def progress(orders: DataFrame, files: DataFrame) -> DataFrame:
    """Status each order should have, from the translations it wants and those it has.

    orders: order_id, languages. An order is completed when its last wanted language first got a
    file, processing when some have one, pending otherwise. Files are folded per (order, language)
    before they are grouped per order, so that group is as long as the list of languages.
    """
    first = (
        files.filter(F.col("type") == "translated")
        .groupBy("order_id", "language")
        .agg(F.min("created_at").alias("first_at"))
    )
    entry = F.struct("language", "first_at")
    have = first.groupBy("order_id").agg(F.map_from_entries(F.collect_list(entry)).alias("_have"))
    joined = orders.select("order_id", "languages").join(have, "order_id", "left")
    times = F.transform(F.array_distinct("languages"), lambda c: F.try_element_at("_have", c))
    done = F.size(F.filter(F.col("_times"), lambda t: t.isNotNull()))
    finished = (F.col("finished") == F.col("wanted")) & (F.col("wanted") > 0)
    return (
        joined.withColumn("_times", times)
        .withColumn("wanted", F.coalesce(F.size("_times"), F.lit(0)).cast("long"))
        .withColumn("finished", F.coalesce(done, F.lit(0)).cast("long"))
        .withColumn("status", F.when(finished, "completed").when(F.col("finished") > 0, "processing").otherwise("pending"))
        .withColumn("started_at", F.array_min("_times"))
        .withColumn("completed_at", F.when(finished, F.array_max("_times")))
        .drop("_times", "_have", "languages")
    )


def status_rows(progressed: DataFrame) -> DataFrame:
    """Rows for the status log, ready to append: an order starts with its first file and completes with its last.

    The id of a change follows from the change, so rows that are appended twice are the same change.
    An order of one language starts and completes at one time; the higher id is the later state.
    """
    step = F.struct(F.lit("processing").alias("status"), F.col("started_at").alias("changed_at"), F.lit(0).alias("step"))
    last = F.struct(F.lit("completed").alias("status"), F.col("completed_at").alias("changed_at"), F.lit(1).alias("step"))
    each = progressed.select("order_id", F.inline(F.array(step, last))).filter(F.col("changed_at").isNotNull())
    low = F.xxhash64("order_id", "status").bitwiseAND(F.lit((1 << 60) - 1))
    change = F.when(F.col("step") == 1, low.bitwiseOR(F.lit(1 << 60))).otherwise(low)
    return each.select("order_id", "status", "changed_at", change.alias("change_id"))
