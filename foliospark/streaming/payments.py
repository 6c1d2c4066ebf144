"""Payment events as a stream: keyed orders, then the translation work they trigger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from foliospark.operators.payments import first_delivery, paid_orders, typed_events
from foliospark.operators.requests import known_languages
from foliospark.sinks import snapshots, tables

ORDER_DDL = """
payment_session_id string, event_id string, delivered_at timestamp, email string, author_name string,
book_title string, word_count int, tier string, file_format string, languages array<string>,
genre string, upsells array<string>, special_instructions string, amount_paid decimal(12,2),
voucher_code string, original_amount decimal(12,2), created_at timestamp_ntz, order_id string,
status string, created_date date
"""
WORK_DDL = "order_id string, language string, position bigint, reason string"
KEY_DDL = "payment_session_id string, bucket int, batch_id string"
BATCH = "batch_id"
DAY = ("created_date",)
BUCKETS = 64  # of the table of stored sessions; fixed for a table's life
ORDER_COLUMNS = [part.split()[0] for part in ORDER_DDL.replace("decimal(12,2)", "decimal").split(",")]


def session_bucket() -> Column:
    return F.pmod(F.xxhash64("payment_session_id"), F.lit(BUCKETS)).cast("int")


def orders_stream(bodies: DataFrame) -> DataFrame:
    """Streaming bodies (body, delivered_at) to pending orders, replays included.

    Nothing is dropped here, however late it comes: the writer makes a session one order. An event
    without a creation time lies in a day of its own; the day says nothing about uniqueness.
    """
    paid = paid_orders(typed_events(bodies)).withColumn("delivered_at", F.col("delivered_at").cast("timestamp"))
    day = F.coalesce(F.col("created_at").cast("date"), F.lit("1970-01-01").cast("date"))
    return paid.withColumn("created_date", day).select(*ORDER_COLUMNS)


def prepare(spark: SparkSession, folder: str) -> None:
    """Create the empty order and work tables once, before the first start. The key table begins with its first part."""
    tables.ensure(spark, f"{folder}/orders", ORDER_DDL, BATCH, DAY)
    tables.ensure(spark, f"{folder}/work", WORK_DDL, BATCH)


def stored_orders(spark: SparkSession, folder: str) -> DataFrame:
    return tables.read(spark, f"{folder}/orders", ORDER_DDL, BATCH, keep=True)


def stored_work(spark: SparkSession, folder: str) -> DataFrame:
    return tables.read(spark, f"{folder}/work", WORK_DDL, BATCH, keep=True)


def stored_keys(spark: SparkSession, folder: str) -> DataFrame:
    return snapshots.snapshot(spark, f"{folder}/keys").read(spark, KEY_DDL)


def by_bucket(keys: DataFrame) -> DataFrame:
    """Keys sorted by bucket, so that a reader skips the row groups of other buckets; small shares become one file."""
    return keys.repartitionByRange("bucket").sortWithinPartitions("bucket")


def pending_work(orders: DataFrame) -> DataFrame:
    """One row per order and language, in the order's own language order; unknown codes with a reason."""
    each = orders.select("order_id", "languages", F.explode(F.array_distinct("languages")).alias("language"))
    unknown = ~F.array_contains(known_languages(), F.col("language"))
    return each.select(
        "order_id", "language", F.array_position("languages", F.col("language")).cast("long").alias("position"),
        F.when(unknown, "unknown_language").alias("reason"),
    )


def batch_writer(folder: str, checkpoint: str):
    """Write one micro-batch: new orders, the work they trigger, and last their sessions as keys.

    All folders are named by the batch, so a repeated batch replaces its own rows. A session is new
    when no other batch has its key. The key table is narrow; its parts are sorted by a hash bucket of the
    session and merged by level, so a batch opens a number of parts that grows with the logarithm of the
    batches, and reads only the row groups with its buckets. A batch that breaks off before its keys are
    switched in is run again by the stream. Replays within the batch are combined on the map side before
    anything is shuffled by session.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        number = tables.batch_number(checkpoint, batch_id)
        rows = first_delivery(batch).select(*ORDER_COLUMNS).withColumn("bucket", session_bucket()).persist()
        try:
            buckets = [r[0] for r in rows.select("bucket").distinct().collect()]  # at most BUCKETS
            keys = stored_keys(spark, folder).filter((F.col(BATCH) != number) & F.col("bucket").isin(buckets))
            new = rows.join(keys.select("bucket", "payment_session_id"), ["bucket", "payment_session_id"], "left_anti")
            tables.write_run(new.select(*ORDER_COLUMNS), f"{folder}/orders", number, BATCH, DAY)
            written = spark.read.schema(ORDER_DDL).parquet(f"{folder}/orders/{BATCH}={number}")
            tables.write_run(pending_work(written), f"{folder}/work", number, BATCH)
            sessions = written.select("payment_session_id", session_bucket().alias("bucket"), F.lit(number).alias(BATCH))
            snapshots.append(by_bucket(sessions), f"{folder}/keys", number)
            snapshots.merge(spark, f"{folder}/keys", KEY_DDL, by_bucket)
        finally:
            rows.unpersist()

    return write


def start(
    bodies: DataFrame, folder: str, checkpoint: str, available_now: bool = False
) -> StreamingQuery:
    """Start the job. Call ``prepare`` once before; restart with the same checkpoint to resume.

    A start with a new checkpoint reads all events again and adds only orders that are not stored.
    """
    writer = orders_stream(bodies).writeStream.foreachBatch(batch_writer(folder, checkpoint))
    writer = writer.option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
