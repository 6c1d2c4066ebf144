"""Payment events to typed, keyed order rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.functions.json_text import with_json
from foliospark.functions.money import from_cents, parse_money
from foliospark.functions.text import fallback, leading_int
from foliospark.sources.events import PAID, with_event


def order_key(session_id: Column | str) -> Column:
    """Order id derived from the payment session, so a replay gives the same id."""
    session_id = F.col(session_id) if isinstance(session_id, str) else session_id
    return F.substring(F.sha2(session_id.cast("binary"), 256), 1, 32)


def typed_events(bodies: DataFrame, body: str = "body") -> DataFrame:
    """Parse each body once; keep the row with a ``reason`` when it cannot become an order.

    reason is null for a good paid event, ``ignored_type`` for other event types, and otherwise
    names what is wrong.
    """
    meta = "_e.data.object.metadata."
    # The event is flattened at once, so that the list parsers below carry plain columns only.
    flat = with_event(bodies, "_e", body).select(
        *[F.col(c) for c in bodies.columns if c != body],
        F.col("_e.type").alias("event_type"),
        F.col("_e.id").alias("event_id"),
        F.col("_e.data.object.id").alias("payment_session_id"),
        F.col("_e.data.object.customer_email").alias("email"),
        F.col(meta + "authorName").alias("author_name"),
        F.col(meta + "bookTitle").alias("book_title"),
        leading_int(meta + "wordCount").alias("word_count"),
        F.col(meta + "tier").alias("tier"),
        F.col(meta + "fileFormat").alias("file_format"),
        F.col(meta + "selectedGenre").alias("genre"),
        F.nullif(F.col(meta + "specialInstructions"), F.lit("")).alias("special_instructions"),
        from_cents("_e.data.object.amount_total").alias("amount_paid"),
        F.nullif(F.col(meta + "voucherCode"), F.lit("")).alias("voucher_code"),
        parse_money(meta + "originalAmount").alias("original_amount"),
        F.timestamp_seconds("_e.created").cast("timestamp_ntz").alias("created_at"),
        # The lists inside other events are not looked at.
        F.when(F.col("_e.type") == PAID, F.col(meta + "selectedLanguages")).alias("_list_of_languages"),
        F.when(F.col("_e.type") == PAID, fallback(meta + "selectedUpsells", "[]")).alias("_list_of_upsells"),
    )
    listed = with_json(flat, "languages", "_list_of_languages", "array<string>")
    typed = with_json(listed, "upsells", "_list_of_upsells", "array<string>").drop("_list_of_languages", "_list_of_upsells")
    reason = (
        F.when(F.col("event_type").isNull(), F.lit("bad_body"))
        .when(F.col("event_type") != PAID, F.lit("ignored_type"))
        .when(F.col("payment_session_id").isNull(), F.lit("no_session"))
        .when(F.col("languages").isNull(), F.lit("bad_languages"))
        .when(F.col("upsells").isNull(), F.lit("bad_upsells"))
        .when(F.col("word_count").isNull(), F.lit("bad_word_count"))
        .when(F.col("amount_paid").isNull(), F.lit("no_amount"))
    )
    return typed.withColumn("reason", reason)


def paid_orders(typed: DataFrame) -> DataFrame:
    """Good paid events as pending order rows, replays still included."""
    return (
        typed.filter((F.col("event_type") == PAID) & F.col("reason").isNull())
        .withColumn("order_id", order_key("payment_session_id"))
        .withColumn("status", F.lit("pending"))
        .drop("reason", "event_type")
    )


def first_delivery(paid: DataFrame, delivered_at: str = "delivered_at") -> DataFrame:
    """One row per payment session: its earliest delivery.

    ``min_by`` combines on the map side, so a session that was replayed millions of times leaves
    each task as one row.
    """
    rest = [c for c in paid.columns if c != "payment_session_id"]
    row = F.struct(*rest)
    kept = paid.groupBy("payment_session_id").agg(
        F.min_by(row, F.struct(delivered_at, "event_id")).alias("_r"), F.count("*").alias("deliveries")
    )
    return kept.select("payment_session_id", "_r.*", "deliveries")


def rejected(typed: DataFrame) -> DataFrame:
    """Events that became no order, counted per reason and type."""
    return (
        typed.filter(F.col("reason").isNotNull())
        .groupBy("reason", F.coalesce("event_type", F.lit("")).alias("event_type"))
        .agg(F.count("*").alias("events"))
    )
