"""Staged uploads (last write wins), their expiry and promotion, and file retention."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.functions.text import instant

# How long things are kept.
STAGED_HOURS = 24
LINK_DAYS = 7
FILE_DAYS = 30


def latest_upload(log: DataFrame) -> DataFrame:
    """Last write per session from an upload log (session_id, created_at, upload_id, ...)."""
    rest = [c for c in log.columns if c != "session_id"]
    kept = log.groupBy("session_id").agg(
        F.max_by(F.struct(*rest), F.struct("created_at", "upload_id")).alias("_r"), F.count("*").alias("writes")
    )
    return kept.select("session_id", "_r.*", "writes")


def expired(as_of: dt.datetime, created_at: str = "created_at", hours: int = STAGED_HOURS) -> Column:
    return F.col(created_at) < instant(as_of) - F.expr(f"INTERVAL {hours} HOURS")


def without_expired(staged: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Staged rows (one per session) still within their time; rows without a time stay."""
    return staged.filter(F.coalesce(~expired(as_of), F.lit(True)))


def promote(staged: DataFrame, orders: DataFrame) -> DataFrame:
    """Original file row of every order whose upload session is staged.

    staged holds one row per session. orders: order_id, upload_session_id, created_at.
    """
    facts = staged.withColumnRenamed("created_at", "uploaded_at").withColumnRenamed("session_id", "upload_session_id")
    return orders.join(facts, "upload_session_id").withColumn("type", F.lit("original")).withColumn("language", F.lit("en"))


def retention_due(orders: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Completed orders with their link and file deadlines and what is due."""
    links = F.col("completed_at") + F.expr(f"INTERVAL {LINK_DAYS} DAYS")
    files = F.col("completed_at") + F.expr(f"INTERVAL {FILE_DAYS} DAYS")
    return (
        orders.filter(F.col("completed_at").isNotNull())
        .withColumn("links_until", links)
        .withColumn("files_until", files)
        .withColumn("links_expired", F.col("links_until") < instant(as_of))
        .withColumn("files_due", F.col("files_until") < instant(as_of))
    )


def kept_orders(orders: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Orders whose files are not yet due for deletion; unfinished orders always stay."""
    due = F.col("completed_at") + F.expr(f"INTERVAL {FILE_DAYS} DAYS") < instant(as_of)
    return orders.filter(F.coalesce(~due, F.lit(True)))
