"""Bulk delivery: resolve download requests to files or to the reason there is none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.sources.dimensions import language_name

# Fixed value: characters of the payment session shown to the customer.
REFERENCE_CHARS = 12


def file_name(title: Column | str, language: Column | str) -> Column:
    title = F.col(title) if isinstance(title, str) else title
    language = F.col(language) if isinstance(language, str) else language
    return F.concat(title, F.lit("_"), F.coalesce(language_name(language), language), F.lit(".txt"))


def order_reference(session_id: Column | str) -> Column:
    session_id = F.col(session_id) if isinstance(session_id, str) else session_id
    return F.right(session_id, F.lit(REFERENCE_CHARS))


def order_by_id(orders: DataFrame, order_id) -> DataFrame:
    """Rows of one order. The equality reaches the Parquet scan, which skips row groups by their bounds."""
    return orders.filter(F.col("order_id") == F.lit(order_id))


def lookup_one(wanted: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """For each wanted key: how often asked, how many rows match, and found / missing / ambiguous.

    Both sides are reduced to one row per key before they meet.
    """
    asked = wanted.groupBy(key).agg(F.count("*").alias("requests"))
    held = table.groupBy(key).agg(F.count("*").alias("matches"))
    matches = F.coalesce("matches", F.lit(0))
    outcome = F.when(matches == 0, "missing").when(matches == 1, "found").otherwise("ambiguous")
    return asked.join(held, key, "left").select(key, "requests", matches.alias("matches"), outcome.alias("outcome"))


def resolve(requests: DataFrame, orders: DataFrame, files: DataFrame) -> DataFrame:
    """One row per requested (order_id, language): the outcome, and the latest file where there is one.

    orders holds one row per order_id; the checks apply in the order an interactive download makes them.
    Requests and files are reduced to one row per pair first and meet on the pair, which both are
    already partitioned by; the order's status joins after that. No text column is touched.
    """
    asked = requests.groupBy("order_id", "language").agg(F.count("*").alias("requests"))
    latest = F.struct("created_at", "file_id")
    held = (
        files.filter(F.col("type") == "translated")
        .groupBy("order_id", "language")
        .agg(F.count("*").alias("copies"), F.max(latest).alias("_l"))
        .select("order_id", "language", "copies", "_l.file_id", "_l.created_at")
    )
    found = asked.join(held, ["order_id", "language"], "left")
    known = orders.select("order_id", "status", "book_title")
    outcome = (
        F.when(F.col("status").isNull(), "order_not_found")
        .when(F.col("status") != "completed", "not_complete")
        .when(F.col("copies").isNull(), "translation_not_found")
        .when(F.col("copies") > 1, "ambiguous")
        .otherwise("ok")
    )
    return found.join(known, "order_id", "left").withColumn("outcome", outcome)


def manifest(resolved: DataFrame) -> DataFrame:
    """Files to hand out. Of several copies the latest is delivered and the fact is kept."""
    return (
        resolved.filter(F.col("outcome").isin("ok", "ambiguous"))
        .withColumn("file_name", file_name("book_title", "language"))
        .withColumn("duplicated", F.col("outcome") == "ambiguous")
        .select("order_id", "language", "file_id", "file_name", "duplicated", "created_at")
    )


def deliver(manifest_rows: DataFrame, files: DataFrame) -> DataFrame:
    """The text of every file in the manifest and its first pass; the wide join, on the unique file id."""
    return manifest_rows.join(files.select("file_id", "content", "original_content"), "file_id")
