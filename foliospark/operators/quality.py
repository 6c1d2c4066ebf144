"""Integrity and form checks on orders and files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.functions.text import fallback
from foliospark.sources.dimensions import FORMATS, LANGUAGE_CODES


def orphan_files(files: DataFrame, orders: DataFrame) -> DataFrame:
    """Orders ids that files point to but no order has, with their number of files.

    Files are counted per order before the anti-join, so a hot order meets it as one row.
    """
    per_order = files.groupBy("order_id").agg(F.count("*").alias("files"), F.max("created_at").alias("newest"))
    return per_order.join(orders.select("order_id"), "order_id", "left_anti")


def cascade_delete(files: DataFrame, deleted_orders: DataFrame) -> DataFrame:
    """Files that remain when the given orders go."""
    return files.join(deleted_orders.select("order_id"), "order_id", "left_anti")


def removed_by_cascade(files: DataFrame, deleted_orders: DataFrame) -> DataFrame:
    return files.join(deleted_orders.select("order_id"), "order_id", "left_semi")


def check_orders(orders: DataFrame) -> DataFrame:
    """One flag per rule; a row-wise projection."""
    languages = F.coalesce("languages", F.array().cast("array<string>"))
    known = F.array(*[F.lit(c) for c in LANGUAGE_CODES])
    checks = {
        "no_email": fallback("email", F.lit(None)).isNull(),
        "no_title": fallback("book_title", F.lit(None)).isNull(),
        "no_language": F.size(languages) == 0,
        "repeated_language": F.size(F.array_distinct(languages)) < F.size(languages),
        "unknown_language": F.size(F.array_except(languages, known)) > 0,
        "repeated_addon": F.coalesce(F.size(F.array_distinct("upsells")) < F.size("upsells"), F.lit(False)),
        "bad_format": ~F.coalesce(F.col("file_format").isin(*["." + f for f, _ in FORMATS]), F.lit(False)),
    }
    out = orders
    for name, test in checks.items():
        out = out.withColumn(name, test)
    failed = sum((F.col(n).cast("int") for n in checks), F.lit(0))
    return out.withColumn("failed_checks", failed.cast("long"))


