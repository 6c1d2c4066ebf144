"""Order and file look-ups for a dashboard."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def orders_by_status(orders: DataFrame) -> DataFrame:
    return orders.groupBy("status").agg(
        F.count("*").alias("orders"),
        F.sum("amount_paid").alias("revenue"),
        F.min("created_at").alias("oldest"),
        F.max("created_at").alias("newest"),
    )


def orders_by_email(orders: DataFrame) -> DataFrame:
    return orders.groupBy("email").agg(
        F.count("*").alias("orders"),
        F.sum("amount_paid").alias("revenue"),
        F.count(F.when(F.col("status") == "completed", 1)).alias("completed"),
        F.max("created_at").alias("newest"),
    )


def recent_orders(orders: DataFrame, k: int) -> DataFrame:
    """The k newest orders. Each task keeps k rows; no global sort."""
    return orders.orderBy(F.col("created_at").desc(), F.col("order_id")).limit(k)


def files_by_type_language(files: DataFrame) -> DataFrame:
    return files.groupBy("type", "language").agg(
        F.count("*").alias("files"), F.max("created_at").alias("newest")
    )
