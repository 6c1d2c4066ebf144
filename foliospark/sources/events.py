"""Payment event documents: one JSON body per row, typed with an explicit schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foliospark.functions.json_text import with_json

# Fixed value: the only event type that creates an order.
PAID = "checkout.session.completed"

METADATA = (
    "authorName", "bookTitle", "wordCount", "tier", "fileFormat", "selectedLanguages", "selectedGenre",
    "selectedUpsells", "specialInstructions", "originalAmount", "voucherCode", "finalAmount",
)
EVENT = (
    "struct<id:string, type:string, created:bigint, data:struct<object:struct<"
    "id:string, customer_email:string, amount_total:bigint, metadata:struct<"
    + ",".join(f"{m}:string" for m in METADATA)
    + ">>>>"
)


def with_event(bodies: DataFrame, name: str, body: str = "body") -> DataFrame:
    return with_json(bodies, name, body, EVENT)


def read_bodies(spark: SparkSession, path: str) -> DataFrame:
    """Event bodies from text files, one document per line."""
    return spark.read.text(path).withColumnRenamed("value", "body")

