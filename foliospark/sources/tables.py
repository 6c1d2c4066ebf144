"""Explicit schemas and readers for the persistent relations and request bodies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

ORDERS = """
order_id string, payment_session_id string, email string, author_name string, book_title string,
word_count int, tier string, file_format string, languages array<string>, genre string,
upsells array<string>, special_instructions string, amount_paid decimal(10,2), voucher_code string,
original_amount decimal(12,2), status string, created_at timestamp, completed_at timestamp
"""
FILES = """
file_id string, order_id string, type string, language string, content string,
original_content string, file_url string, created_at timestamp
"""
STAGED = """
session_id string, file_name string, file_format string, content string, word_count bigint,
created_at timestamp
"""
CART = (
    "email string, authorName string, bookTitle string, wordCount bigint, tier string, fileFormat string, "
    "selectedLanguages array<string>, selectedGenre string, selectedUpsells array<string>, "
    "specialInstructions string, totalAmount string, voucherCode string"
)
VOUCHER_REQUEST = "code string, subtotal decimal(12,2)"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def orders(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ORDERS).parquet(path)


def files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FILES).parquet(path)


def staged(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(STAGED).parquet(path)


def carts(spark: SparkSession, path: str) -> DataFrame:
    """Checkout request bodies, one JSON document per line; bad lines land in ``bad_body``."""
    return (
        spark.read.schema(CART + ", bad_body string")
        .option("columnNameOfCorruptRecord", "bad_body")
        .json(path)
    )


def voucher_requests(spark: SparkSession, path: str) -> DataFrame:
    return (
        spark.read.schema(VOUCHER_REQUEST + ", bad_body string")
        .option("columnNameOfCorruptRecord", "bad_body")
        .json(path)
    )
