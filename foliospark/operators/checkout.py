"""Checkout request bodies to charges, with the client's total checked against our own quote."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.functions.json_text import with_json
from foliospark.functions.money import parse_money
from foliospark.operators.pricing import quote
from foliospark.operators.vouchers import apply_voucher, charge_lines
from foliospark.sources.tables import CART


def typed_carts(bodies: DataFrame, body: str = "body") -> DataFrame:
    """Parse each body once. ``reason`` names what makes a cart unusable."""
    cart = "struct<" + ", ".join(f"{n}:{t}" for n, t in (f.split() for f in CART.split(", "))) + ">"
    typed = with_json(bodies, "_c", body, cart).select(
        *[F.col(c) for c in bodies.columns if c != body],
        F.col("_c").isNotNull().alias("_read"),
        F.col("_c.email").alias("email"),
        F.col("_c.authorName").alias("author_name"),
        F.col("_c.bookTitle").alias("book_title"),
        F.col("_c.wordCount").alias("word_count"),
        F.col("_c.tier").alias("client_tier"),
        F.col("_c.fileFormat").alias("file_format"),
        F.col("_c.selectedLanguages").alias("languages"),
        F.col("_c.selectedGenre").alias("genre"),
        F.col("_c.selectedUpsells").alias("upsells"),
        F.col("_c.specialInstructions").alias("special_instructions"),
        parse_money("_c.totalAmount").alias("client_total"),
        F.col("_c.voucherCode").alias("voucher_input"),
    )
    reason = (
        F.when(~F.col("_read"), F.lit("bad_body"))
        .when(F.col("word_count").isNull(), F.lit("no_word_count"))
        .when(F.col("languages").isNull(), F.lit("no_languages"))
        .when(F.col("client_total").isNull(), F.lit("bad_total"))
    )
    return typed.withColumn("reason", reason).drop("_read")


def checkout(bodies: DataFrame, as_of: dt.datetime, body: str = "body") -> DataFrame:
    """Charge line per usable cart, for the total the client sent, as it is charged today.

    ``quoted_total`` is what the cart should cost and ``total_differs`` marks carts that claim
    another amount. Row-wise from end to end: constant broadcasts only, no shuffle.
    """
    usable = typed_carts(bodies, body).filter(F.col("reason").isNull())
    quoted = quote(usable).withColumnRenamed("total", "quoted_total").withColumnRenamed("client_total", "total")
    applied = apply_voucher(quoted, as_of)
    return charge_lines(applied).withColumn("total_differs", F.col("total") != F.col("quoted_total"))
