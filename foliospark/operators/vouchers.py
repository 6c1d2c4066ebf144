"""Voucher look-up, discount, minimum charge and the charge line."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.functions.money import MONEY, at_least_minimum, cents, percent_of, rounded
from foliospark.functions.text import fallback, instant, thousands, trim_all
from foliospark.operators.scan import rank_by_key
from foliospark.sources import dimensions as dims

# The pieces of a charge line.
LINE_NAME = "Book Translation: "
CURRENCY = "usd"
WORDS_OPEN, WORDS_CLOSE = " words (", ") → "
BULLET = " • "
FORMAT_NOTE = " format preserved"
VOUCHER_NOTE = " • Voucher: "

UNKNOWN, EXPIRED, USED_UP = "unknown_code", "expired", "used_up"


def voucher_key(code):
    return trim_all(F.upper(code))


def apply_voucher(
    orders: DataFrame,
    as_of: dt.datetime,
    code: str = "voucher_input",
    subtotal: str = "total",
    vouchers: DataFrame | None = None,
) -> DataFrame:
    """Discount one subtotal per row by its voucher text.

    Adds ``voucher_code`` (the key, only when accepted), ``reject_reason``, ``discount_amount`` and
    ``shown_total`` (rounded discount), ``charged_total`` and ``charged_cents`` (unrounded discount).
    The built-in table is broadcast; a caller's own table is joined as its size allows.
    """
    spark = orders.sparkSession
    table = dims.constant(dims.vouchers(spark)) if vouchers is None else vouchers
    looked_up = table.select("code", "discount", "discount_kind", "expires_at")
    entered = orders.withColumn("_code", F.when(fallback(code, F.lit(None)).isNotNull(), voucher_key(F.col(code))))
    joined = entered.join(looked_up, F.col("_code") == F.col("code"), "left")
    reason = (
        F.when(F.col("_code").isNull(), F.lit(None).cast("string"))
        .when(F.col("code").isNull(), F.lit(UNKNOWN))
        .when(F.col("expires_at") < instant(as_of), F.lit(EXPIRED))
    )
    accepted = F.col("code").isNotNull() & F.col("reject_reason").isNull()
    exact = F.when(
        accepted,
        F.when(F.col("discount_kind") == "percent", percent_of(subtotal, "discount")).otherwise(
            F.least(F.col("discount").cast(MONEY), F.col(subtotal))
        ),
    ).otherwise(F.lit(0)).cast("decimal(14,4)")
    return with_totals(
        joined.withColumn("reject_reason", reason)
        .withColumn("voucher_code", F.when(accepted, F.col("code")))
        .withColumn("_exact", exact),
        subtotal,
    ).drop("_code", "code", "discount", "discount_kind", "expires_at")


def with_totals(discounted: DataFrame, subtotal: str) -> DataFrame:
    """Totals from the exact discount in ``_exact``. Without an accepted voucher the shown total
    keeps the subtotal as it is; the minimum still applies to the charge."""
    shown = F.when(
        F.col("voucher_code").isNotNull(), at_least_minimum(F.col(subtotal) - F.col("discount_amount"))
    ).otherwise(F.col(subtotal))
    return (
        discounted.withColumn("discount_amount", rounded("_exact"))
        .withColumn("shown_total", rounded(shown))
        .withColumn("_charged", at_least_minimum(F.col(subtotal) - F.col("_exact")))
        .withColumn("charged_total", rounded("_charged"))
        .withColumn("charged_cents", cents("_charged"))
        .drop("_exact", "_charged")
    )


def enforce_max_uses(
    applied: DataFrame,
    vouchers: DataFrame,
    order_id: str,
    ts: str,
    subtotal: str = "total",
) -> DataFrame:
    """Undo the discount of redemptions beyond a code's ``max_uses``, earliest orders first.

    Off unless called. Only codes that have a limit are ranked, by a prefix scan over ranges, so a code
    that very many orders use in one moment does not become one task.
    """
    limits = vouchers.filter(F.col("max_uses").isNotNull()).select(F.col("code").alias("voucher_code"), "max_uses")
    limited = applied.select(order_id, ts, "voucher_code").join(limits, "voucher_code")
    ranked = rank_by_key(limited, ["voucher_code"], ts, order_id, "use_no")
    beyond = ranked.filter(F.col("use_no") > F.col("max_uses")).select(order_id, F.lit(True).alias("_beyond"))
    marked = applied.join(beyond, order_id, "left")
    late = F.col("_beyond").isNotNull()
    none = F.lit(0).cast(MONEY)
    charged = at_least_minimum(F.col(subtotal))
    return (
        marked.withColumn("reject_reason", F.when(late, F.lit(USED_UP)).otherwise(F.col("reject_reason")))
        .withColumn("voucher_code", F.when(~late, F.col("voucher_code")))
        .withColumn("discount_amount", F.when(late, none).otherwise(F.col("discount_amount")))
        .withColumn("shown_total", F.when(late, F.col(subtotal)).otherwise(F.col("shown_total")))
        .withColumn("charged_total", F.when(late, rounded(charged)).otherwise(F.col("charged_total")))
        .withColumn("charged_cents", F.when(late, cents(charged)).otherwise(F.col("charged_cents")))
        .drop("_beyond")
    )


def reject_report(applied: DataFrame) -> DataFrame:
    """Orders and face value per voucher outcome."""
    outcome = (
        F.when(F.col("reject_reason").isNotNull(), F.col("reject_reason"))
        .when(F.col("voucher_code").isNotNull(), F.lit("accepted"))
        .otherwise(F.lit("no_code"))
    )
    return applied.groupBy(outcome.alias("outcome"), "voucher_code").agg(
        F.count("*").alias("orders"), F.sum("discount_amount").alias("discount_total")
    )


def voucher_answers(applied: DataFrame, vouchers: DataFrame | None = None) -> DataFrame:
    """The look-up answer per request: validity, code, kind, size, discount and new total."""
    table = dims.constant(dims.vouchers(applied.sparkSession)) if vouchers is None else vouchers
    facts = table.select(F.col("code").alias("voucher_code"), "discount", "discount_kind", "description")
    valid = F.col("voucher_code").isNotNull()
    return (
        applied.join(facts, "voucher_code", "left")
        .withColumn("valid", valid)
        .withColumn("discount_amount", F.when(valid, F.col("discount_amount")))
        .withColumn("new_total", F.when(valid, F.col("charged_total")))
    )


MISSING_CODE, BAD_SUBTOTAL = "missing_code", "bad_subtotal"


def request_answers(requests: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Answers to look-up requests (code, subtotal decimal, any other columns), one per request.

    A request without a code, or whose subtotal is missing, unreadable or negative, is not valid and
    has that as its reason; the others are answered as an order with that subtotal would be.
    """
    entered = requests.withColumn("voucher_input", F.col("code")).drop("code")
    answers = voucher_answers(apply_voucher(entered, as_of, subtotal="subtotal"))
    bad = F.when(F.col("voucher_input").isNull(), MISSING_CODE).when(F.col("subtotal").isNull() | (F.col("subtotal") < 0), BAD_SUBTOTAL)
    usable = F.col("valid") & bad.isNull()
    answers = answers.withColumn("reject_reason", F.coalesce(bad, F.when(~F.col("valid"), F.coalesce("reject_reason", F.lit(UNKNOWN)))))
    for name in ("voucher_code", "discount", "discount_kind", "description", "discount_amount", "new_total"):
        answers = answers.withColumn(name, F.when(usable, F.col(name)))
    return answers.withColumn("valid", usable)


def charge_lines(applied: DataFrame) -> DataFrame:
    """Name, description, amount in cents and string metadata of every charge.

    Needs book_title, author_name, word_count, tier, languages, file_format, genre, upsells and the
    columns of ``apply_voucher``.
    """
    voucher_note = F.when(
        F.col("voucher_code").isNotNull(), F.concat(F.lit(VOUCHER_NOTE), F.col("voucher_code"))
    ).otherwise(F.lit(""))
    description = F.concat(
        thousands("word_count"), F.lit(WORDS_OPEN), F.col("tier"), F.lit(WORDS_CLOSE),
        F.upper(F.array_join("languages", ", ")), F.lit(BULLET), F.upper("file_format"),
        F.lit(FORMAT_NOTE), voucher_note,
    )
    metadata = F.struct(
        F.col("author_name").alias("authorName"),
        F.col("book_title").alias("bookTitle"),
        F.col("word_count").cast("string").alias("wordCount"),
        F.col("tier"),
        F.col("file_format").alias("fileFormat"),
        F.to_json("languages").alias("selectedLanguages"),
        F.col("genre").alias("selectedGenre"),
        F.to_json("upsells").alias("selectedUpsells"),
        F.col("special_instructions").alias("specialInstructions"),
        F.col("total").cast("string").alias("originalAmount"),
        F.coalesce("voucher_code", F.lit("")).alias("voucherCode"),
        F.col("charged_total").cast("string").alias("finalAmount"),
    )
    return (
        applied.withColumn("line_name", F.concat(F.lit(LINE_NAME), F.col("book_title")))
        .withColumn("line_description", description)
        .withColumn("currency", F.lit(CURRENCY))
        .withColumn("quantity", F.lit(1).cast("long"))
        .withColumn("metadata", metadata)
    )
