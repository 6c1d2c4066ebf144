"""Notification rows for customers and the administrator. Sending them is left to a mail service."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.functions.text import fallback, thousands
from foliospark.sources.dimensions import language_name

# Subjects, the download path and the words used for empty lists.
CONFIRMED = ("Order Confirmed: ", " Translation")
NEW_ORDER = "New Order: "
READY = "Your translations are ready: "
COMPLETE = "Translation Complete: "
DOWNLOAD_PATH = "/download/"
NONE = "None"


def language_names(languages: Column | str = "languages") -> Column:
    """Names joined with commas; an unknown code stands for itself."""
    languages = F.col(languages) if isinstance(languages, str) else languages
    return F.array_join(F.transform(languages, lambda c: F.coalesce(language_name(c), c)), ", ")


def links(base_url: str, languages: Column | str = "languages") -> Column:
    """One (language, url) pair per language, in order."""
    languages = F.col(languages) if isinstance(languages, str) else languages
    order = F.col("order_id").cast("string")
    return F.transform(
        languages,
        lambda c: F.struct(
            F.coalesce(language_name(c), c).alias("language"),
            F.concat(F.lit(base_url + DOWNLOAD_PATH), order, F.lit("/"), c).alias("url"),
        ),
    )


def outbox(orders: DataFrame, admin: str, base_url: str) -> DataFrame:
    """Order confirmations for every order, completion notices for completed ones.

    Each order is read once and fans out to its two or four notices in the same task.
    """
    title, done = F.col("book_title"), F.col("status") == "completed"
    amount = F.concat(F.lit("$"), F.col("amount_paid").cast("string"))
    codes = F.array_join("languages", ", ")

    def notice(kind, recipient, subject, languages, with_links):
        return F.struct(
            F.lit(kind).alias("kind"),
            recipient.alias("recipient"),
            subject.alias("subject"),
            languages.alias("languages_text"),
            (links(base_url) if with_links else F.lit(None).cast("array<struct<language:string,url:string>>")).alias("links"),
        )

    confirmations = F.array(
        notice("order_confirmation", F.col("email"), F.concat(F.lit(CONFIRMED[0]), title, F.lit(CONFIRMED[1])), F.upper(codes), False),
        notice("admin_new_order", F.lit(admin), F.concat(F.lit(NEW_ORDER), title, F.lit(" - "), amount), codes, False),
    )
    completions = F.array(
        notice("completion", F.col("email"), F.concat(F.lit(READY), title), language_names(), True),
        notice("admin_completion", F.lit(admin), F.concat(F.lit(COMPLETE), title), language_names(), False),
    )
    notices = F.when(done, F.concat(confirmations, completions)).otherwise(confirmations)
    facts = orders.select(
        "order_id", "author_name", F.col("email").alias("customer_email"), "book_title", "tier", "file_format", "genre",
        thousands("word_count").alias("words_text"),
        F.upper("file_format").alias("format_text"),
        F.when(F.size("upsells") > 0, F.array_join("upsells", ", ")).otherwise(F.lit(NONE)).alias("upsells_text"),
        fallback("special_instructions", NONE).alias("instructions_text"),
        F.explode(notices).alias("n"),
    )
    return facts.select("*", "n.*").drop("n")


def order_improvement_notices(orders: DataFrame, parsed: DataFrame, base_url: str) -> DataFrame:
    """One notice per order whose edited texts are ready: recipient, subject, links, improvements per language.

    orders: order_id, email, author_name, book_title; parsed: order_id, language, changes, any number of parts per language.
    Parts are added up per order and language before anything is grouped per order, so that group is as long as the order has languages.
    """
    per_language = parsed.groupBy("order_id", "language").agg(F.sum(F.size("changes").cast("long")).alias("n"))
    own = F.array_sort(F.collect_list(F.struct("language", "n")))
    per_order = per_language.groupBy("order_id").agg(own.alias("_each"), F.sum("n").alias("improvements"))
    name = lambda c: F.coalesce(language_name(c), c)
    line = lambda e: F.concat(name(e["language"]), F.lit(": "), e["n"].cast("string"), F.lit(" improvements"))
    return per_order.join(orders.select("order_id", "email", "author_name", "book_title"), "order_id").select(
        "order_id", F.lit("improvement_notice").alias("kind"), F.col("email").alias("recipient"), F.concat(F.lit(READY), F.col("book_title")).alias("subject"),
        "author_name", links(base_url, F.transform("_each", lambda e: e["language"])).alias("links"),
        F.array_join(F.transform("_each", line), "\n").alias("summary"), "improvements",
    )


def improvement_notices(parsed: DataFrame) -> DataFrame:
    """Number of editorial improvements per order and language, as text for the completion notice.

    parsed: order_id, language, changes.
    """
    name = F.coalesce(language_name(F.col("language")), F.col("language"))
    return parsed.select(
        "order_id", "language", F.size("changes").cast("long").alias("improvements"),
        F.concat(name, F.lit(": "), F.size("changes").cast("string"), F.lit(" improvements")).alias("line"),
    )
