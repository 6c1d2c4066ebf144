"""Business inputs derived from the test tables by Spark, row for row over the whole tables."""

from __future__ import annotations

import datetime as dt
import io
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.operators.intake import intake
from foliospark.operators.pricing import quote, tier_of
from foliospark.sources.dimensions import ADDONS, LANGUAGE_CODES
from foliospark.sources.events import METADATA, PAID
from foliospark.sources.manuscripts import shares
from foliospark.sources.tables import table

UPLOADS_AS_OF = dt.datetime(2024, 1, 31)
ORDERS_AS_OF = dt.datetime(1998, 6, 1)
STATUS_AS_OF = dt.datetime(2024, 1, 25)
STATUS_TIMEOUT = dt.timedelta(days=1)
STATUS_DELAY = "12 hours"
SUFFIXES = (".txt", ".docx", ".epub", ".pdf", ".TXT", ".v2.txt", "")
VOUCHER_INPUTS = ("LAUNCH20", "FIRST50", "FRIEND10", "AUTHOR25", "BETA95", "TESTDRIVE", "  launch20 ", "NOPE", None)


def pick(values, index):
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))


def manuscripts(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    suffix = pick(SUFFIXES, F.col("doc_id") % 7)
    return docs.select(
        "doc_id", "source", "lang",
        F.concat(F.lit("s"), F.col("doc_id").cast("string")).alias("session_id"),
        F.concat(F.lit("my_book_"), F.col("doc_id").cast("string"), suffix).alias("file_name"),
        F.col("n_chars").alias("size_bytes"),
        F.col("text").alias("content"),
    )


def order_inputs(spark: SparkSession, d: str, customers: bool = False) -> DataFrame:
    """Carts with everything that follows from the order row; ``customers`` adds email and genre."""
    o = table(spark, d, "orders")
    key = F.col("o_orderkey")
    words = F.floor("o_totalprice").cast("long") % 160000 + 1
    bits = F.floor(key / 5).cast("long") % 16
    chosen = F.filter(
        F.array(*[F.when(F.floor(bits / (1 << i)).cast("long") % 2 == 1, F.lit(a[0])) for i, a in enumerate(ADDONS)],
                F.when(key % 97 == 0, F.lit("unknown"))),
        lambda x: x.isNotNull(),
    )
    done = F.col("o_orderstatus") == "F"
    out = o.select(
        key.alias("order_id"),
        F.col("o_custkey").alias("customer_id"),
        F.concat(F.lit("cs_"), F.lpad(key.cast("string"), 12, "0")).alias("payment_session_id"),
        F.concat(F.lit("s"), F.col("o_custkey").cast("string")).alias("upload_session_id"),
        F.concat(F.lit("Author "), F.col("o_custkey").cast("string")).alias("author_name"),
        F.concat(F.lit("Book "), key.cast("string")).alias("book_title"),
        words.alias("word_count"),
        tier_of(words).alias("tier"),
        pick((".txt", ".docx", ".epub", ".pdf"), F.col("o_custkey") % 4).alias("file_format"),
        F.slice(F.array(*[F.lit(c) for c in LANGUAGE_CODES]), 1, (key % 5).cast("int")).alias("languages"),
        chosen.alias("upsells"),
        F.when(key % 3 == 0, F.lit("Keep chapter titles short.")).alias("special_instructions"),
        pick(VOUCHER_INPUTS, key % 9).alias("voucher_input"),
        F.col("o_totalprice").cast("decimal(12,2)").alias("amount_paid"),
        F.col("o_orderpriority").alias("priority"),
        F.when(F.col("o_orderstatus") == "P", "pending").when(done, "completed").otherwise("processing").alias("status"),
        F.col("o_orderdate").alias("created_at"),
        F.when(done, F.col("o_orderdate") + F.expr("INTERVAL 3 DAYS")).alias("completed_at"),
    )
    if not customers:
        return out
    c = table(spark, d, "customer").select(
        F.col("c_custkey").alias("customer_id"),
        F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit("."))), F.lit("@example.com")).alias("email"),
        F.col("c_mktsegment").alias("segment"),
    )
    genre = F.when(F.col("priority") == "5-LOW", F.lit("")).otherwise(F.col("segment"))
    return out.join(c, "customer_id").withColumn("genre", genre).drop("segment")


def cart_bodies(spark: SparkSession, d: str) -> DataFrame:
    """Checkout bodies of all orders; some claim a total of 1.00, some are cut off."""
    o = quote(order_inputs(spark, d, customers=True))
    claimed = F.when(F.col("order_id") % 10 == 3, F.lit("1.00")).otherwise(F.col("total").cast("string"))
    cart = F.struct(
        F.col("email"), F.col("author_name").alias("authorName"), F.col("book_title").alias("bookTitle"),
        F.col("word_count").alias("wordCount"), F.col("tier"), F.col("file_format").alias("fileFormat"),
        F.col("languages").alias("selectedLanguages"), F.col("genre").alias("selectedGenre"),
        F.col("upsells").alias("selectedUpsells"), F.col("special_instructions").alias("specialInstructions"),
        claimed.alias("totalAmount"), F.coalesce("voucher_input", F.lit("")).alias("voucherCode"),
    )
    body = F.to_json(cart)
    cut = F.when(F.col("order_id") % 50 == 7, F.left(body, F.length(body) - 1)).otherwise(body)
    return o.select("order_id", cut.alias("body"))


def file_rows(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    parts = [F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]
    return li.select(
        F.concat_ws("-", *parts).alias("file_id"),
        F.col("l_orderkey").alias("order_id"),
        F.lit("translated").alias("type"),
        pick(LANGUAGE_CODES, F.col("l_linenumber") % 4).alias("language"),
        F.col("l_shipdate").alias("created_at"),
    )


def file_texts(spark: SparkSession, d: str) -> DataFrame:
    """Contents of the files of ``file_rows``: the line's comment for a few times, and a first pass."""
    li = table(spark, d, "lineitem")
    parts = [F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]
    line = F.concat(F.lit("Überarbeitet: "), F.concat_ws(" ", *parts), F.lit("\n"))
    return li.select(
        F.concat_ws("-", *parts).alias("file_id"), F.repeat(line, (F.col("l_linenumber") + 1).cast("int")).alias("content"), line.alias("original_content")
    )


def originals(spark: SparkSession, d: str) -> DataFrame:
    """Staged manuscripts as original files; every fourth order has two, so the look-up is ambiguous."""
    staged = intake(manuscripts(spark, d))
    return staged.select(
        F.floor(F.col("doc_id") * 4 / 5).cast("long").alias("order_id"),
        F.col("doc_id").alias("file_id"), "file_format", "word_count", "has_text", "content",
    )


def download_requests(spark: SparkSession, d: str) -> DataFrame:
    """One click per line item; part numbers decide the language, some of them unknown."""
    li = table(spark, d, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("order_id"), pick((*LANGUAGE_CODES, "xx"), F.col("l_partkey") % 5).alias("language")
    )


def payment_bodies(events: DataFrame) -> DataFrame:
    """Event bodies from the raw events table, batch or streaming.

    Each event is delivered one to three times, ten minutes apart. Purchases are paid sessions,
    some with an unreadable language list; errors are broken bodies.
    """
    eid = F.col("event_id")
    text = eid.cast("string")
    words = (eid * 37) % 160000 + 1
    languages = F.slice(F.array(*[F.lit(c) for c in LANGUAGE_CODES]), 1, (eid % 4 + 1).cast("int"))
    cents = F.floor(F.col("value") * 100 + 0.5).cast("long")
    values = {
        "authorName": F.concat(F.lit("Author "), F.col("user_id").cast("string")),
        "bookTitle": F.concat(F.lit('Book "'), text, F.lit('"')),
        "wordCount": words.cast("string"),
        "tier": tier_of(words),
        "fileFormat": pick((".txt", ".docx", ".epub", ".pdf"), eid % 4),
        "selectedLanguages": F.when(eid % 11 == 0, F.array_join(languages, ",")).otherwise(F.to_json(languages)),
        "selectedGenre": F.when(eid % 5 == 0, F.lit("")).otherwise(F.lit("Romance")),
        "selectedUpsells": F.when(eid % 5 == 0, F.lit("")).otherwise(F.lit('["newsletter"]')),
        "specialInstructions": F.when(eid % 3 == 0, F.lit("Keep names.")),
        "originalAmount": (cents * 2 * F.lit("0.01").cast("decimal(3,2)")).cast("decimal(12,2)").cast("string"),
        "voucherCode": F.when(eid % 4 == 0, F.lit("LAUNCH20")).otherwise(F.lit("")),
        "finalAmount": (cents * F.lit("0.01").cast("decimal(3,2)")).cast("decimal(12,2)").cast("string"),
    }
    kind = F.when(F.col("event_type") == "purchase", F.lit(PAID)).otherwise(F.concat(F.lit("other."), F.col("event_type")))
    session = F.struct(
        F.concat(F.lit("cs_"), text).alias("id"),
        F.concat(F.lit("user"), F.col("user_id").cast("string"), F.lit("@example.com")).alias("customer_email"),
        cents.alias("amount_total"),
        F.struct(*[values[m].alias(m) for m in METADATA]).alias("metadata"),
    )
    event = F.struct(
        F.concat(F.lit("evt_"), text).alias("id"), kind.alias("type"),
        F.unix_seconds(F.col("ts").cast("timestamp")).alias("created"), F.struct(session.alias("object")).alias("data"),
    )
    body = F.to_json(event)
    broken = F.when(F.col("event_type") == "error", F.concat(body, F.lit(" trailing"))).otherwise(body)
    # The explode comes in a step of its own: next to it, struct fields would lose their names.
    bodies = events.select(broken.alias("body"), "ts", F.sequence(F.lit(0), (eid % 3).cast("int")).alias("times"))
    each = bodies.select("body", "ts", F.explode("times").alias("delivery"))
    first = F.unix_seconds(F.col("ts").cast("timestamp"))
    return each.select("body", F.timestamp_seconds(first + F.col("delivery") * 600).alias("delivered_at"))


def status_log(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    state = (
        F.when(F.col("event_type") == "signup", "pending").when(F.col("event_type") == "view", "processing")
        .when(F.col("event_type") == "click", "completed").when(F.col("event_type") == "error", "failed")
    )
    return e.filter(F.col("event_type") != "purchase").select(
        F.col("user_id").alias("order_id"), state.alias("status"), F.col("ts").alias("changed_at"),
        F.col("event_id").alias("change_id"),
    )


def arriving(rows: DataFrame, ts: str, tie: str, delay: str, parts: int) -> DataFrame:
    """Rows with the ``part`` in which they arrive, each later than its time by up to ``delay``."""
    late = F.expr(f"interval {delay}") * (F.pmod(F.xxhash64(tie), F.lit(1000)) / 1000)
    timed = rows.withColumn("part", F.unix_micros((F.col(ts) + late).cast("timestamp")))
    first, last = timed.agg(F.min("part"), F.max("part")).first()
    share = (F.col("part") - (first or 0)) * parts / ((last or 0) - (first or 0) + 1)
    return timed.withColumn("part", F.floor(share).cast("int"))


def upload_log(events: DataFrame) -> DataFrame:
    eid = F.col("event_id")
    suffix = pick(SUFFIXES, eid % 7)
    name = F.concat(F.lit("my_book_"), eid.cast("string"), suffix)
    return events.select(
        F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("session_id"),
        eid.alias("upload_id"), F.col("ts").alias("created_at"), name.alias("file_name"),
        F.concat(F.lit("."), F.lower(F.substring_index(name, ".", -1))).alias("file_format"),
        ((eid * 37) % 160000 + 1).alias("word_count"),
    )


def selection_log(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    action = F.when(F.col("event_type") == "signup", "all").when(F.col("event_type") == "click", "toggle").otherwise("other")
    return e.select(
        F.col("user_id").alias("session_id"), pick(LANGUAGE_CODES, F.col("event_id") % 4).alias("item"),
        action.alias("action"), F.col("ts").alias("at"), F.col("event_id").alias("seq"),
    )


def model_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Every user turn as a translation, with the answer to it or null."""
    c = table(spark, d, "conversations")
    user = c.filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("translated"))
    answer = c.filter(F.col("role") == "assistant").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("improved"))
    return user.join(answer, ["conv_id", "turn"], "left")


def editorial_answers(spark: SparkSession, d: str) -> DataFrame:
    """Model answers in six shapes by conversation: good, plain text, empty text, no change list,
    a change list of the wrong type, and trailing text."""
    pairs = model_pairs(spark, d)
    change = lambda kind: F.struct(
        F.col("translated").alias("original"), F.col("improved").alias("edited"),
        F.lit("reads better").alias("reason"), F.lit(kind).alias("type"),
    )
    text = F.col("improved").alias("editedText")
    changes = F.array(change("style"), change("tone")).alias("changes")
    good = F.to_json(F.struct(text, changes))
    shape = F.col("conv_id") % 6
    answer = (
        F.when(shape == 0, good)
        .when(shape == 1, F.col("improved"))
        .when(shape == 2, F.to_json(F.struct(F.lit("").alias("editedText"), changes)))
        .when(shape == 3, F.to_json(F.struct(text)))
        .when(shape == 4, F.to_json(F.struct(text, F.lit("none").alias("changes"))))
        .otherwise(F.concat(good, F.lit(" That is all.")))
    )
    return pairs.select("conv_id", "turn", pick(LANGUAGE_CODES, F.col("conv_id") % 4).alias("language"), "translated",
                        F.when(F.col("improved").isNotNull(), answer).alias("answer"))


def marked_texts(spark: SparkSession, d: str) -> DataFrame:
    """Texts with one mark for odd documents, a second one for every other odd document."""
    docs = table(spark, d, "documents")
    t, did = F.col("text"), F.col("doc_id")
    head = F.concat(F.lit("[[ORIGINAL: "), F.substring(t, 1, 20), F.lit("]]"))
    rest = F.substring(t, F.lit(21), F.length(t))
    tail = F.concat(F.lit("[[ORIGINAL: end\nnote]]"), F.lit("The end."))
    text = F.when(did % 4 == 1, F.concat(head, rest, tail)).when(did % 2 == 1, F.concat(head, rest)).otherwise(t)
    return docs.select("doc_id", "lang", F.col("text").alias("original"), text.alias("text"))


def reformatted_texts(spark: SparkSession, d: str) -> DataFrame:
    """Original next to a copy that is unchanged, lost its blank lines, or gained a list."""
    docs = table(spark, d, "documents")
    t = F.col("text")
    after = (
        F.when(F.col("doc_id") % 3 == 0, t)
        .when(F.col("doc_id") % 3 == 1, F.replace(t, F.lit("\n\n"), F.lit("\n")))
        .otherwise(F.concat(t, F.lit("\n- first\n2. second\n# Notes\n")))
    )
    return docs.select("doc_id", t.alias("original"), after.alias("translated"))


def restructured_texts(spark: SparkSession, d: str) -> DataFrame:
    """Documents with a blank line after every line, next to a copy that is unchanged, lost its blank lines, became one list,
    or gained a heading at the end."""
    docs = table(spark, d, "documents")
    t = F.replace("text", F.lit("\n"), F.lit("\n\n"))
    kind = F.col("doc_id") % 4
    after = (
        F.when(kind == 0, t).when(kind == 1, F.replace(t, F.lit("\n\n"), F.lit("\n")))
        .when(kind == 2, F.regexp_replace(t, r"([^\n]+)", "- $1")).otherwise(F.concat(t, F.lit("\n# Notes")))
    )
    return docs.select("doc_id", t.alias("original"), after.alias("translated"))


def strategy_books(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    did = F.col("doc_id")
    return docs.select(
        "doc_id", pick((*LANGUAGE_CODES, "xx"), did % 5).alias("language"),
        F.concat(F.lit("Book "), did.cast("string")).alias("book_title"),
        F.concat(F.lit("Author "), F.col("source")).alias("author_name"),
        F.lit("Romance").alias("genre"), F.col("text").alias("book_description"),
    )


def strategy_answers(spark: SparkSession, d: str) -> DataFrame:
    """Fenced or bare strategy JSON of varying quality, built from each document."""
    # A column of its own: the boxes use it many times, and inlined it would be computed as often.
    books = strategy_books(spark, d).withColumn("line", F.translate("book_description", "\n", " "))
    did, line = F.col("doc_id"), F.col("line")
    count = lambda base, m: (F.lit(base) + did % m).cast("int")
    named = lambda word, n: F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.lit(word + " "), i.cast("string")))
    boxes = F.transform(
        F.sequence(F.lit(1), F.when(did % 8 == 7, 6).otherwise(7)),
        lambda i: F.substring(line, i * 60 - 59, (F.lit(17) + i * 4 + did % 11).cast("int")),
    )
    prices = F.struct(F.lit("€4.99").alias("ebook"), F.lit("€12.99").alias("paperback"), F.lit("Local average").alias("reasoning"))
    strategy = F.struct(
        boxes.alias("backendKeywords"),
        named("keyword", count(22, 12)).alias("adKeywords"),
        named("path", count(4, 5)).alias("categories"),
        F.when(did % 13 != 0, prices).alias("pricingRecommendation"),
        line.alias("bookDescription"),
        named("tip", count(4, 5)).alias("reviewStrategy"),
        named("step", count(1, 3)).alias("kdpUploadChecklist"),
    )
    bare = F.to_json(strategy)
    answer = (
        F.when(did % 10 == 9, F.col("book_description"))
        .when(did % 2 == 1, F.concat(F.lit("```json\n"), bare, F.lit("\n```\n")))
        .otherwise(bare)
    )
    return books.withColumn("answer", answer).drop("line")


_DOCX_HEAD = (
    '<?xml version="1.0" encoding="UTF-8"?><w:document '
    'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>'
)


def docx_bytes(text: str) -> bytes:
    """A minimal Word file with one paragraph per line."""
    lines = "".join(
        f'<w:p><w:r><w:t xml:space="preserve">{escape(line)}</w:t></w:r></w:p>' for line in text.split("\n")
    )
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        archive.writestr("word/document.xml", _DOCX_HEAD + lines + "</w:body></w:document>")
    return out.getvalue()


def docx_files(spark: SparkSession, d: str) -> DataFrame:
    """Every document as a Word file; the test tables hold no binary uploads."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in shares(batch, "text"):
                yield pd.DataFrame({"doc_id": part.doc_id, "bytes": [docx_bytes(t) for t in part.text]})

    return table(spark, d, "documents").select("doc_id", "text").mapInPandas(pack, "doc_id bigint, bytes binary")
