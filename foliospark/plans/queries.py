"""The named queries: each reads whole test tables through ``fixtures`` and applies the operators."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.functions.text import word_count
from foliospark.operators import (
    checkout, delivery, editorial, inference, intake, kept, launch, outbox, payments, pricing, quality, reports,
    requests, retention, selection, status, vouchers,
)
from foliospark.plans import fixtures as fx
from foliospark.session import fresh_dir
from foliospark.sinks import clustered, shards
from foliospark.sources import manuscripts
from foliospark.sources.events import read_bodies
from foliospark.sources.tables import table
from foliospark.streaming import payments as payment_stream
from foliospark.streaming import status as status_stream_job
from foliospark.streaming import uploads as upload_stream

ADMIN = "admin@example.com"
SITE = "https://books.example.com"
BRAND = "Folio"
RECENT = 100

QUERIES: dict = {}


def query(fn):
    """Register a query under its name, with its output in portable types."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return portable(fn(spark, sf_dir))

    QUERIES[fn.__name__] = run
    return fn


def portable(df: DataFrame) -> DataFrame:
    """Money as double, times as text and lists as comma text, so any engine compares them alike."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DecimalType):
            c = c.cast("double")
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        elif isinstance(f.dataType, T.ArrayType):
            c = F.array_join(c.cast("array<string>"), ",")
        out.append(c.alias(f.name))
    return df.select(*out)


def digest(c):
    return F.md5(F.col(c).cast("binary") if isinstance(c, str) else c.cast("binary"))


# ---- Intake -------------------------------------------------------------------------------
@query
def intake_formats(spark, d):
    rows = intake.intake(fx.manuscripts(spark, d))
    return rows.groupBy("file_format", "supported").agg(
        F.count("*").alias("files"), F.sum("word_count").alias("words"), F.max("word_count").alias("longest"),
        F.sum(F.length("content")).alias("staged_chars"),
    )


@query
def word_counts(spark, d):
    rows = intake.intake(fx.manuscripts(spark, d))
    return rows.select("session_id", "extension", "title", "word_count")


@query
def manuscript_files(spark, d):
    """Words of whole text files: the documents of each source and language are files of a book, written and read back."""
    folder = fresh_dir(spark, "manuscripts")
    docs = table(spark, d, "documents").select("source", "lang", F.translate("text", "\n", " ").alias("value"))
    docs.repartition("source", "lang").write.partitionBy("source", "lang").text(folder)
    rows = manuscripts.read_text(spark, f"{folder}/*/*")
    place = F.regexp_extract("path", r"/source=([^/]*)/lang=([^/]*)/[^/]*$", 0)
    named = rows.select(F.regexp_extract(place, "/source=([^/]*)/", 1).alias("source"), F.regexp_extract(place, "/lang=([^/]*)/", 1).alias("lang"),
                        "size_bytes", word_count("content").alias("words"))
    return named.groupBy("source", "lang").agg(F.sum("size_bytes").alias("size_bytes"), F.sum("words").alias("words"))


@query
def book_word_totals(spark, d):
    return books(spark, d)


@query
def opaque_estimates(spark, d):
    return intake.stored_file_manifest(fx.manuscripts(spark, d))


@query
def docx_bulk_extract(spark, d):
    text = manuscripts.extract_docx(fx.docx_files(spark, d), "bytes")
    return text.select(
        "doc_id", F.length("content").cast("long").alias("chars"), digest("content").alias("content_md5"),
        word_count("content").alias("words"), "error",
    )


def books(spark, d):
    """Books made of all documents of one source or one language."""
    docs = table(spark, d, "documents").select("source", "lang", word_count("text").alias("word_count"))
    return intake.book_totals(docs, "source", "lang")


# ---- Tiers and quotes -----------------------------------------------------------------------
@query
def tier_assign(spark, d):
    return books(spark, d).select("book_id", "words", pricing.tier_of("words").alias("tier"))


@query
def tier_assign_range_join(spark, d):
    rows = fx.order_inputs(spark, d).select("order_id", "word_count")
    return pricing.assign_tier_by_bands(rows, "word_count")


@query
def over_limit_books(spark, d):
    return books(spark, d).filter(pricing.over_limit("words")).select("book_id", "words")


def quoted(spark, d):
    return pricing.quote(fx.order_inputs(spark, d))


@query
def quote_orders(spark, d):
    return quoted(spark, d).select(
        "order_id", "tier", "n_languages", "list_price", "translation_price", "addon_total", "total",
        pricing.over_limit("word_count").alias("over_limit"),
    )


@query
def quote_books(spark, d):
    """Flagship: documents to words to books to tier to price, for one to four languages each."""
    sizes = books(spark, d).withColumnRenamed("words", "word_count")
    each = sizes.withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(4))))
    codes = F.array(*[F.lit(c) for c in fx.LANGUAGE_CODES])
    carts = each.withColumn("languages", F.slice(codes, F.lit(1), F.col("n"))).withColumn("upsells", F.array(F.lit("launch-pack")))
    return pricing.quote(carts).select(
        "book_id", "word_count", "tier", "n_languages", "translation_price", "addon_total", "total"
    )


@query
def addon_totals(spark, d):
    return pricing.addon_sales(fx.order_inputs(spark, d))


@query
def bundle_savings(spark, d):
    return pricing.bundle_savings(quoted(spark, d))


# ---- Vouchers and charges -------------------------------------------------------------------
def charged(spark, d, customers=False):
    return vouchers.apply_voucher(pricing.quote(fx.order_inputs(spark, d, customers)), fx.ORDERS_AS_OF)


@query
def voucher_apply(spark, d):
    answers = vouchers.voucher_answers(charged(spark, d))
    return answers.select(
        "order_id", "valid", "voucher_code", "discount", "discount_kind", "description", "reject_reason",
        "discount_amount", "new_total", "total",
    )


@query
def voucher_request_answers(spark, d):
    """Look-up requests with the orders' codes, some without a subtotal or with a negative one."""
    o = pricing.quote(fx.order_inputs(spark, d))
    subtotal = F.when(F.col("order_id") % 10 == 0, None).when(F.col("order_id") % 10 == 1, -F.col("total")).otherwise(F.col("total"))
    asked = o.select("order_id", F.col("voucher_input").alias("code"), subtotal.cast("decimal(12,2)").alias("subtotal"))
    return vouchers.request_answers(asked, fx.ORDERS_AS_OF).select("order_id", "valid", "voucher_code", "discount_amount", "new_total", "reject_reason")


@query
def voucher_reject_reasons(spark, d):
    return vouchers.reject_report(charged(spark, d))


@query
def voucher_use_limits(spark, d):
    """The same orders with expired and limited codes, redeemed in order of arrival."""
    from foliospark.sources.dimensions import VOUCHERS, vouchers as voucher_table

    rows = [(*v[:4], LIMITS.get(v[0]), EXPIRIES.get(v[0])) for v in VOUCHERS]
    table_ = voucher_table(spark, rows)
    applied = vouchers.apply_voucher(quoted(spark, d), fx.ORDERS_AS_OF, vouchers=table_)
    limited = vouchers.enforce_max_uses(applied, table_, "order_id", "created_at")
    return limited.select("order_id", "voucher_code", "reject_reason", "discount_amount", "shown_total", "charged_cents")


# Use limits and expiry dates put on the built-in codes for ``voucher_use_limits``.
LIMITS = {"LAUNCH20": 500, "BETA95": 0}
EXPIRIES = {"FRIEND10": fx.dt.datetime(1997, 1, 1), "AUTHOR25": fx.dt.datetime(2000, 1, 1)}


@query
def charge_lines(spark, d):
    lines = vouchers.charge_lines(charged(spark, d, customers=True))
    meta = [F.col(f"metadata.{m}").alias(f"m_{m}") for m in ("wordCount", "selectedLanguages", "selectedUpsells", "originalAmount", "voucherCode", "finalAmount")]
    return lines.select(
        "order_id", "email", "line_name", "line_description", "charged_cents", "quantity", "currency", *meta
    )


@query
def price_catalogue(spark, d):
    return pricing.price_points(charged(spark, d))


@query
def shown_vs_charged(spark, d):
    """Orders whose shown total and charged amount differ."""
    rows = charged(spark, d)
    return rows.filter(F.col("shown_total") != F.col("charged_total")).select(
        "order_id", "total", "voucher_code", "discount_amount", "shown_total", "charged_total", "charged_cents"
    )


@query
def checkout_requests(spark, d):
    rows = checkout.checkout(fx.cart_bodies(spark, d), fx.ORDERS_AS_OF)
    return rows.select("order_id", "line_name", "line_description", "total", "quoted_total", "total_differs", "voucher_code", "charged_cents")


@query
def checkout_rejects(spark, d):
    rows = checkout.typed_carts(fx.cart_bodies(spark, d))
    return rows.groupBy(F.coalesce("reason", F.lit("usable")).alias("reason")).agg(F.count("*").alias("carts"))


# ---- Payments ---------------------------------------------------------------------------------
def typed_events(spark, d):
    return payments.typed_events(fx.payment_bodies(table(spark, d, "events")))


ORDER_OUT = (
    "order_id", "payment_session_id", "email", "author_name", "book_title", "word_count", "tier", "file_format",
    "languages", "genre", "upsells", "special_instructions", "amount_paid", "voucher_code", "original_amount",
    "status", "created_at",
)


@query
def payment_events_to_orders(spark, d):
    orders = payments.first_delivery(payments.paid_orders(typed_events(spark, d)))
    return orders.select(*ORDER_OUT, "deliveries", F.col("delivered_at").cast("timestamp_ntz").alias("delivered_at"))


@query
def rejected_events(spark, d):
    return payments.rejected(typed_events(spark, d))


@query
def rejected_events_from_files(spark, d):
    """The bodies written to text files, one per line, and read back."""
    folder = fresh_dir(spark, "bodies")
    fx.payment_bodies(table(spark, d, "events")).select("body").write.text(folder)
    return payments.rejected(payments.typed_events(read_bodies(spark, folder)))


EVENTS_DDL = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def event_stream(spark, d) -> DataFrame:
    # As a pattern the path may be one file or a folder of files.
    return spark.readStream.schema(EVENTS_DDL).parquet(f"{d}/events[.]parquet")


EVENTS_A_FILE = 50_000  # behind a file of bodies, about


def run_payment_stream(spark, d) -> str:
    """Run the payment stream over the whole events table, in four out-of-order micro-batches; return the folder it wrote."""
    folder = fresh_dir(spark, "payments")
    payment_stream.prepare(spark, folder)
    # The newest events come first, and each event's deliveries lie in several files. Only the narrow events are
    # shuffled, to files of about the same number of rows, so that no task holds or sorts a share of all bodies.
    events = table(spark, d, "events")
    files = 2 * (1 + events.count() // EVENTS_A_FILE)
    bodies = fx.payment_bodies(events.repartitionByRange(files, F.desc("ts")))
    late = F.pmod(F.xxhash64("body", "delivered_at"), F.lit(2))
    for part in range(2):  # one write after another: files are taken in the order of their times
        bodies.filter(late == part).write.parquet(f"{folder}/bodies/part={part}")
    found = len(spark.read.parquet(f"{folder}/bodies").inputFiles())
    stream = spark.readStream.schema("body string, delivered_at timestamp").option("maxFilesPerTrigger", -(-found // 4)).parquet(f"{folder}/bodies/part=*")
    payment_stream.start(stream, folder, f"{folder}/checkpoint", available_now=True).awaitTermination()
    return folder


@query
def orders_stream(spark, d):
    return payment_stream.stored_orders(spark, run_payment_stream(spark, d)).select(*ORDER_OUT)


@query
def pending_work_stream(spark, d):
    work = payment_stream.stored_work(spark, run_payment_stream(spark, d))
    return work.select("order_id", "language", "position", "reason")


# ---- Requests and model passes ------------------------------------------------------------------
def work(spark, d):
    orders = fx.order_inputs(spark, d, customers=True)
    done = fx.file_rows(spark, d).select("order_id", "language")
    return requests.work_per_order(orders, fx.originals(spark, d), done)


@query
def pending_languages(spark, d):
    return requests.pending_languages(work(spark, d)).select("order_id", "language", "position")


@query
def unknown_languages(spark, d):
    """Codes no one translates, beside known ones in every thirteenth order."""
    orders = fx.order_inputs(spark, d, customers=True)
    some = F.when(F.col("order_id") % 13 == 0, F.concat("languages", F.array(F.lit("xx")))).otherwise(F.col("languages"))
    done = fx.file_rows(spark, d).select("order_id", "language")
    return requests.unknown_languages(requests.work_per_order(orders.withColumn("languages", some), fx.originals(spark, d), done))


@query
def request_blockers(spark, d):
    return work(spark, d).filter(F.col("reason").isNotNull()).select("order_id", "reason")


@query
def translation_requests(spark, d):
    rows = requests.translation_requests(work(spark, d), fx.originals(spark, d))
    return rows.select(
        "order_id", "language", "position", F.length("request").cast("long").alias("request_chars"), digest("request").alias("request_md5")
    )


@query
def windowed_requests(spark, d):
    rows = requests.translation_requests(work(spark, d), fx.originals(spark, d), requests.WINDOWED)
    return rows.select(
        "order_id", "language", "part", F.length("request").cast("long").alias("request_chars"), digest("request").alias("request_md5")
    )


def first_pass(spark, d):
    """A stand-in first pass over every pending language: the manuscript in brackets."""
    ready = requests.with_text(work(spark, d), fx.originals(spark, d))
    return ready.select("original_id", F.explode("pending").alias("language"), F.concat(F.lit("<"), "content", F.lit(">")).alias("translated"))


@query
def editorial_requests(spark, d):
    rows = requests.editorial_requests(work(spark, d), fx.originals(spark, d), first_pass(spark, d))
    return rows.select(
        "order_id", "language", F.length("request").cast("long").alias("request_chars"), digest("request").alias("request_md5")
    )


def longer_first_pass(spark, d):
    """A stand-in first pass that makes every line longer, so that both texts drift apart."""
    ready = requests.with_text(work(spark, d), fx.originals(spark, d))
    longer = F.regexp_replace("content", r"([^\n]+)", "«$1»")
    return ready.select("original_id", F.explode("pending").alias("language"), longer.alias("translated"))


@query
def windowed_reviews(spark, d):
    """The second pass in windows: original and translation cut between paragraphs that belong together."""
    rows = requests.editorial_requests(work(spark, d), fx.originals(spark, d), longer_first_pass(spark, d), requests.WINDOWED)
    return rows.select(
        "order_id", "language", "part", F.length("translated").cast("long").alias("translated_chars"), digest("request").alias("request_md5")
    )


def stub_translate(batch: pd.DataFrame) -> list:
    """Deterministic stand-in for a model: the request in brackets."""
    return [[{"type": "text", "text": f"<{text}>"}] for text in batch["request"]]


def stub_edit(batch: pd.DataFrame) -> list:
    """Deterministic stand-in for an editor: a mark in front of the answer, or a non-text block."""
    return [
        [{"type": "text", "text": f"[[ORIGINAL: old]]new {len(text)}"}] if language != "pt" else [{"type": "image", "text": None}]
        for text, language in zip(batch["request"], batch["language"])
    ]


@query
def two_pass_inference(spark, d):
    orders = fx.order_inputs(spark, d, customers=True)
    folder = fresh_dir(spark, "inference")
    inference.run_two_pass(orders, fx.originals(spark, d), folder, stub_translate, stub_edit)
    # The same call again finds everything stored and asks for nothing.
    files = inference.run_two_pass(orders, fx.originals(spark, d), folder, stub_translate, stub_edit)
    return files.select(
        "order_id", "language", digest("original_content").alias("translated_md5"),
        F.when(F.col("language") != "pt", F.col("content")).alias("edited"),
        (F.col("content") == F.col("original_content")).alias("first_pass_kept"), "empty_translation",
    )


# ---- Editorial answers ----------------------------------------------------------------------------
def parsed_answers(spark, d):
    return editorial.parse_editorial(fx.editorial_answers(spark, d))


@query
def editorial_json_parse(spark, d):
    return parsed_answers(spark, d).select(
        "conv_id", "turn", "parsed", digest("edited").alias("edited_md5"), F.size("changes").cast("long").alias("n_changes")
    )


@query
def change_counts(spark, d):
    return editorial.change_counts(parsed_answers(spark, d), "language")


@query
def improvement_notices(spark, d):
    rows = parsed_answers(spark, d).withColumn("order_id", F.concat_ws("-", "conv_id", "turn"))
    return outbox.improvement_notices(rows)


@query
def order_improvement_notices(spark, d):
    """One notice per conversation that is an order: every turn is a part of one of its languages."""
    parts = parsed_answers(spark, d).withColumn("order_id", F.col("conv_id")).withColumn("language", fx.pick(fx.LANGUAGE_CODES, F.col("turn") % 4))
    rows = outbox.order_improvement_notices(fx.order_inputs(spark, d, customers=True), parts, SITE)
    urls = F.array_join(F.transform("links", lambda x: F.concat(x["language"], F.lit("="), x["url"])), ";")
    return rows.withColumn("links", urls)


@query
def mark_spans(spark, d):
    rows = editorial.mark_spans(fx.marked_texts(spark, d), "text")
    return rows.select("doc_id", "n_spans", "marked_chars", "published_chars", digest(F.array_join("spans", "|")).alias("spans_md5"))


@query
def final_text(spark, d):
    rows = editorial.mark_spans(fx.marked_texts(spark, d), "text")
    return rows.select("doc_id", digest("published").alias("published_md5"), F.length("text").cast("long").alias("marked_length"))


@query
def structure_check(spark, d):
    rows = editorial.structure_check(fx.reformatted_texts(spark, d), "original", "translated")
    return rows.drop("original", "translated")


@query
def structure_losses(spark, d):
    return editorial.structure_losses(fx.restructured_texts(spark, d), "original", "translated", "doc_id")


@query
def results_by_order(spark, d):
    grouped = editorial.results_by_order(fx.file_rows(spark, d))
    pick = [F.try_element_at("results", F.lit(c))["file_id"].alias(f"file_{c}") for c in fx.LANGUAGE_CODES]
    copies = F.aggregate(F.map_values("results"), F.lit(0).cast("long"), lambda a, r: a + r["copies"])
    return grouped.select("order_id", F.size("results").cast("long").alias("languages"), copies.alias("files"), *pick)


# ---- Staged uploads and retention -------------------------------------------------------------------
def uploads(spark, d):
    return fx.upload_log(table(spark, d, "events"))


@query
def staged_upsert(spark, d):
    return retention.latest_upload(uploads(spark, d))


@query
def staged_stream(spark, d):
    """The streaming form of ``staged_upsert``: append-only log per batch, folded on read."""
    folder = fresh_dir(spark, "staged")
    events = event_stream(spark, d)
    log = fx.upload_log(events).withColumn("created_at", F.col("created_at").cast("timestamp"))
    upload_stream.start(log, f"{folder}/log", f"{folder}/checkpoint", available_now=True, expire=False).awaitTermination()
    rows = upload_stream.staged(spark, f"{folder}/log", expire=False)
    return rows.withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))


@query
def live_uploads_stream(spark, d):
    """Staged uploads of the last day, from a log that was merged and expired while nine micro-batches were added."""
    folder = fresh_dir(spark, "live")
    log = fx.upload_log(table(spark, d, "events")).withColumn("created_at", F.col("created_at").cast("timestamp"))
    log = log.withColumn("part", F.pmod(F.xxhash64("upload_id"), F.lit(9)))
    log.repartition("part").write.partitionBy("part").parquet(f"{folder}/in")
    stream = spark.readStream.schema(upload_stream.STAGED_DDL).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/part=*")
    upload_stream.start(stream, f"{folder}/log", f"{folder}/checkpoint", available_now=True).awaitTermination()
    rows = upload_stream.staged(spark, f"{folder}/log")
    return rows.withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))


@query
def expire_staged(spark, d):
    return retention.without_expired(retention.latest_upload(uploads(spark, d)), fx.UPLOADS_AS_OF)


@query
def promote_originals(spark, d):
    staged = retention.latest_upload(uploads(spark, d)).drop("writes")
    rows = retention.promote(staged, fx.order_inputs(spark, d).select("order_id", "upload_session_id"))
    return rows.select("order_id", "upload_session_id", "upload_id", "type", "language", "file_name", "file_format", "word_count", "uploaded_at")


@query
def retention_due(spark, d):
    rows = retention.retention_due(fx.order_inputs(spark, d), fx.ORDERS_AS_OF)
    return rows.select("order_id", "links_until", "files_until", "links_expired", "files_due")


# ---- Status ---------------------------------------------------------------------------------------
@query
def order_status_latest(spark, d):
    return status.latest_status(fx.status_log(spark, d))


@query
def status_transitions(spark, d):
    rows = status.transitions(fx.status_log(spark, d))
    return rows.select("order_id", "change_id", "previous", "status", "legal")


@query
def illegal_transitions(spark, d):
    return status.illegal_transitions(fx.status_log(spark, d))


@query
def status_with_timeouts(spark, d):
    """The log up to a date, with orders that stood still for a day as failed."""
    return status.with_timeouts(fx.status_log(spark, d), fx.STATUS_TIMEOUT, fx.STATUS_AS_OF)


@query
def status_stream(spark, d):
    """The same as a stream over the whole log, in four micro-batches that are out of order by up to twelve hours."""
    folder = fresh_dir(spark, "status")
    status_stream_job.prepare(spark, f"{folder}/steps")
    changes = fx.arriving(fx.status_log(spark, d), "changed_at", "change_id", fx.STATUS_DELAY, 4)
    # A micro-batch takes all files of a part, so every part has as many; each holds some ten thousand rows or more.
    counts = dict(changes.groupBy("part").agg(F.count("*")).collect())
    files = 1 + min(counts.get(part, 0) for part in range(4)) // EVENTS_A_FILE
    for part in range(4):  # one write after another: files are taken in the order of their times
        changes.filter(F.col("part") == part).drop("part").repartition(files, "change_id").write.parquet(f"{folder}/changes/part={part}")
    arrivals = spark.readStream.schema(changes.drop("part").schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/changes/part=*")
    for _ in range(2):  # the second run starts from the checkpoint and adds nothing
        job = status_stream_job.start(arrivals, f"{folder}/steps", f"{folder}/checkpoint", fx.STATUS_TIMEOUT, fx.STATUS_DELAY, available_now=True)
        job.awaitTermination()
    rows = status_stream_job.stored_steps(spark, f"{folder}/steps")
    return rows.withColumn("changed_at", F.col("changed_at").cast("timestamp_ntz"))


@query
def order_progress(spark, d):
    return status.progress(fx.order_inputs(spark, d), fx.file_rows(spark, d))


@query
def status_written(spark, d):
    """Latest state of the log rows that progress writes, as far as an order has started."""
    return status.latest_status(status.status_rows(order_progress(spark, d)))


# ---- Delivery ---------------------------------------------------------------------------------------
def resolved(spark, d):
    orders = retention.kept_orders(fx.order_inputs(spark, d), fx.ORDERS_AS_OF)
    return delivery.resolve(fx.download_requests(spark, d), orders, fx.file_rows(spark, d))


@query
def delivery_resolve(spark, d):
    return resolved(spark, d).select("order_id", "language", "requests", "outcome", "copies", "file_id")


@query
def delivery_manifest(spark, d):
    return delivery.manifest(resolved(spark, d))


@query
def delivered_documents(spark, d):
    """The texts of all files that can be delivered, exported as shards and read back by their places."""
    folder = fresh_dir(spark, "documents")
    texts = delivery.deliver(delivery.manifest(resolved(spark, d)), fx.file_texts(spark, d))
    shards.export(texts, folder, "content", "order_id", "language", "file_name", shard_bytes=1 << 20)
    index = shards.read_index(spark, folder, "order_id bigint, language string, file_name string")
    rows = shards.read_texts(index.repartition("shard").sortWithinPartitions("shard", "start"), folder)
    return rows.select("order_id", "language", "file_name", "bytes", digest("content").alias("content_md5"))


@query
def order_lookup(spark, d):
    orders = retention.kept_orders(fx.order_inputs(spark, d), fx.ORDERS_AS_OF)
    return delivery.lookup_one(fx.download_requests(spark, d), orders, "order_id")


@query
def original_lookup(spark, d):
    """Which orders have exactly one original file, none, or several."""
    return delivery.lookup_one(fx.order_inputs(spark, d), fx.originals(spark, d), "order_id")


@query
def order_references(spark, d):
    return fx.order_inputs(spark, d).select("order_id", delivery.order_reference("payment_session_id").alias("reference"))


# ---- Notices, quality, reports ------------------------------------------------------------------------
@query
def notification_outbox(spark, d):
    rows = outbox.outbox(fx.order_inputs(spark, d, customers=True), ADMIN, SITE)
    urls = F.array_join(F.transform("links", lambda x: F.concat(x["language"], F.lit("="), x["url"])), ";")
    return rows.withColumn("links", urls).drop("tier", "file_format")


def deleted_orders(spark, d):
    orders = fx.order_inputs(spark, d)
    return retention.retention_due(orders, fx.ORDERS_AS_OF).filter("files_due")


@query
def orphan_files(spark, d):
    kept = retention.kept_orders(fx.order_inputs(spark, d), fx.ORDERS_AS_OF)
    return quality.orphan_files(fx.file_rows(spark, d), kept)


@query
def cascade_delete(spark, d):
    return quality.cascade_delete(fx.file_rows(spark, d), deleted_orders(spark, d))


@query
def removed_by_cascade(spark, d):
    rows = quality.removed_by_cascade(fx.file_rows(spark, d), deleted_orders(spark, d))
    return rows.groupBy("language").agg(F.count("*").alias("files"), F.max("created_at").alias("newest"))


@query
def cascade_rewrite(spark, d):
    """What ``cascade_delete`` leaves, from a stored table of which only the files with due orders were written again."""
    folder = fresh_dir(spark, "files")
    rows = fx.file_rows(spark, d)
    clustered.create(rows, folder, "order_id")
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    state, _ = clustered.delete(spark, folder, ddl, "order_id", deleted_orders(spark, d))
    return state.read(spark, ddl)


@query
def dq_orders(spark, d):
    """Quality flags on all order rows; every flag is true somewhere."""
    rows = fx.order_inputs(spark, d, customers=True)
    every = lambda n: F.col("order_id") % n == 0
    some = F.size("languages") > 0
    languages = F.when(every(7), F.concat("languages", "languages")).otherwise(F.col("languages"))
    languages = F.when(every(13) & some, F.concat(languages, F.array(F.lit("xx")))).otherwise(languages)
    rows = (
        rows.withColumn("languages", languages)
        .withColumn("email", F.when(~every(11), F.col("email")))
        .withColumn("book_title", F.when(F.col("priority") != "1-URGENT", F.col("book_title")).otherwise(F.lit("")))
        .withColumn("upsells", F.when(every(17), F.array(F.lit("newsletter"), F.lit("newsletter"))).otherwise(F.array(F.lit("newsletter"))))
        .withColumn("file_format", F.when(every(19), F.lit(".mobi")).otherwise(F.lit(".txt")))
    )
    return quality.check_orders(rows).select(
        "order_id", "no_email", "no_title", "no_language", "repeated_language", "unknown_language",
        "repeated_addon", "bad_format", "failed_checks",
    )


@query
def orders_by_status(spark, d):
    return reports.orders_by_status(fx.order_inputs(spark, d))


def changed_orders(spark, d) -> str:
    """Kept reports after three sets of changes: some orders go on a step, some are deleted; returns their folder."""
    folder = fresh_dir(spark, "kept")
    orders = fx.order_inputs(spark, d).select(*kept.COLUMNS)
    kept.create(orders, folder, 16, RECENT)
    step = F.when(F.col("status") == "pending", "processing").when(F.col("status") == "processing", "completed").otherwise("failed")
    for k in range(3):
        some = orders.filter(F.col("order_id") % 40 == k).withColumn("status", step)
        kept.apply(some.withColumn("deleted", F.col("order_id") % 3 == 0), folder, 16, RECENT)
    return folder


@query
def kept_orders_by_status(spark, d):
    return kept.orders_by_status(spark, changed_orders(spark, d))


@query
def kept_recent_orders(spark, d):
    rows = kept.recent_orders(spark, changed_orders(spark, d), RECENT)
    return rows.select("order_id", "book_title", "status", "amount_paid", "created_at")


@query
def orders_by_email(spark, d):
    return reports.orders_by_email(fx.order_inputs(spark, d, customers=True))


@query
def recent_orders(spark, d):
    rows = reports.recent_orders(fx.order_inputs(spark, d), RECENT)
    return rows.select("order_id", "book_title", "status", "amount_paid", "created_at")


@query
def files_by_type_language(spark, d):
    return reports.files_by_type_language(fx.file_rows(spark, d))


@query
def selection_fold(spark, d):
    return selection.selection_fold(fx.selection_log(spark, d))


# ---- Launch packs ---------------------------------------------------------------------------------------
@query
def strategy_requests(spark, d):
    rows = launch.strategy_requests(fx.strategy_books(spark, d))
    return rows.select("doc_id", "language", "reason", F.length("request").cast("long").alias("request_chars"), digest("request").alias("request_md5"))


def strategies(spark, d):
    return launch.parse_strategies(fx.strategy_answers(spark, d))


@query
def strategy_parse(spark, d):
    s = "strategy."
    return strategies(spark, d).select(
        "doc_id", "reason", F.size(s + "backendKeywords").alias("boxes"), F.size(s + "adKeywords").alias("ad_keywords"),
        F.size(s + "categories").alias("categories"), F.col(s + "pricingRecommendation.ebook").alias("ebook"),
        digest(F.col(s + "bookDescription")).alias("description_md5"),
    )


@query
def strategy_contract(spark, d):
    return launch.contract(strategies(spark, d)).drop(
        "language", "book_title", "author_name", "genre", "book_description", "answer", "strategy"
    )


@query
def strategy_render(spark, d):
    rows = launch.render(strategies(spark, d), BRAND)
    return rows.select("doc_id", "language", "reason", F.length("document").cast("long").alias("document_chars"), digest("document").alias("document_md5"))
