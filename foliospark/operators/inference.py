"""Two-pass batch inference with a function the caller supplies.

The function gets a pandas DataFrame of requests and returns one list of answer blocks per row
(``[{"type": "text", "text": ...}]``). Spark partitions and retries the work. Answers are kept by order,
language and part as soon as a batch has them, so a job that is started again sends only what is missing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.operators import requests as rq
from foliospark.operators.editorial import CHANGE, parse_editorial
from foliospark.sinks import answers
from foliospark.sources.dimensions import LANGUAGE_CODES

ModelFn = Callable[[pd.DataFrame], list]
BLOCKS = "array<struct<type:string,text:string>>"
KEYS = ("order_id", "language", "part")
DONE_KEY = ("order_id", "language")
SHARE = 8 << 20  # bytes of texts that a task gets, about
ADVISORY = "spark.sql.adaptive.advisoryPartitionSizeInBytes"


def one_by_one(batch: pd.DataFrame, fn: ModelFn) -> Iterator[tuple[list | None, str | None]]:
    for at in range(len(batch)):
        try:
            yield list(fn(batch.iloc[at : at + 1]))[0], None
        except Exception as problem:
            yield None, f"{type(problem).__name__}: {problem}"


def answered(batch: pd.DataFrame, fn: ModelFn) -> pd.DataFrame:
    """A batch of requests with ``blocks`` and ``error`` instead of the request.

    When the function fails on a batch, its rows are sent one by one, and a row that fails alone has the
    reason and no blocks.
    """
    try:
        pairs = [(blocks, None) for blocks in fn(batch)]
    except Exception:
        pairs = list(one_by_one(batch, fn))
    blocks, errors = zip(*pairs) if pairs else ((), ())
    return batch.drop(columns="request").assign(blocks=list(blocks), error=list(errors))


def ask_and_store(requests: DataFrame, fn: ModelFn, path: str, carry: tuple[str, ...], ddl: str, share: int) -> int:
    """Send requests and store each batch of answers when it is there.

    The texts behind the requests are dealt in ``share``s by ``spread``. A text that is needed next to the answer is carried
    through instead of being joined back, which would shuffle it again.
    """
    spark = requests.sparkSession
    before = spark.conf.get(ADVISORY)
    spark.conf.set(ADVISORY, str(share))  # what the rebalance of the texts cuts and packs by
    try:
        sent = requests.select(*KEYS, "parts", *carry, "request")
        return answers.store_each(sent, lambda batch: answered(batch, fn), path, ddl)
    finally:
        spark.conf.set(ADVISORY, before)


def spread(texts: DataFrame) -> DataFrame:
    """Texts in shares of about equal bytes. Requests hold a text once per language or twice, so they are made after this."""
    return texts.hint("rebalance")


def nothing_to_send(work: DataFrame, stored: DataFrame) -> bool:
    """Whether all is stored, as narrow keys tell, so that no text has to move to find that out."""
    return not stored.isEmpty() and work.filter(F.col("reason").isNull()).isEmpty()


def first_text(blocks: Column | str, otherwise: Column) -> Column:
    """Text of the first block when it is a text block."""
    blocks = F.col(blocks) if isinstance(blocks, str) else blocks
    first = F.get(blocks, F.lit(0))
    return F.when(first["type"] == "text", first["text"]).otherwise(otherwise)


def join_parts(answers: DataFrame, text: str) -> DataFrame:
    """Concatenate the parts of one order and language in order.

    A group holds one book: its windows, never other rows, since (order, language, part) is unique.
    """
    ordered = F.array_sort(F.collect_list(F.struct("part", text)))
    return answers.groupBy("order_id", "original_id", "language").agg(
        F.array_join(F.transform(ordered, lambda p: p[text]), "").alias(text)
    )


def edited(answered: DataFrame, style: rq.RequestStyle = rq.WHOLE) -> DataFrame:
    """Second pass: order_id, language, translated, edited, changes.

    A whole-text answer is the edited text itself. A windowed answer is JSON per part; its parts
    are put back together in order. Without a usable answer the first pass stands.
    """
    rows = answered.withColumn("answer", first_text("blocks", F.lit(None).cast("string")))
    if style.review_window is None:
        text = F.coalesce("answer", "translated")
        none = F.array().cast(f"array<{CHANGE}>")
        return rows.select("order_id", "language", "translated", text.alias("edited"), none.alias("changes"))
    parsed = parse_editorial(rows)
    ordered = F.array_sort(F.collect_list(F.struct("part", "translated", "edited", "changes")))
    together = parsed.groupBy("order_id", "language").agg(ordered.alias("_p"))
    return together.select(
        "order_id",
        "language",
        F.array_join(F.transform("_p", lambda p: p["translated"]), "").alias("translated"),
        F.array_join(F.transform("_p", lambda p: p["edited"]), "").alias("edited"),
        F.flatten(F.transform("_p", lambda p: p["changes"])).alias("changes"),
    )


def finished_files(edited: DataFrame) -> DataFrame:
    """Result rows of the file table, flagged when the first pass came back empty."""
    key = F.concat(F.col("order_id").cast("string"), F.lit("/"), F.col("language"))
    return edited.select(
        F.substring(F.sha2(key.cast("binary"), 256), 1, 32).alias("file_id"),
        "order_id",
        F.lit("translated").alias("type"),
        "language",
        F.col("edited").alias("content"),
        F.col("translated").alias("original_content"),
        "changes",
        (F.length("translated") == 0).alias("empty_translation"),
    )


def whole_books(stored: DataFrame) -> DataFrame:
    """(order_id, language) whose parts are all stored."""
    counted = stored.groupBy(*DONE_KEY).agg(F.count("*").alias("n"), F.max("parts").alias("parts"))
    return counted.filter(F.col("n") >= F.col("parts")).select(*DONE_KEY)


def of_whole_books(stored: DataFrame) -> DataFrame:
    """Rows of books whose parts are all stored. Few books are stored in part, so those are taken out and no text moves for the others."""
    counted = stored.groupBy(*DONE_KEY).agg(F.count("*").alias("n"), F.max("parts").alias("parts"))
    partly = counted.filter(F.col("n") < F.col("parts")).select(*DONE_KEY)
    n = partly.count()
    if not n:
        return stored
    return stored.join(F.broadcast(partly) if n <= answers.FEW else partly, list(DONE_KEY), "left_anti")


def without_stored(requests: DataFrame, stored: DataFrame) -> DataFrame:
    """Requests whose answers are not stored; narrow keys tell, and only where a book is answered in part."""
    have = stored.select("order_id", "language", "part").join(whole_books(stored), list(DONE_KEY), "left_anti")
    have = have.groupBy(*DONE_KEY).agg(F.collect_set("part").alias("_have"))
    if have.isEmpty():
        return requests
    return requests.join(have, list(DONE_KEY), "left").filter(~F.coalesce(F.array_contains("_have", F.col("part")), F.lit(False))).drop("_have")


def run_two_pass(
    orders: DataFrame,
    originals: DataFrame,
    folder: str,
    translate_fn: ModelFn,
    edit_fn: ModelFn,
    style: rq.RequestStyle = rq.WHOLE,
    share: int = SHARE,
) -> DataFrame:
    """Translate and edit everything not yet in ``folder``; return the file table of finished books.

    Each pass reads the manuscripts' texts once and moves those it may need twice: to their orders and in even shares. Answers are stored batch by batch by the tasks themselves, so a call that
    breaks off loses the open batches at most, and the same call again asks only for what is not stored. A request
    that the model fails on is a row with its reason (``failed_requests``) and is asked again by the next call.
    """
    spark = orders.sparkSession
    id_type = orders.schema["order_id"].dataType.simpleString()
    file_type = originals.schema["file_id"].dataType.simpleString()
    keys = f"order_id {id_type}, language string, part bigint, parts bigint"
    one = f"{keys}, original_id {file_type}, blocks {BLOCKS}, error string"
    two = f"{keys}, translated string, blocks {BLOCKS}, error string"
    read = lambda name, ddl: answers.read(spark, f"{folder}/{name}", ddl, KEYS, "error")

    stored = read("translated", one)
    work = rq.work_per_order(orders, originals, whole_books(stored))
    if not nothing_to_send(work, stored):
        requests = without_stored(rq.translation_parts(spread(rq.with_text(work, originals)), style), stored)
        ask_and_store(requests, translate_fn, f"{folder}/translated", ("original_id",), one, share // len(LANGUAGE_CODES))

    stored = read("translated", one)
    first = of_whole_books(stored).withColumn("translated", first_text("blocks", F.lit("")))
    first = first.select("order_id", "original_id", "language", "translated") if style.translate_window is None else join_parts(first, "translated")
    stored = read("files", two)
    work = rq.work_per_order(orders, originals, whole_books(stored))
    if not nothing_to_send(work, stored):
        requests = without_stored(rq.editorial_parts(spread(rq.with_translations(work, originals, first)), style), stored)
        ask_and_store(requests, edit_fn, f"{folder}/files", ("translated",), two, share)

    stored = read("files", two)
    return finished_files(edited(of_whole_books(stored), style))


def failed_requests(spark: SparkSession, folder: str, id_type: str = "bigint") -> DataFrame:
    """(pass, order_id, language, part, reason) of requests the model failed on and that no later call has answered."""
    out = None
    ddl = f"order_id {id_type}, language string, part bigint, error string"
    for name in ("translated", "files"):
        rows = spark.read.schema(ddl).parquet(f"{folder}/{name}")
        per = rows.groupBy(*KEYS).agg(F.max("error").alias("reason"), F.count(F.when(F.col("error").isNull(), 1)).alias("_ok")).filter("_ok = 0").drop("_ok")
        per = per.select(F.lit(name).alias("pass"), *KEYS, "reason")
        out = per if out is None else out.unionByName(per)
    return out
