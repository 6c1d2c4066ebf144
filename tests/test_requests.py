"""Request rows, windows, and the two-pass job with restarts."""

import json
import os
import uuid
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from foliospark.operators import editorial, inference
from foliospark.operators import requests as rq

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the stub models below

ORDERS = """order_id bigint, languages array<string>, genre string, book_title string, author_name string,
special_instructions string"""
ORIGINALS = "file_id string, order_id bigint, file_format string, content string"
LONG = "".join(chr(97 + i % 26) for i in range(120_001))


def tables(spark):
    orders = spark.createDataFrame(
        [
            (1, ["es", "fr"], "", "T1", "A", "Be kind."), (2, ["de"], "Romance", "T2", "A", None), (3, ["es"], None, "T3", "A", ""),
            (4, ["es"], "", "T4", "A", None), (5, [], "", "T5", "A", None), (6, ["xx"], "", "T6", "A", None), (7, ["pt", "xx"], "", "T7", "A", None),
        ],
        ORDERS,
    )
    originals = spark.createDataFrame(
        [
            ("f1", 1, ".txt", "short text"), ("f2", 2, ".txt", LONG), ("f3", 3, ".epub", "[EPUB]"), ("f4a", 4, ".txt", "a"),
            ("f4b", 4, ".txt", "b"), ("f5", 5, ".txt", "t"), ("f6", 6, ".txt", "t"), ("f7", 7, ".txt", "x"),
        ],
        ORIGINALS,
    ).withColumn("has_text", F.length("content") > 0)
    done = spark.createDataFrame([(1, "fr")] * 3, "order_id bigint, language string")
    return orders, originals, done


def test_work(spark):
    orders, originals, done = tables(spark)
    work = {r.order_id: (r.reason, r.pending) for r in rq.work_per_order(orders, originals, done).collect()}
    assert work[1] == (None, ["es"])
    assert work[2] == (None, ["de"])
    assert [work[i][0] for i in (3, 4, 5, 6)] == ["opaque_source", "ambiguous_original", "no_languages", "unknown_language"]
    assert work[7] == (None, ["pt"])


def test_request_slots(spark):
    orders, originals, done = tables(spark)
    rows = {(r.order_id, r.language): r for r in rq.translation_requests(rq.work_per_order(orders, originals, done), originals).collect()}
    assert set(rows) == {(1, "es"), (2, "de"), (7, "pt")}
    text = rows[1, "es"].request
    assert "this general manuscript into Spanish" in text and "Instructions from the author: Be kind." in text
    assert "short text" in text and "Latin America" in text
    assert "Instructions" not in rows[2, "de"].request and LONG in rows[2, "de"].request


def test_windows_cover_everything(spark):
    orders, originals, done = tables(spark)
    work = rq.work_per_order(orders, originals, done)
    parts = [r for r in rq.translation_requests(work, originals, rq.WINDOWED).orderBy("part").collect() if r.order_id == 2]
    sent = [r.request.split("Manuscript:\n")[1].split("\nAnswer with")[0] for r in parts]
    assert [len(s) for s in sent] == [50000, 50000, 20001] and "".join(sent) == LONG
    translated = spark.createDataFrame([("f2", "de", LONG.upper() + "END")], "original_id string, language string, translated string")
    pairs = rq.editorial_requests(work, originals, translated, rq.WINDOWED).orderBy("part").collect()
    assert "".join(r.translated for r in pairs) == LONG.upper() + "END"
    assert "".join(r.request.split("Original:\n")[1].split("\nTranslation:")[0] for r in pairs) == LONG


def bracket(batch):
    return [[{"type": "text", "text": f"<{r.split('Manuscript:')[1].strip().split(chr(10))[0]}>"}] for r in batch["request"]]


def must_not_run(batch):
    raise AssertionError("asked again")


def improve(batch):
    return [[{"type": "text", "text": "[[ORIGINAL: a]]b"}] if lang == "es" else [] for lang in batch["language"]]


def test_two_pass_runs_once(spark, folder):
    orders, originals, _ = tables(spark)
    out = f"{folder}/run"
    files = {(r.order_id, r.language): r for r in inference.run_two_pass(orders, originals, out, bracket, improve).collect()}
    assert set(files) == {(1, "es"), (1, "fr"), (2, "de"), (7, "pt")}
    assert files[1, "es"].content == "[[ORIGINAL: a]]b" and files[1, "es"].original_content == "<short text>"
    assert files[1, "fr"].content == files[1, "fr"].original_content == "<short text>"
    # The same call again asks for nothing and changes nothing.
    again = inference.run_two_pass(orders, originals, out, must_not_run, must_not_run)
    assert inference.failed_requests(spark, out).count() == 0
    assert {(r.order_id, r.language): r for r in again.collect()} == files


def counted(calls, answer, fails=(), how="kill"):
    """A model that notes every request in a file of its own, and fails on some orders' books or takes its process with it."""

    def run(batch):
        out = answer(batch)
        for request in batch["request"]:
            if any(word in request for word in fails):
                if how == "kill":
                    os._exit(1)
                raise RuntimeError("no answer")
        for request in batch["request"]:
            with open(f"{calls}/{uuid.uuid4().hex}", "w") as f:
                f.write(request)
        return out

    return run


@pytest.fixture()
def small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    yield
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "256")


@pytest.mark.parametrize("failing", ["first", "second"])
def test_a_killed_task_loses_its_open_batch_only(spark, folder, small_batches, failing):
    orders, originals, _ = tables(spark)
    calls, again, out = f"{folder}/calls", f"{folder}/again", f"{folder}/run"
    os.mkdir(calls)
    os.mkdir(again)
    word = "Title: T2" if failing == "first" else f"<{LONG[:40]}"
    broken = counted(calls, bracket if failing == "first" else improve, [word])
    first, second = (broken, counted(calls, improve)) if failing == "first" else (counted(calls, bracket), broken)
    with pytest.raises(Exception, match="(?i)crash|exited|worker|EOF"):
        inference.run_two_pass(orders, originals, out, first, second)
    stored = sum(spark.read.parquet(f"{out}/{name}").count() for name in ("translated", "files") if os.path.exists(f"{out}/{name}") and os.listdir(f"{out}/{name}"))
    files = inference.run_two_pass(orders, originals, out, counted(again, bracket), counted(again, improve))
    assert files.count() == 4
    # Four languages, two passes: what had been answered is stored and not asked for again.
    assert len(os.listdir(calls)) == stored and len(os.listdir(again)) == 8 - stored
    assert stored >= (0 if failing == "first" else 4)
    inference.run_two_pass(orders, originals, out, must_not_run, must_not_run).count()
    assert inference.failed_requests(spark, out).count() == 0


def test_a_failed_request_is_a_row_with_its_reason(spark, folder):
    orders, originals, _ = tables(spark)
    out, calls = f"{folder}/run", f"{folder}/calls"
    os.mkdir(calls)
    fails = counted(calls, bracket, ["Title: T2"], "raise")
    files = inference.run_two_pass(orders, originals, out, fails, improve)
    assert {(r.order_id, r.language) for r in files.collect()} == {(1, "es"), (1, "fr"), (7, "pt")}
    failed = inference.failed_requests(spark, out).collect()
    assert [(r["pass"], r.order_id, r.language, r.part, r.reason) for r in failed] == [("translated", 2, "de", 0, "RuntimeError: no answer")]
    files = inference.run_two_pass(orders, originals, out, bracket, improve)
    assert files.count() == 4 and inference.failed_requests(spark, out).count() == 0


def test_a_book_answered_in_part(spark, folder, small_batches):
    """Only the windows that are missing are asked for, and a row stored twice counts once."""
    orders, originals, _ = tables(spark)
    out, calls = f"{folder}/run", f"{folder}/calls"
    os.mkdir(calls)
    only = counted(calls, bracket, ["Manuscript:\n" + LONG[100000:100003]], "raise")  # the last of three windows fails
    inference.run_two_pass(orders, originals, out, only, improve, rq.WINDOWED).count()
    n = len(os.listdir(calls))
    stored = spark.read.parquet(f"{out}/translated").filter("order_id = 2 and error is null")
    assert stored.count() == 2
    stored.coalesce(1).write.mode("append").parquet(f"{out}/translated")
    files = inference.run_two_pass(orders, originals, out, counted(calls, bracket), improve, rq.WINDOWED)
    long = files.filter("order_id = 2").first()
    assert len(os.listdir(calls)) == n + 1
    assert long.original_content == f"<{LONG[:50000]}><{LONG[50000:100000]}><{LONG[100000:]}>"


def test_empty_books_are_not_sent(spark):
    orders, originals, done = tables(spark)
    empty = originals.withColumn("content", F.lit("")).withColumn("has_text", F.lit(False))
    reasons = {r.order_id: r.reason for r in rq.work_per_order(orders, empty, done).collect()}
    assert reasons[1] == reasons[2] == "empty_source" and reasons[3] == "opaque_source"


def test_windowed_two_pass(spark, folder):
    orders, originals, _ = tables(spark)

    def explain(batch):
        answers = []
        for r in batch["request"]:
            part = r.split("Translation:\n")[1].split("\nAnswer with")[0]
            change = {"original": "o", "edited": "e", "reason": "r", "type": "style"}
            answers.append([{"type": "text", "text": json.dumps({"editedText": part + "!", "changes": [change]})}])
        return answers

    files = {(r.order_id, r.language): r for r in inference.run_two_pass(orders, originals, f"{folder}/w", bracket, explain, rq.WINDOWED).collect()}
    long = files[2, "de"]
    assert long.original_content == f"<{LONG[:50000]}><{LONG[50000:100000]}><{LONG[100000:]}>"
    assert long.content.replace("!", "") == long.original_content and len(long.changes) == 5


def test_editorial_fallbacks(spark):
    good = '{"editedText": "new", "changes": [{"original":"a","edited":"b","reason":"c","type":"style"}]}'
    cases = [
        (good, "new", 1), ("text", "old", 0), (good + " bye", "old", 0), ('{"editedText": "", "changes": []}', "old", 0),
        ('{"editedText": "new"}', "new", 0), ('{"editedText": "new", "changes": "x"}', "new", 0), (None, "old", 0),
    ]
    df = spark.createDataFrame([(i, a, "old") for i, (a, _, _) in enumerate(cases)], "i int, answer string, translated string")
    got = {r.i: (r.edited, r.n) for r in editorial.parse_editorial(df).withColumn("n", F.size("changes")).collect()}
    assert got == {i: (e, n) for i, (_, e, n) in enumerate(cases)}


def test_empty_first_pass_is_flagged(spark):
    df = spark.createDataFrame([(1, "es", "", "x"), (2, "es", "t", "x")], "order_id bigint, language string, translated string, edited string")
    rows = inference.finished_files(df.withColumn("changes", F.array()))
    assert {r.order_id: r.empty_translation for r in rows.collect()} == {1: True, 2: False}
