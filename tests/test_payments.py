"""Event parsing rules, and the stream against its batch form."""

import datetime as dt
import json

import pytest

from foliospark.operators import payments
from foliospark.streaming import payments as stream
from foliospark.streaming import uploads

START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
BODIES = "body string, delivered_at timestamp"


def body(n, kind="checkout.session.completed", **changes):
    meta = {
        "authorName": "A", "bookTitle": f"B{n}", "wordCount": "1200", "tier": "small", "fileFormat": ".txt",
        "selectedLanguages": '["fr","es","xx"]', "selectedGenre": "", "selectedUpsells": "", "voucherCode": "",
        "originalAmount": "264.00",
    }
    meta.update(changes.pop("meta", {}))
    obj = {"id": f"cs_{n}", "customer_email": "a@example.com", "amount_total": 26400, "metadata": meta}
    obj.update(changes)
    created = int((START + dt.timedelta(minutes=n)).timestamp())
    return json.dumps({"id": f"evt_{n}", "type": kind, "created": created, "data": {"object": obj}})


def at(minutes):
    return START + dt.timedelta(minutes=minutes)


def test_rules(spark):
    cases = {
        "good": (body(1), None),
        "other": (body(2, "invoice.paid"), "ignored_type"),
        "trailing": (body(3) + "x", "bad_body"),
        "not json": ("hello", "bad_body"),
        "languages": (body(4, meta={"selectedLanguages": "fr,es"}), "bad_languages"),
        "upsells": (body(5, meta={"selectedUpsells": "{"}), "bad_upsells"),
        "words": (body(6, meta={"wordCount": "many"}), "bad_word_count"),
        "session": (body(7, id=None), "no_session"),
        "amount": (body(8, amount_total=None), "no_amount"),
    }
    df = spark.createDataFrame([(k, b) for k, (b, _) in cases.items()], "name string, body string")
    typed = payments.typed_events(df)
    assert {r.name: r.reason for r in typed.collect()} == {k: w for k, (_, w) in cases.items()}
    row = payments.paid_orders(typed).first()
    assert row.languages == ["fr", "es", "xx"] and row.upsells == [] and row.word_count == 1200
    assert str(row.amount_paid) == "264.00" and row.special_instructions is None and row.status == "pending"
    assert {(r.reason, r.events) for r in payments.rejected(typed).collect()} >= {("bad_body", 2), ("ignored_type", 1)}


def test_first_delivery_of_a_hot_session(spark):
    rows = [(body(1), at(5 + i)) for i in range(400)] + [(body(1), at(1))] + [(body(n), at(n)) for n in range(2, 50)]
    typed = payments.typed_events(spark.createDataFrame(rows, BODIES))
    out = {r.payment_session_id: r for r in payments.first_delivery(payments.paid_orders(typed)).collect()}
    assert len(out) == 49
    assert out["cs_1"].deliveries == 401
    assert out["cs_1"].delivered_at.replace(tzinfo=dt.timezone.utc) == at(1)


def feed(spark, folder, name, rows):
    spark.createDataFrame(rows, BODIES).coalesce(1).write.mode("append").parquet(f"{folder}/in/{name}")


def run(spark, folder, checkpoint="checkpoint"):
    bodies = spark.readStream.schema(BODIES).parquet(f"{folder}/in/*")
    job = stream.start(bodies, f"{folder}/out", f"{folder}/{checkpoint}", available_now=True)
    job.awaitTermination()


def test_stream_restart_and_replays(spark, folder):
    stream.prepare(spark, f"{folder}/out")
    feed(spark, folder, "a", [(body(n), at(n)) for n in range(20)] + [(body(3), at(4)), ("junk", at(5))])
    run(spark, folder)
    first = {r.payment_session_id for r in stream.stored_orders(spark, f"{folder}/out").collect()}
    assert first == {f"cs_{n}" for n in range(20)}
    # After a restart: replays inside the watermark, replays long after it, and new orders.
    feed(spark, folder, "b", [(body(19), at(21)), (body(30), at(30)), (body(0), at(60 * 24 * 3))])
    run(spark, folder)
    feed(spark, folder, "c", [(body(5), at(60 * 24 * 9)), (body(31), at(60 * 24 * 9))])
    run(spark, folder)
    orders = stream.stored_orders(spark, f"{folder}/out").collect()
    keys = [r.payment_session_id for r in orders]
    assert len(keys) == len(set(keys)) and set(keys) == {f"cs_{n}" for n in [*range(20), 30, 31]}
    # A lost checkpoint: everything is read again, nothing is stored twice or replaced.
    feed(spark, folder, "d", [(body(40), at(60 * 24 * 9))])
    run(spark, folder, "another")
    keys = [r.payment_session_id for r in stream.stored_orders(spark, f"{folder}/out").collect()]
    assert len(keys) == len(set(keys)) == 23
    work = stream.stored_work(spark, f"{folder}/out").collect()
    assert len(work) == 3 * 23
    assert {(r.language, r.position, r.reason) for r in work} == {("fr", 1, None), ("es", 2, None), ("xx", 3, "unknown_language")}


def test_late_and_repeated_sessions(spark, folder):
    stream.prepare(spark, f"{folder}/out")
    feed(spark, folder, "a", [(body(700), at(720))])
    run(spark, folder)
    # Hours late, another event of a stored session two days on, and events that tell no creation time.
    other = json.loads(body(700)) | {"id": "evt_other", "created": int((START + dt.timedelta(days=2)).timestamp())}
    timeless = [{k: v for k, v in json.loads(body(n)).items() if k != "created"} for n in (900, 900, 901)]
    feed(spark, folder, "b", [(body(1), at(60)), (body(721), at(721)), (json.dumps(other), at(3000))] + [(json.dumps(t), at(3001)) for t in timeless])
    run(spark, folder)
    feed(spark, folder, "c", [(json.dumps(timeless[0]), at(5000)), (body(2), at(1)), (json.dumps(other), at(1))])
    run(spark, folder)
    keys = sorted(r.payment_session_id for r in stream.stored_orders(spark, f"{folder}/out").collect())
    assert keys == sorted(f"cs_{n}" for n in (700, 1, 721, 900, 901, 2))
    assert sorted(r.payment_session_id for r in stream.stored_keys(spark, f"{folder}/out").collect()) == keys


def test_repeated_batch_replaces_itself(spark, folder):
    stream.prepare(spark, f"{folder}/out")
    rows = spark.createDataFrame([(body(n), at(n)) for n in range(5)], BODIES)
    day = payments.F.col("created_at").cast("date")
    batch = payments.paid_orders(payments.typed_events(rows)).withColumn("created_date", day).select(*stream.ORDER_COLUMNS)
    write = stream.batch_writer(f"{folder}/out", "c")
    for _ in range(3):
        write(batch, 0)
    write(batch, 1)
    assert stream.stored_orders(spark, f"{folder}/out").count() == 5
    assert stream.stored_work(spark, f"{folder}/out").count() == 15


@pytest.mark.parametrize("order", [[0, 1, 2], [2, 1, 0]])
def test_staged_uploads_fold(spark, folder, order):
    write = uploads.batch_writer(folder, "c", expire=False)
    ddl = "session_id string, upload_id bigint, created_at timestamp, file_name string, file_format string, word_count bigint"
    for number, k in enumerate(order):
        rows = [("s1", k * 10 + i, at(k * 10 + i), f"f{k}{i}.txt", ".txt", 1) for i in range(3)] + [(f"t{k}", 100 + k, at(0), "x.txt", ".txt", 2)]
        write(spark.createDataFrame(rows, ddl), number)
        write(spark.createDataFrame(rows, ddl), number)
    out = {r.session_id: r.file_name for r in uploads.staged(spark, folder, expire=False).collect()}
    assert out == {"s1": "f22.txt", "t0": "x.txt", "t1": "x.txt", "t2": "x.txt"}
