"""What keeps the cost of a row, and the memory of a task, the same however large the tables are."""

import datetime as dt
import json
import os
from types import SimpleNamespace

import pandas as pd
from pyspark.sql import Row
from pyspark.sql import functions as F

from foliospark.functions import alignment
from foliospark.operators import inference, payments, status
from foliospark.operators import requests as rq
from foliospark.plans import fixtures as fx
from foliospark.plans import queries
from foliospark.sinks import clustered
from foliospark.sources import manuscripts
from foliospark.sources.tables import table
from foliospark.streaming import payments as payment_stream
from foliospark.streaming import status as status_stream


def test_files_of_a_clustered_table_are_told_apart_without_work_per_row(spark, folder, monkeypatch):
    kind, plans = type(spark.range(0)), []
    read = kind.collect
    monkeypatch.setattr(kind, "collect", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or read(df))
    rows = spark.range(4000).selectExpr("id as order_id", "cast(id as string) as name").repartition(4)
    clustered.create(rows, folder, "order_id")
    due = spark.range(7, 4000, 900).withColumnRenamed("id", "order_id")
    state, written = clustered.delete(spark, folder, "order_id bigint, name string", "order_id", due)
    assert written and all(p.startswith("data/") and p.count("/") == 2 for p in written)
    assert state.read(spark, "order_id bigint, name string").count() == 4000 - due.count()
    assert any("file_path" in p for p in plans) and not any("regexp" in p for p in plans)


def test_bodies_of_the_payment_stream_lie_in_files_of_bounded_size(spark, small, monkeypatch):
    monkeypatch.setattr(queries, "EVENTS_A_FILE", 100, raising=False)
    folder, events = queries.run_payment_stream(spark, small), table(spark, small, "events")
    bodies = spark.read.parquet(f"{folder}/bodies")
    assert sorted(bodies.select("body").collect()) == sorted(fx.payment_bodies(events).select("body").collect())
    assert len(bodies.inputFiles()) > events.count() // 100
    assert len([f for f in os.listdir(f"{folder}/checkpoint/commits") if f.isdigit()]) == 4
    want = {r.payment_session_id for r in payments.paid_orders(payments.typed_events(fx.payment_bodies(events))).collect()}
    assert sorted(r.payment_session_id for r in payment_stream.stored_orders(spark, folder).collect()) == sorted(want)


def test_texts_that_pair_one_by_one_take_no_table(monkeypatch):
    """Equal texts, blank lines lost, a mark on every line, every line made a list item."""
    lengths = [40 + 7 * i % 90 for i in range(400)]
    cases = [(lengths, [0] * 400), ([n + 2 for n in lengths], [0] * 400), ([n + 2 for n in lengths], [2] * 400)]
    want = [(i, i + 1, i, i + 1) for i in range(400)]
    with monkeypatch.context() as without:
        without.setattr(alignment, "straight", lambda a, b, ratio: False, raising=False)
        assert all(alignment.align(lengths, [0] * 400, *case) == want for case in cases)
    monkeypatch.setattr(alignment, "sweep", None)
    assert all(alignment.align(lengths, [0] * 400, *case) == want for case in cases)


def test_word_files_are_read_in_shares(monkeypatch):
    monkeypatch.setattr(manuscripts, "HELD", 10, raising=False)
    batch = pd.DataFrame({"id": range(6), "bytes": [b"x" * 4, b"y" * 5, None, b"", b"z" * 30, b"w" * 3]})
    parts = list(manuscripts.shares(batch, "bytes"))
    assert [list(p.id) for p in parts] == [[0, 1, 2, 3], [4], [5]] and list(manuscripts.shares(batch[:0], "bytes")) == []


class Held:
    """State of one lane in memory; counts the calls to it."""

    calls = 0

    def __init__(self):
        self.rows, self.timers = [], set()

    def getListState(self, name, ddl):
        return type(self)()

    getValueState = getListState

    def __getattribute__(self, name):
        if name in ("exists", "get", "put", "update", "appendList", "clear", "registerTimer", "deleteTimer"):
            Held.calls += 1
        return object.__getattribute__(self, name)

    exists = lambda self: bool(self.rows)
    clear = lambda self: setattr(self, "rows", [])
    put = lambda self, rows: setattr(self, "rows", list(rows))
    update = lambda self, row: setattr(self, "rows", row)
    get = lambda self: self.rows
    appendList = lambda self, rows: self.rows.extend(rows)
    registerTimer = lambda self, at: self.timers.add(at)
    deleteTimer = lambda self, at: self.timers.remove(at)


def test_status_state_is_called_per_lane_and_not_per_order():
    minute, at = 60_000_000, lambda ms: SimpleNamespace(getCurrentWatermarkInMs=lambda: ms)
    lane, store, key = status_stream.StatusProcessor(dt.timedelta(minutes=5)), Held(), (7,)
    lane.init(store)
    Held.calls, orders = 0, range(9000)
    told = list(lane.handleInputRows(key, iter([Row(order_id=o, at=minute, change_id=o, status="processing") for o in orders]), at(0)))
    late = [Row(order_id=o, at=3 * minute, change_id=10000 + o, status="completed") for o in orders if o % 2]
    told += lane.handleInputRows(key, iter(late), at(0))
    assert not told and store.timers == {60_000}
    for now in (120_000, 400_000):  # the first changes, the others and the time-outs
        moment, = store.timers
        told = sorted(((r.order_id, r.at, r.status, r.previous, r.cause) for r in lane.handleExpiredTimer(key, at(now), None)), key=str)
        store.timers.discard(moment)
        if now == 120_000:
            assert told == sorted(((o, minute, "processing", None, "change") for o in orders), key=str) and store.timers == {180_000}
    assert told == sorted(((o, 3 * minute, "completed", "processing", "change") if o % 2 else (o, 6 * minute, "failed", "processing", "timeout") for o in orders), key=str)
    assert not store.timers and Held.calls < 40


def test_parts_of_the_status_stream_lie_in_files_of_bounded_size(spark, small, monkeypatch):
    monkeypatch.setattr(queries, "EVENTS_A_FILE", 50)
    seen, start = [], status_stream.start
    monkeypatch.setattr(status_stream, "start", lambda changes, *a, **k: seen.append((changes, a)) or start(changes, *a, **k))
    got = queries.QUERIES["status_stream"](spark, small)
    root = os.path.dirname(seen[0][1][0])
    per_part = [sum(f.endswith(".parquet") for f in os.listdir(f"{root}/changes/part={part}")) for part in range(4)]
    assert per_part[0] > 1 and len(set(per_part)) == 1
    spent = [json.loads(line) for name in os.listdir(f"{root}/checkpoint/offsets") if name.isdigit() for line in open(f"{root}/checkpoint/offsets/{name}").read().split("\n")[2:]]
    assert max(s["logOffset"] for s in spent) == 3
    monkeypatch.setattr(queries, "EVENTS_A_FILE", 1 << 30)
    assert sorted(got.collect(), key=str) == sorted(queries.QUERIES["status_stream"](spark, small).collect(), key=str)


def test_texts_of_a_two_pass_job_move_before_they_are_copied_and_never_for_nothing(spark, small, folder, monkeypatch):
    plans, store = [], inference.answers.store_each
    monkeypatch.setattr(inference.answers, "store_each", lambda rows, *a: plans.append(rows._jdf.queryExecution().optimizedPlan().toString()) or store(rows, *a))
    run = lambda: inference.run_two_pass(fx.order_inputs(spark, small, customers=True), fx.originals(spark, small), folder, queries.stub_translate, queries.stub_edit)
    files = sorted(run().collect())
    assert files and len(plans) == 2
    for plan in plans:  # the dealing in shares lies below the copying per language
        assert 0 < plan.index("Generate") < plan.index("RebalancePartitions")
    again = run()
    assert len(plans) == 2 and sorted(again.collect()) == files
    assert "LeftSemi" not in again._jdf.queryExecution().optimizedPlan().toString()


def test_texts_that_no_one_needs_stay(spark):
    rows = spark.range(20000).selectExpr("id as n", "concat('f', id) as original_id")
    keys = rows.filter("n % 100 = 7").select("original_id")
    left = {r.n for r in rq.marked(rows, keys, "original_id").collect()}
    assert {n for n in range(20000) if n % 100 == 7} <= left and len(left) < 210
    assert rq.marked(rows, keys.limit(0), "original_id").count() == 0


def test_a_part_of_the_status_stream_without_changes_is_a_micro_batch_too(spark, small, monkeypatch):
    """Nothing arrives in the second quarter; parts then have one file each, and no change comes too late."""
    monkeypatch.setattr(queries, "EVENTS_A_FILE", 50)
    quiet = fx.status_log(spark, small).filter("changed_at < timestamp'2024-01-07' or changed_at > timestamp'2024-01-18'")
    monkeypatch.setattr(fx, "status_log", lambda *a: quiet)
    newest = quiet.agg(F.date_trunc("millisecond", F.max("changed_at"))).first()[0]
    want = status.with_timeouts(quiet, fx.STATUS_TIMEOUT, newest - dt.timedelta(hours=12))
    got = queries.QUERIES["status_stream"](spark, small)
    assert sorted(got.collect(), key=str) == sorted(queries.portable(want).select(*got.columns).collect(), key=str)
