"""The status stream against its batch fold and against plain Python, under shuffled micro-batches."""

import datetime as dt
import random

import pytest

from foliospark.operators import status
from foliospark.streaming import status as stream

START = dt.datetime(2024, 1, 1)
HOUR = dt.timedelta(hours=1)
DDL = "order_id bigint, status string, changed_at timestamp, change_id bigint"
DELAY = 6 * HOUR


def plain(rows, timeout, until):
    """(order, at, change, previous, status, cause) by walking each order's changes."""
    out, by_order = [], {}
    for order, state, at, change in set(rows):
        if at is not None and at <= until:
            by_order.setdefault(order, []).append((at, change, state))
    for order, own in by_order.items():
        now, since = None, None
        for at, change, state in sorted(own) + [(until + dt.timedelta(microseconds=1), None, None)]:
            if now == "processing" and since + timeout < at:
                out.append((order, since + timeout, None, now, "failed", "timeout"))
                now, since = "failed", since + timeout
            if state is not None:
                out.append((order, at, change, now, state, "change"))
                now, since = state, at
    return sorted(out, key=str)


def told(frame):
    return sorted(((r.order_id, r.changed_at, r.change_id, r.previous, r.status, r.cause) for r in frame.collect()), key=str)


def arrivals(rows, seed, parts):
    """The rows dealt to micro-batches: each arrives up to DELAY after its time, some twice."""
    rng = random.Random(seed)
    late = [(at + rng.random() * DELAY, (order, state, at, change)) for order, state, at, change in rows for _ in range(1 + (rng.random() < 0.2))]
    late.sort(key=lambda r: r[0])
    size = -(-len(late) // parts)
    out = []
    for i in range(0, len(late), size):
        part = [r for _, r in late[i : i + size]]
        rng.shuffle(part)
        out.append(part)
    return out


def run(spark, folder, source, timeout):
    changes = spark.readStream.schema(DDL).option("maxFilesPerTrigger", 1).parquet(f"{source}/*")
    stream.start(changes, f"{folder}/steps", f"{folder}/checkpoint", timeout, f"{DELAY // HOUR} hours", available_now=True).awaitTermination()


def some_log(seed, n):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        order = 0 if rng.random() < 0.34 else rng.randrange(1, 12)  # one order holds a third
        at = START + dt.timedelta(minutes=rng.randrange(0, 6000), microseconds=rng.choice([0, 1, 500, 999999]))
        rows.append((order, rng.choice(["pending", "processing", "processing", "completed", "failed"]), at, i))
    return rows


def test_shuffled_batches(spark, folder):
    rows, timeout = some_log(1, 300), 5 * HOUR
    stream.prepare(spark, f"{folder}/steps")
    for i, part in enumerate(arrivals(rows, 2, 4)):
        spark.createDataFrame(part, DDL).coalesce(1).write.parquet(f"{folder}/in/part={i}")
    run(spark, folder, f"{folder}/in", timeout)
    newest = max(r[2] for r in rows)
    until = newest.replace(microsecond=newest.microsecond // 1000 * 1000) - DELAY
    want = plain(rows, timeout, until)
    got = told(stream.stored_steps(spark, f"{folder}/steps"))
    assert got == want and {"timeout", "change"} == {r[-1] for r in got}
    log = spark.createDataFrame(rows, DDL)
    batch = status.with_timeouts(log, timeout, until)
    assert told(batch) == want
    legal = {(r.previous, r.status): r.legal for r in stream.stored_steps(spark, f"{folder}/steps").collect()}
    assert all(ok == (now in status.LEGAL[before]) for (before, now), ok in legal.items())

    run(spark, folder, f"{folder}/in", timeout)  # again from the checkpoint: nothing new
    assert told(stream.stored_steps(spark, f"{folder}/steps")) == want

    # More changes after a stop: what waited is applied, timers that were set still run.
    more = [(o, s, newest + dt.timedelta(hours=30 + i), 1000 + i) for i, (o, s, _, _) in enumerate(rows[:20])]
    spark.createDataFrame(more, DDL).coalesce(1).write.parquet(f"{folder}/in/part=9")
    run(spark, folder, f"{folder}/in", timeout)
    newest = max(r[2] for r in more)
    until = newest.replace(microsecond=newest.microsecond // 1000 * 1000) - DELAY
    want = plain(rows + more, timeout, until)
    assert told(stream.stored_steps(spark, f"{folder}/steps")) == want


@pytest.mark.parametrize("seed", range(3))
def test_batch_fold(spark, seed):
    rows = some_log(seed, 400) + [(3, "processing", None, 5000), (4, "failed", START, 5001), (4, "failed", START, 5001)]
    for until in (START + dt.timedelta(days=2), START + dt.timedelta(days=9)):
        got = told(status.with_timeouts(spark.createDataFrame(rows, DDL), 3 * HOUR, until))
        assert got == plain(rows, 3 * HOUR, until)


def test_last_moment_is_progress(spark):
    rows = [(1, "processing", START, 1), (1, "completed", START + HOUR, 2), (2, "processing", START, 3), (2, "completed", START + HOUR + dt.timedelta(microseconds=1), 4)]
    got = told(status.with_timeouts(spark.createDataFrame(rows, DDL), HOUR, START + 9 * HOUR))
    assert [r[0] for r in got if r[-1] == "timeout"] == [2]
    assert status.with_timeouts(spark.createDataFrame([], DDL), HOUR, START).collect() == []
