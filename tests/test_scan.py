"""Prefix scans per key against plain Python, with one key holding a third of the rows."""

import datetime as dt
import random

import pytest

from foliospark.operators import selection, status
from foliospark.operators.scan import RANGE, lag_by_key, rank_by_key, ranged, sum_by_key

START = dt.datetime(2024, 1, 1)


def log(seed, n=900, hot=0):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        key = hot if rng.random() < 0.34 else rng.randrange(1, 40)
        at = START + dt.timedelta(minutes=rng.randrange(0, 3000))
        rows.append((key, i, at, rng.choice(["pending", "processing", "completed", "failed"])))
    return rows


@pytest.mark.parametrize("hot", [0, None])
def test_lag_and_rank(spark, hot):
    rows = log(1, hot=hot)
    df = spark.createDataFrame(rows, "order_id int, change_id int, changed_at timestamp_ntz, status string")
    by_key = {}
    for r in sorted(rows, key=lambda r: (r[2], r[1])):
        by_key.setdefault(r[0], []).append(r)
    lag, rank = {}, {}
    for rs in by_key.values():
        for place, r in enumerate(rs):
            lag[r[1]] = rs[place - 1][3] if place else None
            rank[r[1]] = place + 1
    got = lag_by_key(df, ["order_id"], "changed_at", "change_id", "status", "previous").collect()
    assert {r.change_id: r.previous for r in got} == lag and len(got) == len(rows)
    got = rank_by_key(df, ["order_id"], "changed_at", "change_id", "n").collect()
    assert {r.change_id: r.n for r in got} == rank and len(got) == len(rows)


def test_latest_and_legal(spark):
    rows = [
        (1, 1, START, "pending"), (1, 2, START, "processing"), (1, 3, START + dt.timedelta(days=2), "completed"),
        (2, 4, START, "processing"), (2, 5, START + dt.timedelta(hours=1), "processing"),
    ]
    df = spark.createDataFrame(rows, "order_id int, change_id int, changed_at timestamp_ntz, status string")
    latest = {r.order_id: r for r in status.latest_status(df).collect()}
    assert latest[1].status == "completed" and latest[1].completed_at == rows[2][2]
    assert latest[2].status == "processing" and latest[2].completed_at is None
    legal = {r.change_id: r.legal for r in status.transitions(df).collect()}
    assert legal == {1: True, 2: True, 3: True, 4: False, 5: False}


def fold(rows, items):
    chosen = {}
    for session, item, action, _, _ in sorted(rows, key=lambda r: (r[3], r[4])):
        here = chosen.setdefault(session, set())
        if action == "all":
            here.clear()
            here.update(items)
        elif action == "toggle":
            here ^= {item}
    return {(s, i) for s, items_ in chosen.items() for i in items_}


@pytest.mark.parametrize("seed", range(2))
def test_selection(spark, seed):
    rng = random.Random(seed)
    items = ("es", "fr", "de", "pt")
    rows = []
    for i in range(600):
        session = 0 if rng.random() < 0.34 else rng.randrange(1, 60)
        action = rng.choice(["toggle"] * 6 + ["all", "other"])
        rows.append((session, rng.choice(items), action, START + dt.timedelta(minutes=rng.randrange(400)), i))
    df = spark.createDataFrame(rows, "session_id int, item string, action string, at timestamp_ntz, seq int")
    got = selection.selection_fold(df, items).collect()
    assert {(r.session_id, r.item) for r in got} == fold(rows, items)
    assert len(got) == len(fold(rows, items))


def test_one_key_at_one_time(spark):
    """One key with all rows in one second spreads over the tasks, and nothing changes in the result."""
    rows = [(7, i, START, "pending" if i % 2 else "failed") for i in range(3000)]
    df = spark.createDataFrame(rows, "order_id int, change_id int, changed_at timestamp_ntz, status string").repartition(8)
    got = {r.change_id: r.previous for r in lag_by_key(df, ["order_id"], "changed_at", "change_id", "status", "previous").collect()}
    assert got == {i: rows[i - 1][3] if i else None for i in range(3000)}
    assert sorted(r.n for r in rank_by_key(df, ["order_id"], "changed_at", "change_id", "n").collect()) == list(range(1, 3001))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        shares = [r["count"] for r in ranged(df, ["order_id"], ["changed_at", "change_id"]).groupBy(RANGE).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(shares) == 4 and max(shares) < 1200  # the test session has four shuffle partitions


def test_running_sum(spark):
    rng = random.Random(2)
    rows = [(rng.choice([None, 1, 2]), i, START + dt.timedelta(seconds=rng.randrange(5)), rng.choice([None, 1, 5, -2])) for i in range(500)]
    df = spark.createDataFrame(rows, "k int, i int, at timestamp_ntz, v long").repartition(5)
    want, sums = {}, {}
    for k, i, _, v in sorted(rows, key=lambda r: (r[2], r[1])):
        if v is not None:
            sums[k] = sums.get(k, 0) + v
        want[i] = sums.get(k)
    assert {r.i: r.total for r in sum_by_key(df, ["k"], "at", "i", "v", "total").collect()} == want


def test_lag_of_several_columns_and_an_empty_log(spark):
    rows = [(1, 5, START, "a"), (1, 6, START, "b"), (2, 7, None, "c"), (2, 8, START, None)]
    df = spark.createDataFrame(rows, "order_id int, change_id int, changed_at timestamp_ntz, status string")
    got = {r.change_id: r.before and tuple(r.before) for r in lag_by_key(df, ["order_id"], "changed_at", "change_id", ["status", "change_id"], "before").collect()}
    assert got == {5: None, 6: ("a", 5), 7: None, 8: ("c", 7)}
    assert lag_by_key(df.limit(0), ["order_id"], "changed_at", "change_id", "status", "before").collect() == []
