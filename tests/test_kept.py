"""Deletes that rewrite few files and reports that are kept, against plain Python after random changes."""

import datetime as dt
import os
import random
from decimal import Decimal

from pyspark.sql import functions as F

from foliospark.operators import kept
from foliospark.sinks import clustered
from foliospark.sinks.snapshots import snapshot

FILES = "order_id bigint, file_id string, text string"
START = dt.datetime(2024, 1, 1)


def files(spark, n):
    return spark.range(n).select((F.col("id") % 997).alias("order_id"), F.col("id").cast("string").alias("file_id"), F.lit("x").alias("text"))


def ids(spark, folder, state=None):
    return sorted(int(r.file_id) for r in (state or snapshot(spark, folder)).read(spark, FILES).collect())


def test_deletes_rewrite_the_files_they_touch(spark, folder):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        state = clustered.create(files(spark, 8000), folder, "order_id")
        assert len(state.parts) == 4
        due = spark.createDataFrame([(3,), (5,), (5,), (2000,)], "order_id bigint")
        new, written = clustered.delete(spark, folder, FILES, "order_id", due)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(written) == 1 and {p.path for p in state.parts} - {p.path for p in new.parts} == set(written)
    want = [i for i in range(8000) if i % 997 not in (3, 5)]
    assert ids(spark, folder) == want
    assert ids(spark, folder, state) == list(range(8000))  # a reader that began before
    # Keys inside a range that no row has: nothing is written.
    again, written = clustered.delete(spark, folder, FILES, "order_id", due)
    assert again.version == new.version and written == []
    # All orders of one file, then everything.
    low, high = max((p.bounds["order_id"] for p in again.parts), key=lambda b: b[0])
    clustered.delete(spark, folder, FILES, "order_id", spark.range(low, high + 1).withColumnRenamed("id", "order_id"))
    assert ids(spark, folder) == [i for i in want if not low <= i % 997 <= high]
    clustered.delete(spark, folder, FILES, "order_id", spark.range(2000).withColumnRenamed("id", "order_id"))
    assert ids(spark, folder) == []
    assert clustered.delete(spark, folder, FILES, "order_id", due)[1] == []


def test_empty_clustered_table(spark, folder):
    assert clustered.create(files(spark, 0), folder, "order_id").read(spark, FILES).count() == 0


def plain(orders):
    out = {}
    for status, amount, at, _ in orders.values():
        n, total, low, high = out.get(status, (0, Decimal(0), at, at))
        out[status] = (n + 1, total + amount, min(low, at), max(high, at))
    return out


def test_kept_reports(spark, folder):
    rng = random.Random(11)
    states = ["pending", "processing", "completed", "failed"]
    row = lambda: (rng.choice(states), Decimal(rng.randrange(100, 99999)) / 100, START + dt.timedelta(hours=rng.randrange(500)), "t")
    orders = {i: row() for i in range(400)}
    table = lambda rows, extra="": spark.createDataFrame(rows, f"order_id bigint, status string, amount_paid decimal(12,2), created_at timestamp_ntz, book_title string{extra}")
    kept.create(table([(i, *r) for i, r in orders.items()]), folder, buckets=16, newest=10)
    for step in range(3):
        newest = sorted(orders, key=lambda i: (-orders[i][2].timestamp(), i))[:4]  # the newest ones go, too
        gone = set(rng.sample(sorted(orders), 5)) | set(newest if step < 2 else [])
        other = {i: row() for i in rng.sample(sorted(set(orders) - gone), 4)} | {1000 + step: row()}
        changes = [(i, None, None, None, None, True) for i in gone] + [(i, *r, False) for i, r in other.items()]
        before = {p.name: p.path for p in snapshot(spark, folder).parts}
        state, touched = kept.apply(table(changes, ", deleted boolean"), folder, buckets=16, newest=10)
        for i in gone:
            del orders[i]
        orders |= other
        after = {p.name: p.path for p in state.parts}
        assert all(before[n] == after[n] for n in before if int(n.split("/")[1]) not in touched)
        got = {r.status: (r.orders, r.revenue, r.oldest, r.newest) for r in kept.orders_by_status(spark, folder).collect()}
        assert got == plain(orders)
        top = [r.order_id for r in kept.recent_orders(spark, folder, 10).collect()]
        assert top == sorted(orders, key=lambda i: (-orders[i][2].timestamp(), i))[:10]
    everything = table([(i, None, None, None, None, True) for i in orders], ", deleted boolean")
    kept.apply(everything, folder, buckets=16, newest=10)
    assert kept.orders_by_status(spark, folder).count() == 0 and kept.recent_orders(spark, folder).count() == 0
    assert kept.apply(everything.limit(0), folder, buckets=16)[1] == []
    assert len(os.listdir(f"{folder}/manifests")) >= 4
