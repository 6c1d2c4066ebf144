"""Reports that are kept while orders change: counts, sums, first and last times, and the newest orders.

Orders lie in buckets of a hash of their id. Next to each bucket lie its partial aggregates and its newest orders.
A set of changes reads and writes only the buckets it touches, and a report adds up the partials, which number buckets
times groups whatever the number of orders. As partials are made from the bucket's rows, sums never drift, and a deleted
or changed order that was the first, the last or among the newest is replaced by the next one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliospark.sinks.snapshots import Part, Snapshot, read_parts, snapshot, switch

BUCKETS = 64
NEWEST = 100
ORDER_DDL = "order_id bigint, status string, amount_paid decimal(12,2), created_at timestamp_ntz, book_title string"
COLUMNS = [c.strip().split()[0] for c in ORDER_DDL.replace("(12,2)", "").split(",")]
PARTIAL_DDL = "status string, orders bigint, revenue decimal(22,2), oldest timestamp_ntz, newest timestamp_ntz"


def bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("order_id"), F.lit(buckets)).cast("int")


def sums() -> list[Column]:
    return [F.count("*").alias("orders"), F.sum("amount_paid").alias("revenue"), F.min("created_at").alias("oldest"), F.max("created_at").alias("newest")]


def write_buckets(rows: DataFrame, folder: str, newest: int) -> list[Part]:
    """Store rows with their ``bucket``, and what the reports need of each."""
    spark, parts = rows.sparkSession, []
    place = f"data/{uuid.uuid4().hex}"
    rows.repartition("bucket").write.partitionBy("bucket").parquet(f"{folder}/{place}/orders")
    held = spark.read.schema(f"{ORDER_DDL}, bucket int").parquet(f"{folder}/{place}/orders")
    held.groupBy("bucket", "status").agg(*sums()).repartition("bucket").write.partitionBy("bucket").parquet(f"{folder}/{place}/partials")
    by_age = Window.partitionBy("bucket").orderBy(F.col("created_at").desc(), "order_id")
    top = held.withColumn("n", F.row_number().over(by_age)).filter(F.col("n") <= newest).drop("n")
    top.write.partitionBy("bucket").parquet(f"{folder}/{place}/newest")
    for b in [r.bucket for r in held.select("bucket").distinct().collect()]:  # as many as buckets at most
        parts += [Part(f"{place}/{kind}/bucket={b}", f"{kind}/{b}") for kind in ("orders", "partials", "newest")]
    return parts


def create(orders: DataFrame, folder: str, buckets: int = BUCKETS, newest: int = NEWEST) -> Snapshot:
    """Store orders (order_id unique) and their reports."""
    spark = orders.sparkSession
    return switch(spark, snapshot(spark, folder), write_buckets(orders.select(*COLUMNS, bucket(buckets).alias("bucket")), folder, newest))


def apply(changes: DataFrame, folder: str, buckets: int = BUCKETS, newest: int = NEWEST) -> tuple[Snapshot, list[int]]:
    """Insert, replace or delete orders: rows of ORDER_DDL with ``deleted``, one per order. Returns the state and the touched buckets."""
    spark = changes.sparkSession
    state = snapshot(spark, folder)
    dealt = changes.select(*COLUMNS, "deleted", bucket(buckets).alias("bucket"))
    touched = sorted(r.bucket for r in dealt.select("bucket").distinct().collect())
    if not touched:
        return state, []
    names = {f"{kind}/{b}" for kind in ("orders", "partials", "newest") for b in touched}
    old = read_parts(spark, folder, [p for p in state.parts if p.name in names and p.name.startswith("orders/")], ORDER_DDL)
    stay = old.join(dealt.select("order_id"), "order_id", "left_anti").select(*COLUMNS, bucket(buckets).alias("bucket"))
    new = write_buckets(stay.unionByName(dealt.filter(~F.col("deleted")).drop("deleted")), folder, newest)
    return switch(spark, state, [p for p in state.parts if p.name not in names] + new), touched


def _held(spark: SparkSession, folder: str, kind: str, ddl: str) -> DataFrame:
    state = snapshot(spark, folder)
    return read_parts(spark, folder, [p for p in state.parts if p.name.startswith(kind + "/")], ddl)


def orders_by_status(spark: SparkSession, folder: str) -> DataFrame:
    """As ``reports.orders_by_status`` over all orders, from the partials."""
    partials = _held(spark, folder, "partials", PARTIAL_DDL)
    total = [F.sum("orders").alias("orders"), F.sum("revenue").cast("decimal(22,2)").alias("revenue"), F.min("oldest").alias("oldest"), F.max("newest").alias("newest")]
    return partials.groupBy("status").agg(*total)


def recent_orders(spark: SparkSession, folder: str, k: int = NEWEST) -> DataFrame:
    """The k newest orders, k at most as many as each bucket keeps."""
    return _held(spark, folder, "newest", ORDER_DDL).orderBy(F.col("created_at").desc(), F.col("order_id")).limit(k)
