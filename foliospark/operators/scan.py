"""Ordered per-key logic as a two-level prefix scan: no key's history is ever one task's work.

A window partitioned by the key alone sorts all rows of a key in a single task. Here the log is
range-partitioned by (key, order), so that a hot key spreads over as many ranges as its rows need, even
if all of them have one time. Windows run inside a range; one summary row per key and range is scanned
per key and carried back. A key has at most as many summary rows as there are ranges, and a range holds a
share of the log whatever its keys. The ranges are stored once, since their borders come from a
sample and rows and summaries must see the same ones; the table also cuts the lineage.

The key columns are compared as one struct, in which nulls are equal: rows without a key are a
group like any other, and often the hottest one. Rows without a time come first. The order columns together
must tell rows of a key apart, else equal rows come in any order and share a range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.session import fresh_dir

KEY, RANGE = "_key", "_range"


def ranged(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The rows with their key struct and range number, from a table in which each range is contiguous in (key, order)."""
    path = fresh_dir(df.sparkSession, "ranges")
    columns = [F.struct(*keys).alias(KEY), *[F.col(c) for c in df.columns]]
    rows = df.select(*columns).repartitionByRange(KEY, *order).withColumn(RANGE, F.spark_partition_id())
    rows.write.parquet(path)
    return df.sparkSession.read.schema(rows.schema).parquet(path)


def carried(rows: DataFrame, summary: dict[str, Column], across: dict[str, Column]) -> DataFrame:
    """One row per key and range: ``summary`` aggregates inside, ``across`` are window columns over the ranges before."""
    per_range = rows.groupBy(KEY, RANGE).agg(*[c.alias(n) for n, c in summary.items()])
    return per_range.select(KEY, RANGE, *[c.alias(n) for n, c in across.items()])


def over_ranges():
    return Window.partitionBy(KEY).orderBy(RANGE)


def lag_by_key(df: DataFrame, keys: list[str], ts: str, tie: str, value: str | list[str], out: str) -> DataFrame:
    """``lag(value)`` over (partition by keys order by ts, tie). Several values come as a struct."""
    rows = ranged(df, keys, [ts, tie])
    held = F.struct(*([value] if isinstance(value, str) else value))
    summary = {"_last": F.max_by(held, F.struct(ts, tie))}
    borders = carried(rows, summary, {"_carried": F.lag("_last").over(over_ranges())})
    inner = Window.partitionBy(KEY, RANGE).orderBy(ts, tie)
    inside = rows.withColumn("_lag", F.lag(held).over(inner)).withColumn("_first", F.row_number().over(inner) == 1)
    both = F.when(F.col("_first"), F.col("_carried")).otherwise(F.col("_lag"))
    both = both[value] if isinstance(value, str) else both
    return inside.join(borders, [KEY, RANGE]).select(*df.columns, both.alias(out))


def rank_by_key(df: DataFrame, keys: list[str], ts: str, tie: str, out: str) -> DataFrame:
    """``row_number()`` over (partition by keys order by ts, tie)."""
    rows = ranged(df, keys, [ts, tie])
    earlier = F.coalesce(F.sum("_n").over(over_ranges().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    borders = carried(rows, {"_n": F.count("*")}, {"_before": earlier})
    inner = Window.partitionBy(KEY, RANGE).orderBy(ts, tie)
    place = (F.row_number().over(inner) + F.col("_before")).cast("long")
    return rows.join(borders, [KEY, RANGE]).select(*df.columns, place.alias(out))


def sum_by_key(df: DataFrame, keys: list[str], ts: str, tie: str, value: str, out: str) -> DataFrame:
    """``sum(value)`` over (partition by keys order by ts, tie), this row included; nulls add nothing."""
    rows = ranged(df, keys, [ts, tie])
    earlier = F.sum("_sum").over(over_ranges().rowsBetween(Window.unboundedPreceding, -1))
    borders = carried(rows, {"_sum": F.sum(value)}, {"_before": earlier})
    inner = Window.partitionBy(KEY, RANGE).orderBy(ts, tie).rowsBetween(Window.unboundedPreceding, 0)
    here = F.sum(value).over(inner)
    total = F.when(F.col("_before").isNull(), here).otherwise(F.col("_before") + F.coalesce(here, F.lit(0)))
    return rows.join(borders, [KEY, RANGE]).select(*df.columns, total.alias(out))
