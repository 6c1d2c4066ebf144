"""Re-runnable Parquet writers: one folder per run or micro-batch, replaced as a whole.

Writing run or batch N again replaces exactly what its first attempt left, so a retry after a lost
executor or driver never duplicates rows. Plain Parquet has no row updates; a changed row is a new
row, and readers fold by key.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ensure(spark: SparkSession, folder: str, ddl: str, by: str = "run_id", partition_by: tuple[str, ...] = ()) -> None:
    """Create an empty table, as run 0, so that the first read finds the folder."""
    write_run(spark.createDataFrame([], ddl), folder, 0, by, partition_by)


def batch_number(checkpoint: str, batch_id: int) -> str:
    """Folder name of a micro-batch. Batches count from zero for every checkpoint, so the name also has
    the digest of the checkpoint's name: a stream started over with a new one replaces nothing."""
    return f"{hashlib.sha256(checkpoint.rstrip('/').encode()).hexdigest()}-{batch_id + 1}"


def write_run(rows: DataFrame, folder: str, run_id: int | str, by: str = "run_id", partition_by: tuple[str, ...] = ()) -> None:
    """Replace one run's folder. Partitioned rows are rebalanced first: small partition values share
    a task and large ones are split, so neither tiny files nor one overloaded task come out."""
    if partition_by:
        rows = rows.hint("rebalance", *[F.col(c) for c in partition_by])
    rows.write.mode("overwrite").partitionBy(*partition_by).parquet(f"{folder}/{by}={run_id}")


def read(spark: SparkSession, folder: str, ddl: str, by: str = "run_id", keep: bool = False) -> DataFrame:
    """Read all runs with an explicit schema; ``keep`` also returns the run or batch number."""
    rows = spark.read.schema(f"{ddl}, {by} string").parquet(folder)
    return rows if keep else rows.drop(by)


def write_files_by_language(files: DataFrame, folder: str, run_id: int) -> None:
    """Finished translations, partitioned by language so a delivery for one language reads only it."""
    write_run(files, folder, run_id, partition_by=("language",))


def write_bucketed(rows: DataFrame, table: str, key: str = "order_id", buckets: int = 1024) -> None:
    """Catalog table bucketed by key: later joins on the key read it without a shuffle."""
    rows.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).saveAsTable(table)


def write_documents(rows: DataFrame, folder: str, text: str, *names: str) -> None:
    """One text document per row below ``folder/name=value/...``; the text is written as it is."""
    rows.select(*names, F.col(text).alias("value")).write.mode("overwrite").partitionBy(*names).text(folder)
