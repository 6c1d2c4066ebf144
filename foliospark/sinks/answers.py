"""Rows that are too dear to lose, stored batch by batch by the tasks that make them.

A task stores every batch as a file of its own before it takes the next one, so a task that is killed loses its open
batch only, whatever becomes of the job. Nothing is replaced; a row that a repeated attempt stored again
is chosen away on its narrow key when it is read.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from foliospark.sinks.store import filesystem, put

FILE = "_file"
FEW = 100_000  # repeated rows that are broadcast


def store_each(rows: DataFrame, make: Callable[[pd.DataFrame], pd.DataFrame], path: str, ddl: str) -> int:
    """Make rows of ``ddl`` from each batch and store them at once; returns how many there are."""
    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, root = filesystem(path)
        files.create_dir(root)
        for batch in batches:
            made = make(batch)
            if len(made):
                out = io.BytesIO()
                pq.write_table(pa.Table.from_pandas(made, schema, preserve_index=False), out, compression="zstd")
                put(files, f"{root}/{uuid.uuid4().hex}.parquet", out.getvalue())
            yield pd.DataFrame({"n": [len(made)]})

    return rows.mapInPandas(run, "n bigint").agg(F.sum("n")).first()[0] or 0


def read(spark: SparkSession, path: str, ddl: str, keys: tuple[str, ...], failed: str | None = None) -> DataFrame:
    """One row per key; of rows that name a ``failed`` reason only those without.

    Repeated keys are found on the key columns and the names of the files. The rows themselves are not shuffled
    unless very many are repeated.
    """
    files, root = filesystem(path)
    files.create_dir(root)
    rows = spark.read.schema(ddl).parquet(path).withColumn(FILE, F.col("_metadata.file_path"))
    if failed:
        rows = rows.filter(F.col(failed).isNull())
    first = rows.groupBy(*keys).agg(F.min(FILE).alias("_first"), F.count("*").alias("_n")).filter("_n > 1").select(*keys, "_first")
    repeated = rows.select(*keys, FILE).join(first, list(keys)).filter(F.col(FILE) != F.col("_first")).select(*keys, FILE)
    n = repeated.count()
    if n:
        rows = rows.join(F.broadcast(repeated) if n <= FEW else repeated, [*keys, FILE], "left_anti")
    return rows.drop(FILE)
