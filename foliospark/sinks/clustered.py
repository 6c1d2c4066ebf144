"""A table whose files are ranges of a key, and deletes that rewrite only the files that hold a deleted key.

The manifest knows the least and the largest key of every file. Keys to delete meet the files' ranges in an equi-join on
bands; of the files that remain the key column alone tells which really hold one. Those are written again without
the deleted rows and switched in together, so a reader sees all of a delete or nothing of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.sinks.snapshots import Part, Snapshot, snapshot, switch, write_part

FILE = "_file"


def file_column():
    """Path of a row's file as Spark has it, the same value for all rows of a file: nothing is computed per row."""
    return F.col("_metadata.file_path")


def below(path: str) -> str:
    """Path of a file below the table's folder."""
    return "data/" + "/".join(path.split("/")[-2:])


def clustered_parts(rows: DataFrame, folder: str, key: str, name: str) -> list[Part]:
    """Store rows sorted by key, one part per file with the bounds of its keys."""
    held = write_part(rows.repartitionByRange(key).sortWithinPartitions(key), folder, name)
    back = rows.sparkSession.read.schema(rows.schema).parquet(f"{folder}/{held.path}")
    found = back.select(key, file_column().alias(FILE)).groupBy(FILE).agg(F.min(key).alias("low"), F.max(key).alias("high"))
    return [Part(below(r[FILE]), name, 0, {key: [r.low, r.high]}) for r in found.collect()]  # a line per file, as in the manifest


def create(rows: DataFrame, folder: str, key: str) -> Snapshot:
    """Store a table for the first time, or replace what it held. Rows without a key belong to nobody and stay out."""
    spark = rows.sparkSession
    return switch(spark, snapshot(spark, folder), clustered_parts(rows.filter(F.col(key).isNotNull()), folder, key, "files"))


def in_range(spark: SparkSession, parts: tuple[Part, ...], key: str, due: DataFrame) -> list[str]:
    """Paths of the parts whose range holds a due key."""
    ranges = [(p.path, *p.bounds[key]) for p in parts]
    if not ranges:
        return []
    width = max(1, (max(r[2] for r in ranges) - min(r[1] for r in ranges)) // len(ranges) + 1)
    band = lambda c: F.floor(F.col(c) / width)
    files = spark.createDataFrame(ranges, "path string, low bigint, high bigint").withColumn("band", F.explode(F.sequence(band("low"), band("high"))))
    met = due.select(key).distinct().withColumn("band", band(key)).join(files, "band").filter(F.col(key).between(F.col("low"), F.col("high")))
    return [r.path for r in met.select("path").distinct().collect()]


def delete(spark: SparkSession, folder: str, ddl: str, key: str, due: DataFrame) -> tuple[Snapshot, list[str]]:
    """Delete the rows of due keys (whole numbers); returns the new state and the files that were written again."""
    state = snapshot(spark, folder)
    keys = due.select(key).distinct()
    near = in_range(spark, state.parts, key, keys)
    if not near:
        return state, []
    held = spark.read.schema(ddl).parquet(*[f"{folder}/{p}" for p in near]).select(key, file_column().alias(FILE))
    hit = {below(r[FILE]) for r in held.join(keys, key, "left_semi").select(FILE).distinct().collect()}
    if not hit:
        return state, []
    rest = spark.read.schema(ddl).parquet(*[f"{folder}/{p}" for p in sorted(hit)]).join(keys, key, "left_anti").select(*spark.createDataFrame([], ddl).columns)
    new = clustered_parts(rest, folder, key, "files")
    return switch(spark, state, [p for p in state.parts if p.path not in hit] + new), sorted(hit)
