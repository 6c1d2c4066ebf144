"""Helpers shared by the operators: row packing, shared tables, constant-size bitmaps."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

M64 = (1 << 64) - 1


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names. A local session without it (a test) gets its own."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="llm-shared-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


MADE: list[str] = []  # tables of the running operator, oldest first
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 4 << 20


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder, read again: later steps don't depend on what made them.

    So its shuffle files go as soon as it is written.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/llm/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    MADE.append(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, paths: list[str]) -> None:
    """Delete stored tables that nothing reads any more."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def settled(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """``stored(make())``, after which the tables that were stored on the way are deleted."""
    first = len(MADE)
    out = stored(make(), name)
    dropped(out.sparkSession, MADE[first:-1])
    del MADE[first:-1]
    return out


def small_batches(spark: SparkSession) -> None:
    """From now on an Arrow batch of this session holds about ``BATCH_BYTES``, or one longer text; less if so set before.

    Without it 10,000 whole texts cross at once, and the task's JVM and its Python worker each hold them more than once.
    The setting stays, since a result's plan may read it when the result is written.
    """
    size = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(BATCH))
    if size > BATCH_BYTES:
        spark.conf.set(BATCH, str(BATCH_BYTES))


def hot_join(rows: DataFrame, groups: DataFrame, key: str, count: str) -> DataFrame:
    """Rows that meet a group of their key; ``groups`` has each key once and the number of its rows.

    A key with a thousandth of all these rows or more is hot. There are a thousand such keys at most,
    whatever the data, so they are broadcast and their rows stay where they are; no other key can make
    a large partition. Both sides are read twice and should be stored.
    """
    total = groups.agg(F.sum(count)).first()[0] or 0
    hot = F.col(count) * 1000 >= total
    few = F.broadcast(groups.where(hot))
    rest = rows.join(few.select(key), key, "left_anti").join(groups.where(~hot), key)
    return rows.join(few, key).unionByName(rest)


def named(name: str) -> Column:
    """A column by its exact name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def packed(docs: DataFrame, *columns: Column) -> DataFrame:
    """All columns of ``docs`` in one struct ``row``, so that working columns beside it can't clash."""
    return docs.select(F.struct(*[named(c) for c in docs.columns]).alias("row"), *columns)


def unpacked(df: DataFrame, names: list[str], **replaced: Column) -> DataFrame:
    """The columns of ``docs`` again, some of them with new values."""
    return df.select([replaced.get(c, F.col("row")[c]).alias(c) for c in names])


def identity() -> tuple[Column, Column]:
    """96 bits that stand for a document: its id and text. Rows equal in both are one document."""
    return F.xxhash64("doc_id", "text").alias("k1"), F.hash("text", "doc_id").alias("k2")


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64 bits over each other (uint64, wraps)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


KNOWN_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    if len(KNOWN_POWERS.get(base, ())) < n:
        KNOWN_POWERS[base] = np.concatenate([[np.uint64(1)], np.multiply.accumulate(np.full(n, base, np.uint64))])
    return KNOWN_POWERS[base][:n]


def bounded(texts: list[str | None], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts with about ``most`` characters each; a longer text stands alone."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        n = len(text or "") + 1
        if size and size + n > most:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def pieces(column: pa.Array, most: int) -> Iterator[tuple[int, list[str]]]:
    """The texts of an Arrow column (null: empty), some at a time: about ``most`` bytes, or one longer text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    start = 0
    while start < len(ends):
        limit = (ends[start - 1] if start else 0) + most
        stop = max(start + 1, int(np.searchsorted(ends, limit, "right")))
        yield start, strings(column.slice(start, stop - start).to_pylist())
        start = stop


def bitmap(hashes: DataFrame, column: str, bits: int) -> np.ndarray:
    """2**bits bits on the driver, set at the low bits of the hashes: a filter of constant size.

    A set bit may be set by chance, never is one missing. Spark gathers the words, at most
    2**(bits-6) of them, whatever the number of hashes.
    """
    at = F.col(column).bitwiseAND(F.lit((1 << bits) - 1))
    words = hashes.groupBy(F.shiftright(at, 6).cast("int").alias("w")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, cast(({column} & 63) as int))")).alias("v")
    )
    out = np.zeros(1 << (bits - 6), np.int64)
    got: pa.Table = words.toArrow()
    out[got.column("w").to_numpy()] = got.column("v").to_numpy()
    return out


def in_bitmap(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """For each hash whether its bit is set."""
    at = hashes.view(np.uint64) & np.uint64(len(bits) * 64 - 1)
    word = bits.view(np.uint64)[(at >> np.uint64(6)).astype(np.int64)]
    return (word >> (at & np.uint64(63))) & np.uint64(1) == 1


def strings(column: pd.Series | pa.Array) -> list[str]:
    """Texts without nulls."""
    return [t if isinstance(t, str) else "" for t in column]
