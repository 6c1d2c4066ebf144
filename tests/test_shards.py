"""Document export: files follow bytes, any document is found by its place, attempts leave nothing behind."""

import os

import pytest
from pyspark.sql import functions as F

from foliospark.sinks import shards as m

KEYS = "order_id long, language string, file_name string"


def books(spark, n, parts):
    df = spark.range(n).select(
        F.col("id").alias("order_id"), F.when(F.col("id") % 2 == 0, "es").otherwise("fr").alias("language"),
        F.concat(F.lit("Bücher/"), F.col("id").cast("string"), F.lit("_Spanish.txt")).alias("file_name"),
        F.when(F.col("id") % 7 == 3, F.lit(None)).when(F.col("id") % 5 == 0, F.lit("")).otherwise(F.repeat(F.concat(F.lit("é\r\n"), F.col("id").cast("string")), F.col("id").cast("int"))).alias("content"),
    )
    return df.repartition(parts, "order_id")


def listed(folder):
    return sorted(f for d in ("shards", "indexes") if os.path.isdir(f"{folder}/{d}") for f in os.listdir(f"{folder}/{d}"))


def test_round_trip(spark, folder):
    rows = books(spark, 300, 4)
    want = {r.order_id: r.content or "" for r in rows.collect()}
    m.export(rows, folder, "content", "order_id", "language", "file_name", shard_bytes=20000)
    index = m.read_index(spark, folder, KEYS)
    got = {r.order_id: r for r in m.read_texts(index.orderBy("shard", "start"), folder).collect()}
    assert {k: r.content for k, r in got.items()} == want and got[8].file_name == "Bücher/8_Spanish.txt"
    size = sum(len(t.encode()) for t in want.values())
    files = listed(folder)
    assert len(files) <= 4 + size // 20000 * 2 + 4 < 30
    assert sum(os.path.getsize(f"{folder}/shards/{f}") for f in os.listdir(f"{folder}/shards") if not f.startswith(".")) == size
    r = index.where("order_id = 299").first()
    assert m.read_place(folder, r.shard, r.start, r["bytes"]) == want[299]


def test_replace_and_append(spark, folder):
    for _ in range(2):  # the same export again leaves only its own files
        m.export(books(spark, 40, 3), folder, "content", "order_id", "language", "file_name")
    assert len(listed(folder)) == 6
    m.export(books(spark, 5, 1).withColumn("order_id", F.col("order_id") + 1000), folder, "content", "order_id", "language", "file_name", append=True)
    assert m.read_index(spark, folder, KEYS).count() == 45 and len(listed(folder)) == 8
    m.export(books(spark, 0, 2), folder, "content", "order_id", "language", "file_name")
    assert m.read_index(spark, folder, KEYS).count() == 0 and listed(folder) == []


def test_a_failed_attempt_leaves_nothing(spark, folder):
    m.export(books(spark, 10, 2), folder, "content", "order_id", "language", "file_name")
    before = listed(folder)
    broken = books(spark, 100, 4).withColumn("content", F.when(F.col("order_id") == 77, F.raise_error(F.lit("lost"))).otherwise(F.col("content")))
    with pytest.raises(Exception, match="lost"):
        m.export(broken, folder, "content", "order_id", "language", "file_name")
    assert listed(folder) == before and m.read_index(spark, folder, KEYS).count() == 10


def test_files_of_attempts_without_commit_go(folder):
    """Two attempts of one task: the one that is not reported is deleted when the job commits."""
    import pyarrow as pa

    writer = m.ShardWriter({"path": folder}, ["k", "t"], True)
    batch = pa.record_batch([pa.array([1]), pa.array(["abc"])], ["k", "t"])
    writer.write(iter([batch]))
    kept = writer.write(iter([batch]))
    assert len(listed(folder)) == 4
    writer.commit([kept, None])
    assert listed(folder) == sorted(f.split("/")[1] for f in kept.files)


@pytest.mark.parametrize("shard_bytes", [1, 100])
def test_a_task_that_outlives_its_failed_job_leaves_nothing(folder, shard_bytes):
    """The job is given up while a task still has documents to write."""
    import pyarrow as pa

    writer = m.ShardWriter({"path": folder, "shard_bytes": shard_bytes}, ["k", "t"], True)

    def batches():
        yield pa.record_batch([pa.array([1]), pa.array(["abc"])], ["k", "t"])
        writer.abort([None])
        assert listed(folder) == []
        yield pa.record_batch([pa.array([2]), pa.array(["def"])], ["k", "t"])

    with pytest.raises(RuntimeError, match="another task"):
        writer.write(batches())
    assert listed(folder) == []


def test_a_job_that_fails_before_any_task_has_begun(folder):
    m.ShardWriter({"path": f"{folder}/new"}, ["k", "t"], True).abort([])
    assert listed(f"{folder}/new") == []
