"""Whole texts cross into Python a few MB at a time in every stage of the pipeline."""

import pyarrow as pa
import pytest

import corpus_pipeline
from foliospark.llm import common

SMALL = "/root/testdata/sf0.001"


@pytest.fixture()
def wide(spark):
    """Batches as Spark sets them, not as the library's own session does."""
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = {k: spark.conf.get(k) for k in (rows, common.BATCH)}
    spark.conf.set(rows, "10000")
    spark.conf.set(common.BATCH, str(64 << 20))
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def largest(docs):
    def sizes(batches):
        for b in batches:
            yield pa.record_batch([pa.array([b.nbytes])], ["n"])

    return docs.select("text").mapInArrow(sizes, "n long").agg({"n": "max"}).first()[0]


@pytest.mark.parametrize("place", range(len(corpus_pipeline.STAGES)))
def test_every_stage_bounds_its_batches(wide, place):
    docs = wide.range(0, 9000, 1, 1).selectExpr("repeat('word ', 600) as text")
    assert largest(docs) > 16 << 20
    corpus_pipeline.STAGES[place][1](wide, wide.read.parquet(f"{SMALL}/documents.parquet"), SMALL)
    assert largest(docs) < common.BATCH_BYTES + (64 << 10)


@pytest.mark.parametrize("size, then", [("1000", "1000"), ("2m", "2m"), ("64m", str(common.BATCH_BYTES))])
def test_a_smaller_bound_stays(wide, size, then):
    wide.conf.set(common.BATCH, size)
    common.small_batches(wide)
    assert wide.conf.get(common.BATCH).removesuffix("b") in (then, then.replace("2m", str(2 << 20)))
