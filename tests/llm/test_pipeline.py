"""The pipeline and its stages on the smallest tables."""

import pytest

import corpus_pipeline
from foliospark.llm import decontaminate, line_dedup, simhash_dedup

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    from foliospark.llm.common import stored

    docs, out = spark.read.parquet(f"{SMALL}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        after = stored(stage(spark, docs, SMALL), "test-stage")
        out.append((name, docs, after))
        docs = after
    return out


def test_columns(spark, steps):
    names = spark.read.parquet(f"{SMALL}/documents.parquet").columns
    assert [n for n, _, _ in steps] == ["quality classifier", "line dedup", "simhash near-dedup", "benchmark decontamination", "mixing to target weights"]
    assert all(after.columns == names for _, _, after in steps[:-1])


def test_quality(spark, steps):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet").collect()
    bad, good = ({r.doc_id for r in labels if r.quality == q} for q in (0, 1))
    left = {r.doc_id for r in steps[0][2].collect()}
    assert len(left & bad) <= len(bad) * 0.2 and len(good - left) <= len(good) * 0.05


def test_lines(steps):
    _, before, after = steps[1]
    assert after.count() == before.count()
    seen = set()
    for r in after.orderBy("doc_id").collect():
        for line in (x for x in r.text.split("\n") if x):
            assert line not in seen
            seen.add(line)
        assert r.n_chars == len(r.text)
    assert seen <= {x for r in before.collect() for x in r.text.split("\n")}
    assert line_dedup.lines(after).where("not kept").count() == 0


def test_groups(steps):
    _, before, after = steps[2]
    groups = {}
    for r in simhash_dedup.near_duplicates(before).collect():
        groups.setdefault(r.component_id, set()).add(r.doc_id)
    left = sorted(r.doc_id for r in after.collect())
    assert left == sorted(groups) and all(len(g & set(left)) == 1 for g in groups.values())


def test_leaks(spark, steps):
    _, before, after = steps[3]
    passages = [r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    left = {r.doc_id for r in after.collect()}
    for r in before.collect():
        if any(p in r.text for p in passages):
            assert r.doc_id not in left
    assert decontaminate.found(after, spark.read.parquet(f"{SMALL}/benchmark.parquet")).where("size(hits) > 0").count() == 0


def test_run(spark, steps):
    rows = corpus_pipeline.run(spark, SMALL)
    _, before, after = steps[4]
    assert rows.columns == after.columns
    assert sorted(r.doc_id for r in rows.collect()) == sorted(r.doc_id for r in before.collect())
    assert all(r.rate >= 0 for r in rows.collect())
