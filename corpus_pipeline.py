"""From documents to a weighted training corpus: five stages, each written as Parquet and read again.

``python corpus_pipeline.py <folder>`` runs it on the tables of a folder. No SQL expresses the stages
(a trained classifier, edit distances, fingerprints, a fitted mixture), so ORACLE_SQL is None and the
stages are tested against brute force.
"""

from __future__ import annotations

import sys
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from foliospark.llm import decontaminate, line_dedup, mixing, quality, simhash_dedup
from foliospark.llm.common import small_batches, stored

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def in_small_batches(stage: Stage) -> Stage:
    """The stage with texts that cross into Python a few MB at a time."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return stage(spark, docs, sf_dir)

    return run_stage


STAGES = [
    ("quality classifier", in_small_batches(quality.keep_good)),
    ("line dedup", in_small_batches(line_dedup.keep_first_lines)),
    ("simhash near-dedup", in_small_batches(simhash_dedup.keep_one_copy)),
    ("benchmark decontamination", in_small_batches(decontaminate.keep_clean)),
    ("mixing to target weights", in_small_batches(mixing.mix_sources)),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage: doc_id, tokens, domain posteriors and the rate of each document that is left."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs


if __name__ == "__main__":
    session = SparkSession.builder.appName("corpus pipeline").getOrCreate()
    run(session, sys.argv[1]).write.mode("overwrite").parquet(sys.argv[2] if len(sys.argv) > 2 else "corpus_weights")
