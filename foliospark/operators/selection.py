"""Fold a log of selection clicks into the final selection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.sources.dimensions import LANGUAGE_CODES


def selection_fold(log: DataFrame, items=LANGUAGE_CODES) -> DataFrame:
    """Selected items per session from rows (session_id, item, action, at, seq).

    ``toggle`` flips one item, ``all`` selects every item. An item is selected when one "all"
    (if any) plus the toggles after the last "all" are an odd number. The last "all" of a session is
    one row by partial aggregation; it joins back, and the toggles after it are counted by partial
    aggregation, too. No session is ever sorted or held in a task.
    """
    acts = log.filter(F.col("action").isin("toggle", "all")).withColumn("_at", F.struct("at", "seq"))
    sessions = acts.groupBy("session_id").agg(
        F.max(F.when(F.col("action") == "all", F.col("_at"))).alias("_all")
    )
    live = acts.join(sessions.withColumnRenamed("session_id", "_s"), F.col("session_id").eqNullSafe(F.col("_s")))
    live = live.filter(F.col("_all").isNull() | (F.col("_at") >= F.col("_all")))
    counts = [
        F.sum(F.when((F.col("action") == "toggle") & (F.col("item") == i), 1).otherwise(0)).alias(f"n{k}")
        for k, i in enumerate(items)
    ]
    folded = live.groupBy("session_id").agg(F.max(F.col("_all").isNotNull()).cast("int").alias("reset"), *counts)
    pairs = F.array(*[F.struct(F.lit(i).alias("item"), F.col(f"n{k}").alias("toggles")) for k, i in enumerate(items)])
    return (
        folded.select("session_id", "reset", F.inline(pairs))
        .filter((F.col("reset") + F.col("toggles")) % 2 == 1)
        .select("session_id", "item", "toggles")
    )
