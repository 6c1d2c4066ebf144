"""Connected components as Spark joins: large stars and small stars in turn."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import MADE, dropped, stored


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) for every node of ``links`` (a, b: long); the root is the smallest node reachable.

    Each round hangs larger neighbours, then smaller ones, under the smallest neighbour. The number
    of rounds grows with the logarithm of a component's length. No component is gathered: a star is
    its rows. Self links and null ends are left out; no links give no rows.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges, before = stored(edges, name), None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        large = (
            both.join(low, "u").where("v > u")
            .select(F.col("v").alias("u"), F.least("m", "u").alias("v")).where("u <> v").distinct()
        )
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        under = large.join(low, "u")
        small = under.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        old = [MADE.pop()]
        edges = stored(small.where("u <> v").distinct(), name)
        dropped(edges.sparkSession, old)
        state = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.hash("u", "v").cast("long"))).first()
        if state == before or not state[0]:
            break
        before = state
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
