"""Nearest neighbours by inner product with hash-prefix forests.

Equal vectors are one class. Classes are dealt out to shards of about ``SHARD`` classes; each shard has a
forest: per tree a sorted array of hash strings of ``BITS`` bits (signs of random projections; vectors
are lifted to equal norm first, so that a small angle is a large inner product). A query descends in
each tree to its longest matching prefix, then all trees ascend together, a bit at a time and tree by
tree, until at least ``CANDIDATES`` of the shard's classes are reached. The candidates are ranked by
the inner product of the original vectors in double precision, and the shards' best are merged.

The stated queries meet the shards in blocks. The share of candidates is what recall costs: vectors without structure
need most of the rows for a recall of 0.9 (README has figures), clustered ones a small part.

Defined cases: vectors that are null, empty, zero, hold null or non-finite components, have a null id or another
length than most vectors take no part. Fewer candidates than ``k`` give shorter lists. Repeated
rows: each is a candidate of its own, a query is answered once. Ties go to the smaller vec_id. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliospark.llm.common import stored

K = 20
TREES = 24
BITS = 32
CANDIDATES = 0.7
SHARD = 8_192  # classes
BLOCK = 4_096  # queries that meet a shard at once
CELLS = 1 << 20  # of a block's scores
SEED = 11


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding (double) of the vectors that take part."""
    finite = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    clean = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    clean = clean.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())
    clean = clean.where(finite & F.exists("embedding", lambda x: x != 0))
    sizes = clean.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return clean.where(F.size("embedding") == (sizes[0] if sizes else 0))


def classes_of(clean: DataFrame, k: int = K) -> DataFrame:
    """(cid, embedding, ids): equal vectors with their k + 1 smallest ids."""
    rank = F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))
    few = clean.withColumn("rank", rank).where(F.col("rank") <= k + 1)
    return few.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).select(F.col("ids")[0].alias("cid"), "embedding", "ids")


class Forest:
    """Sorted hash strings of some vectors, per tree."""

    def __init__(self, vectors: np.ndarray, largest: float, trees: int = TREES, bits: int = BITS):
        self.trees, self.bits, self.n = trees, bits, len(vectors)
        self.planes = np.random.default_rng(SEED).normal(size=(vectors.shape[1] + 1, trees * bits))
        norms = np.linalg.norm(vectors, axis=1)
        lifted = np.concatenate([vectors / largest, np.sqrt(np.maximum(0, 1 - (norms / largest) ** 2))[:, None]], axis=1)
        codes = self.strings(lifted)
        self.order = np.argsort(codes, axis=0, kind="stable")
        self.sorted = np.take_along_axis(codes, self.order, axis=0)

    def strings(self, lifted: np.ndarray) -> np.ndarray:
        """[vector, tree]: hash strings as numbers, first bit highest."""
        out = np.zeros((len(lifted), self.trees), np.int64)
        step = max(1, CELLS // (self.trees * self.bits))
        for at in range(0, len(lifted), step):
            signs = (lifted[at : at + step] @ self.planes > 0).reshape(-1, self.trees, self.bits)
            out[at : at + step] = signs @ (1 << np.arange(self.bits - 1, -1, -1, dtype=np.int64))
        return out

    def ranges(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """[query, tree, length]: where in the sorted array the prefix of that length stands."""
        low = np.zeros((len(codes), self.trees, self.bits + 1), np.int32)
        high = np.zeros_like(low)
        for length in range(self.bits + 1):
            shift = self.bits - length
            start = codes >> shift << shift
            for t in range(self.trees):
                low[:, t, length] = np.searchsorted(self.sorted[:, t], start[:, t])
                high[:, t, length] = np.searchsorted(self.sorted[:, t], start[:, t] + (1 << shift))
        return low, high

    def candidates(self, queries: np.ndarray, wanted: int) -> np.ndarray:
        """[query, vector]: at least ``wanted`` candidates each, by synchronous ascent."""
        lifted = np.concatenate([queries / np.linalg.norm(queries, axis=1)[:, None], np.zeros((len(queries), 1))], axis=1)
        low, high = self.ranges(self.strings(lifted))
        reach = (high - low).sum(1)  # [query, length]: at most so many candidates
        out = np.zeros((len(queries), self.n), bool)
        for q in range(len(queries)):
            length = int(np.flatnonzero(reach[q] >= wanted)[-1])
            mark = out[q]
            if length < self.bits:  # all trees stand one bit lower, with too few candidates
                for t in range(self.trees):
                    mark[self.order[low[q, t, length + 1] : high[q, t, length + 1], t]] = True
            have = np.count_nonzero(mark)
            while have < wanted:
                for t in range(self.trees):
                    mark[self.order[low[q, t, length] : high[q, t, length], t]] = True
                    have = np.count_nonzero(mark)
                    if have >= wanted:
                        break
                length -= 1
        return out


def search_block(data: pd.DataFrame, queries: pd.DataFrame, largest: float, k: int, share: float) -> pd.DataFrame:
    """(qid, cid, score): the k + 1 best candidates of one shard for some queries."""
    vectors, wanted_by = np.stack(data["embedding"].to_numpy()), np.stack(queries["asked"].to_numpy())
    cids, forest, out = data["cid"].to_numpy(), Forest(vectors, largest), []
    step = max(1, CELLS // len(vectors))
    wanted = min(len(vectors), max(k + 1, int(np.ceil(share * len(vectors)))))
    for at in range(0, len(wanted_by), step):
        some = wanted_by[at : at + step]
        scores = np.where(forest.candidates(some, wanted), some @ vectors.T, -np.inf)
        keep = min(k + 1 + 8, len(vectors))  # some more, for the last bits of the matrix product
        best = np.argpartition(-scores, keep - 1, axis=1)[:, :keep]
        for i, rows in enumerate(best):
            rows = rows[np.isfinite(scores[i, rows])]
            exact = (vectors[rows] * some[i]).sum(axis=1)
            order = np.lexsort((cids[rows], -exact))[: k + 1]
            out.append((np.full(len(order), queries["qid"].iat[at + i]), cids[rows[order]], exact[order]))
    return pd.DataFrame({"qid": np.concatenate([o[0] for o in out]), "cid": np.concatenate([o[1] for o in out]), "score": np.concatenate([o[2] for o in out])})


def neighbours(vectors: DataFrame, is_query, k: int = K, share: float = CANDIDATES, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows where ``is_query`` (a column over vec_id) holds."""
    clean = stored(usable(vectors), "vectors")
    classes = stored(classes_of(clean, k), "vector-classes")
    size = classes.agg(F.count("*"), F.max(F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)))).first()
    shards = max(1, -(-size[0] // shard))
    largest = float(size[1] or 1.0)
    asked = clean.where(is_query).select("vec_id", "embedding").distinct()
    queries = stored(asked.join(classes.select("cid", "embedding"), "embedding").select("vec_id", F.col("cid").alias("qid")), "queries")
    once = queries.select("qid").distinct()
    blocks = max(1, -(-once.count() // block))
    left = classes.select(
        F.pmod(F.xxhash64("cid"), F.lit(shards)).cast("int").alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "cid", "embedding"
    )
    right = classes.withColumnRenamed("cid", "qid").join(once, "qid").select(
        F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard2"), F.pmod(F.xxhash64("qid", F.lit(1)), F.lit(blocks)).cast("int").alias("block2"),
        "qid", F.col("embedding").alias("asked"),
    )

    def search(data: pd.DataFrame, some: pd.DataFrame) -> pd.DataFrame:
        if not len(data) or not len(some):
            return pd.DataFrame({"qid": [], "cid": [], "score": []})
        return search_block(data, some, largest, k, share)

    found = left.groupBy("shard", "block").cogroup(right.groupBy("shard2", "block2")).applyInPandas(search, "qid long, cid long, score double")
    by_score = Window.partitionBy("qid").orderBy(F.desc("score"), "cid")
    found = found.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k + 1)
    each = found.join(classes.select("cid", "ids"), "cid").select("qid", "score", F.explode("ids").alias("vec_id"))
    by_id = Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id")
    each = stored(each.withColumn("rank", F.row_number().over(by_id)).where(F.col("rank") <= k + 1).drop("rank"), "neighbours")
    own = each.join(queries.withColumnRenamed("vec_id", "query_id"), "qid").where("vec_id <> query_id")
    last = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return own.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op4_neighbours(spark, sf_dir: str) -> DataFrame:
    return neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)
