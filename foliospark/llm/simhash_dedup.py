"""SimHash near-duplicates by the generalised pigeonhole principle.

The 64 bits are grouped into partitions so that correlated bits lie together. For a search within
``radius`` bits, any thresholds t_i >= -1 with sum(t_i + 1) = radius + 1 are complete: if every
partition i differed in more than t_i bits, the whole would differ in at least radius + 1. Each
fingerprint gets thresholds of its own, by dynamic programming over an estimate of what it must
enumerate and of the candidates it meets. It probes all values within t_i of its own in partition i;
the other side is indexed by its value alone. Candidates are verified on all 64 bits.

Defined cases: a null or empty text, or one of white space, has fingerprint zero and is linked like any
other. Texts with fewer than three words have one shingle. Rows equal in id and text are one document
with equal answers. An empty table gives no rows. A null doc_id counts as smaller than none: its row is
linked, but never names a component unless all ids in it are null.

In the pipeline's stage two documents are near copies when the Jaccard similarity of their sets of five-word shingles
is ``SIMILARITY`` or more. Candidates come from the search above over SimHash fingerprints of these sets. No radius is
sure to hold all such pairs (at 0.8 they lie 9.7 bits apart on average, some twice that), so for those that lie
farther apart more come from a prefix filter, which is complete: if all shingles stand in one order, two sets that similar share one of the first n // 5 + 1 of each. The order is
by rarity in hashed counters of constant size, so that common shingles seldom are keys. Candidates are
verified on the whole sets. A group of copies is joined through one of its members; only pairs that this leaves in
different components are listed. Texts without words have one, empty, set.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from foliospark.llm import common
from foliospark.llm.common import stored
from foliospark.llm.components import components

BITS = 64
RADIUS = 3
WORDS = 3  # of a shingle
SEED = 42
PARTS = 3
HALF = 11  # bits of the histograms behind the estimates, so at most 2**HALF counts each
PIECE = 1 << 16  # shingles held at once
PROBE_COST = 1.0  # of one enumerated value, in candidates
STAGE_WORDS = 5  # of a shingle in the stage
SIMILARITY = (4, 5)  # of near copies in the stage, as a fraction
STAGE_RADIUS = 6  # bits between fingerprints of sets that the stage compares first
COUNTERS = 1 << 18  # behind the order of shingles
GROUP = 512  # sets of one key that meet in one group
FILTER_BITS = (20, 30)  # least and most of a filter, which has eight for each wanted hash
FAN = 16  # arrays of counters that one task adds
ROUNDS = 3  # of comparisons before all pairs between components: near fingerprints, then one set of each key with the others


def words_of(text: str) -> list[bytes]:
    """Words of a text with A-Z lower-cased: runs of bytes other than space and \\x09-\\x0D."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def fingerprint(text: str, width: int = WORDS) -> int:
    """A bit is one if more than half of the shingles' XXH64 have it."""
    words = words_of(text)
    if not words:
        return 0
    joined, width = b" ".join(words), min(width, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - width + 1]
    ends = ends[width - 1 :]
    ones, digest = np.zeros(BITS, np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(starts), PIECE):
        cuts = zip(starts[at : at + PIECE].tolist(), ends[at : at + PIECE].tolist())
        hashes = np.array([digest(joined[a:b], SEED) for a, b in cuts], ">u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(starts)).tobytes(), "big", signed=True)


def fingerprints(width: int = WORDS):
    """Column function text -> fingerprint as a signed long; null reads as empty."""

    @pandas_udf("long")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([fingerprint(t if isinstance(t, str) else "", width) for t in texts], dtype="int64")

    return of


def bit_matrix(values: np.ndarray) -> np.ndarray:
    """0/1 per bit, most significant first."""
    return np.unpackbits(values.astype(">i8").view(np.uint8).reshape(-1, 8), axis=1)


def correlation(distinct: DataFrame) -> tuple[np.ndarray, int]:
    """Correlations between bits over all fingerprints, and their number. Each task sends a 64 x 64 sum."""

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pairs, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            bits = bit_matrix(batch["fp"].to_numpy()).astype(np.float32)
            pairs += bits.T @ bits
            n += len(bits)
        yield pd.DataFrame({"i": np.append(np.arange(BITS * BITS), -1), "v": np.append(pairs.ravel(), n)})

    got = distinct.select("fp").mapInPandas(sums, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).toPandas()
    table = np.zeros(BITS * BITS + 1)
    table[got["i"].to_numpy()] = got["v"].to_numpy()
    n = int(table[-1])
    if not n:
        return np.zeros((BITS, BITS)), 0
    both = table[:-1].reshape(BITS, BITS) / n
    mean = both.diagonal()
    spread = np.sqrt(np.maximum(mean * (1 - mean), 1e-9))
    return (both - np.outer(mean, mean)) / np.outer(spread, spread), n


def group_bits(correlated: np.ndarray, parts: int = PARTS) -> list[list[int]]:
    """Partitions of nearly equal width; each takes next the free bit most correlated with what it has."""
    strength, free = np.abs(correlated - np.diag(correlated.diagonal())), set(range(BITS))
    out = []
    for p in range(parts):
        width = BITS // parts + (p < BITS % parts)
        first = max(free, key=lambda b: (strength[b, sorted(free)].max(), -b))
        part = [first]
        free.remove(first)
        while len(part) < width:
            take = max(free, key=lambda b: (strength[b, part].sum(), -b))
            part.append(take)
            free.remove(take)
        out.append(part)
    return out


def extract(values: np.ndarray, bits: list[int]) -> np.ndarray:
    """The chosen bits as one small number."""
    out, unsigned = np.zeros(len(values), np.int64), values.view(np.uint64)
    for b in bits:
        out = (out << 1) | ((unsigned >> np.uint64(BITS - 1 - b)) & np.uint64(1)).astype(np.int64)
    return out


def histograms(distinct: DataFrame, blocks: list[list[int]]) -> list[np.ndarray]:
    """How many fingerprints have each value of each block of at most HALF bits."""

    def counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = [np.zeros(1 << len(b), np.int64) for b in blocks]
        for batch in batches:
            values = batch["fp"].to_numpy()
            for t, b in zip(total, blocks):
                t += np.bincount(extract(values, b), minlength=len(t))
        for k, t in enumerate(total):
            at = np.flatnonzero(t)
            yield pd.DataFrame({"k": np.full(len(at), k, "int32"), "v": at, "n": t[at]})

    got = distinct.select("fp").mapInPandas(counts, "k int, v long, n long").groupBy("k", "v").agg(F.sum("n").alias("n")).toPandas()
    out = [np.zeros(1 << len(b)) for b in blocks]
    for k, v, n in got.itertuples(index=False):
        out[k][v] = n
    return out


def near_counts(histogram: np.ndarray, width: int, radius: int) -> np.ndarray:
    """[value, e]: how many lie at exactly e bits from the value."""
    values = np.arange(len(histogram))
    out = np.zeros((len(histogram), radius + 1))
    for e in range(min(radius, width) + 1):
        for flip in combinations(range(width), e):
            out[:, e] += histogram[values ^ sum(1 << b for b in flip)]
    return out


def allocate(costs: list[np.ndarray], radius: int) -> np.ndarray:
    """Thresholds t_i in -1..radius per row with sum(t_i + 1) = radius + 1 and the least total cost.

    ``costs[i][row, u]`` is the cost of t_i = u - 1, zero at u = 0.
    """
    rows = len(costs[0])
    best = np.full((rows, radius + 2), np.inf)
    best[:, 0] = 0
    choices = []
    for cost in costs:
        nxt, pick = np.full_like(best, np.inf), np.zeros(best.shape, np.int8)
        for have in range(radius + 2):
            for u in range(radius + 2 - have):
                total = best[:, have] + cost[:, u]
                better = total < nxt[:, have + u]
                nxt[better, have + u] = total[better]
                pick[better, have + u] = u
        best = nxt
        choices.append(pick)
    out, left = np.zeros((rows, len(costs)), np.int8), np.full(rows, radius + 1)
    for i in range(len(costs) - 1, -1, -1):
        u = choices[i][np.arange(rows), left]
        out[:, i] = u - 1
        left = left - u
    return out


class Plan:
    """What tasks need to index and probe: partitions, estimates, masks. Its size is constant."""

    def __init__(self, parts: list[list[int]], halves: list[list[list[int]]], tables: list[list[np.ndarray]], n: int, radius: int):
        self.parts, self.halves, self.tables, self.n, self.radius = parts, halves, tables, n, radius
        self.masks = [
            [np.array([sum(1 << (len(p) - 1 - b) for b in flip) for flip in combinations(range(len(p)), e)], np.int64) for e in range(radius + 1)]
            for p in parts
        ]

    def thresholds(self, values: np.ndarray) -> np.ndarray:
        costs = []
        for part, halves, tables in zip(self.parts, self.halves, self.tables):
            exact = np.ones((len(values), 1))
            for bits, table in zip(halves, tables):
                near = table[extract(values, bits)] / max(self.n, 1)
                exact = np.stack([
                    sum(exact[:, a] * near[:, e - a] for a in range(min(e, exact.shape[1] - 1) + 1)) for e in range(self.radius + 1)
                ], 1)
            met = np.cumsum(exact, 1) * self.n
            work = np.cumsum([comb(len(part), e) for e in range(self.radius + 1)]) * PROBE_COST
            costs.append(np.concatenate([np.zeros((len(values), 1)), met + work], 1))
        return allocate(costs, self.radius)


def plan_for(distinct: DataFrame, radius: int = RADIUS, parts: int = PARTS) -> Plan:
    correlated, n = correlation(distinct)
    grouped = group_bits(correlated, parts)
    halves = [[p[i : i + HALF] for i in range(0, len(p), HALF)] for p in grouped]
    counted = iter(histograms(distinct, [h for p in halves for h in p]))
    tables = [[near_counts(next(counted), len(h), radius) for h in p] for p in halves]
    return Plan(grouped, halves, tables, n, radius)


def links(distinct: DataFrame, radius: int = RADIUS, parts: int = PARTS) -> DataFrame:
    """(a, b) with a < b: every two of the distinct fingerprints ``fp`` within ``radius`` bits, once."""
    plan = distinct.sparkSession.sparkContext.broadcast(plan_for(distinct, radius, parts))

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            values = batch["fp"].to_numpy()
            for i, part in enumerate(plan.value.parts):
                yield pd.DataFrame({"key": extract(values, part) * len(plan.value.parts) + i, "b": values})

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            values = batch["fp"].to_numpy()
            chosen, p = plan.value.thresholds(values), plan.value
            for i, part in enumerate(p.parts):
                own = extract(values, part)
                for e in range(radius + 1):
                    rows = np.flatnonzero(chosen[:, i] >= e)
                    masks = p.masks[i][e]
                    step = max(1, (1 << 20) // len(masks))
                    for at in range(0, len(rows), step):
                        some = rows[at : at + step]
                        yield pd.DataFrame({
                            "key": ((own[some][:, None] ^ masks) * len(p.parts) + i).ravel(), "a": np.repeat(values[some], len(masks)),
                        })

    right = distinct.mapInPandas(index, "key long, b long")
    left = distinct.mapInPandas(probe, "key long, a long")
    near = left.join(right, "key").where((F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius))
    return near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, radius: int = RADIUS, parts: int = PARTS, width: int = WORDS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, k1, k2, fp, root (a fingerprint), component_id."""
    marked = stored(docs.select("doc_id", *common.identity(), fingerprints(width)(F.col("text")).alias("fp")), "fingerprints")
    classes = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    roots = components(links(classes.select("fp"), radius, parts), "simhash")
    labelled = classes.join(roots, classes.fp == roots.node, "left").select(F.col("fp"), "first", F.coalesce("root", "fp").alias("root"))
    least = labelled.groupBy("root").agg(F.min("first").alias("component_id"))
    named = labelled.join(least, "root").select("fp", "root", "component_id")
    return marked.join(named, "fp")


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def op6_simhash(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs).select("doc_id", hex16(F.col("fp")).alias("fingerprint"), "component_id")


def shingle_set(text: str, width: int = STAGE_WORDS) -> np.ndarray:
    """Hashes of a text's different shingles, sorted."""
    words = words_of(text)
    if not words:
        return np.zeros(0, np.int64)
    joined, width, digest = b" ".join(words), min(width, len(words)), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - width + 1]
    cuts = zip(starts.tolist(), ends[width - 1 :].tolist())
    return np.unique(np.fromiter((digest(joined[a:b], SEED) for a, b in cuts), np.uint64, len(starts)).view(np.int64))


def set_fingerprint(hashes: np.ndarray) -> int:
    """SimHash of a set: a bit is one if more than half of its hashes have it; zero for an empty set."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), PIECE):
        ones += bit_matrix(hashes[at : at + PIECE]).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big", signed=True)


def set_names(sets: list[np.ndarray]) -> dict[str, np.ndarray]:
    """128 bits per set."""
    return {c: np.array([xxhash.xxh64_intdigest(s.tobytes(), k) for s in sets], np.uint64).view(np.int64) for k, c in enumerate(("c1", "c2"))}


def set_classes():
    """Column function text -> the 128 bits of its set, and the set's fingerprint."""

    @pandas_udf("c1 long, c2 long, fp long")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            sets = [shingle_set(t) for t in common.strings(texts)]
            yield pd.DataFrame({**set_names(sets), "fp": np.array([set_fingerprint(s) for s in sets], np.int64)})

    return of


def shingle_counters(docs: DataFrame) -> np.ndarray:
    """In how many documents a shingle of each hash class is, roughly: enough to order by.

    A task sends one packed array; the arrays are added in groups of ``FAN`` until few are left.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for a, b in common.bounded(texts := common.strings(batch["text"]), PIECE << 4):
                total += np.bincount(np.concatenate([shingle_set(t) for t in texts[a:b]]) & (COUNTERS - 1), minlength=COUNTERS)
        yield pd.DataFrame({"place": [TaskContext.get().partitionId()], "counts": [zlib.compress(total.tobytes(), 1)]})

    def add(group: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(zlib.decompress(c), np.int64) for c in group["counts"])
        return pd.DataFrame({"place": [int(group["place"].iat[0])], "counts": [zlib.compress(total.tobytes(), 1)]})

    parts, texts = max(1, docs.rdd.getNumPartitions()), docs.select("text")
    rows = texts.mapInPandas(run, "place int, counts binary")
    while parts > 1:
        rows = rows.withColumn("place", F.floor(F.col("place") / FAN).cast("int")).groupBy("place").applyInPandas(add, "place int, counts binary")
        parts = -(-parts // FAN)
    # One row, or the few that a plan with other partitions than the counted ones leaves.
    return sum((np.frombuffer(zlib.decompress(r.counts), np.int64) for r in rows.toLocalIterator()), np.zeros(COUNTERS, np.int64))


def prefix_rows(docs: DataFrame, counters, shared=None) -> DataFrame:
    """(key, c1, c2, size, pos): the rarest shingles of each document's set, as many as a near copy can't all lack.

    ``shared`` is a bitmap of the keys that are wanted, if only those are.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        often = counters.value
        for batch in batches:
            for a, b in common.bounded(texts := common.strings(batch["text"]), PIECE << 4):
                sets = [s for t in texts[a:b] if len(s := shingle_set(t))]
                first = [s[np.lexsort((s, often[s & (COUNTERS - 1)]))[: len(s) - -(-len(s) * SIMILARITY[0] // SIMILARITY[1]) + 1]] for s in sets]
                if sets:
                    n = [len(f) for f in first]
                    own = {c: np.repeat(v, n) for c, v in set_names(sets).items()}
                    pos = np.concatenate([np.arange(k, dtype=np.int64) for k in n])
                    out = pd.DataFrame({"key": np.concatenate(first), **own, "size": np.repeat([len(s) for s in sets], n), "pos": pos})
                    yield out if shared is None else out[common.in_bitmap(shared.value, out["key"].to_numpy())]

    return docs.select("text").mapInPandas(run, "key long, c1 long, c2 long, size long, pos long")


def filter_of(rows: DataFrame, column: str):
    """A broadcast bitmap of hashes with eight bits for each, within bounds; beyond them more passes by chance."""
    bits = min(FILTER_BITS[1], max(FILTER_BITS[0], (8 * rows.count()).bit_length()))
    return rows.sparkSession.sparkContext.broadcast(common.bitmap(rows, column, bits))


def shared_keys(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(key, node, size, pos): the prefixes of all sets, as far as their keys are in more than one set."""
    counters = docs.sparkSession.sparkContext.broadcast(shingle_counters(docs))
    name = F.struct("c1", "c2")
    ends = prefix_rows(docs, counters).groupBy("key").agg(F.min(name).alias("low"), F.max(name).alias("high"))
    keys = stored(ends.where("low <> high").select("key"), "copy-shared")
    rows = prefix_rows(docs, counters, filter_of(keys, "key")).distinct().join(keys, "key")
    return stored(rows.join(classes.select("node", "c1", "c2"), ["c1", "c2"]).select("key", "node", "size", "pos"), "copy-keys")


def texts_of(docs: DataFrame, nodes: DataFrame, classes: DataFrame) -> DataFrame:
    """(node, text): one text of each of some classes. A filter lets few other texts move."""
    wanted = stored(nodes.select("node").distinct().join(classes, "node").select("node", "k1", "k2"), "copy-nodes")
    bits = filter_of(wanted, "k1")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[common.in_bitmap(bits.value, batch["k1"].to_numpy())]

    texts = docs.select(*common.identity(), "text").mapInPandas(read, "k1 long, k2 int, text string")
    return stored(texts.dropDuplicates(["k1", "k2"]).join(wanted, ["k1", "k2"]).select("node", "text"), "copy-texts")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are near copies.

    A text moves once for each text it is compared with as ``b``, and once for each ``GROUP`` partners as ``a``.
    A task streams a share: the text ``a``, then its partners.
    """
    often = pairs.groupBy("a").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("shares"))
    dealt = pairs.join(often, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("shares")).cast("int").alias("share"))
    first = often.select("a", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"))
    first = first.join(texts.withColumnRenamed("node", "a"), "a").select("a", "share", F.lit(None).cast("long").alias("b"), "text")
    rest = dealt.join(texts.withColumnRenamed("node", "b"), "b").select("a", "share", "b", "text")
    rows = first.unionByName(rest).repartition("a", "share").sortWithinPartitions("a", "share", "b")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(0, np.int64)
        for batch in batches:
            a, b, near = batch.column("a").to_pylist(), batch.column("b").to_pylist(), []
            for at, texts in common.pieces(batch.column("text"), PIECE << 4):
                for i, text in enumerate(texts, at):
                    this = shingle_set(text)
                    if b[i] is None:
                        own = this
                        continue
                    both = len(np.intersect1d(own, this, assume_unique=True))
                    if both * SIMILARITY[1] >= (len(own) + len(this) - both) * SIMILARITY[0]:
                        near.append(i)
            yield pa.record_batch([pa.array([a[i] for i in near], pa.int64()), pa.array([b[i] for i in near], pa.int64())], ["a", "b"])

    return rows.select("a", "b", "text").mapInArrow(compare, "a long, b long")


def may_be_near(m: str, n: str) -> Column:
    return F.least(m, n) * SIMILARITY[1] >= F.greatest(m, n) * SIMILARITY[0]


def simhash_pairs(classes: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b): sets with equal fingerprints or with fingerprints within ``STAGE_RADIUS`` bits.

    A fingerprint goes by one of its sets and is paired with the smallest one near it, so that a group of copies
    isn't listed pair by pair. Sets without a text in ``texts`` share no rare shingle with another and are left out.
    """
    able = classes.join(texts.select("node"), "node", "left_semi").select("node", "fp")
    firsts = stored(able.groupBy("fp").agg(F.min("node").alias("first")), "copy-prints")
    near = links(firsts.select("fp"), STAGE_RADIUS).groupBy("b").agg(F.min("a").alias("a"))
    side = lambda c: firsts.select(F.col("fp").alias(c), F.col("first").alias(f"{c}_first"))
    between = near.join(side("a"), "a").join(side("b"), "b").select(F.col("a_first").alias("a"), F.col("b_first").alias("b"))
    equal = able.join(firsts, "fp").where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    return between.unionByName(equal)


def star_pairs(rows: DataFrame, seed: int) -> DataFrame:
    """Each set of a key with one of them, if it is not yet in the same component."""
    middle = F.min(F.struct(F.xxhash64("node", F.lit(seed)), "node", "root", "size")).alias("c")
    stars = rows.groupBy("key").agg(middle, F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    met = rows.join(stars.select("key", "c"), "key").where("root <> c.root").select("node", "size", F.col("c.node").alias("center"), F.col("c.size").alias("n"))
    return met.where(may_be_near("size", "n")).select(F.col("center").alias("a"), F.col("node").alias("b")).distinct()


def cross_pairs(rows: DataFrame) -> DataFrame:
    """Every two sets that share a key, are in different components and may be near copies by size and place.

    With the first key they share at places p and q, sets of m and n shingles share min(m - p, n - q) at most.
    A key of more than GROUP sets is cut into shares; every two shares meet in a group of their own.
    """
    split = rows.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.ceil(F.count("*") / GROUP).cast("int").alias("shares")).where("low <> high")
    rows = rows.join(split.select("key", "shares"), "key").withColumn("own", F.pmod(F.xxhash64("node"), F.col("shares")).cast("int"))
    others = F.explode(F.sequence(F.lit(0), F.col("shares") - 1))
    left = rows.select("key", F.col("own").alias("x"), others.alias("y"), F.col("node").alias("a"), F.col("size").alias("m"), F.col("pos").alias("p"), F.col("root").alias("r"))
    right = rows.select("key", others.alias("x"), F.col("own").alias("y"), F.col("node").alias("b"), F.col("size").alias("n"), F.col("pos").alias("q"), F.col("root").alias("s"))
    met = left.join(right, ["key", "x", "y"]).where((F.col("a") < F.col("b")) & (F.col("r") != F.col("s")) & may_be_near("m", "n"))
    pairs = met.groupBy("a", "b").agg(F.least(F.first("m") - F.min("p"), F.first("n") - F.min("q")).alias("most"), (F.first("m") + F.first("n")).alias("both"))
    enough = F.col("most") * (SIMILARITY[0] + SIMILARITY[1]) >= F.col("both") * SIMILARITY[0]
    return pairs.where(enough).select("a", "b")


def similar_sets(docs: DataFrame, classes: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(a, b): links between near copies that join the same nodes of ``classes`` (node, fp, c1, c2, k1, k2) as all links would.

    First the sets with near fingerprints are compared. Then the sets that share a key are compared with one of
    them, which joins a group of copies without listing its pairs. After some rounds, each with other middles, every pair that still lies in two
    components is compared, so that no link between components is lost.
    """
    keys = shared_keys(docs, classes)
    texts = texts_of(docs, keys, classes)
    tried = links = roots = None
    for step in range(rounds + 1):
        rows = keys.withColumn("root", F.col("node"))
        if roots is not None:
            rows = keys.join(roots.withColumnRenamed("root", "r"), "node", "left").select("key", "node", "size", "pos", F.coalesce("r", "node").alias("root"))
        pairs = cross_pairs(rows) if step == rounds else star_pairs(rows, step) if step else simhash_pairs(classes, texts)
        if tried is not None:
            either = tried.union(tried.select(F.col("b").alias("a"), F.col("a").alias("b")))
            pairs = pairs.join(either, ["a", "b"], "left_anti")
        pairs = stored(pairs, "copy-pairs")
        found = stored(verified(pairs, texts), "copy-links")
        tried = pairs if tried is None else tried.union(pairs)
        links = found if links is None else links.union(found)
        if step < rounds:
            roots = components(links, "copy-roots")
    return links


def near_copies(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, k1, k2, root (a node), component_id."""
    marked = docs.select("doc_id", *common.identity(), set_classes()(F.coalesce("text", F.lit(""))).alias("c"))
    marked = stored(marked.select("doc_id", "k1", "k2", "c.c1", "c.c2", "c.fp"), "set-names")
    classes = marked.groupBy("c1", "c2").agg(F.min("doc_id").alias("first"), F.min(F.struct("k1", "k2")).alias("key"), F.min("fp").alias("fp"))
    classes = stored(classes.select(F.monotonically_increasing_id().alias("node"), "c1", "c2", "fp", "first", "key.k1", "key.k2"), "set-classes")
    roots = components(similar_sets(docs, classes), "copies").withColumnRenamed("node", "member")
    labelled = classes.join(roots, F.col("node") == F.col("member"), "left").select("c1", "c2", "first", F.coalesce("root", "node").alias("root"))
    least = labelled.groupBy("root").agg(F.min("first").alias("component_id"))
    named = labelled.join(least, "root").select("c1", "c2", "root", "component_id")
    return marked.join(named, ["c1", "c2"]).select("doc_id", "k1", "k2", "root", "component_id")


def one_of_each(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """Of each component in ``groups`` the document with the smallest id; of equal rows one."""
    kept = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select("k1", "k2", "root").distinct()
    kept = kept.groupBy("root").agg(F.min(F.struct("k1", "k2")).alias("key")).select("key.*")
    names = docs.columns
    keyed = common.packed(docs, *common.identity())
    chosen = keyed.join(kept, ["k1", "k2"], "left_semi")
    once = chosen.dropDuplicates(["k1", "k2"])
    return common.unpacked(once, names)


def keep_one(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of op6_simhash the document with the smallest id stays; of equal rows one."""
    return one_of_each(docs, near_duplicates(docs))


def keep_one_copy(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage: of each component of near copies the document with the smallest id stays; of equal rows one."""
    return one_of_each(docs, common.settled(lambda: near_copies(docs), "copy-groups"))
