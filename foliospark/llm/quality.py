"""Quality classifier: logistic regression on hashed word n-grams, trained with follow-the-regularised-leader.

Features of a text are n-grams over its words (runs without white space), hashed to 2**BITS slots:
single words without their punctuation, pairs of them, and pairs of word shapes (letter case,
punctuation kept, equal to the word before or not). A feature's value is ``SCALE`` times its share of
the words, so a score is a sparse dot product that doesn't grow with the length.

Training takes at most ``sample`` labelled rows (those with the smallest hash of the id), shares them
out to at most ``SHARDS`` tasks of at least ``SHARD_ROWS`` rows, runs the per-coordinate proximal
updates in each and averages the weights. A shard makes at least ``UPDATES`` of them.
Only labels and texts are read; lang, source and doc_id never enter a feature.

Defined cases: a null, empty or white-space text has one feature of its own. Null labels, and labels
other than 0 and 1, are left out; a document with both labels is trained with both. If a label is
missing altogether, every score is 0.5. Repeated rows get equal answers; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from foliospark.llm import common

BITS = 18
SAMPLE = 20_000
SHARDS = 8
SHARD_ROWS = 2_000
UPDATES = 8_000
SCALE = 8.0
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-5, 1e-4
PIECE = 1 << 20  # characters tokenised at once
CACHE = 1 << 17  # words whose hashes a worker remembers
PUNCTUATION = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
EMPTY = 1  # hash of a text without words


def word_hashes(word: str) -> tuple[int, int]:
    """(word without punctuation and case, shape)."""
    core = word.strip(PUNCTUATION)
    if not core:
        case = "-"
    elif core.islower():
        case = "x"
    elif core.isupper():
        case = "X" if len(core) > 1 else "I"
    elif core.istitle():
        case = "Xx"
    else:
        case = "9" if any(c.isdigit() for c in core) else "m"
    head = word[: len(word) - len(word.lstrip(PUNCTUATION))] if core else ""
    tail = word[len(word.rstrip(PUNCTUATION)) :] if core else word
    shape = f"{head[:4]} {case} {tail[:4]}"
    return xxhash.xxh64_intdigest(core.lower().encode("utf-8", "surrogatepass"), 1), xxhash.xxh64_intdigest(shape.encode("utf-8", "surrogatepass"), 2)


class Featurizer:
    """Texts to feature slots. Remembers the hashes of words it has seen, up to a bound."""

    def __init__(self, bits: int = BITS):
        self.bits, self.known = bits, {}

    def tokens(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word hashes, shape hashes, and words per text."""
        lists = pc.utf8_split_whitespace(pa.array(texts, pa.large_string()))
        flat = lists.flatten().dictionary_encode()
        offsets = lists.offsets.to_numpy()
        unique = flat.dictionary.to_pylist()
        if len(self.known) > CACHE:
            self.known = {}
        known = self.known
        pairs = np.array([known.get(w) or known.setdefault(w, word_hashes(w)) for w in unique], np.uint64).reshape(-1, 2)
        at = flat.indices.to_numpy()
        counts = np.diff(offsets)
        words, shapes = pairs[at, 0], pairs[at, 1]
        blank = words == np.uint64(xxhash.xxh64_intdigest(b"", 1))
        keep = ~(blank & (shapes == np.uint64(word_hashes("")[1])))  # splitting leaves empty words at the ends
        if not keep.all():
            owner = np.repeat(np.arange(len(texts)), counts)[keep]
            words, shapes, counts = words[keep], shapes[keep], np.bincount(owner, minlength=len(texts))
        return words, shapes, counts

    def slots(self, texts: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
        """Three parallel arrays of slots, one entry per word, and words per text; a text without words has one."""
        words, shapes, counts = self.tokens(texts)
        if (counts == 0).any():
            at = np.cumsum(counts)[counts == 0]
            words, shapes = np.insert(words, at, np.uint64(EMPTY)), np.insert(shapes, at, np.uint64(EMPTY))
            counts = np.maximum(counts, 1)
        first = np.zeros(len(words), bool)
        first[np.cumsum(counts) - counts] = True
        before, shape_before = np.roll(words, 1), np.roll(shapes, 1)
        before[first], shape_before[first] = 0, 0
        same = (before == words).astype(np.uint64)
        mask = np.uint64((1 << self.bits) - 1)
        pair = common.mix(words * np.uint64(3) ^ before)
        shape = common.mix(shapes * np.uint64(5) + shape_before * np.uint64(7) + same)
        return [(h & mask).astype(np.int64) for h in (common.mix(words), pair, shape)], counts

    def vectors(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Sparse vector (slots, values) of each text."""
        arrays, counts = self.slots(texts)
        ends = np.cumsum(counts)
        for a, b in zip(ends - counts, ends):
            slots, n = np.unique(np.concatenate([x[a:b] for x in arrays]), return_counts=True)
            yield slots, (n * (SCALE / (b - a))).astype(np.float32)


def train_shard(rows: list[tuple[np.ndarray, np.ndarray, int]], bits: int, seed: int) -> np.ndarray:
    """Weights and, last, the bias after per-coordinate follow-the-regularised-leader updates."""
    size = (1 << bits) + 1
    z, n = np.zeros(size), np.zeros(size)
    order = np.random.default_rng(seed)

    def weights(at):
        own = z[at]
        return np.where(np.abs(own) <= L1, 0.0, -(own - np.sign(own) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    for _ in range(max(2, -(-UPDATES // max(1, len(rows))))):
        for i in order.permutation(len(rows)):
            slots, values, label = rows[i]
            at, x = np.append(slots, size - 1), np.append(values, 1.0)
            w = weights(at)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - label) * x
            root = np.sqrt(n[at])
            n[at] += g * g
            z[at] += g - (np.sqrt(n[at]) - root) / ALPHA * w
    return weights(np.arange(size))


def train(labelled: DataFrame, sample: int = SAMPLE, bits: int = BITS) -> np.ndarray | None:
    """Weights from (text, label, h): at most ``sample`` rows, already chosen. None if a label is missing."""
    shards = max(1, min(SHARDS, sample // SHARD_ROWS))

    def featurize(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Featurizer(bits)
        for batch in batches:
            texts = common.strings(batch["text"])
            for a, b in common.bounded(texts, PIECE):
                sparse = list(own.vectors(texts[a:b]))
                yield pd.DataFrame({
                    "shard": (batch["h"].to_numpy()[a:b] % shards).astype("int32"), "h": batch["h"].to_numpy()[a:b], "label": batch["label"].to_numpy()[a:b],
                    "slots": [s.astype("<i4").tobytes() for s, _ in sparse], "vals": [v.astype("<f4").tobytes() for _, v in sparse],
                })

    def fit(key: tuple, batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values(["h", "label", "slots"])
        rows = [(np.frombuffer(s, "<i4"), np.frombuffer(v, "<f4"), y) for s, v, y in zip(batch["slots"], batch["vals"], batch["label"])]
        w = train_shard(rows, bits, int(key[0]))
        return pd.DataFrame({"n": [len(rows)], "ones": [int(batch["label"].sum())], "w": [w.astype("<f4").tobytes()]})

    # A shard holds sample / shards rows of at most 2**bits slots each.
    vectors = labelled.mapInPandas(featurize, "shard int, h long, label int, slots binary, vals binary")
    got = vectors.groupBy("shard").applyInPandas(fit, "n long, ones long, w binary").toPandas()
    rows, ones = int(got["n"].sum()), int(got["ones"].sum())
    if not rows or ones in (0, rows):
        return None
    return np.average([np.frombuffer(w, "<f4") for w in got["w"]], axis=0, weights=got["n"]).astype(np.float32)


def scorer(spark, weights: np.ndarray | None, bits: int = BITS):
    """Column function text -> score in 0..1. The weights are 2**bits numbers."""
    shared = spark.sparkContext.broadcast(weights)

    @pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own, w = Featurizer(bits), shared.value
        for series in batches:
            texts, out = common.strings(series), []
            for a, b in common.bounded(texts, PIECE):
                if w is None:
                    out.append(np.full(b - a, 0.5))
                    continue
                arrays, counts = own.slots(texts[a:b])
                each = sum(w[x].astype(np.float64) for x in arrays)
                sums = np.add.reduceat(each, np.cumsum(counts) - counts)
                out.append(1 / (1 + np.exp(-np.clip(sums * SCALE / counts + w[-1], -35, 35))))
            yield pd.Series(np.concatenate(out) if out else np.zeros(0))

    return score


def held_out(doc_id: Column | str) -> Column:
    """Rows no label is learnt from: crc32 of the id as text leaves 1 when divided by 3. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id) % 3 == 1, F.lit(False))


def model(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> np.ndarray | None:
    """Weights learnt from the labelled documents that are not held out."""
    known = (
        labels.where(F.col("quality").isin(0, 1) & ~held_out("doc_id") & F.col("doc_id").isNotNull())
        .select("doc_id", F.col("quality").cast("int").alias("label")).distinct()
        .withColumn("h", F.xxhash64("doc_id").bitwiseAND(F.lit((1 << 62) - 1)))
    )
    chosen = known.orderBy("h", "doc_id", "label").limit(sample)  # the bound makes the broadcast safe
    rows = chosen.agg(F.count("*")).first()[0]
    # A labelled document that stands in many rows is learnt from once.
    learnt = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "label", "h").distinct()
    return train(learnt, rows)


def scored(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``."""
    score = scorer(docs.sparkSession, model(docs, labels, sample))
    return docs.select("doc_id", score(F.col("text")).alias("score")).select(
        "doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def op1_quality(spark, sf_dir: str) -> DataFrame:
    return scored(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def keep_good(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage: documents that the classifier predicts as 0 go."""
    score = scorer(spark, model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    rows = common.packed(docs, score(common.named("text")).alias("score"))
    return common.unpacked(rows.where(F.col("score") >= 0.5), docs.columns)
