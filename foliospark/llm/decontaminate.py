"""Benchmark decontamination: SimHash of item-sized windows, a multi-index over Hamming blocks, exact verification.

Words are runs of ASCII letters and digits and of characters beyond ASCII, in lower case; shingles are
five words. A document matches an item when a stretch of it holds shingles of the item with at
least ``SIMILARITY`` of the item's weight. A shingle weighs more the fewer items of the whole benchmark have it; the weights
are counted once by Spark, whatever the number of passes.

Windows. An item has one fingerprint, the weighted SimHash of its shingles. A document is searched with all of its windows
as long as an item; one that holds no shingle of the benchmark can't match and is left out.

Index. A fingerprint is cut into ``BLOCKS``; two within ``RADIUS`` bits differ in at most RADIUS // blocks bits in one of them.
All values that near are listed per block, so every window within the radius of an item is found. At a similarity of
0.8 about a fifth of the bits differ, with a spread of three; the radius lies three spreads above (measured in the tests: 0.99 and more
of the matches). As bits can't promise a match, an exact supplement adds the places of each item's heaviest shingles, of which no match
can lack all; so all matches are found. Candidates are verified on the shingles.

Items go to the tasks ``ITEMS`` at a time, which bounds the broadcast; a larger benchmark takes more
passes over the documents, and their hits are joined by document. The results don't depend on the passes.

Defined cases: null and empty texts have no words and match nothing; items without words or without an id are left out.
A text or item with fewer than five words has one shingle, the whole sequence, so such an item matches
only documents that consist of it. Repeated items are reported each. Repeated rows get equal answers.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from foliospark.llm import common
from foliospark.llm.common import mix, powers, stored

WORDS = 5
SIMILARITY = 0.8
RADIUS = 23
BLOCKS = (8,) * 8
BASES = np.array([sum(1 << w for w in BLOCKS[:i]) for i in range(len(BLOCKS))])  # where a block's values begin in a table
ITEMS = 2_000
PIECE = 1 << 19  # characters searched at once
KNOWN_BITS = 20  # of a table that tells most shingles apart from the benchmark's
CHUNK = 1 << 12  # windows with their sums of bits
HITS = "array<struct<item_id:bigint,similarity:double>>"
U = np.uint64
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
SPREAD = mix(np.arange(1, 257, dtype=U))
IN_WORD = np.array([c >= 128 or chr(c).isalnum() for c in range(256)])
FACTORS = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], U)


def registered(counts: Counter, weights: dict[int, float]) -> set[int]:
    """The heaviest shingles of an item that a match can't all lack."""
    held = sorted(((n * weights[h], h) for h, n in counts.items()), reverse=True)
    out, left = set(), sum(w for w, _ in held)
    enough = left * (SIMILARITY - 1e-9)
    for weight, h in held:
        if left < enough:
            break
        out.add(h)
        left -= weight
    return out


def words_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A hash per word, and words per text. Hashes come from prefix sums, for all words at once."""
    parts = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n".join(parts), np.uint8)
    inside = np.concatenate([[False], IN_WORD[data], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    power, inverse = powers(BASE, len(data) + 1), powers(INVERSE, len(data) + 1)
    sums = np.concatenate([[U(0)], np.cumsum(SPREAD[data] * power[: len(data)], dtype=U)])
    hashes = mix((sums[ends] - sums[starts]) * inverse[starts]) ^ (ends - starts).astype(U)
    bounds = np.cumsum([len(p) + 1 for p in parts])
    return hashes, np.diff(np.searchsorted(starts, bounds), prepend=0)


def shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles in order, and shingles per text."""
    words, counts = words_of(texts)
    owner, ends = np.repeat(np.arange(len(texts)), counts), np.cumsum(counts)
    short = np.flatnonzero((counts > 0) & (counts < WORDS))
    total = max(0, len(words) - WORDS + 1)
    sums = np.zeros(total, U)
    for i in range(WORDS):
        sums += words[i : i + total] * FACTORS[i]
    inside = owner[:total] == owner[len(owner) - total :]
    out, belongs = mix(sums[inside]), owner[:total][inside]
    if len(short):
        whole = np.array([mix(np.sum(words[ends[i] - counts[i] : ends[i]] * FACTORS[: counts[i]], keepdims=True) + U(counts[i]))[0] for i in short], U)
        order = np.argsort(np.concatenate([belongs, short]), kind="stable")
        out, belongs = np.concatenate([out, whole])[order], np.concatenate([belongs, short])[order]
    return out, np.bincount(belongs, minlength=len(texts))


def bit_sums(hashes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Running sums, per bit, of the weights of the hashes that have it less those that don't."""
    signs = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).astype(np.int64) * 2 - 1
    return np.concatenate([np.zeros((1, 64), np.int64), np.cumsum(signs * weights[:, None], axis=0)])


def simhashes(sums: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """Fingerprints of the windows of ``size`` hashes: the bits that more than half of a window's weight has."""
    return np.packbits(sums[starts + size] > sums[starts], axis=1).view(">u8").ravel().astype(U)


def whole_weight(weight: float | np.ndarray) -> np.ndarray:
    """Weights as whole numbers, so that sums of bits are exact."""
    return np.maximum(1, np.rint(np.asarray(weight) * 64)).astype(np.int64)


def starts_around(places: np.ndarray, first: np.ndarray, last: np.ndarray, size: int, total: int) -> np.ndarray:
    """Starts of the windows that hold one of some places and lie in its text, first..last. A shorter text is one window."""
    low, high = np.maximum(first, places - size + 1), np.minimum(places, last - size)
    marks = np.zeros(total + 1, np.int64)
    fits = high >= low
    np.add.at(marks, low[fits], 1)
    np.add.at(marks, high[fits] + 1, -1)
    return np.flatnonzero(np.cumsum(marks[:-1]) > 0)


def blocks(values: np.ndarray) -> list[np.ndarray]:
    out, shift = [], 64
    for width in BLOCKS:
        shift -= width
        out.append(((values >> U(shift)) & U((1 << width) - 1)).astype(np.int64))
    return out


class Index:
    """Some items of a benchmark of ``total`` items: their fingerprints by size, each size with one table of the values of all blocks."""

    def __init__(self, items: list[tuple[int, np.ndarray, np.ndarray]], total: int):
        """items: (item_id, hashes of its shingles, number of items that have each)."""
        self.ids = [i for i, _, _ in items]
        self.shingles = [h for _, h, _ in items]
        self.weights = {h: float(np.log1p(total / n)) for _, hashes, often in items for h, n in zip(hashes.tolist(), often.tolist())}
        self.rare = float(np.log1p(total))  # the weight of a shingle that no item has
        self.counts = [Counter(own.tolist()) for own in self.shingles]
        self.totals = [sum(n * self.weights[h] for h, n in c.items()) for c in self.counts]
        self.known = np.array(sorted(self.weights), U)
        self.known_weights = np.array([self.weights[h] for h in self.known.tolist()])
        self.maybe = np.zeros(1 << KNOWN_BITS, bool)
        self.maybe[(self.known & U((1 << KNOWN_BITS) - 1)).astype(np.int64)] = True
        by_size: dict[int, list] = {}
        heavy: list[tuple[int, int, int]] = []
        for k, own in enumerate(self.shingles):
            if len(own):
                by_size.setdefault(len(own), []).append(k)
                some = registered(self.counts[k], self.weights)
                heavy += [(h, k, at) for at, h in enumerate(own.tolist()) if h in some]
        heavy.sort()
        self.heavy = tuple(np.array([x[i] for x in heavy], U if not i else np.int64) for i in range(3))
        self.sizes = {}
        for size, which in by_size.items():
            prints = np.concatenate([simhashes(bit_sums(self.shingles[k], whole_weight([self.weights[h] for h in self.shingles[k].tolist()])), np.zeros(1, np.int64), size) for k in which])
            near, held = [], []
            for own, width, base in zip(blocks(prints), BLOCKS, BASES):
                flips = [sum(1 << b for b in f) for e in range(RADIUS // len(BLOCKS) + 1) for f in combinations(range(width), e)]
                near.append(base + (own[:, None] ^ np.array(flips)).ravel())
                held.append(np.repeat(np.arange(len(own)), len(flips)))
            near, held = np.concatenate(near), np.concatenate(held)
            order = np.argsort(near, kind="stable")
            places = np.searchsorted(near[order], np.arange(BASES[-1] + (1 << BLOCKS[-1]) + 1))
            tables = (places, held[order])
            self.sizes[size] = (prints, np.array(which), tables)

    def candidates(self, own: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(window, item of this size) for every two within the radius, each once."""
        prints, _, (places, held) = self.sizes[size]
        keys = (np.stack(blocks(own), 1) + BASES).ravel()
        low = places[keys]
        n = places[keys + 1] - low
        w = np.repeat(np.repeat(np.arange(len(own)), len(BLOCKS)), n)
        o = held[np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())]
        ok = np.bitwise_count(own[w] ^ prints[o]) <= RADIUS
        each = np.unique(w[ok] * len(prints) + o[ok])
        return each // len(prints), each % len(prints)

    def known_places(self, hashes: np.ndarray) -> np.ndarray:
        """Where a shingle of the benchmark stands."""
        some = np.flatnonzero(self.maybe[(hashes & U((1 << KNOWN_BITS) - 1)).astype(np.int64)])
        if not len(self.known):
            return some[:0]
        at = np.minimum(np.searchsorted(self.known, hashes[some]), len(self.known) - 1)
        return some[self.known[at] == hashes[some]]

    def by_windows(self, hashes: np.ndarray, places: np.ndarray, first: np.ndarray, last: np.ndarray) -> list[np.ndarray]:
        """(item, start) of the windows whose fingerprint is near an item's. first, last: where each hash's text lies.

        Only what lies as near to a shingle of the benchmark (``places``) as a window may reach is looked at.
        """
        reach, marks = max(self.sizes), np.zeros(len(hashes) + 1, np.int64)
        np.add.at(marks, np.maximum(first[places], places - reach + 1), 1)
        np.add.at(marks, np.minimum(last[places], places + reach), -1)
        here = np.flatnonzero(np.cumsum(marks[:-1]) > 0)
        # The same places and texts, counted among what is looked at.
        low, high = np.searchsorted(here, first[places]), np.searchsorted(here, last[places])
        cuts = np.flatnonzero(np.diff(here) > 1) + 1  # a window must not span what was left out
        own = np.searchsorted(here, places)
        run = np.searchsorted(cuts, own, "right")
        edges = np.concatenate([[0], cuts, [len(here)]])
        low, high = np.maximum(low, edges[run]), np.minimum(high, edges[run + 1])
        weights = np.full(len(here), self.rare)
        weights[own] = self.known_weights[np.searchsorted(self.known, hashes[places])]
        sums, out = bit_sums(hashes[here], whole_weight(weights)), []
        for size, (_, which, _) in self.sizes.items():
            starts = starts_around(own, low, high, size, len(here))
            for a in range(0, len(starts), CHUNK):
                some = starts[a : a + CHUNK]
                w, o = self.candidates(simhashes(sums, some, size), size)
                out.append(np.stack([which[o], here[some[w]]], 1))
        return out

    def by_shingles(self, hashes: np.ndarray, places: np.ndarray) -> list[np.ndarray]:
        """(item, start, place) by the items' heaviest shingles: the exact supplement."""
        value, item, offset = self.heavy
        low, high = np.searchsorted(value, hashes[places], "left"), np.searchsorted(value, hashes[places], "right")
        n = high - low
        w = np.repeat(places, n)
        o = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return [np.stack([item[o], w - offset[o], w], 1)]

    def search(self, texts: list[str], exact: bool = True) -> list[dict[int, float]]:
        """For each text its items (positions) with their similarity, where it reaches SIMILARITY.

        Without ``exact`` the fingerprints alone give the candidates.
        """
        hashes, counts = shingles(texts)
        out = [{} for _ in texts]
        if not len(hashes):
            return out
        ends, known = np.cumsum(counts), self.known_places(hashes)
        if not len(known):
            return out
        owner = np.repeat(np.arange(len(texts)), counts)
        first, last = (ends - counts)[owner], ends[owner]
        places = [np.concatenate([owner[p[:, 1]][:, None], p], 1) for p in self.by_windows(hashes, known, first, last)]
        if exact:
            places += [np.stack([owner[p[:, 2]], p[:, 0], p[:, 1]], 1) for p in self.by_shingles(hashes, known)]
        if not places:
            return out
        before = (-1, -1, 0)
        for doc, k, at in np.unique(np.concatenate(places), axis=0).tolist():
            # What is verified reaches further than this on both sides.
            if (doc, k) == before[:2] and at < before[2] + WORDS:
                continue
            before = (doc, k, at)
            if out[doc].get(k, 0) >= 1:
                continue
            m = len(self.shingles[k])
            slack = m // 4 + WORDS
            low, high = max(at - slack, ends[doc] - counts[doc]), min(at + m + slack, ends[doc])
            here = Counter(hashes[low:high].tolist())
            shared = sum(min(n, here[h]) * self.weights[h] for h, n in self.counts[k].items() if h in here)
            similarity = min(1.0, round(shared / self.totals[k], 12))
            if similarity >= SIMILARITY and similarity > out[doc].get(k, 0):
                out[doc][k] = similarity
        return out


def hits(spark, index: Index):
    """Column function text -> (item_id, similarity) of the items it holds, by item_id."""
    shared = spark.sparkContext.broadcast(index)

    @pandas_udf(HITS)
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = shared.value
        for series in batches:
            texts, out = common.strings(series), []
            for a, b in common.bounded(texts, PIECE):
                for found in own.search(texts[a:b]):
                    out.append(sorted(({"item_id": own.ids[k], "similarity": s} for k, s in found.items()), key=lambda x: (x["item_id"], x["similarity"])))
            yield pd.Series(out, dtype=object)

    return find


def weighed(benchmark: DataFrame) -> DataFrame:
    """(uid, item_id, hashes, often): the shingles of every item in order, each with the number of items that have it."""
    rows = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), "text").where("item_id is not null and text is not null")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            hashes, counts = shingles(texts := common.strings(batch["text"]))
            each = np.split(hashes.view(np.int64), np.cumsum(counts)[:-1]) if len(texts) else []
            yield pd.DataFrame({"item_id": batch["item_id"], "hashes": each})

    items = rows.mapInPandas(cut, "item_id bigint, hashes array<bigint>").where(F.size("hashes") > 0)
    items = stored(items.withColumn("uid", F.monotonically_increasing_id()), "benchmark-items")
    often = items.select("uid", F.explode("hashes").alias("h")).distinct().groupBy("h").agg(F.count("*").alias("n"))
    each = items.select("uid", F.posexplode("hashes").alias("at", "h")).join(often, "h")
    own = each.groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("at", "n"))).alias("own"))  # as long as one item
    return stored(items.join(own, "uid").select("uid", "item_id", "hashes", F.col("own.n").alias("often")), "benchmark-weights")


def indexes(benchmark: DataFrame, items: int = ITEMS) -> Iterator[Index]:
    """Indexes of at most ``items`` items each; the driver holds one of them at a time."""
    rows = weighed(benchmark)
    total, some = rows.count(), []
    for row in rows.select("item_id", "hashes", "often").toLocalIterator():
        some.append((row[0], np.array(row[1], np.int64).view(U), np.array(row[2], np.int64)))
        if len(some) == items:
            yield Index(some, total)
            some = []
    if some:
        yield Index(some, total)


def found(docs: DataFrame, benchmark: DataFrame, items: int = ITEMS) -> DataFrame:
    """``row`` (all columns of ``docs``) and ``hits``: the benchmark items in the text, by item_id."""
    spark, made = docs.sparkSession, []
    rows = common.packed(docs)
    several = indexes(benchmark, items)
    first = next(several, None)
    if first is None:
        return rows.withColumn("hits", F.array().cast(HITS))
    second = next(several, None)
    if second is None:
        return rows.withColumn("hits", hits(spark, first)(F.coalesce(F.col("row.text"), F.lit(""))))
    source = docs.select(*common.identity(), "text")
    for index in (x for part in ([first, second], several) for x in part):
        made.append(stored(source.select("k1", "k2", F.explode(hits(spark, index)(F.col("text"))).alias("hit")), "hits"))
    every = made[0]
    for more in made[1:]:
        every = every.union(more)
    every = every.distinct().groupBy("k1", "k2").agg(F.sort_array(F.collect_list("hit")).alias("hits"))  # at most one per item and text
    keyed = common.packed(docs, *common.identity())
    return keyed.join(every, ["k1", "k2"], "left").select("row", F.coalesce("hits", F.array().cast(HITS)).alias("hits"))


def op8_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Each document with the benchmark items it holds."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held = found(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return held.select(
        F.col("row.doc_id").alias("doc_id"), F.size("hits").cast("long").alias("n_items"), F.col("hits.item_id").alias("items"),
        F.coalesce(F.array_max("hits.similarity"), F.lit(0.0)).alias("similarity"),
    )


def keep_clean(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage: documents that hold a benchmark item go."""
    held = found(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return common.unpacked(held.where(F.size("hits") == 0), docs.columns)
