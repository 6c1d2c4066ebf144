"""Repeated byte strings by per-shard suffix arrays.

A byte goes if a string of ``LENGTH`` bytes that covers it starts anywhere else, too, in any document.

Shards. Each start of a string has an anchor: among the ``GRAM``-byte grams inside the string, the one with
the smallest hash, the leftmost of equal ones. Equal strings have equal anchors, so only starts with one
anchor need to be compared. Consecutive starts with the same anchor form a region of text. A region
that occurs twice is repeated as a whole. Different regions with one anchor go to the shard of the
anchor, where a suffix array (Larsson-Sadakane refinement) and common prefixes (Kasai, all regions
in step) tell which starts are repeated. An anchor with more than ``SHARD`` bytes is cut into several shards, and every two of
them are merged by binary search of the strings of one in the suffix array of the other.

The text of a region moves only if its anchor has other regions; the text of a document only if it
loses something. Both are told by filters of constant size that may let through more.

Defined cases: null and empty texts, and those shorter than LENGTH bytes, lose nothing. Matches never
cross documents. Rows equal in id and text are two documents that repeat each other. Overlaps count, within a document, too.
An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from foliospark.llm import common
from foliospark.llm.common import mix, powers, stored

LENGTH = 400
GRAM = 128
PIECE = 1 << 19  # bytes searched at once; a longer text comes in overlapping pieces
PLACE = 21  # bits that hold a place in a piece
SHARD = 1 << 20  # bytes
FILTER_BITS = 26
LANES = 1 << 14  # strings compared at once
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
SPREAD = mix(np.arange(1, 257, dtype=np.uint64))
U = np.uint64


def split_long(texts: list[bytes], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(owner, first byte, parts): all texts in pieces of about PIECE bytes that share length - 1 bytes."""
    owner, first, parts, size = [], [], [], 0
    for i, text in enumerate(texts):
        for at in range(0, max(1, len(text) - length + 1), PIECE):
            part = text[at : at + PIECE + length - 1]
            if len(part) >= length:
                owner.append(i)
                first.append(at)
                parts.append(part)
                size += len(part)
            if size >= PIECE:
                yield np.array(owner), np.array(first), parts
                owner, first, parts, size = [], [], [], 0
    if parts:
        yield np.array(owner), np.array(first), parts


def regions(parts: list[bytes], length: int = LENGTH, gram: int = GRAM):
    """(part, low, high, anchor, hash): for every run of starts low..high in a part with one anchor, and its text's hash."""
    data = np.frombuffer(b"".join(parts), np.uint8)
    n = len(data)
    sums = np.concatenate([[U(0)], np.cumsum(SPREAD[data] * powers(BASE, n), dtype=U)])
    inverse = powers(INVERSE, n + 1)
    grams = mix((sums[gram:] - sums[:-gram]) * inverse[: n - gram + 1])
    ranked = (grams & ~U((1 << PLACE) - 1)) | np.arange(len(grams), dtype=U)
    window, count = length - gram + 1, n - length + 1
    blocks = -(-len(ranked) // window)
    padded = np.full(blocks * window, ~U(0))
    padded[: len(ranked)] = ranked
    grid = padded.reshape(blocks, window)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    place = (np.minimum(behind[:count], ahead[window - 1 : window - 1 + count]) & U((1 << PLACE) - 1)).astype(np.int64)
    ends = np.cumsum([len(p) for p in parts])
    begins = ends - [len(p) for p in parts]
    part = np.searchsorted(begins, np.arange(count), "right") - 1
    valid = np.arange(count) + length <= ends[part]
    change = np.flatnonzero((place[1:] != place[:-1]) | (part[1:] != part[:-1]) | (valid[1:] != valid[:-1])) + 1
    low = np.concatenate([[0], change])
    high = np.concatenate([change, [count]]) - 1
    low, high = low[valid[low]], high[valid[low]]
    own = part[low]
    size = high - low + length
    text = mix((sums[low + size] - sums[low]) * inverse[low] + size.astype(U))
    return own, low - begins[own], high - begins[own], grams[place[low]], text


def runs(docs: DataFrame) -> DataFrame:
    """(k1, k2, low, high, anchor, region): the runs of starts of every document."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, texts in common.pieces(batch.column("text"), PIECE):
                for owner, first, parts in split_long([t.encode("utf-8", "surrogatepass") for t in texts], LENGTH):
                    own, low, high, anchor, text = regions(parts)
                    rows = pa.array(owner[own] + x)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("k1").take(rows), batch.column("k2").take(rows), pa.array(first[own] + low), pa.array(first[own] + high),
                         pa.array(anchor.view(np.int64)), pa.array(text.view(np.int64))],
                        names=["k1", "k2", "low", "high", "anchor", "region"],
                    )

    source = docs.select(*common.identity(), "text")
    return source.mapInArrow(find, "k1 long, k2 int, low long, high long, anchor long, region long")


def texts_of(docs: DataFrame, wanted: np.ndarray) -> DataFrame:
    """(anchor, region, bytes) of the regions that may be wanted, about once per task."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recent = np.zeros(1 << 16, U)
        for batch in batches:
            for _, texts in common.pieces(batch.column("text"), PIECE):
                for _, _, parts in split_long([t.encode("utf-8", "surrogatepass") for t in texts], LENGTH):
                    own, low, high, anchor, text = regions(parts)
                    some = np.flatnonzero(common.in_bitmap(shared.value, text))
                    some = some[recent[(text[some] & U(0xFFFF)).astype(np.int64)] != text[some]]
                    recent[(text[some] & U(0xFFFF)).astype(np.int64)] = text[some]
                    cut = [parts[own[i]][low[i] : high[i] + LENGTH] for i in some]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(anchor[some].view(np.int64)), pa.array(text[some].view(np.int64)), pa.array(cut, pa.binary())], names=["anchor", "region", "bytes"]
                    )

    return docs.select("text").mapInArrow(find, "anchor long, region long, bytes binary")


class Shard:
    """Some texts, a byte value of zero after each, with their suffix array."""

    def __init__(self, texts: list[bytes]):
        # UTF-8 has no byte 255, so every value can move up by one.
        self.lengths = np.array([len(t) for t in texts], np.int64)
        self.offsets = np.cumsum(self.lengths + 1) - self.lengths - 1
        raw = np.frombuffer(b"\xff".join(texts) + b"\xff", np.uint8) + np.uint8(1)
        self.text = np.concatenate([raw, np.zeros(LENGTH + 16, np.uint8)])
        self.n = len(raw)
        self.wide = np.ndarray((len(self.text) - 7,), ">u8", self.text, strides=(1,)).astype(U)  # the eight bytes from each place
        self.sa, self.rank = suffix_array(self.wide[: self.n], self.n)

    def common_prefixes(self, most: int) -> np.ndarray:
        """[r]: what suffixes r - 1 and r of the order share, up to ``most``. Kasai, one lane per text."""
        out, lanes = np.zeros(self.n, np.int64), np.argsort(-self.lengths, kind="stable")
        have = np.zeros(len(lanes), np.int64)
        sizes = self.lengths[lanes]
        for step in range(int(sizes[0]) if len(sizes) else 0):
            active = int(np.searchsorted(-sizes, -step, "left"))  # lanes longer than ``step``
            i = self.offsets[lanes[:active]] + step
            r = self.rank[i]
            h = np.maximum(have[:active] - 1, 0)
            h[r == 0] = 0
            j = self.sa[np.maximum(r - 1, 0)]
            on = np.flatnonzero((r > 0) & (h < most))
            while len(on):  # eight bytes at a time
                differ = self.wide[i[on] + h[on]] ^ self.wide[j[on] + h[on]]
                h[on] += sum((differ < U(1 << 8 * k)).astype(np.int64) for k in range(8))
                on = on[(differ == 0) & (h[on] < most)]
            h = np.minimum(h, most)
            out[r] = h
            have[:active] = h
        return out

    def starts(self, length: int) -> np.ndarray:
        """For each suffix in order whether ``length`` bytes of one text follow."""
        text = np.searchsorted(self.offsets, self.sa, "right") - 1
        return self.sa + length <= (self.offsets + self.lengths)[text]

    def strings(self, at: np.ndarray, length: int) -> np.ndarray:
        view = np.ndarray((len(self.text) - length + 1,), f"S{length}", self.text, strides=(1,))
        return view[at]

    def ranges(self, repeated: np.ndarray, length: int) -> list[list[tuple[int, int]]]:
        """For each text the ranges (first, last) of repeated starts."""
        flag = np.zeros(self.n + 2, np.int8)
        flag[repeated + 1] = 1
        edges = np.diff(flag)
        low, high = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1) - 1
        text = np.searchsorted(self.offsets, low, "right") - 1
        out = [[] for _ in self.lengths]
        for t, a, b in zip(text.tolist(), (low - self.offsets[text]).tolist(), (high - self.offsets[text]).tolist()):
            out[t].append((a, b))
        return out


def suffix_array(wide: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and ranks: sorted by eight bytes, then unsorted groups by the rank of what follows them."""
    sa = np.argsort(wide, kind="stable")
    new = np.concatenate([[True], wide[sa][1:] != wide[sa][:-1]])
    last = np.concatenate([np.flatnonzero(new)[1:], [n]]) - 1
    rank = np.empty(n, np.int64)
    rank[sa] = last[np.cumsum(new) - 1]  # a group's rank is its last place
    depth = 8
    sizes = np.diff(np.concatenate([[-1], last]))
    places = np.flatnonzero(np.repeat(sizes > 1, sizes))
    while len(places):
        at = sa[places]
        after = np.where(at + depth < n, rank[np.minimum(at + depth, n - 1)] + 1, 0)
        key = (rank[at].astype(U) << U(32)) | after.astype(U)
        order = np.argsort(key, kind="stable")
        at, key = at[order], key[order]
        sa[places] = at
        new = np.concatenate([[True], key[1:] != key[:-1]])
        ends = np.concatenate([np.flatnonzero(new)[1:], [len(key)]]) - 1
        group = np.cumsum(new) - 1
        rank[at] = places[ends[group]]
        sizes = np.diff(np.concatenate([[-1], ends]))
        places = places[np.repeat(sizes > 1, sizes)]
        depth *= 2
    return sa, rank


def repeated_inside(shard: Shard, length: int = LENGTH) -> np.ndarray:
    """Starts of strings that start elsewhere in the shard."""
    shared = (shard.common_prefixes(length) >= length) & shard.starts(length)
    either = shared.copy()
    either[:-1] |= shared[1:]
    return shard.sa[either]


def repeated_across(one: Shard, other: Shard, length: int = LENGTH) -> np.ndarray:
    """Starts in ``one`` of strings that start in ``other``: binary search in its suffix array."""
    own, sa = one.sa[one.starts(length)], other.sa[other.starts(length)]
    found = []
    for x in range(0, len(own), LANES):
        wanted = one.strings(own[x : x + LANES], length)
        low, high = np.zeros(len(wanted), np.int64), np.full(len(wanted), len(sa))
        while (low < high).any():
            middle = np.minimum((low + high) // 2, len(sa) - 1)
            less = (other.strings(sa[middle], length) < wanted) & (low < high)
            low, high = np.where(less, middle + 1, low), np.where(less, high, np.minimum(high, middle))
        hit = low < len(sa)
        hit[hit] = other.strings(sa[low[hit]], length) == wanted[hit]
        found.append(own[x : x + LANES][hit])
    return np.concatenate(found) if found else np.zeros(0, np.int64)


RANGES = "array<struct<first:bigint,last:bigint>>"


def search_shard(batch: pd.DataFrame) -> pd.DataFrame:
    """Ranges of repeated starts per region of one shard, or of two shards of one anchor that are merged."""
    left, right = batch[batch["side"] == 0], batch[batch["side"] == 1]
    one = Shard(list(left["bytes"]))
    if len(right):
        other = Shard(list(right["bytes"]))
        results = [(left, one, repeated_across(one, other)), (right, other, repeated_across(other, one))]
    else:
        results = [(left, one, repeated_inside(one))] if not batch["two"].iat[0] else []
    out = [(a, r, [{"first": x, "last": y} for x, y in own]) for rows, shard, at in results for a, r, own in zip(rows["anchor"], rows["region"], shard.ranges(at, LENGTH)) if own]
    return pd.DataFrame(out, columns=["anchor", "region", "ranges"])


def repeated_regions(docs: DataFrame, found: DataFrame, shard: int = SHARD) -> DataFrame:
    """(anchor, region, ranges) of the regions of ``found`` with repeated starts; null ranges: all of them."""
    spark = docs.sparkSession
    many = found.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor")
    may = within(spark, common.bitmap(many, "anchor", FILTER_BITS))
    some = found.where(may("anchor"))
    counted = stored(some.groupBy("anchor", "region").agg(F.count("*").alias("times"), F.max(F.col("high") - F.col("low") + LENGTH).alias("size")), "suffix-regions")
    whole = counted.where("times > 1").select("anchor", "region", F.lit(None).cast(RANGES).alias("ranges"))
    kinds = counted.groupBy("anchor").agg(F.count("*").alias("kinds"), F.min("times").alias("least"), F.sum("size").alias("bytes"))
    kinds = stored(kinds.where("kinds > 1 and least = 1").select("anchor", "bytes"), "suffix-anchors")
    compared = counted.join(kinds, "anchor")
    texts = texts_of(docs, common.bitmap(compared.select("region").distinct(), "region", FILTER_BITS))
    texts = texts.groupBy("anchor", "region").agg(F.first("bytes").alias("bytes")).join(kinds.withColumnRenamed("bytes", "total"), "anchor")
    shards = max(1, -(-int(kinds.agg(F.sum("bytes")).first()[0] or 0) // shard))
    # An anchor with more than a shard's bytes has shards of its own, and a group for every two of them.
    own = F.ceil(F.col("total") / shard).cast("int")
    mine = F.pmod(F.xxhash64("region"), own).cast("int")
    small = texts.where(own == 1).select(
        "anchor", "region", "bytes", F.lit(0).cast("long").alias("key"), F.pmod(F.xxhash64("anchor"), F.lit(shards)).cast("int").alias("x"), F.lit(-1).alias("y"),
        F.lit(0).alias("side"), F.lit(False).alias("two"),
    )
    pair = F.explode(F.transform(F.sequence(F.lit(0), own - 1), lambda o: F.struct(F.least(o, mine).alias("x"), F.greatest(o, mine).alias("y"))))
    large = texts.where(own > 1).select("anchor", "region", "bytes", mine.alias("mine"), pair.alias("pair")).select(
        "anchor", "region", "bytes", F.col("anchor").alias("key"), "pair.x", "pair.y", ((F.col("mine") == F.col("pair.y")) & (F.col("pair.x") != F.col("pair.y"))).cast("int").alias("side"),
        (F.col("pair.x") != F.col("pair.y")).alias("two"),
    )
    groups = small.union(large)
    ranged = groups.groupBy("key", "x", "y").applyInPandas(search_shard, f"anchor long, region long, ranges {RANGES}")
    # Regions that occur twice are whole already.
    ranged = ranged.join(whole.select("anchor", "region"), ["anchor", "region"], "left_anti")
    return stored(whole.union(ranged), "suffix-repeated")


def within(spark, bits: np.ndarray):
    """Column function hash -> whether its bit is set."""
    shared = spark.sparkContext.broadcast(bits)

    @pandas_udf("boolean")
    def test(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for values in batches:
            yield pd.Series(common.in_bitmap(shared.value, values.to_numpy()))

    return test


def without(text: str, starts: list, length: int = LENGTH) -> tuple[bytes, int]:
    """The bytes that are left, and the number of runs that went."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    steps = np.zeros(len(data) + 1, np.int64)
    for first, last in starts:
        steps[first] += 1
        steps[last + length] -= 1
    gone = np.cumsum(steps[:-1]) > 0
    return data[~gone].tobytes(), int(np.count_nonzero(np.diff(np.concatenate([[False], gone]).astype(np.int8)) == 1))


def cutter():
    """Column function (text, first starts, last starts) -> what is left and its digest."""

    @pandas_udf("struct<kept:string,n_bytes:bigint,n_removed:bigint,n_spans:bigint,sha:string>")
    def cut(texts: pd.Series, firsts: pd.Series, lasts: pd.Series) -> pd.DataFrame:
        out = []
        for text, a, b in zip(common.strings(texts), firsts, lasts):
            n = len(text.encode("utf-8", "surrogatepass"))
            left, spans = without(text, list(zip(a, b)) if a is not None else [])
            out.append((left.decode("utf-8", "replace"), n, n - len(left), spans, hashlib.sha256(left).hexdigest()))
        return pd.DataFrame(out, columns=["kept", "n_bytes", "n_removed", "n_spans", "sha"])

    return cut


def deduplicated(docs: DataFrame, shard: int = SHARD) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and ``kept``, the text that is left
    (null where nothing went; bytes of a character cut in two read as U+FFFD)."""
    docs = docs.select("doc_id", "text")
    found = stored(runs(docs), "suffix-runs")
    repeated = repeated_regions(docs, found, shard)
    may = within(docs.sparkSession, common.bitmap(repeated.select("region").distinct(), "region", FILTER_BITS))
    hits = found.where(may("region")).join(repeated, ["anchor", "region"])
    all_of = F.array(F.struct(F.lit(0).cast("long").alias("first"), (F.col("high") - F.col("low")).alias("last")))
    hits = hits.select("k1", "k2", "low", F.explode(F.coalesce("ranges", all_of)).alias("range")).select(
        "k1", "k2", F.struct((F.col("low") + F.col("range.first")).alias("first"), (F.col("low") + F.col("range.last")).alias("last")).alias("starts")
    )
    starts = stored(hits.groupBy("k1", "k2").agg(F.collect_set("starts").alias("starts")), "suffix-starts")  # a document's own
    loses = within(docs.sparkSession, common.bitmap(starts.select("k1").distinct(), "k1", FILTER_BITS))
    keyed = docs.select("doc_id", *common.identity(), F.coalesce("text", F.lit("")).alias("text")).withColumn("loses", loses("k1"))
    data = F.col("text").cast("binary")
    same = keyed.where("not loses").select(
        "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"),
        F.sha2(data, 256).alias("kept_sha256"), F.lit(None).cast("string").alias("kept"),
    )
    less = keyed.where("loses").join(starts, ["k1", "k2"], "left")
    cut = cutter()
    less = less.select("doc_id", cut("text", F.col("starts.first"), F.col("starts.last")).alias("c"))
    return same.union(less.select("doc_id", "c.n_bytes", "c.n_removed", "c.n_spans", F.col("c.sha").alias("kept_sha256"), "c.kept"))


def op7_suffix(spark, sf_dir: str) -> DataFrame:
    return deduplicated(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("kept")
