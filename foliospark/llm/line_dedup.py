"""Lines that repeat up to a few edits, by a segment-partition join.

Two lines match when they are equal, or when their edit distance (code points) is at most
``edits_for(length of the shorter)``: one edit per 10 code points, at most ``MAX_EDITS``. So a match has
an edit similarity of 0.9 or more. A line of length l that allows t edits is cut into t + 1 segments; t
edits leave one of them whole. Each longer or equally long line looks, for every length l it may
match, for the segments of l at the few places where they can still lie (multi-match-aware
selection). Lines that share such a key are verified by edit distance in a band of 2t + 1 bits.

The join runs on hashes; a line's text moves only when another line shares one of its keys. Equal
lines are one line throughout, with its first occurrence (smallest doc_id, then document key, then line).

Defined cases: a null text is empty, an empty text has one empty line; empty lines never match
another and stay. A null doc_id comes first. Rows equal in id and text are one document. A line goes
if it has occurred before or matches a line that occurred before, itself kept or not. An empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliospark.llm import common
from foliospark.llm.common import mix, powers, stored

MAX_EDITS = 2
PER_EDIT = 10  # code points of the shorter line
PIECE = 1 << 19  # bytes hashed at once
FILTER_BITS = 26  # of the filter of lines to fetch: 8 MB whatever the input
GROUP = 512  # lines of one key that meet in one group
PAIRS = 1 << 14  # verified at once
ROWS = 1 << 11  # of groups taken at once
CELLS = 1 << 22  # code points of the pairs verified at once
BASES = (0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1)
U = np.uint64


def edits_for(length):
    """Allowed edits for a shorter line of this length."""
    return np.minimum(MAX_EDITS, length // PER_EDIT)


class Lines:
    """The lines of some texts with prefix sums from which the hash of any substring follows."""

    def __init__(self, texts: list[str]):
        joined = "\n".join(texts)
        self.chars = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
        breaks = np.flatnonzero(self.chars == 10)
        self.starts = np.concatenate([[0], breaks + 1])
        self.lengths = np.concatenate([breaks, [len(self.chars)]]) - self.starts
        sizes = np.fromiter((t.count("\n") + 1 for t in texts), np.int64, len(texts))
        self.doc = np.repeat(np.arange(len(texts)), sizes)
        self.number = np.arange(len(self.starts)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        self.sums, self.inverse = [], []
        for base in BASES:
            n = len(self.chars) + 1
            spread = mix(self.chars.astype(U) + U(base))
            self.sums.append(np.concatenate([[U(0)], np.cumsum(spread * powers(base, n)[:-1], dtype=U)]))
            self.inverse.append(powers(pow(base, -1, 1 << 64), n))

    def hashed(self, start: np.ndarray, length: np.ndarray | int, which: int = 0) -> np.ndarray:
        """Hash of the code points [start, start + length)."""
        s = self.sums[which]
        return mix((s[start + length] - s[start]) * self.inverse[which][start])

    def ids(self) -> tuple[np.ndarray, np.ndarray]:
        """128 bits per line."""
        size = self.lengths.astype(U)
        return mix(self.hashed(self.starts, self.lengths, 0) + size), mix(self.hashed(self.starts, self.lengths, 1) ^ size)

    def keys(self, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
        """(rows, keys, indexed) for the chosen lines: segments under which a line is found, places where it looks.

        A place of a line's own length and segment is both, and comes once, as indexed.
        """
        start, own = self.starts[rows], self.lengths[rows]
        for shift in range(MAX_EDITS + 1):
            length = own - shift
            allowed = edits_for(np.maximum(length, 0))
            for t in range(max(shift, 1), MAX_EDITS + 1):
                at = np.flatnonzero((allowed == t) & (length > 0))
                if not len(at):
                    continue
                s, n, l = start[at], own[at], length[at]
                for i in range(t + 1):
                    size = (l + i) // (t + 1)  # later segments are the longer ones
                    p = sum(((l + j) // (t + 1) for j in range(i)), np.zeros(len(l), np.int64))
                    low = np.maximum(np.maximum(p - i, p + shift - (t - i)), 0)
                    high = np.minimum(np.minimum(p + i, p + shift + (t - i)), n - size)
                    tag = mix((l * 64 + t * 8 + i).astype(U))
                    for step in range(2 * t + 1):
                        place = low + step
                        ok = np.flatnonzero(place <= high)
                        if not len(ok):
                            break
                        key = mix(self.hashed(s[ok] + place[ok], size[ok]) ^ tag[ok])
                        same = (place[ok] == p[ok]) if shift == 0 else np.zeros(len(ok), bool)
                        for flag in (True, False):
                            some = np.flatnonzero(same == flag)
                            if len(some):
                                yield rows[at[ok[some]]], key[some], flag


class Recent:
    """Drops most lines that a task has sent before, in constant memory, so that a hot line is few rows."""

    def __init__(self, bits: int = 18):
        self.slots = np.zeros(1 << bits, U)

    def fresh(self, ids: np.ndarray) -> np.ndarray:
        """Positions of different lines, without those still remembered."""
        some, at = np.unique(ids, return_index=True)
        slot = (some & U(len(self.slots) - 1)).astype(np.int64)
        new = self.slots[slot] != some
        self.slots[slot[new]] = some[new]
        return at[new]


def occurrences(docs: DataFrame) -> DataFrame:
    """(doc_id, k1, k2, number, a, b, length): each line of each document, its place and its 128 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, texts in common.pieces(batch.column("text"), PIECE):
                lines = Lines(texts)
                a, b = lines.ids()
                rows = pa.array(lines.doc + x)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c).take(rows) for c in ("doc_id", "k1", "k2")]
                    + [pa.array(lines.number.astype(np.int32)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(lines.lengths.astype(np.int32))],
                    names=["doc_id", "k1", "k2", "number", "a", "b", "length"],
                )

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *common.identity(), "text")
    return source.mapInArrow(run, "doc_id long, k1 long, k2 int, number int, a long, b long, length int")


def key_rows(docs: DataFrame) -> DataFrame:
    """(key, a, indexed): keys of every line, about once per line and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recent = Recent()
        for batch in batches:
            for _, texts in common.pieces(batch.column("text"), PIECE):
                lines = Lines(texts)
                a, _ = lines.ids()
                once = recent.fresh(a)
                for rows, key, flag in lines.keys(once[lines.lengths[once] >= PER_EDIT]):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key.view(np.int64)), pa.array(a[rows].view(np.int64)), pa.array(np.full(len(rows), flag))], names=["key", "a", "indexed"]
                    )

    return docs.select("text").mapInArrow(run, "key long, a long, indexed boolean")


def fetched(docs: DataFrame, wanted: np.ndarray) -> DataFrame:
    """(a, b, line): the text of lines whose hash may be wanted, about once per task."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recent = Recent()
        for batch in batches:
            for _, texts in common.pieces(batch.column("text"), PIECE):
                lines = Lines(texts)
                a, b = lines.ids()
                once = recent.fresh(a)
                once = once[(lines.lengths[once] >= PER_EDIT) & common.in_bitmap(shared.value, a[once])]
                own = [lines.chars[s : s + n].tobytes().decode("utf-32-le", "surrogatepass") for s, n in zip(lines.starts[once], lines.lengths[once])]
                yield pa.RecordBatch.from_arrays([pa.array(a[once].view(np.int64)), pa.array(b[once].view(np.int64)), pa.array(own, pa.string())], names=["a", "b", "line"])

    return docs.select("text").mapInArrow(run, "a long, b long, line string")


def codes(line: str) -> np.ndarray:
    """Code points plus one."""
    return np.frombuffer(line.encode("utf-32-le", "surrogatepass"), "<u4") + np.uint32(1)


def trimmed(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The longer and the shorter line without what they share at both ends."""
    if len(x) < len(y):
        x, y = y, x
    differ = np.flatnonzero(x[: len(y)] != y)
    head = differ[0] if len(differ) else len(y)
    x, y = x[head:], y[head:]
    differ = np.flatnonzero(x[len(x) - len(y) :] != y)
    tail = len(y) - 1 - differ[-1] if len(differ) else len(y)
    return x[: len(x) - tail], y[: len(y) - tail]


def within(left: list[np.ndarray], right: list[np.ndarray], band: int = MAX_EDITS) -> np.ndarray:
    """Whether each two lines (as code points) lie within the allowed edits: a band of bits, many pairs a column at a time.

    Bit r of a pair's words stands for row j - band + r in column j, so the band slides down by itself.
    The score follows the diagonal that ends in the last cell. Pairs beyond their limit leave.
    """
    allowed = edits_for(np.array([min(len(x), len(y)) for x, y in zip(left, right)], np.int64))
    cores = [trimmed(x, y) for x, y in zip(left, right)]
    m = np.array([len(x) for x, _ in cores], np.int64)
    n = np.array([len(y) for _, y in cores], np.int64)
    out, full = np.zeros(len(cores), bool), (1 << (2 * band + 1)) - 1
    todo = np.flatnonzero(m - n <= allowed)
    todo = todo[np.argsort(n[todo], kind="stable")]
    while len(todo):
        wide = np.maximum.accumulate(n[todo] + 3 * band + 1) * np.arange(1, len(todo) + 1)
        take = max(1, int(np.searchsorted(wide, CELLS)))
        rows, todo = todo[:take], todo[take:]
        width = int(n[rows].max())
        longs = np.zeros((len(rows), width + 3 * band + 1), np.uint32)  # the first code point stands at ``band``
        shorts = np.zeros((len(rows), width), np.uint32)
        for k, r in enumerate(rows):
            x, y = cores[r]
            longs[k, band : band + len(x)] = x
            shorts[k, : len(y)] = y
        size, limit, ends, score = n[rows], allowed[rows], m[rows] - n[rows] + band, m[rows] - n[rows]
        vp = np.full(len(rows), full & ~((1 << band) - 1), np.int64)
        vn = np.zeros(len(rows), np.int64)
        for j in range(width):
            if j & (j - 1) == 0 or j % 256 == 0:
                stay = (score <= limit) & (j < size)
                out[rows[~stay]] = (score <= limit)[~stay]
                if not stay.all():
                    rows, longs, shorts, size, limit, ends, score, vp, vn = (v[stay] for v in (rows, longs, shorts, size, limit, ends, score, vp, vn))
                if not len(rows):
                    break
            window = longs[:, j : j + 2 * band + 1] == shorts[:, j : j + 1]
            match = np.zeros(len(rows), np.int64)
            for r in range(2 * band + 1):
                match |= window[:, r].astype(np.int64) << r
            d0 = ((((match & vp) + vp) ^ vp) | match | vn) & full
            hp = (vn | ~(d0 | vp)) & full
            hn = d0 & vp
            score = score + ((j < size) & ((d0 >> ends) & 1 == 0))
            vp = (hn | ~((d0 >> 1) | hp)) & full
            vn = (d0 >> 1) & hp
        out[rows] = score <= limit
    return out


class Judge:
    """Verifies the lines that share a key. Of a pair that shares several keys, the smallest one counts.

    Takes rows sorted by group (key, x, y) and keeps, for each line, how many others it matches and the
    earliest of them. Pairs exist here only, PAIRS at a time; a group has at most 2 * GROUP lines.
    """

    FIRST = ["doc_id", "k1", "k2", "number"]

    def __init__(self, rows: pd.DataFrame):
        self.rows = rows.reset_index(drop=True)
        self.group = self.rows.groupby(["key", "x", "y"], sort=False).ngroup().to_numpy()
        self.key = self.rows["key"].to_numpy()
        self.indexed = self.rows["indexed"].to_numpy()
        self.side = self.rows["side"].to_numpy()
        self.two = (self.rows["x"] != self.rows["y"]).to_numpy()
        self.lines = [codes(t) for t in self.rows["line"]]
        self.length = np.array([len(t) for t in self.lines])
        width = max(map(len, self.rows["keys"]), default=1)
        self.keys, self.flags = np.zeros((len(rows), width), np.int64), np.zeros((len(rows), width), bool)
        self.used = np.zeros((len(rows), width), bool)
        for i, (k, f) in enumerate(zip(self.rows["keys"], self.rows["flags"])):
            self.keys[i, : len(k)], self.flags[i, : len(f)], self.used[i, : len(k)] = k, f, True
        order = self.rows[self.FIRST].sort_values(self.FIRST, na_position="first").index.to_numpy()
        self.order, self.place = order, np.empty(len(order), np.int64)
        self.place[order] = np.arange(len(order))
        self.links = np.zeros(len(rows), np.int64)
        self.earliest = np.full(len(rows), len(rows), np.int64)

    def smallest(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether the group's key is the smallest by which the two lines find each other."""
        same = (self.keys[i][:, :, None] == self.keys[j][:, None, :]) & self.used[i][:, :, None] & self.used[j][:, None, :]
        same &= self.flags[i][:, :, None] | self.flags[j][:, None, :]
        least = np.where(same.any(2), self.keys[i], np.iinfo(np.int64).max).min(1)
        return least == self.key[i]

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All pairs within the groups, by their distance in the order."""
        held, size, at = [], 0, np.arange(len(self.group))
        for step in range(1, int(np.bincount(self.group).max(initial=1))):
            at = at[at + step < len(self.group)]
            at = at[self.group[at] == self.group[at + step]]
            i, j = at, at + step
            ok = (self.indexed[i] | self.indexed[j]) & (~self.two[i] | (self.side[i] != self.side[j])) & (np.abs(self.length[i] - self.length[j]) <= MAX_EDITS)
            held.append((i[ok], j[ok]))
            size += int(ok.sum())
            if size >= PAIRS:
                yield tuple(map(np.concatenate, zip(*held)))
                held, size = [], 0
        if size:
            yield tuple(map(np.concatenate, zip(*held)))

    def result(self) -> pd.DataFrame:
        for some in self.pairs():
            for at in range(0, len(some[0]), PAIRS):
                i, j = some[0][at : at + PAIRS], some[1][at : at + PAIRS]
                ok = self.smallest(i, j)
                i, j = i[ok], j[ok]
                ok = within([self.lines[k] for k in i], [self.lines[k] for k in j])
                i, j = i[ok], j[ok]
                for one, other in ((i, j), (j, i)):
                    np.add.at(self.links, one, 1)
                    np.minimum.at(self.earliest, one, self.place[other])
        hit = np.flatnonzero(self.links)
        out = self.rows.loc[self.order[self.earliest[hit]], self.FIRST].reset_index(drop=True)
        return out.assign(a=self.rows["a"].to_numpy()[hit], links=self.links[hit])


def matches(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, links, earliest): how many other lines match a line, and the earliest first occurrence among them."""
    keys = key_rows(docs)
    # A key counts when two different lines have it: one pass over the rows of each key.
    each = Window.partitionBy("key")
    shared = keys.withColumn("low", F.min("a").over(each)).withColumn("high", F.max("a").over(each)).where("low <> high")
    shared = stored(shared.groupBy("key", "a").agg(F.max("indexed").alias("indexed")), "line-keys")
    bits = common.bitmap(shared.select("a").distinct(), "a", FILTER_BITS)
    texts = fetched(docs, bits).groupBy("a", "b").agg(F.first("line").alias("line"))
    own = shared.groupBy("a").agg(F.collect_list(F.struct("key", "indexed")).alias("own"))  # a line has at most 15 keys
    lines = own.join(texts, "a").join(classes.select("a", "b", "first"), ["a", "b"])
    sizes = shared.groupBy("key").agg(F.count("*").alias("n"))
    # Groups beyond GROUP lines are cut into shares; every two shares meet in a group of their own.
    shares = F.ceil(F.col("n") / GROUP).cast("int")
    mine = F.pmod(F.xxhash64("a"), shares).cast("int")
    meets = F.transform(F.sequence(F.lit(0), shares - 1), lambda o: F.struct(F.least(o, mine).alias("x"), F.greatest(o, mine).alias("y"), (o < mine).cast("int").alias("side")))
    grouped = shared.join(sizes, "key").select("key", "a", "indexed", F.explode(meets).alias("at")).select("key", "a", "indexed", "at.*")
    rows = grouped.join(lines, "a").select(
        "key", "x", "y", "side", "a", "indexed", "line", F.col("own.key").alias("keys"), F.col("own.indexed").alias("flags"), "first.*"
    )

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                part = batch.iloc[at : at + ROWS]
                rows = part if held is None else pd.concat([held, part], ignore_index=True)
                last = (rows[["key", "x", "y"]] == rows[["key", "x", "y"]].iloc[-1]).all(axis=1).to_numpy()
                held = rows[last]
                if not last.all():
                    yield Judge(rows[~last]).result()
        if held is not None:
            yield Judge(held).result()

    kind = {f.name: f.dataType.simpleString() for f in rows.schema}
    sorted_rows = rows.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y")
    found = sorted_rows.mapInPandas(judge, ", ".join(f"{c} {kind[c]}" for c in Judge.FIRST) + ", a long, links long")
    return found.groupBy("a").agg(F.sum("links").alias("links"), F.min(F.struct(*Judge.FIRST)).alias("earliest"))


def lines(docs: DataFrame) -> DataFrame:
    """One row per line: doc_id, k1, k2, number, the first occurrence ``first`` of its text, ``links``, ``kept``."""
    docs = docs.select("doc_id", "text")
    placed = stored(occurrences(docs), "line-places")
    place = F.struct("doc_id", "k1", "k2", "number")
    classes = stored(placed.groupBy("a", "b").agg(F.min(place).alias("first"), F.max("length").alias("length")), "line-classes")
    judged = classes.join(stored(matches(docs, classes), "line-matches"), "a", "left").select(
        "a", "b", "first", F.coalesce("links", F.lit(0)).alias("links"), "length",
        F.coalesce(F.col("earliest") < F.col("first"), F.lit(False)).alias("near"),
    )
    kept = (F.col("length") == 0) | (~F.col("near") & (F.col("first") == place))
    return placed.drop("length").join(judged, ["a", "b"]).select("doc_id", "k1", "k2", "number", "first", "links", kept.alias("kept"))


def op9_lines(spark, sf_dir: str) -> DataFrame:
    """Each line with its class (the first occurrence), the number of lines linked to the class, and whether it stays."""
    found = lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(
        "doc_id", F.col("number").alias("line_no"), F.col("first.doc_id").alias("class_doc_id"), F.col("first.number").alias("class_line_no"),
        F.col("links").cast("long").alias("n_links"), "kept",
    )


def without(texts: pd.Series, gone: pd.Series) -> list[str | None]:
    """Texts without the lines of the given numbers; null: nothing goes."""
    out = []
    for text, numbers in zip(texts, gone):
        if numbers is not None and text is not None:
            drop = set(numbers)
            text = "\n".join(line for i, line in enumerate(text.split("\n")) if i not in drop)
        out.append(text)
    return out


def keep_first_lines(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage: every document stays, without the lines that occurred before; n_chars follows the text."""

    @F.pandas_udf("string")
    def left(texts: pd.Series, gone: pd.Series) -> pd.Series:
        return pd.Series(without(texts, gone), dtype=object)

    def places() -> DataFrame:
        return lines(docs).where("not kept").select("k1", "k2", "number").distinct()

    gone = common.settled(places, "lines-gone").groupBy("k1", "k2").agg(F.collect_list("number").alias("gone"))
    rows = common.packed(docs, *common.identity()).join(gone, ["k1", "k2"], "left")
    rows = rows.select("row", "gone", left(F.col("row.text"), F.col("gone")).alias("left"))
    names, new = docs.columns, {"text": F.col("left")}
    if "n_chars" in names:
        new["n_chars"] = F.when(F.col("gone").isNull(), F.col("row.n_chars")).otherwise(F.length("left").cast(docs.schema["n_chars"].dataType))
    return common.unpacked(rows, names, **new)
