"""Contaminated documents against the shingles of whole documents."""

import random
from collections import Counter

import numpy as np
import pytest

from foliospark.llm import decontaminate as m


def words(rnd, n):
    return [f"{rnd.choice('abcdefgh')}{rnd.randrange(5000)}" for _ in range(n)]


@pytest.fixture(scope="module")
def case():
    rnd = random.Random(5)
    items = [(k, " ".join(words(rnd, rnd.randrange(5, 80)))) for k in range(40)] + [(40, "two words"), (41, ""), (None, "no id"), (43, None)]
    docs, want = [(1, None), (2, ""), (3, "two words"), (4, "these two words here"), (4, "these two words here")], {3: {40}}
    for i in range(10, 90):
        k, text = items[rnd.randrange(40)]
        own, kind = text.split(), rnd.randrange(4)
        before, after = words(rnd, rnd.randrange(0, 60)), words(rnd, rnd.randrange(0, 60))
        if kind == 0:
            own = [w.upper() + "," for w in own]
        elif kind == 1 and len(own) >= 40:
            own[rnd.randrange(len(own))] = "changed"
        elif kind == 2:
            own = own[: len(own) // 2]
        docs.append((i, " ".join(before + own + after)))
        want[i] = {k} if kind != 2 else set()
    return items, docs, want


def test_all_and_only(spark, case):
    items, docs, want = case
    found = m.found(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    rows = found.select("row.doc_id", "hits").collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert {h.item_id for h in r.hits} == want.get(r.doc_id, set()), r.doc_id
        assert all(h.similarity >= m.SIMILARITY for h in r.hits)


def held(docs, items, n):
    return sorted((r.doc_id, [(h.item_id, h.similarity) for h in r.hits]) for r in m.found(docs, items, n).select("row.doc_id", "hits").collect())


def test_several_passes_agree(spark, case):
    items, docs, _ = case
    docs, items = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert held(docs, items, 1000) == held(docs, items, 7)


@pytest.mark.parametrize("damage", [0, 2, 4, 6, 8])
def test_weights_are_those_of_the_whole_benchmark(spark, damage):
    """Items that share a text: whether a document matches depends neither on the passes nor on the order of the rows."""
    rnd = random.Random(damage)
    shared = words(rnd, 36)
    items = [(k, " ".join(words(rnd, 10) + shared)) for k in range(38)] + [(100 + k, " ".join(words(rnd, 46))) for k in range(9)]
    own = items[3][1].split()
    own[:damage] = words(rnd, damage)
    docs = spark.createDataFrame([(1, " ".join(words(rnd, 30) + own + words(rnd, 9))), (2, " ".join(shared)), (3, items[40][1])], "doc_id long, text string")
    want = None
    for n in (1, 5, 1000):
        table = spark.createDataFrame(rnd.sample(items, len(items)), "item_id long, text string").repartition(3)
        got = held(docs, table, n)
        assert want in (None, got)
        want = got
    brute = whole_weights(items)
    for doc, text in docs.collect():
        assert [h[0] for h in dict(want)[doc]] == [i for i, t in items if brute(t, text) >= m.SIMILARITY - 1e-9]


def whole_weights(items):
    cut = lambda text: (lambda w: [tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))])(text.split())
    have = Counter(s for _, t in items for s in set(cut(t)))
    weight = lambda s: np.log1p(len(items) / have[s])

    def share(item, text):
        here, own = Counter(cut(text)), Counter(cut(item))
        return sum(min(n, here[s]) * weight(s) for s, n in own.items()) / sum(n * weight(s) for s, n in own.items())

    return share


def index_of(texts):
    """An index of items by themselves."""
    hashes, counts = m.shingles(texts)
    each = np.split(hashes, np.cumsum(counts)[:-1])
    have = Counter(h for own in each for h in set(own.tolist()))
    return m.Index([(k, own, np.array([have[h] for h in own.tolist()])) for k, own in enumerate(each)], len(texts))


def test_windows_are_weighted_simhashes():
    rng = np.random.default_rng(2)
    hashes = rng.integers(0, 1 << 63, 300).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    weights = rng.integers(1, 300, 300)
    signs = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).astype(int) * 2 - 1
    for size in (1, 2, 11, 90, 300):
        starts = np.arange(0, 300 - size + 1, 7)
        for at, got in zip(starts, m.simhashes(m.bit_sums(hashes, weights), starts, size)):
            sums = (signs[at : at + size] * weights[at : at + size, None]).sum(0)
            assert int(got) == int.from_bytes(np.packbits(sums > 0).tobytes(), "big")


def test_index_finds_all_within_the_radius():
    rnd = random.Random(1)
    index = index_of([" ".join(words(rnd, 60)) for _ in range(30)])
    (size, (prints, _, _)), = index.sizes.items()
    own = np.concatenate([prints ^ np.uint64(sum(1 << b for b in rnd.sample(range(64), n))) for n in range(0, 27)])
    got = set(zip(*map(np.ndarray.tolist, index.candidates(own, size))))
    assert got == {(i, j) for i in range(len(own)) for j in np.flatnonzero(np.bitwise_count(own[i] ^ prints) <= m.RADIUS).tolist()}


def test_windows_around_places():
    first, last = np.array([0, 0, 0, 0, 4, 4, 4, 4, 4, 4]), np.array([4, 4, 4, 4, 10, 10, 10, 10, 10, 10])
    at = np.array([1, 7])
    assert m.starts_around(at, first[at], last[at], 3, 10).tolist() == [0, 1, 5, 6, 7]
    assert m.starts_around(at, first[at], last[at], 5, 10).tolist() == [4, 5]


def test_shingles_of_texts():
    hashes, counts = m.shingles(["", "one two", "a b c d e f", "One, TWO!", "é à"])
    assert counts.tolist() == [0, 1, 2, 1, 1]
    assert hashes[0] == hashes[3] and len(Counter(hashes.tolist())) == 4


def test_stage(spark, case):
    items, docs, want = case
    table = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, `hits` int, `row` int")
    held = {r.doc_id for r in m.found(table, spark.createDataFrame(items, "item_id long, text string")).where("size(hits) = 0").select("row.doc_id").collect()}
    assert held == {i for i, _ in docs if not want.get(i)}
    none = m.found(table, spark.createDataFrame([], "item_id long, text string")).collect()
    assert len(none) == len(docs) and not any(r.hits for r in none)
    assert m.found(table.limit(0), spark.createDataFrame(items, "item_id long, text string")).count() == 0
