"""Suffix arrays, common prefixes and merges against sorted slices; whole documents against all substrings."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from foliospark.llm import suffix_dedup as m


def texts(rnd, kind):
    if kind == 0:
        return [b"ab" * rnd.randrange(3, 20) for _ in range(4)]
    return [bytes(rnd.choice(b"ab\x00\xf4") for _ in range(rnd.randrange(1, 40))) for _ in range(rnd.randrange(1, 9))]


@pytest.mark.parametrize("seed", range(12))
def test_shards(seed):
    rnd, n = random.Random(seed), 6
    made, other = texts(rnd, seed % 3), texts(rnd, seed % 2)
    shard, across = m.Shard(made), m.Shard(other)
    whole = shard.text[: shard.n].tobytes()
    assert list(shard.sa) == sorted(range(shard.n), key=lambda i: whole[i:])
    shared = shard.common_prefixes(n)
    for r in range(1, shard.n):
        one, two = whole[shard.sa[r - 1] :], whole[shard.sa[r] :]
        k = 0
        while k < min(len(one), len(two), n) and one[k] == two[k]:
            k += 1
        assert shard.text[shard.sa[r]] == 0 or shared[r] == k
    count = Counter(t[i : i + n] for t in made for i in range(len(t) - n + 1))
    starts = [(shard.offsets[k] + i, t[i : i + n]) for k, t in enumerate(made) for i in range(len(t) - n + 1)]
    assert sorted(m.repeated_inside(shard, n).tolist()) == [i for i, s in starts if count[s] > 1]
    there = {t[i : i + n] for t in other for i in range(len(t) - n + 1)}
    assert sorted(m.repeated_across(shard, across, n).tolist()) == [i for i, s in starts if s in there]


def test_regions_cover_every_start_once():
    rnd = random.Random(1)
    parts = [bytes(rnd.choice(b"abc ") for _ in range(rnd.randrange(400, 1500))) for _ in range(5)]
    own, low, high, anchor, _ = m.regions(parts)
    seen = Counter((p, s) for p, a, b in zip(own.tolist(), low.tolist(), high.tolist()) for s in range(a, b + 1))
    assert set(seen.values()) == {1}
    assert set(seen) == {(p, s) for p, t in enumerate(parts) for s in range(len(t) - m.LENGTH + 1)}


def documents():
    rnd = random.Random(9)

    def prose(n):
        return "".join(rnd.choice("abcdefghijklmnop é") for _ in range(n))

    passage, base, long = prose(700), prose(1500), prose(399)
    rows = [(None, base), (1, None), (2, ""), (3, long), (4, long), (5, "é" * 1200), (6, prose(900)), (7, "x"), (7, base[:500])]
    rows += [(10 + i, prose(rnd.randrange(300)) + passage + prose(rnd.randrange(300))) for i in range(8)]
    for i in range(30, 50):
        at = rnd.randrange(len(base))
        rows.append((i, base[:at] + rnd.choice("XYZ") + base[at + 1 :]))
    return rows + [(60, prose(2000))] * 2


def expected(rows, n=m.LENGTH):
    data = [(t or "").encode() for _, t in rows]
    count = Counter(t[i : i + n] for t in data for i in range(len(t) - n + 1))
    out = []
    for (i, _), t in zip(rows, data):
        gone = np.zeros(len(t), bool)
        for s in range(len(t) - n + 1):
            if count[t[s : s + n]] > 1:
                gone[s : s + n] = True
        left = np.frombuffer(t, np.uint8)[~gone].tobytes()
        spans = int(np.count_nonzero(np.diff(np.concatenate([[0], gone.astype(int)])) == 1))
        out.append((i is not None, i or 0, len(t), len(t) - len(left), spans, hashlib.sha256(left).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("shard, piece", [(1 << 20, 1 << 19), (4000, 1 << 19), (1 << 20, 600)])
def test_documents(spark, monkeypatch, shard, piece):
    monkeypatch.setattr(m, "PIECE", piece)
    rows = documents()
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, low int").repartition(4)
    got = m.deduplicated(docs, shard).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == expected(rows)
    kept = {r.doc_id: r.kept for r in got}
    assert kept[5] == "" and kept[2] is None


def test_empty(spark):
    assert m.deduplicated(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert m.deduplicated(spark.createDataFrame([(1, None)], "doc_id long, text string")).collect()[0].n_bytes == 0
