"""SimHash groups against all pairs of fingerprints."""

import random

import numpy as np
import pytest
import xxhash

from foliospark.llm import simhash_dedup as m


def plain_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text).replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def components(prints):
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(prints))]


def test_fingerprints():
    for text in ["", " \n", "One", "ÀB c D", "a b c d\te\x0bF g", "x " * 200, "É é É é z"]:
        assert m.fingerprint(text) & (1 << 64) - 1 == plain_fingerprint(text), text


def test_very_long_text(monkeypatch):
    monkeypatch.setattr(m, "PIECE", 16)
    text = " ".join(f"w{i * i % 97}" for i in range(1000))
    assert m.fingerprint(text) & (1 << 64) - 1 == plain_fingerprint(text)


@pytest.mark.parametrize("parts", [2, 3, 4])
def test_all_links(spark, parts):
    rnd = random.Random(parts)
    prints = [0, -1] + [rnd.getrandbits(64) - (1 << 63) for _ in range(30)]
    for base in prints[:20]:
        for _ in range(12):
            flips = sum(1 << b for b in rnd.sample(range(64), rnd.randrange(1, 6)))
            prints.append(((base ^ flips) + (1 << 63)) % (1 << 64) - (1 << 63))
    prints = sorted(set(prints))
    got = {(r.a, r.b) for r in m.links(spark.createDataFrame([(p,) for p in prints], "fp long"), 3, parts).collect()}
    u = np.array(prints).view(np.uint64)
    want = {(prints[i], prints[j]) for i in range(len(u)) for j in range(i + 1, len(u)) if np.bitwise_count(u[i] ^ u[j]) <= 3}
    assert got == want and want


def test_thresholds_are_complete():
    rng = np.random.default_rng(1)
    costs = [np.concatenate([np.zeros((50, 1)), np.cumsum(rng.random((50, 4)), 1)], 1) for _ in range(3)]
    t = m.allocate(costs, 3).astype(int)
    assert ((t + 1).sum(1) == 4).all() and (t >= -1).all()
    picked = sum(c[np.arange(50), t[:, i] + 1] for i, c in enumerate(costs))
    best = np.min([sum(c[:, x] for c, x in zip(costs, (a, b, 4 - a - b))) for a in range(5) for b in range(5 - a)], axis=0)
    assert np.allclose(picked, best)


def rows():
    rnd = random.Random(3)
    words = [f"word{i}" for i in range(300)]
    out = [(None, "null id"), (1, None), (2, ""), (2, ""), (3, " \t\n")]
    for i in range(10, 50):
        text = " ".join(rnd.choice(words) for _ in range(rnd.randrange(1, 120)))
        out += [(i, text), (i + 100, text), (i + 200, text + " end")]
    return out + [(400, " ".join(words * 60))]


def test_query_and_stage(spark):
    made = rows()
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in made], "doc_id long, text string, `row` string, fp string")
    got = m.near_duplicates(docs).select("doc_id", "k1", "k2", "fp", "component_id").collect()
    assert len(got) == len(made)
    prints = [plain_fingerprint(t or "") for _, t in made]
    groups = components(prints)
    least = {}
    for (i, _), g in zip(made, groups):
        least[g] = min(x for x in (least.get(g), i) if x is not None) if i is not None or g in least and least[g] is not None else None
    want = sorted((i is not None, i or 0, p, least[g]) for (i, _), p, g in zip(made, prints, groups))
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.fp & (1 << 64) - 1, r.component_id) for r in got) == want
    kept = m.keep_one(spark, docs, "")
    assert kept.columns == docs.columns
    assert len(kept.collect()) == len(set(groups))
    assert {r.doc_id for r in kept.collect()} == set(least.values())


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert m.near_duplicates(docs).count() == 0 and m.keep_one(spark, docs, "").count() == 0
