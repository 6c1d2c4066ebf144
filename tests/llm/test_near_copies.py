"""The near-copy stage against the Jaccard similarity of all pairs."""

import random

import pytest

import corpus_pipeline
from foliospark.llm import simhash_dedup as m


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def near(a, b):
    return a == b or len(a & b) * 5 >= len(a | b) * 4


def components(sets):
    root = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if near(sets[i], sets[j]) and root[i] != root[j]:
                root = [root[i] if r == root[j] else r for r in root]
    return root


def rows():
    rnd, out = random.Random(9), [(None, "null id"), (1, None), (2, ""), (2, ""), (3, " \t\n"), (4, "one two"), (5, "One  two")]
    for k in range(40):
        base = [f"w{rnd.randrange(400)}" for _ in range(rnd.randrange(1, 150))]
        out.append((100 + k, " ".join(base)))
        for c in range(1, 4):
            own = list(base)
            for _ in range(rnd.randrange(0, max(2, len(own) // 20))):
                own[rnd.randrange(len(own))] = f"x{rnd.randrange(400)}"
            out.append((100 + k + 100 * c, " ".join(own)))
    return out


@pytest.mark.parametrize("group", [512, 2])
def test_stage_is_the_jaccard_components(spark, monkeypatch, group):
    monkeypatch.setattr(m, "GROUP", group)
    made = rows()
    sets = [shingles(t) for _, t in made]
    bits = [m.fingerprint(t or "") & (1 << 64) - 1 for _, t in made]
    assert any(near(sets[i], sets[j]) and (bits[i] ^ bits[j]).bit_count() > 8 for i in range(len(made)) for j in range(i))
    groups = components(sets)
    want = {}
    for (i, _), g in zip(made, groups):
        want.setdefault(g, []).append(i)
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in made], "doc_id long, text string, `row` string, k1 string").repartition(3)
    stage = dict(corpus_pipeline.STAGES)["simhash near-dedup"]
    kept = stage(spark, docs, "")
    assert kept.columns == docs.columns
    smallest = [min((i for i in ids if i is not None), default=None) for ids in want.values()]
    assert sorted(r.doc_id or 0 for r in kept.collect()) == sorted(i or 0 for i in smallest)
    assert stage(spark, docs.limit(0), "").count() == 0
