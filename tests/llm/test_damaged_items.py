"""Benchmark items with edits at every length, against the shared weight of whole documents."""

import random
from collections import Counter

from test_decontaminate import index_of

from foliospark.llm import decontaminate as m


def test_every_damage_at_every_length():
    rnd = random.Random(7)
    items = [(n, " ".join(f"q{rnd.randrange(9999)}" for _ in range(n + 4))) for n in range(1, 90)]
    index = index_of([t for _, t in items])
    texts, pairs = [], []
    for k, (n, text) in enumerate(items):
        for kind in "idrt":
            for times in (1, 2, 3):
                own = text.split()
                for e in range(times):
                    at = (e + 1) * len(own) // (times + 1)
                    if kind == "i":
                        own.insert(at, "new")
                    elif kind == "d":
                        own.pop(at)
                    elif kind == "r":
                        own[at] = "new"
                    else:
                        own[at:at] = own[max(0, at - 4) : at] * 2  # said again, so that windows break but few shingles go
                texts.append(" ".join([f"b{rnd.randrange(99)}" for _ in range(30)] + own + ["end"] * 7))
                pairs.append((k, n))
    found, missed, hits = index.search(texts), [], 0
    for text, (k, n), got in zip(texts, pairs, found):
        hashes, _ = m.shingles([text])
        here = Counter(hashes.tolist())
        share = sum(min(c, here[h]) * index.weights[h] for h, c in index.counts[k].items()) / index.totals[k]
        hits += share >= m.SIMILARITY
        if (k in got) != (round(share, 12) >= m.SIMILARITY):
            missed.append((n, share))
    assert hits > 300 and not missed, missed
    # The fingerprints alone, by length and by kind of damage: 0.9 and more.
    alone = index.search(texts, exact=False)
    for part in [range(0, 10), range(10, 20), range(20, 40), range(40, 90)]:
        for kind in range(4):
            of = [i for i, (k, n) in enumerate(pairs) if n in part and i // 3 % 4 == kind and k in found[i]]
            near = sum(pairs[i][0] in alone[i] for i in of)
            assert near >= 0.9 * len(of), (part, kind, near, len(of))


def test_light_shingles_may_go():
    shared = " ".join(f"s{i}" for i in range(40))
    items = [(k, " ".join(f"k{k}x{i}" for i in range(60)) + " " + shared) for k in range(50)]
    words = items[0][1].split()
    for at in range(62, 100, 4):
        words[at] = "gone"
    index = index_of([t for _, t in items])
    here = Counter(m.shingles([" ".join(words)])[0].tolist())
    share = sum(min(c, here[h]) * index.weights[h] for h, c in index.counts[0].items()) / index.totals[0]
    assert share >= m.SIMILARITY and set(index.search([" ".join(words)])[0]) == {0}
