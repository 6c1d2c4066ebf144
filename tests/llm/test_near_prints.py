"""The near-copy stage finds copies by their SimHash fingerprints before it looks at shared shingles."""

import random

from foliospark.llm import simhash_dedup as m


def test_near_fingerprints_alone_join_copies(spark, monkeypatch):
    none = lambda rows, *_: rows.selectExpr("node as a", "node as b").limit(0)
    monkeypatch.setattr(m, "star_pairs", none)
    monkeypatch.setattr(m, "cross_pairs", none)
    rnd, rows, want = random.Random(4), [(1, ""), (2, "one two")], {1, 2}
    for k in range(12):
        words = [f"w{rnd.randrange(5000)}" for _ in range(600)]
        rows += [(10 * k + 10, " ".join(words)), (10 * k + 11, " ".join(words + ["end"])), (10 * k + 12, " ".join(["start"] + words))]
        want.add(10 * k + 10)
    bits = {i: m.set_fingerprint(m.shingle_set(t)) & m.common.M64 for i, t in rows}
    near = lambda i, j: (bits[i] ^ bits[j]).bit_count() <= m.STAGE_RADIUS
    joined = {i for i, _ in rows if i % 10 and i > 9 and any(near(i, j) for j in range(i - i % 10, i - i % 10 + 3) if j != i)}
    kept = {r.doc_id for r in m.keep_one_copy(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()}
    assert want <= kept and len(joined) > 12 and not any(i in kept for i in joined if near(i, i - i % 10))
