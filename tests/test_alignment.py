"""Paragraph alignment against the full dynamic program; windows and structure against plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from foliospark.functions import alignment as m
from foliospark.functions import paragraphs as p
from foliospark.operators import editorial


def price(beads, la, ka, lb, kb):
    """Cost of beads that must cover both sides in order."""
    ratio, total, at = m.ratio_of(la, lb), 0, (0, 0)
    for i0, i1, j0, j1 in beads:
        assert (i0, j0) == at and (i1 - i0, j1 - j0) in m.BEADS
        at = (i1, j1)
        if i0 == i1 or j0 == j1:
            total += m.ALONE
        else:
            total += int(m.price(sum(la[i0:i1]), sum(lb[j0:j1]), ratio)) + m.TWO * (i1 - i0 + j1 - j0 > 2) + m.KIND * (len({*ka[i0:i1], *kb[j0:j1]}) > 1)
    assert at == (len(la), len(lb))
    return total


def price_of_one(di, dj, x, kx, y, ky, ratio):
    if not di or not dj:
        return m.ALONE
    return int(m.price(sum(x), sum(y), ratio)) + m.TWO * (di + dj > 2) + m.KIND * (len({*kx, *ky}) > 1)


def least_table(la, ka, lb, kb):
    ratio, cost = m.ratio_of(la, lb), {}
    for i in range(len(la) + 1):
        for j in range(len(lb) + 1):
            cost[i, j] = 0 if i == j == 0 else min(
                cost[i - di, j - dj] + price_of_one(di, dj, la[i - di : i], ka[i - di : i], lb[j - dj : j], kb[j - dj : j], ratio)
                for di, dj in m.BEADS if i >= di and j >= dj
            )
    return cost[len(la), len(lb)]


def damaged(rng, lengths):
    out = [int(x * 1.1) for x in lengths]
    for _ in range(rng.randrange(4)):
        if len(out) > 2:
            at, kind = rng.randrange(len(out) - 1), rng.random()
            if kind < 0.4:
                out[at : at + 2] = [sum(out[at : at + 2])]
            elif kind < 0.7:
                out.pop(at)
            else:
                out[at : at + 1] = [out[at] // 2, out[at] - out[at] // 2]
    return out


@pytest.mark.parametrize("cells", [20, 1 << 22])
def test_optimum(monkeypatch, cells):
    """Also with so few pointers that the rows are halved all the way."""
    monkeypatch.setattr(m, "CELLS", cells)
    rng = random.Random(1)
    for t in range(250):
        n = rng.randrange(0, 35 if t % 3 == 0 else 12)
        la = [rng.randrange(0, 200) for _ in range(n)]
        lb = damaged(rng, la) if t % 2 else [rng.randrange(0, 200) for _ in range(rng.randrange(0, 14))]
        ka = [rng.choice([0, 0, 0, 1, 2]) for _ in la]
        kb = (ka + [0] * len(lb))[: len(lb)] if t % 2 else [rng.choice([0, 0, 1]) for _ in lb]
        assert price(m.align(la, ka, lb, kb), la, ka, lb, kb) == least_table(la, ka, lb, kb)


def test_long_books_stay_small_and_exact():
    """Far more rows than pointers; the only lost paragraph is found."""
    rng = random.Random(5)
    la = [rng.randrange(200, 900) for _ in range(4000)]
    lb = la[:1700] + la[1701:]
    beads = m.align(la, [0] * 4000, lb, [0] * 3999)
    assert [b for b in beads if b[1] - b[0] != 1 or b[3] - b[2] != 1] == [(1700, 1701, 1700, 1700)]


def cut(spark, rows, size):
    df = spark.createDataFrame(rows, "id int, a string, b string")
    got = df.select("id", "a", "b", p.aligned_windows(F.col("a"), F.col("b"), size).alias("w")).collect()
    for r in got:
        a, b = r.a or "", r.b or ""
        assert "".join(a[w.a_start : w.a_start + w.a_chars] for w in r.w) == a
        assert "".join(b[w.b_start : w.b_start + w.b_chars] for w in r.w) == b
        assert r.w and all(max(w.a_chars, w.b_chars) <= size for w in r.w)
    return {r.id: r for r in got}


def book(rng, n):
    return [" ".join("w" * rng.randrange(2, 9) for _ in range(rng.randrange(3, 60))) for _ in range(n)]


def test_windows_hold_what_belongs_together(spark):
    rng = random.Random(6)
    lines = book(rng, 120)
    after = [f"{i}:{t}é" for i, t in enumerate(lines)]
    merged = after[:40] + [after[40] + " " + after[41]] + after[42:77] + after[78:]  # two become one, one is lost
    before = [f"{i}:{t}" for i, t in enumerate(lines)]
    rows = [(1, "\n".join(before), "\n".join(merged)), (2, "", ""), (3, None, "x\ny"), (4, "😀" * 900, "e\n" * 700), (5, "\n\n\na", None), (6, "a\r\n\r\nb\n", "ä\n")]
    r = cut(spark, rows, 1000)[1]
    assert len(r.w) > 20
    for w in r.w:
        first = [re.findall(r"(?m)^(\d+):", text) for text in (r.a[w.a_start : w.a_start + w.a_chars], r.b[w.b_start : w.b_start + w.b_chars])]
        assert set(first[0]) - set(first[1]) <= {"41", "77"} and set(first[1]) <= set(first[0])


def losses(spark, rows):
    df = spark.createDataFrame(rows, "id int, original string, translated string")
    got = editorial.structure_losses(df, "original", "translated", "id").collect()
    return sorted((r.id, r.change, r.kind, r.place, r.place_after) for r in got)


def test_structure(spark):
    rng = random.Random(7)
    lines = book(rng, 30)
    lines[0], lines[10], lines[11], lines[12] = "# Start", "- " + lines[10], "- " + lines[11], "2. " + lines[12]
    lines[20] = "Chapter " + lines[20]
    text = "\n\n".join(lines)

    def changed(do):
        new = list(lines)
        do(new)
        return "\n\n".join(new)

    halves = lambda t: [t[: len(t) // 2], t[len(t) // 2 :]]
    rows = [
        (1, text, text), (2, text, changed(lambda x: x.pop(5))), (3, text, changed(lambda x: x.pop(20))), (4, text, changed(lambda x: x.pop(11))),
        (5, text, changed(lambda x: x.__setitem__(slice(6, 8), [x[6] + " " + x[7]]))), (6, text, changed(lambda x: x.__setitem__(slice(15, 16), halves(x[15])))),
        (7, text, changed(lambda x: x.__setitem__(10, x[10][2:]))), (8, text, changed(lambda x: x.insert(25, "# New"))), (9, text, text.replace("\n\n", "\n", 1)),
        (10, text, ""), (11, None, "a\nb"), (12, "", None), (13, text, text + "\n"),
    ]
    got = losses(spark, rows)
    by = lambda i: [g[1:] for g in got if g[0] == i]
    assert by(1) == by(12) == by(13) == []
    assert by(2) == [("lost", "paragraph", 6, 5)]
    assert by(3) == [("lost", "heading", 21, 20)]
    assert by(4) == [("lost", "list item", 12, 11)]
    assert by(5) == [("merged", "paragraph", 7, 7)]
    assert by(6) == [("split", "paragraph", 16, 16)]
    assert by(7) == [("retyped", "list item", 11, 11)]
    assert by(8) == [("added", "heading", 25, 26)]
    assert by(9) == [("blank lines lost", "heading", 1, 1)]
    assert [g[0] for g in by(10)] == ["lost"] * 30
    assert by(11) == [("added", "paragraph", 0, 1), ("added", "paragraph", 0, 2)]
