"""Line dedup against edit distances of all pairs."""

import random
from itertools import combinations

import numpy as np
import pytest

from foliospark.llm import line_dedup as m


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def matching(a, b):
    return distance(a, b) <= m.edits_for(min(len(a), len(b)))


def edited(rnd, text, times):
    text = list(text)
    for _ in range(times):
        at, kind = rnd.randrange(len(text) + 1), rnd.choice("ids")
        if kind == "i" or not text:
            text.insert(at, rnd.choice("abñ"))
        elif kind == "d":
            text.pop(min(at, len(text) - 1))
        else:
            text[min(at, len(text) - 1)] = rnd.choice("abñ")
    return "".join(text)


@pytest.fixture(scope="module")
def corpus():
    rnd = random.Random(4)
    made = ["".join(rnd.choice("abñ") for _ in range(rnd.randrange(0, 45))) for _ in range(25)]
    rows = [(None, "first\nfirst line of all"), (3, None), (2, ""), (2, ""), (9, "first line of all!\n\n" + "x" * 5000)]
    for i in range(10, 60):
        rows.append((i, "\n".join(edited(rnd, rnd.choice(made), rnd.randrange(4)) for _ in range(rnd.randrange(1, 6)))))
    rows.append((60, "x" * 2000 + "y" + "x" * 2999))
    return rows


def expected(rows):
    places = {}
    for doc, text in set(rows):
        for k, line in enumerate((text or "").split("\n")):
            places.setdefault(line, []).append((doc is not None, doc or 0, text or "", k))
    lines = list(places)
    links = {x: set() for x in lines}
    for x, y in combinations(lines, 2):
        if abs(len(x) - len(y)) <= 2 and matching(x, y):
            links[x].add(y)
            links[y].add(x)
    first = {x: min(places[x], key=lambda p: (p[0], p[1], p[3])) for x in lines}
    return links, first


def test_bands_agree_with_the_full_table():
    rnd = random.Random(8)
    left = ["".join(rnd.choice("abñ") for _ in range(rnd.randrange(0, 60))) for _ in range(1500)]
    right = [edited(rnd, x, rnd.randrange(5)) for x in left]
    got = m.within([m.codes(x) for x in left], [m.codes(x) for x in right])
    assert got.tolist() == [bool(matching(x, y)) for x, y in zip(left, right)]


def test_every_match_shares_a_key():
    rnd = random.Random(6)
    for _ in range(400):
        x = "".join(rnd.choice("abñ") for _ in range(rnd.randrange(10, 60)))
        y = edited(rnd, x, rnd.randrange(1, 3))
        if x != y and min(len(x), len(y)) >= m.PER_EDIT and matching(x, y):
            found = [({}, {}), ({}, {})]
            for rows, keys, indexed in m.Lines([x, y]).keys(np.arange(2)):
                for r, k in zip(rows, keys):
                    found[r][0 if indexed else 1][k] = 1
            one, two = found
            assert set(one[0]) & (set(two[0]) | set(two[1])) or set(two[0]) & (set(one[0]) | set(one[1]))


@pytest.mark.parametrize("group", [512, 2])
def test_all_pairs(spark, corpus, monkeypatch, group):
    monkeypatch.setattr(m, "GROUP", group)
    links, first = expected(corpus)
    docs = spark.createDataFrame(corpus, "doc_id long, text string").repartition(5)
    rows = m.lines(docs).collect()
    assert len(rows) == sum((t or "").count("\n") + 1 for _, t in corpus)
    texts = {}
    for doc, text in corpus:
        texts[doc] = text or ""
    for r in rows:
        line = texts[r.doc_id].split("\n")[r.number]
        assert r.links == len(links[line]), line
        assert (r["first"].doc_id, r["first"].number) == ((first[line][1] if first[line][0] else None), first[line][3])
        here = (r.doc_id is not None, r.doc_id or 0, r.number)
        own = (first[line][0], first[line][1], first[line][3])
        near = any((first[o][0], first[o][1], first[o][3]) < own for o in links[line])
        assert r.kept == (line == "" or (here == own and not near)), line


def test_stage_keeps_documents_and_columns(spark):
    docs = spark.createDataFrame(
        [(1, "a line that is long enough\nother", "en", 32, "s"), (2, "A line that is long enough\nnew", "en", 30, "t"), (3, None, None, None, None), (4, "", "de", 0, "u")],
        "doc_id long, text string, `row` string, n_chars long, `k1` string",
    )
    got = {r.doc_id: r for r in m.keep_first_lines(spark, docs, "").collect()}
    assert m.keep_first_lines(spark, docs, "").columns == docs.columns
    assert (got[1].text, got[2].text, got[2].n_chars, got[3].text, got[4].text) == ("a line that is long enough\nother", "new", 3, None, "")
    assert m.lines(docs.limit(0)).count() == 0
