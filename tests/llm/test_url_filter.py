"""URL parts and rules against plain Python; the language models against hand counts."""

import random
from math import isclose

from foliospark.llm import url_filter as m


def plain(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    stop = min([path.find(c) for c in "?#" if c in path], default=len(path))
    return host, path[:stop]


def plain_rule(host, path):
    best = None
    for verdict, rule in m.RULES:
        domain, start = rule[: rule.index("/")], rule[rule.index("/") :]
        if (host == domain or host.endswith("." + domain)) and path.startswith(start) and (best is None or len(rule) > len(best[1])):
            best = (verdict, rule)
    return best


def urls():
    rnd = random.Random(2)
    made = [None, "", "no scheme", "http://", "HTTP://WWW.Example.ORG", "http://example.org/en/1?x=/y#z", "http://badexample.org/es/", "https://a.com?q=http://b.org/de/", "x://É.ORG/Ü#f", "http://org/", "http://u:p@h.com:80/fr/x\ny"]
    for _ in range(300):
        host = rnd.choice(["", "www.", "m."]) + rnd.choice(["alpha", "beta", "example"]) + "." + rnd.choice(["org", "com", "net", "example.org"])
        made.append(f"http://{host}/{rnd.choice(['de', 'fr', 'en', 'es'])}/{rnd.randrange(300)}{rnd.choice(['', '?a=b', '#t', '/'])}")
    return made + made[:20]


def test_rows(spark):
    made = list(enumerate(urls()))
    rows = {r.page_id: r for r in m.judged(spark.createDataFrame([(i, u, "clash") for i, u in made], "page_id long, url string, host string").repartition(3)).collect()}
    assert len(rows) == len(made)
    verdicts = {}
    for i, u in made:
        r, by = rows[i], plain_rule(*plain(u))
        assert (r.host, r.path) == plain(u), u
        assert r.rule == (by[1] if by else None)
        assert r.verdict == (by[0] if by else "allow" if r.score >= r.threshold else "block")
        assert verdicts.setdefault(u, r.verdict) == r.verdict
    open_ = [r for r in rows.values() if r.rule is None and "/de/" in r.path]
    assert sum(r.verdict == "block" for r in open_) > len(open_) * 0.8


def test_counts_and_probabilities(spark):
    known = spark.createDataFrame([(True, "ab"), (True, "ab"), (False, "b")], "accepted boolean, url string").repartition(2)
    got = {(r.accepted, r.context, r.next): r.n for r in m.counts(known, 1).collect()}
    e = m.EDGE
    assert got == {
        (True, "", "a"): 2, (True, "", "b"): 2, (True, "", e): 2, (True, e, "a"): 2, (True, "a", "b"): 2, (True, "b", e): 2,
        (False, "", "b"): 1, (False, "", e): 1, (False, e, "b"): 1, (False, "b", e): 1,
    }
    model = m.Model([("", "a", 2), ("", "b", 2), ("a", "b", 2)])
    flat = (2 + 2 / m.CHARACTERS) / 6
    assert isclose(model.probability("", "a"), flat)
    assert isclose(model.probability("a", "b"), (2 + flat) / 3)
    assert isclose(model.probability("zz", "b"), flat)
    total = sum(model.probability("a", c) for c in "ab") + (m.CHARACTERS - 2) * model.probability("a", "q")
    assert isclose(total, 1)


def test_threshold(spark):
    rows = [(True, 2.0), (True, 1.0), (True, -1.0), (False, -2.0), (False, 0.0)]
    assert 0.0 < m.threshold(spark.createDataFrame(rows, "accepted boolean, score double")) <= 1.0
    assert m.threshold(spark.createDataFrame(rows[:3], "accepted boolean, score double")) == 0.0


def test_one_sided_and_empty(spark):
    pages = spark.createDataFrame([(1, "http://a.org/"), (2, "http://b.net/x"), (None, None)], "page_id long, url string")
    rows = {r.page_id: r for r in m.judged(pages).collect()}
    assert [rows[i].verdict for i in (1, 2, None)] == ["allow"] * 3 and rows[2].score == 0.0
    assert m.judged(pages.limit(0)).count() == 0
