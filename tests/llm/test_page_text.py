"""Main texts of made pages with and without an article element."""

import random
import time

import pytest

from foliospark.llm import page_text as m


def words(rnd, n):
    return " ".join(f"{rnd.choice(['alpha', 'beta', 'gamma'])}{rnd.randrange(999)}" for _ in range(n))


def article(rnd, i):
    body, more = words(rnd, 30), words(rnd, 12)
    html = (
        f'<!DOCTYPE html><html><head><title>T {i}</title><style>p{{a:b}}</style></head><body><header class="site"><h2>Site</h2></header><div class="cookie-notice">We use cookies</div>'
        f'<nav><ul><li>Home<li>News</ul></nav><!-- <article>no</article> --><article><header><h1>Title&nbsp;{i}</h1><p>by line {i}</p></header><p>{body}<p>{more} &amp; x<b>y{i}</b>&lt;z{i}&gt;<br>end {i}'
        f'<div class="ad">buy {i}</div><script>if (a < b) "</article>"</script><form>mail <input name=q></form><section id="comments"><article>nice {i}</article></section></article>'
        f'<aside>side {i}</aside><footer>&copy; us</footer>'
    )
    return html, f"Title {i} {body} {more} & xy{i}<z{i}> end {i}"


def plain(rnd, i):
    body, more = words(rnd, 40), words(rnd, 25)
    html = (
        f"<body><div class=menu>a b c</div><div id=wrap><div class=c1><span>Posted on our site</span><h1>Head {i}</h1><p>{body}</p><p>{more}</p><span>Read the rules</span></div>"
        f'<div class="sidebar">other {i}</div></div><div role="contentinfo">legal</div></body>'
    )
    return html, f"Head {i} {body} {more}"


def test_article_and_template(spark):
    rnd = random.Random(3)
    rows, want = [], {}
    for i in range(30):
        for base, make, host in ((0, article, "a.example.com"), (100, plain, "b.example.com")):
            html, text = make(rnd, i)
            rows.append((base + i, f"http://{host}/{i}", html, "clash"))
            want[base + i] = text
    rows += [(200, None, None, ""), (201, "x", "", ""), (202, "http://c.org/", "no tags &amp at all", ""), (203, "http://c.org/", "<p>Only <b>bold</b>text</p><div class='ads'>buy</div>", ""), (203, "http://c.org/", "<p", "")]
    table = spark.createDataFrame(rows, "page_id long, url string, html string, host string").repartition(4)
    got = sorted((r.page_id, r.text) for r in m.extracted(table).collect())
    own = dict(got)
    assert len(got) == len(rows)
    assert {i: own[i] for i in want} == want
    assert own[200] == own[201] == "" and own[202] == "no tags & at all"
    assert [t for i, t in got if i == 203] == ["", "Only boldtext"]
    assert m.extracted(table.limit(0)).count() == 0


def test_copies_are_no_template(spark):
    html = article(random.Random(1), 5)
    table = spark.createDataFrame([(i, "http://a.example.com/", html[0]) for i in range(40)], "page_id long, url string, html string")
    assert {r.text for r in m.extracted(table).collect()} == {html[1]}


def test_order_of_template_tokens():
    nodes, _ = m.read("<p>one</p><p>two</p><p>free</p><p>three</p>")
    template = {nodes[0].token: (5, True), nodes[1].token: (6, True), nodes[3].token: (1, True)}
    assert [n.text for n in m.slots(nodes, template)] == ["free", "three"]


def test_very_long_and_broken():
    deep = "<div>" * 3000 + "x" + "</div>" * 10
    assert m.main_text(deep, {}) == "x"
    assert m.main_text("<article>" + "<p>w</p>" * 20000, {}) == " ".join(["w"] * 20000)
    assert m.main_text("<article><p>a</b></i>b</article", {}) == "ab"


@pytest.mark.parametrize(
    "page, text",
    [
        ('<div class="has-sidebar"><article><h1>Title</h1><p>Real text here.</p></article><div class="sidebar">no</div></div>', "Title Real text here."),
        ('<article class="post no-comments"><p>Text.</p></article>', "Text."),
        ('<article><header class="entry-header"><h1>Title</h1></header><p>Text.</p></article>', "Title Text."),
        ('<article><p>Text.</p><section id="related-work"><p>More.</p></section><div class="related">no</div></article>', "Text. More."),
        ('<form id="aspnetForm"><div class="ads-free"><article><p>Text.</p></article></div></form>', "Text."),
        ('<div class="widget"><article><p>Text.</p></article></div>', "Text."),
        ('<article><p>Text.</p></article><div class="comment-list"><article><p>nice</p></article></div>', "Text."),
        ('<article><p>Text.</p></article><aside><article><p>teaser</p></article></aside><footer><article>x</article></footer>', "Text."),
        ('<div class="site-header">a</div><div><p>Text of the page.</p></div><div id="cookie-banner">b</div><div class="x newsletter-form-2">c</div>', "Text of the page."),
    ],
)
def test_names_of_elements(page, text):
    assert m.main_text(page, {}) == text


def test_deep_and_wide_pages_take_linear_time():
    for make in (
        lambda n: "<div>x" * n, lambda n: "<div>" * n + "x", lambda n: "<b>x" * n + "<p>y</p>" * n, lambda n: "<b>" * n + "</i>" * n + "x",
        lambda n: "<p>x</p>" * n, lambda n: "<ul>" + "<li>x<b>y" * n, lambda n: "<article>" + "<div class=ad>" * n + "z",
    ):
        m.main_text(make(1000), {})
        start = time.process_time()
        m.main_text(make(4_000), {})
        few = time.process_time() - start
        start = time.process_time()
        m.main_text(make(32_000), {})
        assert time.process_time() - start < 8 * 3 * max(few, 0.05)


def test_pages_without_a_host_share_no_template(spark):
    rnd = random.Random(4)
    rows = [(i, url, f"<article><p>Same on all pages</p><p>{words(rnd, 20)}</p></article>") for i, url in enumerate([None, "", "x", "/a"] * 8)]
    got = m.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == 32 and all(r.text.startswith("Same on all pages ") for r in got)
