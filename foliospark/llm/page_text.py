"""Main text of web pages by deduction of a host's template from equivalence classes of tokens.

Tokens. A page is a sequence of tags and text nodes. A token is a tag or a text node together with its
path of open tags, so that equal tags in different places are different tokens.

Classes. Tokens of one host with equal occurrence vectors (how often in each page) form a class. It is
kept by a fingerprint: the exclusive or of a hash of (page, count) over the pages. Pages of equal content count
once here and everywhere in the template, so that copies change nothing. A class is valid if it has at least two tokens and lies in at least ``SUPPORT`` of the host's pages. Classes are not nested:
the text tokens of all valid classes, in page order, are the template; what is between its tokens are the slots. The tokens that come once a page must come
in the template's order (that of their mean places); a page's token out of order belongs to a slot.

Extraction. Text nodes of the template go. Of the others, those in slots of the article remain: the ``article``
elements, else ``main``, else the smallest element with ``MOST`` of what is left. Elements whose name, role, class or
id marks menus, headers, footers, sidebars, notices, adverts, forms and reader comments are no part of it. A class or
id counts as a whole, or as such a name with a word for its place or its box (``site-header``, ``comment-list``);
``has-sidebar``, ``no-comments`` or ``related-work`` mark nothing. An article in a form or in an element with such a
class is an article all the same, but not one among reader comments or in a menu, sidebar or footer.
Headings in the header of an article are part of it. A host with fewer than ``PAGES`` different pages
has no text template, and pages without a host have none: with nine pages, nine tenths of them are all of them, so one page
that lacks a token would decide. There only elements decide.

Defined cases: a null or empty html has an empty text. Unclosed and stray tags, comments, raw script text and pages
that end inside a tag are read as browsers do, roughly. Rows with equal ids are separate pages. An empty table
gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm import common
from foliospark.llm.common import stored
from foliospark.llm.url_filter import parts

SUPPORT = 0.9
PAGES = 10
MOST = 0.7  # of the text, in the smallest element taken for the article
FILTER_BITS = 26  # of the filter of repeated contents: 8 MB whatever the input
SALTS = 16  # shares of a host's pages, so that a hot host is no single task
PIECE = 1 << 22
MASK = (1 << 63) - 1

MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<[!?/][^>]*+(?:>|\Z)|<[a-zA-Z][^>]*+(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
NAME = re.compile(r"[a-z]+")  # of a path: numbers in classes and ids differ from page to page
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "br", "caption", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure",
    "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hr", "html", "li", "main", "menu", "nav", "ol", "p", "pre", "section",
    "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"ul", "ol", "dl", "table", "select"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
ASIDE_TAGS = {"aside", "button", "canvas", "datalist", "dialog", "footer", "form", "head", "input", "label", "menu", "nav", "object", "option", "select", "svg"}
ASIDE_ROLES = {"alert", "alertdialog", "banner", "complementary", "contentinfo", "dialog", "form", "menu", "menubar", "navigation", "search"}
PLACE_WORDS = "site|page|main|global|top|bottom|left|right|primary|secondary|sticky|mobile|user|reader|blog|cookie|newsletter|social|google"
BOX_WORDS = "area|bar|banner|block|box|container|content|form|inner|item|link|links|list|menu|message|panel|popup|section|slot|thread|top|unit|widget|wrap|wrapper"
COMMENT_NAMES = {"comment", "comments", "replies", "respond", "disqus"}
ASIDE_NAMES = COMMENT_NAMES | {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "consent", "cookie", "cookies",
    "disclaimer", "footer", "gdpr", "header", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices",
    "notification", "pager", "pagination", "popup", "promo", "promotion", "related", "search", "share", "sharing", "sidebar", "signup", "social",
    "sponsor", "sponsored", "subscribe", "subscription", "toolbar", "topbar", "widget",
}


MARKED = re.compile(rf"(?:(?:{PLACE_WORDS})[-_]+)?({'|'.join(sorted(ASIDE_NAMES, key=len, reverse=True))})(?:[-_]+(?:{BOX_WORDS}|[0-9]+))*")


def marked_by(names: str) -> str | None:
    """The aside's name among classes and ids, comments first."""
    found = {m[1] for name in names.split() if (m := MARKED.fullmatch(name))}
    return min(found, key=lambda n: (n not in COMMENT_NAMES, n), default=None)


def hashed(*values: str) -> int:
    return xxhash.xxh64_intdigest("\0".join(values).encode("utf-8", "surrogatepass"), 3) & MASK


class Element:
    __slots__ = ("tag", "parent", "depth", "path", "aside", "firm", "header", "heading", "article", "main")

    def __init__(self, tag: str, attributes: str, parent: Element | None):
        found = {m[1].lower(): (m[2] or m[3] or m[4] or "").lower() for m in ATTRIBUTE.finditer(attributes)} if attributes else {}
        names = found.get("class", "") + " " + found.get("id", "")
        self.tag, self.parent, self.depth = tag, parent, parent.depth + 1 if parent else 0
        self.path = hashed(str(parent.path) if parent else "", tag, " ".join(sorted(set(NAME.findall(names)))))
        self.article = tag == "article" or bool(parent and parent.article)
        self.main = tag == "main" or found.get("role") == "main" or bool(parent and parent.main)
        self.heading = tag in HEADINGS or bool(parent and parent.heading)
        self.header = tag == "header" or bool(parent and parent.header)
        mark = None if tag in ("html", "body", "main") else marked_by(names)
        own = tag in ASIDE_TAGS or found.get("role") in ASIDE_ROLES or mark is not None
        # A firm aside keeps even articles; the others lose them.
        self.firm = (tag in ASIDE_TAGS and tag != "form") or mark in COMMENT_NAMES or bool(parent and parent.firm)
        around = bool(parent and (parent.firm if tag == "article" else parent.aside))
        self.aside = own or around


class Node:
    """A text node: its text, the block it belongs to, its element, the token it is."""

    __slots__ = ("text", "block", "element", "token")

    def __init__(self, text: str, block: int, element: Element):
        self.text, self.block, self.element = text, block, element
        self.token = hashed(str(element.path), " ".join(text.split()))


def read(page: str) -> tuple[list[Node], list[Element]]:
    """Text nodes in page order, and the elements in the order of their tags; the first is the page itself."""
    root = Element("", "", None)
    stack, nodes, elements, block, at = [root], [], [root], 0, 0
    open_tags: Counter = Counter()
    marks: list[int] = []  # places in the stack of the elements that a start tag may close or stop at
    end = len(page)

    def close_from(k: int) -> None:
        open_tags.subtract(e.tag for e in stack[k:])
        del stack[k:]
        while marks and marks[-1] >= k:
            marks.pop()

    while at < end:
        m = MARKUP.search(page, at)
        text = page[at : m.start()] if m else page[at:]
        if text:
            decoded = unescape(text)
            nodes.append(Node(decoded, block, stack[-1]))
        if not m:
            break
        at = m.end()
        tag = m[2].lower() if m[2] else None
        if tag is None:
            continue
        if tag in BLOCK:
            block += 1
        if m[1]:
            if open_tags[tag]:
                k = len(stack) - 1
                while stack[k].tag != tag:
                    k -= 1
                close_from(k)
            continue
        if tag in RAW:
            close = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            at = close.end() if close else end
            continue
        if tag in CLOSES:
            for k in reversed(marks):
                if stack[k].tag in CLOSES[tag]:
                    close_from(k)
                    break
                if stack[k].tag in SCOPES:
                    break
        elif tag in BLOCK and tag != "br":
            k = next((k for k in reversed(marks) if stack[k].tag in BLOCK), 0)
            if stack[k].tag == "p":
                close_from(k)
        element = Element(tag, m[3], stack[-1])
        elements.append(element)
        if tag not in VOID and not m[3].endswith("/"):
            if tag in BLOCK or tag in CLOSES or tag in SCOPES:
                marks.append(len(stack))
            stack.append(element)
            open_tags[tag] += 1
    return nodes, elements


def joined(nodes: list[Node]) -> str:
    """Blocks in page order; white space in a block is one space."""
    blocks: dict[int, list[str]] = {}
    for node in nodes:
        blocks.setdefault(node.block, []).append(node.text)
    return " ".join(t for parts_ in blocks.values() if (t := " ".join("".join(parts_).split())))


def slots(nodes: list[Node], template: dict[int, tuple[int, bool]]) -> list[Node]:
    """The nodes that aren't the template's: token -> (rank in the template's order, comes once a page)."""
    out, last = [], -1
    for node in nodes:
        rank, once = template.get(node.token, (-1, False))
        if rank >= 0 and node.text.strip() and (not once or rank > last):
            last = rank if once else last
        else:
            out.append(node)
    return out


def main_text(page: str, template: dict[int, tuple[int, bool]]) -> str:
    """Text of the article's slots."""
    nodes, elements = read(page)
    free = slots(nodes, template)

    def shown(node: Node) -> bool:
        e = node.element
        return not e.aside and (not e.header or ((e.article or e.main) and e.heading))

    for inside in (lambda e: e.article, lambda e: e.main):
        if any(inside(n.element) for n in nodes):
            own = [n for n in free if inside(n.element)]
            text = joined([n for n in own if shown(n)])
            if text or any(shown(n) for n in own):
                return text
    # No element tells: the smallest one that holds most of the text. An element comes after its parent.
    own = [n for n in free if shown(n)]
    size: dict[Element, int] = dict.fromkeys(elements, 0)
    for node in own:
        size[node.element] += len(node.text.strip())
    for element in reversed(elements[1:]):
        size[element.parent] += size[element]
    best = max((e for e in elements if size[e] >= MOST * size[elements[0]]), key=lambda e: e.depth)
    inside = {best}
    for element in elements[1:]:
        if element.parent in inside:
            inside.add(element)
    return joined([n for n in own if n.element in inside])


def token_rows(pages: DataFrame) -> DataFrame:
    """(host, token, text, pages, total, places, vector): each task adds up its own pages first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, keys = batch.column("host").to_pylist(), batch.column("content").to_pylist()
            for x, texts in common.pieces(batch.column("html"), PIECE):
                seen: dict = {}
                for i, page in enumerate(texts):
                    nodes, elements = read(page)
                    order: dict = {}
                    counts: Counter = Counter()
                    for place, (token, is_text) in enumerate([(e.path, False) for e in elements[1:]] + [(n.token, True) for n in nodes if n.text.strip()]):
                        counts[token, is_text] += 1
                        order.setdefault((token, is_text), place)
                    for (token, is_text), n in counts.items():
                        row = seen.setdefault((hosts[x + i], token, is_text), [0, 0, 0, 0])
                        row[0] += 1
                        row[1] += n
                        row[2] += order[token, is_text]
                        row[3] ^= xxhash.xxh64_intdigest(b"%d %d" % (keys[x + i], n), 5) & MASK
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.int64()), pa.array([k[2] for k in seen], pa.bool_()),
                     *[pa.array([v[c] for v in seen.values()], pa.int64()) for c in range(4)]],
                    names=["host", "token", "text", "pages", "total", "places", "vector"],
                )

    return pages.select("host", "content", "html").mapInArrow(run, "host string, token long, text boolean, pages long, total long, places long, vector long")


def once(pages: DataFrame, contents: DataFrame) -> DataFrame:
    """(host, content, html): one page of each content of a host. Only pages whose content may be repeated move."""
    repeated = common.bitmap(contents.where("copies > 1").select("content"), "content", FILTER_BITS)
    shared = pages.sparkSession.sparkContext.broadcast(repeated)

    @F.pandas_udf("boolean")
    def marked(content: pd.Series) -> pd.Series:
        return pd.Series(common.in_bitmap(shared.value, content.to_numpy()))

    rows = pages.select("host", "content", "html", marked("content").alias("again"))
    several = rows.where("again").groupBy("host", "content").agg(F.first("html").alias("html"))
    return rows.where("not again").select("host", "content", "html").union(several)


def templates(pages: DataFrame) -> DataFrame:
    """(host, template): the text nodes in valid classes of a host, in order: (mean place, token, comes once a page)."""
    pages = pages.where("host <> ''")
    contents = stored(pages.groupBy("host", "content").agg(F.count("*").alias("copies")), "page-contents")
    hosts = contents.groupBy("host").agg(F.count("*").alias("n")).where(F.col("n") >= PAGES)
    tokens = token_rows(once(pages, contents)).groupBy("host", "token", "text").agg(
        F.sum("pages").alias("pages"), F.sum("total").alias("total"), F.sum("places").alias("places"), F.bit_xor("vector").alias("vector")
    )
    common_tokens = tokens.join(hosts, "host").where(F.col("pages") >= F.col("n") * SUPPORT)
    common_tokens = stored(common_tokens, "page-tokens")
    # Few tokens are on most pages of a host, so a class is small.
    classes = common_tokens.groupBy("host", "vector").agg(F.count("*").alias("tokens"))
    valid = common_tokens.join(classes.where("tokens >= 2"), ["host", "vector"])
    return valid.where("text").groupBy("host").agg(F.sort_array(F.collect_set(
        F.struct((F.col("places") / F.col("pages")).alias("place"), "token", (F.col("total") == F.col("pages")).alias("once"))
    )).alias("template"))


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text of every row of ``pages`` (page_id, url, html)."""
    host, _ = parts(F.col("url"))
    key = F.xxhash64("page_id", "url", "html")
    keyed = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), host.alias("host"), key.alias("key"), F.xxhash64("html").alias("content"))
    found = templates(keyed).select("host", "template", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    spread = keyed.select("page_id", "url", "html", "host", F.pmod("key", F.lit(SALTS)).cast("int").alias("salt"))

    @F.pandas_udf("string")
    def text_of(html: pd.Series, template: pd.Series) -> pd.Series:
        out = []
        for page, tokens in zip(common.strings(html), template):
            ranked = {t["token"]: (k, t["once"]) for k, t in enumerate(tokens)} if tokens is not None else {}
            out.append(main_text(page, ranked))
        return pd.Series(out, dtype=object)

    return spread.join(found, ["host", "salt"], "left").select("page_id", "url", text_of("html", "template").alias("text"))


def op3_pages(spark, sf_dir: str) -> DataFrame:
    return extracted(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
