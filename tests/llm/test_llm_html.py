"""HTML extraction: rules on fixtures, and the given pages against an extractor that walks a parsed tree."""

from html.parser import HTMLParser

import pytest
from test_llm_language import SF

from evidentia.llm import htmltext
from evidentia.llm.queries import QUERIES

LONG = " ".join(f"w{i}" for i in range(20))


def kept(page):
    return "\n".join(t for k, t in htmltext.blocks(page) if k != htmltext.FURNITURE)


@pytest.mark.parametrize("page, want", [
    ('<div class="page with-sidebar"><article><p>Hello world</p></article></div>', "Hello world"),
    ('<form id="aspnetForm"><nav>n</nav><article><p>Hello</p><form>f</form></article><div class="comments"><article class="comment">c</article></div></form>', "Hello"),
    ('<article><section id="related-work"><p>one</p></section><p class="notice-period">two</p><p class="notice">no</p><div class="siteFooter">x</div></article>', "one\ntwo"),
    (f'<article><p>a</p></article><div class="content"><p>{LONG}</p></div><div>short</div>', f"a\n{LONG}"),
    ('<section id="comments"><article>c1</article></section><main><p>real</p></main>', "real"),
    ('<div class="sidebar"><article>only</article></div>', "only"),
    ('<article><p>x</p><section class="comments"><article class="comment">c</article></section><p>y</p></article>', "x\ny"),
    ('<article><p>x</p><article class="comment">c</article><p>y</p></article>', "x\ny"),
    ('<article class="comment">c</article><article>m</article>', "m"),
    ('<article class="promo">only</article>', "only"),
    ('<div class="sidebar"><article>t1</article></div><article>m</article><div class="ad">q</div>', "m"),
    ('<nav><article>x</nav><p>y</p>', "x"),
    ('<main class="site-header"><p>m</p></main>', "m"),
    ('<div itemprop="articleBody"><p>b</p><aside>s</aside></div>', "b"),
    ('<div class="cookie-notice">c</div><div class="mainNav">n</div><div id="post-comments">r</div><p>rest</p>', "rest"),
    ('<article><div class="ad-banner">a</div><div hidden>h</div><p>t &amp; u&nbsp;v</p></article>', "t & u v"),
    ("", ""), ("<article></article>", ""), ("no tags at all", "no tags at all"),
])
def test_furniture_and_articles(page, want):
    assert kept(page) == want


class Tree(HTMLParser):
    """The text of article elements by a plain walk: a block per block element, without nav, header, footer, aside, form, script and style."""

    SKIP = {"nav", "header", "footer", "aside", "form", "script", "style", "title"}
    BLOCK = {"article", "p", "h1", "h2", "h3", "h4", "ul", "ol", "li", "div", "section", "blockquote", "pre", "table", "tr"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.skipped, self.now, self.done = 0, 0, [], []

    def end_block(self):
        text = " ".join("".join(self.now).split())
        if text:
            self.done.append(text)
        self.now = []

    def handle_starttag(self, tag, attrs):
        if tag in self.BLOCK:
            self.end_block()
        self.inside += tag == "article"
        self.skipped += tag in self.SKIP
        if tag == "br":
            self.now.append(" ")

    def handle_endtag(self, tag):
        if tag in self.BLOCK:
            self.end_block()
        self.inside -= tag == "article"
        self.skipped -= tag in self.SKIP

    def handle_data(self, data):
        if self.inside and not self.skipped:
            self.now.append(data)


def walked(page):
    tree = Tree()
    tree.feed(page or "")
    tree.close()
    tree.end_block()
    return "\n".join(tree.done)


@pytest.mark.parametrize("sf", [SF, SF.replace("sf0.001", "sf0.01")])
def test_pages_equal_a_walk_over_their_tree(spark, sf):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = {r.page_id: (r.text, r.n_chars) for r in QUERIES["op8_html_extraction"](spark, sf).collect()}
    want = {i: walked(page) for i, page in pages.items()}
    assert got == {i: (text, len(text)) for i, text in want.items()} and sum(map(bool, want.values())) > 0.9 * len(want)


def test_repeated_text_beside_articles_goes_and_unique_text_stays(spark):
    own = lambda i: " ".join(f"p{i}x{j}" for j in range(25))
    rows = [(i, "http://h.net/a", f"<article><p>main {i}</p></article><div>{LONG}</div><div>{own(i)}</div>") for i in range(4)]
    rows += [(9, None, None), (10, "http://h.net/b", ""), (11, "x", "<p>alone")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = dict(htmltext.main_text(df).select("page_id", "main_text").collect())
    assert got == {i: f"main {i}\n{own(i)}" for i in range(4)} | {9: "", 10: "", 11: "alone"}
