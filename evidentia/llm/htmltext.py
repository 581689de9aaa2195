"""Main text of web pages: tagged blocks, and a suffix array per host for boilerplate.

A page becomes blocks of text, each marked as part of the page's article, as furniture (inside
a menu, header, footer, sidebar, notice, advert, form or comment element), or as neither.  The
token streams of a host's pages are concatenated; a suffix array, sorted by prefix doubling to
``RUN_TOKENS`` tokens, shows the substrings of that length that stand in ``PAGES`` distinct
pages or more.  Blocks that are furniture by their element go.  Of blocks that are neither, the
covered tokens go as boilerplate and the unique runs stay.  Article blocks stay whole: pages of
one host may carry the same article, and that text is no boilerplate.

A page without a block that is neither is done in its row, and so is a host with no such page.
The pages of a large host are dealt to shards of about ``SHARD_PAGES`` pages, so a host of any
size is no single task.  A shard's suffix array counts the pages of each of its runs; the counts
are added up over the host's shards, and each shard gets back those of its runs that stand in
``PAGES`` pages of the whole host.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm import words as W
from evidentia.llm.tables import free_name, written
from evidentia.llm.urls import host_and_path
from evidentia.session import broadcast_if_small

RUN_TOKENS = 16
PAGES = 3
SHARD_PAGES = 1000

ARTICLE, OTHER, FURNITURE = "a", "o", "f"
ASIDE = "i"  # an article in furniture, until the page is read
RAW = {"script", "style", "noscript", "template", "iframe", "title", "textarea", "xmp", "noembed", "noframes"}
FOREIGN = {"svg", "math"}  # inside these, any tag that ends in /> is an element without content
CLOSABLE = FOREIGN | {"object", "canvas"}
FURNITURE_TAGS = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "select", "head", "fieldset", "datalist"}
FURNITURE_NAMES = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "banner", "cookie", "cookies", "consent",
                   "notice", "popup", "modal", "overlay", "sidebar", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "header", "footer",
                   "comment", "comments", "disqus", "reply", "replies", "respond", "share", "sharing", "social", "newsletter", "subscribe", "signup", "login",
                   "related", "widget", "toolbar", "pagination", "masthead", "alert"}
#: Words that a compound name may have beside a furniture name: ``site-header`` is furniture, ``with-sidebar`` and ``related-work`` are not.
PLACE_NAMES = {"site", "page", "main", "top", "bottom", "left", "right", "primary", "secondary", "global", "sticky", "fixed", "list", "box", "bar", "item", "items",
               "area", "section", "block", "container", "wrapper", "wrap", "inner", "outer", "link", "links", "button", "buttons", "icon", "icons", "form", "panel",
               "row", "group", "slot", "unit", "zone", "message", "post", "posts", "stories", "user", "reader", "thread"}
FURNITURE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar", "alertdialog"}
BLOCK_TAGS = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset",
              "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav",
              "ol", "option", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
SPACING = {"br", "img", "hr", "td", "th"}

_TAG = re.compile(r"""<!--.*?(?:-->|$)|<(?P<close>/?)(?P<name>[A-Za-z][^\s/>]*)(?P<rest>(?:[^<>"']|"[^"]*"|'[^']*')*)>|<(?P<close2>/?)(?P<name2>[A-Za-z][^\s/>]*)(?P<rest2>[^>]*)(?:>|$)|<[!?/][^>]*(?:>|$)""", re.S)
_ATTRIBUTE = re.compile(r"""([A-Za-z][\w:-]*)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>]|$)[^>]*(?:>|$)", re.I | re.S) for name in RAW}
_NAME = re.compile(r"[a-z]+")
_HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Open(NamedTuple):
    name: str
    furniture: bool
    article: bool
    before: int  # furniture around an outermost article, which does not count inside it


def _furniture_name(names: str) -> bool:
    """Whether one of the class names or ids is a furniture name, or a compound of furniture and place names only."""
    for name in names.split():
        words = _NAME.findall(_HUMP.sub("-", name).lower())
        if any(w in FURNITURE_NAMES for w in words) and all(w in FURNITURE_NAMES or w in PLACE_NAMES for w in words):
            return True
    return False


def _kind_of(name: str, rest: str) -> tuple[bool, bool, bool]:
    """Whether an element is furniture, whether it is an article, and whether its class or id is a furniture name."""
    given = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(rest)} if "=" in rest else {}
    role = given.get("role", "").lower()
    if name in ("html", "body"):
        return False, False, False
    named = _furniture_name(given.get("class", "") + " " + given.get("id", ""))
    article = name in ("article", "main") or role in ("main", "article") or given.get("itemprop", "").lower() == "articlebody"
    furniture = role in FURNITURE_ROLES or "hidden" in rest.split() or (not article and (name in FURNITURE_TAGS or named))
    return furniture, article and not furniture, named


def blocks(page: str) -> list[tuple[str, str]]:
    """(kind, text) of each block with text, in page order; character references decoded, white space one space, trimmed.

    Furniture counts inside an article; of the furniture around an article, a form does not
    count (it may hold the whole page).  An article that stands in other furniture, or has a
    furniture name itself (a comment, a teaser), is the page's article only if there is none
    beside it.  With an article, blocks outside that are too short to show a repeated run are
    furniture; longer ones are left to the suffix array.
    """
    out: list[tuple[str, str]] = []
    parts: list[str] = []
    stack: list[Open] = []
    furniture = forms = article = aside = 0
    kind = OTHER

    def flush() -> None:
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                out.append((kind, text))
            parts.clear()

    def pop() -> None:
        nonlocal furniture, article, aside, forms
        top = stack.pop()
        furniture -= top.furniture
        article -= top.article
        forms -= top.furniture and top.name == "form"
        if top.article and not article:
            furniture, aside = furniture + top.before, 0

    at, size = 0, len(page)
    while at < size:
        found = _TAG.search(page, at)
        begin = found.start() if found else size
        if begin > at:
            now = FURNITURE if furniture else (ASIDE if aside else ARTICLE) if article else OTHER
            if now != kind:
                flush()
                kind = now
            parts.append(page[at:begin])
        if not found:
            break
        at = found.end()
        name = (found["name"] or found["name2"] or "").lower()
        if not name:
            continue
        closing = bool(found["close"] or found["close2"])
        if name in BLOCK_TAGS:
            flush()
        elif name in SPACING:
            parts.append(" ")
        if closing:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth].name == name:
                    while len(stack) > depth:
                        pop()
                    break
        elif (found["rest"] or found["rest2"] or "").endswith("/") and (name in CLOSABLE or any(o.name in FOREIGN for o in stack)):
            pass
        elif name in RAW:
            end = _RAW_END[name].search(page, at)
            at = end.end() if end else size
        elif name not in VOID:
            if name in BLOCK_TAGS and stack and stack[-1].name == "p":
                pop()  # a block ends an open paragraph
            is_furniture, is_article, named = _kind_of(name, found["rest"] or found["rest2"] or "")
            before = 0
            if is_article and not article:
                before, aside = furniture, int(named or furniture > forms)
                furniture = 0
            elif is_article and named:
                is_furniture, is_article = True, False  # a comment or teaser inside an article
            stack.append(Open(name, is_furniture, is_article, before))
            furniture += is_furniture
            article += is_article
            forms += is_furniture and name == "form"
    flush()
    kinds = {k for k, _ in out}
    if ASIDE in kinds:
        out = [(k if k != ASIDE else FURNITURE if ARTICLE in kinds else ARTICLE, t) for k, t in out]
    if kinds & {ARTICLE, ASIDE}:
        out = [(FURNITURE if k == OTHER and len(t.split()) < RUN_TOKENS else k, t) for k, t in out]
    return out


def suffix_runs(codes: np.ndarray, page: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of all runs of ``length`` tokens inside a page, equal runs side by side; where each distinct run
    begins among them; and in how many distinct pages it stands.

    ``codes`` are the tokens of one page after another.  Suffixes are ranked by their first
    1, 2, 4, ... tokens; equal final ranks are neighbours in the suffix array with a common
    prefix of ``length``.
    """
    n = len(codes)
    none = np.zeros(0, dtype=np.int64)
    if n < length:
        return none, none, none
    rank = np.unique(codes, return_inverse=True)[1].astype(np.int64)
    width = 1
    while width < length:
        step = min(width, length - width)
        after = np.full(n, -1, dtype=np.int64)
        after[:n - step] = rank[step:]
        after[:n - step][page[:n - step] != page[step:]] = -1  # suffixes end with their page
        rank = np.unique(rank * (n + 2) + after + 1, return_inverse=True)[1].astype(np.int64)
        width += step
    starts = np.flatnonzero(page[:n - length + 1] == page[length - 1:])
    order = starts[np.lexsort((page[starts], rank[starts]))]  # the suffix array, cut at the length
    if not len(order):
        return none, none, none
    new_rank = np.ones(len(order), dtype=bool)
    new_rank[1:] = rank[order[1:]] != rank[order[:-1]]
    new_page = new_rank.copy()
    new_page[1:] |= page[order[1:]] != page[order[:-1]]
    begin = np.flatnonzero(new_rank)
    return order, begin, np.add.reduceat(new_page.astype(np.int64), begin)


def _covered(n: int, starts: np.ndarray, length: int) -> np.ndarray:
    change = np.zeros(n + 1, dtype=np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + length, -1)
    return np.cumsum(change[:-1]) > 0


def repeated(codes: np.ndarray, page: np.ndarray, length: int = RUN_TOKENS, pages: int = PAGES) -> np.ndarray:
    """Mask of the tokens that lie in a run of ``length`` tokens standing in ``pages`` distinct pages."""
    order, begin, distinct = suffix_runs(codes, page, length)
    often = np.repeat(distinct >= pages, np.diff(np.append(begin, len(order))))
    return _covered(len(codes), order[often], length)


class Tokens:
    """Tokens of some pages one after another."""

    def __init__(self, pages: list[list[tuple[str, str]]]):
        self.words = W.words(pa.array([t for page in pages for _, t in page], pa.string()))
        self.codes = self.words.hashes()
        self.page = np.repeat(np.arange(len(pages)), [len(p) for p in pages])[self.words.doc]

    def names(self, starts: np.ndarray) -> np.ndarray:
        """Two 64-bit hashes (columns) of the run at each start."""
        return np.stack([W.Prefix(self.codes, *seed).range(starts, starts + RUN_TOKENS).view(np.int64) for seed in ((), (0x5851F42D4C957F2D,))], axis=1)


def run_counts(pages: list[list[tuple[str, str]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names of the distinct runs of one shard, in how many of its pages each stands, and whether one touches a
    block that is neither article nor furniture."""
    tokens = Tokens(pages)
    order, begin, distinct = suffix_runs(tokens.codes, tokens.page, RUN_TOKENS)
    if not len(order):
        return np.zeros((0, 2), np.int64), distinct, np.zeros(0, bool)
    other = np.array([kind == OTHER for page in pages for kind, _ in page])[tokens.words.doc]
    so_far = np.concatenate(([0], np.cumsum(other)))
    return tokens.names(order[begin]), distinct, np.maximum.reduceat(so_far[order + RUN_TOKENS] - so_far[order], begin) > 0


def main_texts(pages: list[list[tuple[str, str]]], runs: np.ndarray | None = None) -> list[str]:
    """Main text of each page of one host, or of one shard of it with the names of its repeated ``runs``."""
    tokens = Tokens(pages)
    w = tokens.words
    if runs is None:
        covered = repeated(tokens.codes, tokens.page)
    else:
        n = len(tokens.codes)
        starts = np.flatnonzero(tokens.page[:max(0, n - RUN_TOKENS + 1)] == tokens.page[RUN_TOKENS - 1:])
        pair = np.dtype([("a", np.int64), ("b", np.int64)])
        names = np.ascontiguousarray(tokens.names(starts)).view(pair).ravel() if len(starts) else np.zeros(0, pair)
        covered = _covered(n, starts[np.isin(names, np.ascontiguousarray(runs).view(pair).ravel())], RUN_TOKENS)
    out, at = [], 0
    for page in pages:
        kept = []
        for kind, text in page:
            if kind == ARTICLE:
                kept.append(text)
            elif kind == OTHER:
                low, high = w.first[at], w.first[at + 1]
                hit = covered[low:high]
                left = " ".join(t.decode() for t, gone in zip(text.encode().split(), hit, strict=True) if not gone) if hit.any() else text
                if left:
                    kept.append(left)
            at += 1
        out.append("\n".join(kept))
    return out


def _to_blocks(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        W.turn_to("htmltext")
        for batch in batches:
            for piece in W.pieces(batch, "input"):
                found = [blocks(t) if t else [] for t in piece.column("input").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [piece.column(n) for n in names] + [pa.array(["".join(k for k, _ in page) for page in found], pa.string()),
                                                        pa.array([[t for _, t in page] for page in found], pa.list_(pa.string()))], names=[*names, "kinds", "texts"])
    return run


def _pages(rows: pa.Table) -> list[list[tuple[str, str]]]:
    return [list(zip(kinds, texts, strict=True)) for kinds, texts in zip(rows.column("kinds").to_pylist(), rows.column("texts").to_pylist(), strict=True)]


def _with_text(rows: pa.Table, texts: list[str]) -> pa.Table:
    return rows.drop_columns(["kinds", "texts", "host", "shard"]).append_column("main", pa.array(texts, pa.string()))


def _to_text(rows: pa.Table) -> pa.Table:
    return _with_text(rows, main_texts(_pages(rows)))


RUNS = "host string, shard long, a long, b long, n long, other boolean"


def _to_runs(rows: pa.Table) -> pa.Table:
    names, distinct, other = run_counts(_pages(rows))
    here = [rows.column(c)[0].as_py() for c in ("host", "shard")]
    return pa.table({"host": pa.array([here[0]] * len(names), pa.string()), "shard": pa.array([here[1]] * len(names), pa.int64()),
                     "a": names[:, 0], "b": names[:, 1], "n": distinct.astype(np.int64), "other": other})


def _to_text_by(rows: pa.Table, runs: pa.Table) -> pa.Table:
    if not rows.num_rows:
        return _with_text(rows, [])
    return _with_text(rows, main_texts(_pages(rows), np.stack([runs.column(c).to_numpy() for c in ("a", "b")], axis=1)))


def main_text(pages: DataFrame, url_col: str = "url", html_col: str = "html", text_col: str = "main_text") -> DataFrame:
    """The input's columns without the html, and the main text (empty if none; null html: empty).

    Blocks are in page order, joined by one newline.  Pages whose url has no host form one host.
    """
    names = [f"c{i}" for i in range(len(pages.columns)) if pages.columns[i] != html_col]
    held = [c for c in pages.columns if c != html_col]
    host = host_and_path(pages[pages.columns.index(url_col)])[0]
    rows = pages.select(*(pages[i].alias(f"c{i}") for i in range(len(pages.columns)) if pages.columns[i] != html_col), host.alias("host"),
                        pages[pages.columns.index(html_col)].alias("input"))
    schema = rows.drop("input").withColumns({"kinds": F.lit(""), "texts": F.lit(None).cast("array<string>")}).schema
    cut = written(rows.mapInArrow(_to_blocks([*names, "host"]), schema), "blocks")
    schema = rows.select(*names).withColumn("main", F.lit("")).schema
    taken = pages.drop(html_col)

    article = F.filter("texts", lambda _, i: F.substr("kinds", i + 1, F.lit(1)) == ARTICLE)
    undecided = F.contains("kinds", F.lit(OTHER))
    by_host = written(cut.groupBy("host").agg(F.round(F.count(F.lit(1)) / SHARD_PAGES).cast("long").alias("shards"), F.max(undecided).alias("open"))
                      .where("open").select("host", F.greatest("shards", F.lit(1).cast("long")).alias("shards")), "hosts")
    done = cut.where(~undecided).select(*names, F.array_join(article, "\n").alias("main"))
    if not by_host.isEmpty():
        dealt = cut.join(broadcast_if_small(by_host), "host").withColumn("shard", F.pmod(F.xxhash64(*names), "shards"))
        columns = [*names, "kinds", "texts", "host", "shard"]
        small = dealt.where("shards = 1").select(columns).repartition("host", "shard")
        found = small.groupBy("host", "shard").applyInArrow(_to_text, schema)
        if not by_host.where("shards > 1").isEmpty():
            large = dealt.where("shards > 1").select(columns)
            runs = written(large.groupBy("host", "shard").applyInArrow(_to_runs, RUNS), "runs")
            often = runs.groupBy("host", "a", "b").agg(F.sum("n").alias("pages"), F.max("other").alias("any")).where((F.col("pages") >= PAGES) & F.col("any"))
            back = runs.where("other").join(often.select("host", "a", "b"), ["host", "a", "b"]).select("host", "shard", "a", "b")
            found = found.union(large.groupBy("host", "shard").cogroup(back.groupBy("host", "shard")).applyInArrow(_to_text_by, schema))
        done = done.union(found)
    return done.toDF(*held, free_name(taken, text_col))
