"""Main text of web pages: flat text blocks classified by a decision tree.

A page is cut at block-level tags into flat blocks of text. A block's features are its number of
words and link density and those of the blocks before and after it, and what encloses it (landmark
elements, tell-tale class and id names). A decision tree, grown on a small labelled table of
made-up pages, keeps the blocks of the article.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import bound_batches, table

# Fixed values of HTML.
#: Elements that begin and end a block of text.
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead "
    "title tr ul".split()
)
#: Elements whose content is no text of the page.
SILENT = frozenset("script style noscript template svg math iframe object canvas textarea audio video title noframes map".split())
#: Those whose content is raw text.
RAW = frozenset("script style textarea title noframes".split())
#: Those of embedded vocabularies, which a slash at the end of their tag closes.
FOREIGN = frozenset({"svg", "math"})
#: Elements that stay open until closed, with what they hold.
CONTAINERS = frozenset(
    "article aside blockquote body button center dd details dialog div dl dt fieldset figcaption figure footer form header hgroup "
    "li main menu nav ol pre section select table tbody td tfoot th thead tr ul".split()
)
#: Names in class and id by what they tell.
NAMES = {
    "junk": "ad ads adv advert advertisement advertising adsense banner sponsor sponsored promo promotion outbrain taboola dfp",
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs topbar toolbar pagination pager tabs skip skiplink dropdown masthead",
    "edge": "header footer foot copyright colophon legal bottom top sitefooter siteheader",
    "side": "sidebar side aside widget related recommended recommendations trending popular more tags tagcloud archive rail secondary",
    "talk": "comment comments disqus reply replies respond discussion commentlist reviews",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe signup subscription paywall login share sharing social",
    "body": "article content post entry story main body text prose maincontent articlebody postbody entrycontent hentry",
}
_NAME = {n: kind for kind, names in NAMES.items() for n in names.split()}
_LANDMARKS = {"nav": "menu", "menu": "menu", "header": "edge", "footer": "edge", "aside": "side", "form": "form", "dialog": "notice", "button": "form", "select": "form", "fieldset": "form", "article": "body", "main": "body"}
_ROLES = {"navigation": "menu", "banner": "edge", "contentinfo": "edge", "complementary": "side", "search": "form", "dialog": "notice", "alert": "notice", "main": "body", "article": "body"}
_FLAGS = ("junk", "menu", "edge", "side", "talk", "notice", "form", "body")
FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", *_FLAGS, "nearest_body", "heading", "item", "stop")

_TAG = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_LOOSE_TAG = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9:-]*)([^>]*+)>")
_CLASSES = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++))", re.I)
_HREF = re.compile(r"(?:^|\s)href\s*=", re.I)
_PARTS = re.compile(r"[^A-Za-z]+|(?<=[a-z])(?=[A-Z])")


def _flags(name: str, attributes: str) -> frozenset[str]:
    out = {_LANDMARKS[name]} if name in _LANDMARKS else set()
    if "=" in attributes:
        for m in _CLASSES.finditer(attributes):
            value = m[2] or m[3] or m[4] or ""
            if m[1].lower() == "role":
                out |= {_ROLES[value.lower()]} if value.lower() in _ROLES else set()
                continue
            for token in value.split():
                parts = [p.lower() for p in _PARTS.split(token) if p]
                out |= {_NAME[p] for p in (*parts, "".join(parts)) if p in _NAME}
    return frozenset(out)


def blocks(html: str | None) -> list[tuple[str, tuple]]:
    """Text and own features (words, links, flags, nearest_body, heading, item, stop) of each flat block."""
    html = html or ""
    out: list[tuple[str, tuple]] = []
    stack: list[tuple[str, frozenset[str]]] = []
    parts: list[str] = []
    linked: list[str] = []
    in_link = heading = item = in_line = link_in_line = False
    link_depth = 0

    def flush() -> None:
        nonlocal parts, linked
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                words = text.count(" ") + 1
                inside = len(unescape(" ".join(linked)).split())
                nearest, seen = 0, set()
                for k in range(len(stack) - 1, -1, -1):
                    flags = stack[k][1]
                    if not seen and flags:
                        nearest = int("body" in flags and not flags - {"body", "edge"})
                    seen |= flags
                out.append((text, (words, min(1.0, inside / words), *(int(f in seen) for f in _FLAGS), nearest, int(heading), int(item), int(text[-1] in ".!?…»\"”"))))
            parts, linked = [], []

    at, n = 0, len(html)
    while at < n:
        lt = html.find("<", at)
        if lt < 0:
            lt = n
        if lt > at:
            parts.append(html[at:lt])
            if in_link:
                linked.append(html[at:lt])
        if lt == n:
            break
        if html.startswith("<!--", lt):
            end = html.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        if html.startswith(("<!", "<?"), lt):
            end = html.find(">", lt)
            at = n if end < 0 else end + 1
            continue
        m = _TAG.match(html, lt) or _LOOSE_TAG.match(html, lt)
        if not m:
            if html.startswith("</", lt):
                end = html.find(">", lt)
                at = n if end < 0 else end + 1
            elif html[lt + 1 : lt + 2].isalpha():
                at = n  # a tag that never ends
            else:
                parts.append("<")
                at = lt + 1
            continue
        at, close, name = m.end(), m[1], m[2].lower()
        if name in SILENT and not close:
            flush() if name in BLOCKS else None
            # a slash at the end of a tag closes no element of HTML, but one of the embedded vocabularies
            if not (m[3].endswith("/") and name in FOREIGN):
                end = re.compile(f"</{name}\\b[^>]*>", re.I).search(html, at)
                # left open, an element of raw text runs to the end of the page; of others the tag alone is skipped
                at = end.end() if end is not None else n if name in RAW else at
            continue
        if name == "a":
            in_link = not close and bool(_HREF.search(m[3]))
            link_depth, link_in_line = len(stack), in_line
        elif name == "br":
            parts.append(" ")
        if name not in BLOCKS:
            if name in ("img", "input", "wbr"):
                continue
            continue
        flush()
        # a link may hold blocks; one that is not closed ends with the paragraph or element that it began in
        in_link = in_link and not link_in_line
        in_line = not close and name not in CONTAINERS
        heading = name[0] == "h" and name[1:].isdigit() and not close
        item = name == "li" and not close
        if name in CONTAINERS:
            if not close:
                if name in ("li", "dd", "dt", "td", "th", "tr") and stack and stack[-1][0] == name:
                    stack.pop()
                stack.append((name, _flags(name, m[3])))
            else:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == name:
                        del stack[k:]
                        break
                in_link = in_link and len(stack) >= link_depth
    flush()
    return out


def features(found: list[tuple[str, tuple]]) -> np.ndarray:
    """One row of FEATURES for each block; beyond the page's ends there are no words."""
    if not found:
        return np.zeros((0, len(FEATURES)))
    own = np.array([f for _, f in found], float)
    own[:, 0] = np.minimum(own[:, 0], 200)
    pad = np.zeros((1, 2))
    around = np.vstack([pad, own[:, :2], pad])
    return np.hstack([own[:, :2], around[:-2], around[2:], own[:, 2:]])


class Tree:
    """A binary classification tree by Gini impurity."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int = 9, least: int = 2):
        self.nodes: list[tuple[int, float, int, int, int]] = []
        self._grow(x, y, depth, least)

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int, least: int) -> int:
        me = len(self.nodes)
        self.nodes.append((-1, 0.0, 0, 0, int(2 * y.sum() > len(y))))
        if not depth or y.min() == y.max():
            return me
        best = None
        for f in range(x.shape[1]):
            order = np.argsort(x[:, f], kind="stable")
            v, hits = x[order, f], np.cumsum(y[order])
            k = np.flatnonzero(v[1:] > v[:-1]) + 1
            k = k[(k >= least) & (len(y) - k >= least)]
            if not len(k):
                continue
            left, right = hits[k - 1], hits[-1] - hits[k - 1]
            impurity = left * (k - left) / k + right * (len(y) - k - right) / (len(y) - k)
            i = int(np.argmin(impurity))
            if best is None or impurity[i] < best[0] - 1e-12:
                best = (impurity[i], f, (v[k[i]] + v[k[i] - 1]) / 2)
        if best is None:
            return me
        go = x[:, best[1]] <= best[2]
        a = self._grow(x[go], y[go], depth - 1, least)
        b = self._grow(x[~go], y[~go], depth - 1, least)
        self.nodes[me] = (best[1], best[2], a, b, self.nodes[me][4])
        return me

    def predict(self, x: np.ndarray) -> np.ndarray:
        feature, cut, left, right, label = (np.array(c) for c in zip(*self.nodes))
        at = np.zeros(len(x), int)
        while True:
            inner = np.flatnonzero(feature[at] >= 0)
            if not len(inner):
                return label[at].astype(bool)
            k = at[inner]
            at[inner] = np.where(x[inner, feature[k]] <= cut[k], left[k], right[k])


def labelled_pages(n: int = 480, seed: int = 9) -> Iterator[tuple[str, list[bool]]]:
    """The labelled table: made-up pages, and for each flat block whether it is the article's."""
    r = np.random.Generator(np.random.PCG64(seed))
    pick = lambda xs: xs[int(r.integers(len(xs)))]
    chance = lambda p: r.random() < p
    word = lambda: "".join(pick("aeinorstlud") for _ in range(int(r.integers(2, 9))))

    def text(low: int, high: int, stop: str = ".") -> str:
        return " ".join(word() for _ in range(int(r.integers(low, high)))).capitalize() + stop

    link = lambda low=1, high=3: f'<a href="/{word()}">{text(low, high, "")}</a>'
    for _ in range(n):
        out: list[tuple[str, list[bool]]] = []
        add = lambda html, *labels: out.append((html, list(labels)))
        if chance(0.3):
            # neither tags nor names tell what is what, nor how long a block is: whether it is a link does
            teaser = lambda low, high: add(pick(['<div><a href="/x">{}</a></div>', '<a href="/x"><div>{}</div></a>', '<p><a href="/x">{}</a></p>']).format(text(low, high, pick(["", "."]))), False)
            for _ in range(int(r.integers(2, 7))):
                teaser(*((1, 5) if chance(0.5) else (8, 60)))
            for _ in range(int(r.integers(2, 9))):
                body = text(8, 80)
                for _ in range(int(r.integers(0, 3))):
                    body += f" {link(1, 5)} {text(4, 12)}"
                add(pick(["<p>{}</p>", "<div>{}</div>"]).format(body), True)
            for _ in range(int(r.integers(0, 6))):
                teaser(*((1, 5) if chance(0.5) else (8, 60)))
            if chance(0.6):
                add(f"<div>{' '.join(link(1, 4) for _ in range(int(r.integers(2, 7))))}</div>", False)
            yield "<html><body><div>" + "".join(h for h, _ in out) + "</div></body></html>", [x for _, ls in out for x in ls]
            continue
        items = lambda k: ("".join(f"<li>{link()}</li>" for _ in range(k)), [False] * k)
        if chance(0.8):
            k = int(r.integers(2, 8))
            li, no = items(k)
            add(pick(["<nav><ul>{}</ul></nav>", '<div class="menu"><ul>{}</ul></div>', '<header><nav><ul>{}</ul></nav></header>', '<ul id="main-nav">{}</ul>']).format(li), *no)
        if chance(0.4):
            add(pick(["<header><h1>{}</h1></header>", '<div id="header"><p>{}</p></div>', "<header><p>{}</p></header>"]).format(text(1, 7, "")), False)
        if chance(0.6):
            add(pick(['<div class="ad">{}</div>', '<div class="ads banner"><p>{}</p></div>', '<section class="advert">{}</section>', '<div id="sponsored">{}</div>']).format(text(3, 40)), False)
        if chance(0.4):
            add(pick(['<div class="cookie-notice">{}</div>', '<div id="cookie-banner"><p>{}</p></div>', '<div role="dialog">{}</div>', '<div class="newsletter">{}</div>', '<aside class="notice"><p>{}</p></aside>']).format(text(4, 40)), False)
        # the article
        shell = pick([("<article>", "</article>")] * 4 + [('<main><article class="post">', "</article></main>"), ('<div class="content">', "</div>"), ("<main>", "</main>"), ('<div id="article-body">', "</div>"), ("<div>", "</div>")])
        marked = shell[0] != "<div>"
        inner: list[tuple[str, list[bool]]] = []
        put = lambda html, *labels: inner.append((html, list(labels)))
        if chance(0.85):
            title = text(1, 10, pick(["", ".", "."]))
            put(pick(["<h1>{}</h1>", "<h1>{}</h1>", "<header><h1>{}</h1></header>"] if marked else ["<h1>{}</h1>"]).format(title), True)
        for _ in range(int(r.integers(1, 12))):
            kind = r.random()
            short = marked and chance(0.3)
            if kind < 0.7:
                body = text(1, 5) if short else text(12, 120)
                if chance(0.15):
                    body += f" {link()} {text(4, 12)}"
                put(pick(["<p>{}</p>", "<p>{}</p>", "<p>{}", "<p><b>{}</b><br>"]).format(body), True)
            elif kind < 0.78:
                put(pick(["<h2>{}</h2>", "<h3>{}</h3>"]).format(text(1, 6, "")), True)
            elif kind < 0.86 and marked:
                k = int(r.integers(1, 5))
                put("<ul>" + "".join(f"<li>{text(1, 20)}</li>" for _ in range(k)) + "</ul>", *[True] * k)
            elif kind < 0.9 and marked:
                put(f"<blockquote><p>{text(3, 30)}</p></blockquote>", True)
            elif kind < 0.94 and marked:
                put(f"<table><tr><td>{text(1, 4, '')}</td><td>{text(1, 4, '')}</td></tr></table>", True, True)
            elif kind < 0.97 and marked:
                put(f"<figure><figcaption>{text(3, 12)}</figcaption></figure>", True)
            else:
                put(pick(['<div class="ad">{}</div>', '<aside>{}</aside>', '<div class="share"><p>{}</p></div>', '<div class="related"><p>{}</p></div>']).format(text(2, 30)), False)
        if chance(0.12):
            put(f'<section class="comments"><h3>{text(1, 3, "")}</h3><p>{text(3, 30)}</p></section>', False, False)
        add(shell[0] + "".join(h for h, _ in inner) + shell[1], *[x for _, ls in inner for x in ls])
        if chance(0.45):
            k = int(r.integers(1, 5))
            head, each, foot = pick([('<section class="comments">', '<div class="comment"><p>{}</p></div>', "</section>"), ('<div id="comments"><ol>', "<li>{}</li>", "</ol></div>"), ('<div class="discussion">', "<p>{}</p>", "</div>")])
            add(head + "".join(each.format(text(2, 60)) for _ in range(k)) + foot, *[False] * k)
        if chance(0.45):
            k = int(r.integers(1, 6))
            li, no = items(k)
            head, foot = pick([("<aside>", "</aside>"), ('<div class="sidebar">', "</div>"), ('<aside class="widget">', "</aside>"), ('<div id="related-posts">', "</div>")])
            add(f"{head}<h3>{text(1, 3, '')}</h3><ul>{li}</ul><p>{text(3, 40)}</p>{foot}", False, *no, False)
        if chance(0.3):
            k = int(r.integers(2, 6))
            head, foot = pick([("<div>", "</div>"), ("", ""), ("<section>", "</section>")])
            add(head + "".join(f'<a href="/{word()}"><div>{text(2, 16)}</div></a>' for _ in range(k)) + foot, *[False] * k)
        if chance(0.35):
            add(f"<form><p>{text(2, 12)}</p><label>{text(1, 3, '')}</label><button>{word()}</button></form>", False, False, False)
        if chance(0.85):
            add(pick(["<footer>{}</footer>", "<footer><p>{}</p></footer>", '<div class="footer"><p>{}</p></div>', '<div id="copyright">{}</div>']).format("&copy; " + text(2, 14)), False)
        yield "<html><body>" + "".join(h for h, _ in out) + "</body></html>", [x for _, ls in out for x in ls]


@lru_cache(maxsize=1)
def trained_tree() -> Tree:
    """The tree, the same on every run."""
    xs, ys = [], []
    for html, labels in labelled_pages():
        found = blocks(html)
        if len(found) == len(labels):  # a made-up block that came out otherwise teaches nothing
            xs.append(features(found))
            ys += labels
    return Tree(np.vstack(xs), np.array(ys, int))


def main_text(html: str | None, tree: Tree) -> str:
    found = blocks(html)
    if not found:
        return ""
    keep = tree.predict(features(found))
    return "\n".join(text for (text, _), k in zip(found, keep) if k)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of each row; null and empty pages give an empty text, pages without an
    article too. Repeated rows get one row each, an empty table none; pages are read whole."""
    tree = trained_tree()
    bound_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                texts = [main_text(h, tree).encode("utf-8", "replace").decode() for h in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"]
                )

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract(table(spark, sf_dir, "pages"))
