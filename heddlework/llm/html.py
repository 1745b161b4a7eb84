"""Main text of web pages: a linear-chain conditional random field over leaf blocks.

A page is read into its leaf blocks, the runs of text between block elements, in page order. Each
block has features of its ancestors' tags, of known words in their class, id and role, and of its
text. A conditional random field with two labels (article or not), trained by gradient ascent on the
log-likelihood of labelled pages (``labelled_pages``: page plans with every kind of matter around an
article, written out with a fixed seed), labels the blocks of a page jointly by Viterbi decoding.

Character references are decoded, white space inside a block becomes one space, and the article's
blocks are joined by one line end. A null, empty or text-free page gives an empty text. Markup that
is broken off or not closed ends with the page. The open elements are kept as a stack with counts, so
a page takes time by its length however deep its elements are nested. Of two labellings that score
alike the one that leaves a block out is taken. Repeated rows give repeated results, rows without
page_id or url keep their nulls; other columns are ignored.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>?""", re.S)
_ATTRIBUTE = re.compile(r"""(?i)(?<![\w-])(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)""")
_WORDS = re.compile(r"[a-z]+")

# Fixed lists of HTML: elements without content, with raw content that is no text, and that break lines.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style title textarea template iframe noembed noframes annotation annotation-xml".split())
BLOCK = set(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup html label legend li main menu nav ol "
    "optgroup option p pre search section select summary table tbody td tfoot th thead tr ul xmp".split()
)
#: An open element of these is closed by a new element of those.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
KEEPS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}

#: What words in class, id and role say of a block.
CONCEPTS = {
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc skip tabs", "advert": "ad ads advert adverts advertisement sponsor sponsored promo promotion banner dfp adsense", "comment": "comment comments reply replies disqus respond discussion reviews",
    "side": "sidebar aside widget related recommended recommendations trending popular complementary rail", "foot": "footer foot copyright legal colophon contentinfo", "head": "header masthead topbar logo brand hero", "notice": "cookie cookies consent gdpr notice alert modal popup overlay subscribe newsletter signup paywall toast dialog privacy",
    "share": "share sharing social tags byline meta author", "form": "form search login register input", "content": "article content main post entry story text",
}
_CONCEPT = {w: c for c, words in CONCEPTS.items() for w in words.split()}
ANCESTORS = ("nav", "header", "footer", "aside", "article", "main", "form", "section", "ul", "ol", "table", "blockquote", "figure", "dialog", "button", "select", "label", "details", "pre", "dl")


class Open:
    """The open elements, with what a block's features ask of them kept up to date: every step costs the same at any depth."""

    def __init__(self) -> None:
        self.tags: list[str] = []
        self.places: dict[str, list[int]] = {}  # of each tag
        self.blocks: list[int] = []  # places of block elements
        self.concepts: list[tuple[str, ...]] = []
        self.held: dict[str, int] = {}  # open elements of each concept
        self.near: list[str] = []  # concepts in order

    def push(self, tag: str, concepts: tuple[str, ...]) -> None:
        self.places.setdefault(tag, []).append(len(self.tags))
        if tag in BLOCK:
            self.blocks.append(len(self.tags))
        self.tags.append(tag)
        self.concepts.append(concepts)
        self.near.extend(concepts)
        for c in concepts:
            self.held[c] = self.held.get(c, 0) + 1

    def close(self, place: int) -> None:
        """Close the element at a place and all inside it."""
        while len(self.tags) > place:
            tag = self.tags.pop()
            self.places[tag].pop()
            if tag in BLOCK:
                self.blocks.pop()
            concepts = self.concepts.pop()
            del self.near[len(self.near) - len(concepts) :]
            for c in concepts:
                self.held[c] -= 1

    def last(self, *tags: str) -> int:
        """The place of the innermost open element of these tags, -1 without any."""
        return max((p[-1] for t in tags if (p := self.places.get(t))), default=-1)

    def state(self) -> tuple[str, tuple[str, ...], tuple[str, ...], str]:
        """The innermost block's tag, known ancestors' tags, concepts, and the innermost concept."""
        tag = self.tags[self.blocks[-1]] if self.blocks else ""
        return tag, tuple(t for t in ANCESTORS if self.places.get(t)), tuple(c for c, n in self.held.items() if n), self.near[-1] if self.near else ""


def blocks(page: str) -> list[tuple[str, tuple[str, tuple[str, ...], tuple[str, ...], str], int]]:
    """Leaf blocks: text, the state of the open elements, and how many characters are links."""
    out: list = []
    opened = Open()
    held: list[str] = []
    links = 0

    def flush() -> None:
        nonlocal links
        text = " ".join("".join(held).split())
        held.clear()
        if text:
            out.append((text, opened.state(), links))
        links = 0

    def add(text: str) -> None:
        nonlocal links
        if "&" in text:
            text = unescape(text)
        held.append(text)
        if opened.places.get("a"):
            links += len(text.strip())

    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            add(page[at:])
            break
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            if tag in BLOCK:
                flush()
            place = opened.last(tag)
            # An inline end does not close a block.
            if place >= 0 and (tag in BLOCK or not opened.blocks or opened.blocks[-1] < place):
                opened.close(place)
            continue
        attributes = m[3] if m[2] else m[6]
        if tag in RAW:
            if not attributes.rstrip().endswith("/"):
                end = re.compile(rf"(?i)</{tag}(?![\w-])[^>]*>?").search(page, at)
                at = end.end() if end else n
            continue
        if tag == "br" or tag == "hr":
            held.append(" ")
            if tag == "hr":
                flush()
            continue
        if tag in VOID:
            continue
        if tag in BLOCK:
            flush()
            # A new block closes an open paragraph; list items, cells and the like close each other.
            if opened.blocks and opened.tags[opened.blocks[-1]] == "p":
                opened.close(opened.blocks[-1])
            if tag in CLOSES:
                place = opened.last(*CLOSES[tag])
                if place >= 0 and place > opened.last(*KEEPS[tag]):
                    opened.close(place)
        concepts = tuple(dict.fromkeys(c for a in _ATTRIBUTE.findall(attributes) for w in _WORDS.findall(a.lower()) if (c := _CONCEPT.get(w)))) if attributes else ()
        opened.push(tag, concepts)
    flush()
    return out


def features(all_blocks: list) -> list[list[str]]:
    out = []
    for text, (tag, tags, concepts, near), links in all_blocks:
        words = text.count(" ") + 1
        f = ["bias", f"tag={tag}", f"words={words.bit_length()}", f"links={min(4, 4 * links // max(len(text), 1))}"]
        f += [f"in={t}" for t in tags]
        f += [f"of={c}" for c in concepts]
        if near:
            f.append(f"near={near}")
        f.append("stop" if text[-1] in ".!?\"'»”" else "no stop")
        if "©" in text or "all rights reserved" in text.lower():
            f.append("rights")
        if "article" not in tags and "main" not in tags and "content" not in concepts:
            f.append("outside")
        out.append(f)
    return out


class Field:
    """The conditional random field: label 1 is the article. Weights by feature, between labels, and at the start."""

    def __init__(self) -> None:
        self.weights: dict[str, list[float]] = {}
        self.moves = [[0.0, 0.0], [0.0, 0.0]]
        self.begin = [0.0, 0.0]

    def emissions(self, fs: list[list[str]]) -> list[tuple[float, float]]:
        get, none = self.weights.get, (0.0, 0.0)
        out = []
        for f in fs:
            a = b = 0.0
            for k in f:
                x = get(k, none)
                a += x[0]
                b += x[1]
            out.append((a, b))
        return out

    def decode(self, fs: list[list[str]]) -> list[int]:
        """Viterbi."""
        if not fs:
            return []
        e, (m0, m1) = self.emissions(fs), self.moves
        a, b = self.begin[0] + e[0][0], self.begin[1] + e[0][1]
        back = []
        for x, y in e[1:]:
            from_a = (a + m0[0], a + m0[1])
            from_b = (b + m1[0], b + m1[1])
            back.append((int(from_b[0] > from_a[0]), int(from_b[1] > from_a[1])))
            a, b = max(from_a[0], from_b[0]) + x, max(from_a[1], from_b[1]) + y
        out = [int(b > a)]
        for step in reversed(back):
            out.append(step[out[-1]])
        return out[::-1]

    def marginals(self, fs: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """P(label) for each block, and summed P(label, next label), by forward-backward in logarithms."""
        e = np.array(self.emissions(fs))
        m, n = np.array(self.moves), len(fs)
        ahead, behind = np.zeros((n, 2)), np.zeros((n, 2))
        ahead[0] = np.array(self.begin) + e[0]
        for i in range(1, n):
            ahead[i] = np.logaddexp(ahead[i - 1][0] + m[0], ahead[i - 1][1] + m[1]) + e[i]
        for i in range(n - 2, -1, -1):
            behind[i] = np.logaddexp(m[:, 0] + e[i + 1][0] + behind[i + 1][0], m[:, 1] + e[i + 1][1] + behind[i + 1][1])
        z = np.logaddexp(*ahead[-1])
        pairs = np.exp(ahead[:-1, :, None] + m + (e + behind)[1:, None, :] - z).sum(axis=0) if n > 1 else np.zeros((2, 2))
        return np.exp(ahead + behind - z), pairs

    def fit(self, pages: list[tuple[list[list[str]], list[int]]], rounds: int = 8, rate: float = 0.2, decay: float = 1e-4) -> Field:
        order = list(range(len(pages)))
        shuffled = random.Random(3)
        for r in range(rounds):
            shuffled.shuffle(order)
            step = rate / (1 + r / 2)
            for i in order:
                fs, labels = pages[i]
                if not fs:
                    continue
                p, pairs = self.marginals(fs)
                for f, y, q in zip(fs, labels, p.tolist(), strict=True):
                    for k in f:
                        w = self.weights.setdefault(k, [0.0, 0.0])
                        for c in (0, 1):
                            w[c] += step * ((y == c) - q[c] - decay * w[c])
                for a, b in zip(labels, labels[1:], strict=False):
                    self.moves[a][b] += step
                for a in (0, 1):
                    for b in (0, 1):
                        self.moves[a][b] -= step * float(pairs[a][b])
                    self.begin[a] += step * ((labels[0] == a) - float(p[0][a]))
        return self


def labelled_pages(n: int = 160, seed: int = 9) -> Iterator[tuple[str, list[int]]]:
    """Pages with the label of each of their blocks, written from plans of an article and what may stand around and in it."""
    r = random.Random(seed)
    letters = "aeioubcdfglmnprst"

    def words(low: int, high: int) -> str:
        return " ".join("".join(r.choice(letters) for _ in range(r.randint(2, 9))) for _ in range(r.randint(low, high)))

    def sentence(low: int = 4, high: int = 60) -> str:
        return words(low, high).capitalize() + r.choice([".", ".", ".", "!", "?", ""])

    for _ in range(n):
        html, labels = ["<!DOCTYPE html><html><head><title>x</title><style>p{}</style></head><body>"], []

        def leaf(tag: str, text: str, label: int, html: list[str] = html, labels: list[int] = labels) -> None:
            html.append(f"<{tag}>{text}</{tag}>")
            labels.append(label)

        def menu(attributes: str, tag: str, html: list[str] = html, leaf=leaf) -> None:
            html.append(f"<{tag}{attributes}><ul>")
            for _ in range(r.randint(2, 8)):
                leaf("li", f'<a href="/x">{words(1, 3)}</a>', 0)
            html.append(f"</ul></{tag}>")

        def advert(html: list[str] = html, leaf=leaf) -> None:
            html.append(f'<div class="{r.choice(["ad", "ads", "advert", "advertisement", "sponsored", "promo-box", "banner", "ad-slot"])}">')
            leaf(r.choice(["p", "div", "span"]), sentence(), 0)
            html.append("</div>")

        def comments(html: list[str] = html, leaf=leaf) -> None:
            name = r.choice(["comments", "comment-list", "discussion", "reader-comments", "replies"])
            tag = r.choice(["section", "div", "aside"])
            html.append(f"<{tag} {r.choice(['id', 'class'])}=\"{name}\">")
            if r.random() < 0.6:
                leaf(r.choice(["h2", "h3"]), words(1, 2), 0)
            for _ in range(r.randint(1, 5)):
                html.append(f'<{(inner := r.choice(["div", "article", "li"]))} class="comment">')
                if r.random() < 0.5:
                    leaf(r.choice(["h4", "div", "p"]), words(1, 2), 0)
                leaf("p", sentence(3, 40), 0)
                html.append(f"</{inner}>")
            html.append(f"</{tag}>")

        def form(html: list[str] = html, leaf=leaf) -> None:
            html.append(f'<form{r.choice(["", " class=search", " id=newsletter", " class=login-form"])}>')
            leaf(r.choice(["label", "p"]), words(1, 5), 0)
            leaf("button", words(1, 2), 0)
            html.append("</form>")

        def notice(html: list[str] = html, leaf=leaf) -> None:
            tag = r.choice(["div", "section", "dialog", "aside"])
            html.append(f'<{tag} {r.choice(["class", "id"])}="{r.choice(["cookie-notice", "cookie", "notice", "consent", "gdpr-banner", "newsletter", "alert", "popup", "subscribe"])}">')
            leaf(r.choice(["p", "div"]), sentence(5, 40), 0)
            if r.random() < 0.5:
                leaf("button", words(1, 2), 0)
            html.append(f"</{tag}>")

        def side(html: list[str] = html, leaf=leaf) -> None:
            tag, attributes = r.choice([("aside", ""), ("aside", ' class="sidebar"'), ("div", ' class="sidebar"'), ("div", ' id="related"'), ("section", ' class="related-posts"'), ("div", ' class="widget"')])
            html.append(f"<{tag}{attributes}>")
            if r.random() < 0.7:
                leaf(r.choice(["h2", "h3", "h4"]), words(1, 4), 0)
            for _ in range(r.randint(1, 4)):
                leaf(r.choice(["p", "li", "div"]), r.choice([sentence(3, 40), f'<a href="/y">{words(2, 8)}</a>']), 0)
            html.append(f"</{tag}>")

        ahead = r.random() < 0.7  # whether anything stands before the article
        if ahead and r.random() < 0.6:
            html.append(r.choice(["<header>", '<div class="header">', '<header id="masthead">', '<div id="topbar">']))
            leaf(r.choice(["h1", "div", "p"]), words(1, 4), 0)
            if r.random() < 0.5:
                leaf("p", sentence(3, 15), 0)
            if r.random() < 0.6:
                menu("", "nav")
            html.append("</header>" if "<header" in "".join(html[-30:]) else "</div>")
        if ahead and r.random() < 0.7:
            menu(*r.choice([("", "nav"), (' class="menu"', "div"), (' class="breadcrumb"', "nav"), (' id="navigation"', "div")]))
        for part, p in ((notice, 0.3), (advert, 0.5), (form, 0.2), (side, 0.3)):
            if ahead and r.random() < p:
                part()
        opened, closed = r.choice([("<article>", "</article>"), ("<article>", "</article>"), ("<main><article>", "</article></main>"), ("<main>", "</main>"), ('<div class="article-content">', "</div>"), ('<div id="content">', "</div>"), ('<div class="post">', "</div>"), ('<article class="post">', "</article>"), ("<div>", "</div>"), ('<div class="page">', "</div>")])
        html.append(opened)
        if r.random() < 0.85:
            leaf("h1", words(2, 14), 1)
        for _ in range(r.choice([1, 2, 4, 8, 14])):
            kind = r.random()
            if kind < 0.72:
                leaf("p", r.choice([words(1, 2), sentence(1, 12), sentence(8, 160), f"<b>{sentence(2, 20)}</b> {sentence(5, 60)}", f'{sentence(3, 20)} <a href="/z">{words(1, 4)}</a> {words(2, 20)}.']), 1)
            elif kind < 0.82:
                leaf(r.choice(["h2", "h3"]), words(1, 8), 1)
            elif kind < 0.9:
                html.append(f"<{(tag := r.choice(['ul', 'ol']))}>")
                for _ in range(r.randint(1, 5)):
                    leaf("li", sentence(1, 20), 1)
                html.append(f"</{tag}>")
            elif kind < 0.94:
                leaf(r.choice(["blockquote", "pre", "td", "figcaption"]), sentence(3, 40), 1)
            elif kind < 0.97:
                advert()
            else:
                r.choice([form, notice, side])()
        if r.random() < 0.15:
            comments()
        html.append(closed)
        for part, p in ((comments, 0.4), (side, 0.4), (advert, 0.2), (form, 0.2), (notice, 0.2)):
            if r.random() < p:
                part()
        if r.random() < 0.85:
            html.append(r.choice(["<footer>", '<div class="footer">', '<div id="footer">']))
            leaf(r.choice(["p", "div", "span"]), r.choice(["&copy; ", ""]) + sentence(2, 30), 0)
            if r.random() < 0.4:
                menu("", "nav")
            html.append("</footer>" if "<footer>" in "".join(html[-30:]) else "</div>")
        yield "".join(html) + "</body></html>", labels


def trained() -> Field:
    pages = [(features(blocks(html)), labels) for html, labels in labelled_pages()]
    return Field().fit([(f, y) for f, y in pages if len(f) == len(y)])


def main_text(field: Field, page: str) -> str:
    found = blocks(page)
    return "\n".join(b[0] for b, y in zip(found, field.decode(features(found)), strict=True) if y)


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each page."""
    sent = pages.sparkSession.sparkContext.broadcast(trained())

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            out = [main_text(sent.value, x.as_py() or "") for x in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages"))
