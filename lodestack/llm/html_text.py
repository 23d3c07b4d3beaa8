"""Main-text extraction: blocks of a page are labelled by a minimum cut.

A tolerant scanner cuts the page into text blocks and notes for each where it stands. A logistic classifier turns that
into the cost of keeping and of dropping the block (terminal capacities); blocks that follow each other or stand close
in the tree are tied by edges (smoothness); the cut separates content from boilerplate.

The classifier and the strength of the ties are fitted in ``page_model`` on composed pages whose blocks are known. In a
part of them regions carry no telling tag or class, so length, links, sentences, place and neighbours have to count.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batch, texts_of
from .mincut import cut

STOP, SPECIAL = re.compile(r"[\s/>]"), re.compile("[>\"']")
#: A name begins where none goes on, so that a long run without a value is looked at once.
ATTRIBUTE = re.compile(r"""(?<![^\s=/>"'])([^\s=/>"']++)\s*+=\s*+("[^"]*"|'[^']*'|[^\s>]+)""")
PART = re.compile(r"[a-z]+|[A-Z][a-z]*|[0-9]+")
RAW = frozenset("script style noscript template textarea title iframe svg head select button canvas audio video".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: An element that a new one of the same family closes, and how far up it is looked for.
SIBLINGS = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr",), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",))}
BAD_TAGS = frozenset("nav aside footer menu dialog fieldset".split())
BAD_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar".split())
BAD_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification alert nav navbar navigation menu menus breadcrumb breadcrumbs header masthead footer sidebar side aside widget widgets share sharing social related recommended newsletter subscribe signup login search form popup modal overlay copyright toolbar pagination pager tags skip".split()
)
COMMENT_WORDS = frozenset("comment comments commentlist respond response responses replies reply disqus discussion reviews".split())
GOOD_WORDS = frozenset("article content post entry story main text body page prose".split())
#: A heading over what readers wrote.
COMMENT_HEADING = re.compile(r"(?:[0-9]+ )?(?:reader |user )?(?:comments?|responses?|replies|discussion|kommentare?|commentaires?|comentarios?)(?: ?\(?[0-9]+\)?)?:?", re.I)
RIGHTS = re.compile(r"©|\(c\) ?\d{4}|all rights reserved", re.I)
#: Characters outside links that an element with most of the page's text must hold to count as its wrapper.
WRAPPER = 200
#: Share of the page's text that may stand outside an element that wraps it.
OUTSIDE = 0.05


@dataclass
class Element:
    """A tag; article, good and link hold for all inside, the rest after ``spread_marks``."""

    tag: str
    parent: int
    depth: int
    block: bool
    article: bool = False
    good: bool = False
    bad: bool = False
    loose: bool = False
    soft: bool = False
    link: bool = False
    fence: bool = False
    hidden: bool = False


@dataclass
class Block:
    element: int
    text: str
    n_link: int


def described(element: Element, attributes: str) -> None:
    """Set the element's evidence from its tag, role, class and id; it has its parent's already."""
    values = {k.lower(): v.strip("\"'") for k, v in ATTRIBUTE.findall(attributes)} if "=" in attributes else {}
    parts = {p.lower() for p in PART.findall(f"{values.get('class', '')} {values.get('id', '')}")} if element.tag not in ("html", "body") else set()
    role = values.get("role", "").lower()
    if element.tag in ("article", "main") or role in ("main", "article"):
        element.article = element.fence = True
    hidden = "display:none" in values.get("style", "").replace(" ", "").lower() or re.search(r"(?:^|\s)hidden(?:\s|=|$)", attributes) is not None
    element.hidden |= hidden
    if element.tag in BAD_TAGS or role in BAD_ROLES or hidden or (element.tag == "header" and not element.article):
        element.bad = True
    if element.tag == "form" or role == "form" or parts & COMMENT_WORDS:
        element.loose = True
    if parts & BAD_WORDS:
        element.soft = True
    elif parts & GOOD_WORDS:
        element.good = True
    element.link |= element.tag == "a"


class Scanner:
    """The pieces of a page, in time that grows with its length whatever it holds.

    Where a tag ends depends on the place after its name alone, so places of quotes from which no end was found are
    remembered and never gone through again.
    """

    def __init__(self, html: str):
        self.html, self.last = html, html.rfind(">")
        self.stop = -1
        self.failed: set[int] = set()

    def tag_end(self, at: int) -> int:
        """The first > outside quotes; -1 for none."""
        seen = []
        while at <= self.last and (m := SPECIAL.search(self.html, at)):
            i = m.start()
            if m.group() == ">":
                return i
            if i in self.failed:
                break
            seen.append(i)
            at = self.html.find(m.group(), i + 1) + 1
            if not at:
                break
        self.failed.update(seen)
        return -1

    def pieces(self) -> Iterator[tuple[str, str | None, int, int, int]]:
        """(text, None, 0, 0, 0), or for a tag ("" or "/", name, begin and end of its attributes, where it ends); send() goes on elsewhere."""
        html, at = self.html, 0
        while at < len(html):
            if html[at] != "<":
                end = html.find("<", at)
                end = len(html) if end < 0 else end
                yield html[at:end], None, 0, 0, 0
                at = end
                continue
            if html.startswith("<!--", at):
                end = html.find("-->", at + 4)
                at = len(html) if end < 0 else end + 3
                continue
            if html[at + 1 : at + 2] in ("!", "?"):
                end = html.find(">", at)
                at = len(html) if end < 0 else end + 1
                continue
            begin = at + 1 + (html[at + 1 : at + 2] == "/")
            end = -1
            if html[begin : begin + 1].isascii() and html[begin : begin + 1].isalpha() and begin < self.last:
                if self.stop < begin:
                    self.stop = STOP.search(html, begin).start()  # there is a > behind
                end = self.tag_end(self.stop)
            if end < 0:
                yield "<", None, 0, 0, 0
                at += 1
                continue
            moved = yield html[at + 1 : begin], html[begin : self.stop].lower(), self.stop, end, end + 1
            at = end + 1 if moved is None else moved
            if moved is not None:
                yield "", None, 0, 0, 0  # the answer to send()


def blocks_of(html: str) -> tuple[list[Element], list[Block]]:
    """Elements and text blocks in page order; unclosed and stray tags are mended as browsers do."""
    elements = [Element("html", -1, 0, True)]
    stack = [0]
    #: Of each place in the stack, the last block element at or before it; of each tag, its places in the stack.
    nearest, places = [0], {"html": [0]}
    found: list[Block] = []
    words: list[str] = []
    linked = 0
    endless: set[str] = set()

    def close() -> None:
        nonlocal linked
        if words:
            if text := " ".join(unescape("".join(words)).split()):
                found.append(Block(stack[nearest[-1]], text, linked))
            words.clear()
        linked = 0

    def pop_to(depth: int) -> None:
        if nearest[-1] >= depth:
            close()
        for e in reversed(stack[depth:]):
            places[elements[e].tag].pop()
        del stack[depth:], nearest[depth:]

    def top(names: tuple[str, ...]) -> int:
        return max((places[n][-1] for n in names if places.get(n)), default=-1)

    scanner = Scanner(html)
    pieces = scanner.pieces()
    for closing, name, begin, end, at in pieces:
        if name is None:
            if closing:
                words.append(closing)
                if elements[stack[-1]].link:
                    linked += len(closing)
            continue
        if closing:
            if name != "html" and places.get(name):
                pop_to(places[name][-1])
            elif name in BLOCKS:
                close()
            continue
        if name in RAW:
            if html[end - 1] != "/" and name not in endless:
                over = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(html, at)
                if name == "head" and over is None:
                    over = re.compile(r"(?=<body\b)", re.I).search(html, at)
                if over:
                    pieces.send(over.end())
                elif name == "head":
                    endless.add(name)
                else:
                    pieces.send(len(html))
            continue
        if name in VOID:
            if name == "br":
                words.append(" ")
            elif name == "hr":
                close()
            continue
        if name in BLOCKS:
            close()
            if elements[stack[nearest[-1]]].tag == "p":
                pop_to(nearest[-1])
        if name in SIBLINGS:
            family, fence = SIBLINGS[name]
            if (k := top(family)) > max(0, top(fence)):
                pop_to(k)
        if name in ("html", "body"):
            continue
        above = elements[stack[-1]]
        own = Element(name, stack[-1], above.depth + 1, name in BLOCKS, above.article, above.good, False, False, False, above.link, False, above.hidden)
        described(own, html[begin:end])
        elements.append(own)
        places.setdefault(name, []).append(len(stack))
        nearest.append(len(stack) if own.block else nearest[-1])
        stack.append(len(elements) - 1)
    close()
    for b in found:
        if elements[b.element].tag in ("h2", "h3", "h4") and COMMENT_HEADING.fullmatch(b.text):
            elements[elements[b.element].parent].loose |= elements[b.element].parent > 0
    spread_marks(elements, found)
    return elements, found


def spread_marks(elements: list[Element], blocks: list[Block]) -> None:
    """Pass marks down the tree: bad to all inside, soft as far as the next article or main element.

    An element that wraps the page is no part beside the content, so its mark is dropped first: a soft one (as
    ``has-sidebar``) if it holds most of the text outside links; a form or a class as ``page-discussion`` if a
    main heading or element stands in it, or next to no other text outside it.
    """
    held, core = [0] * len(elements), [e.tag in ("h1", "main") for e in elements]
    dark = [False] * len(elements)
    for i in range(1, len(elements)):
        dark[i] = elements[i].bad or dark[elements[i].parent]
    for b in blocks:
        if not dark[b.element]:
            held[b.element] += max(0, len(b.text) - b.n_link)
    for i in range(len(elements) - 1, 0, -1):
        held[elements[i].parent] += held[i]
        core[elements[i].parent] |= core[i]
    for i in range(1, len(elements)):
        e = elements[i]
        if e.soft and held[i] >= WRAPPER and 2 * held[i] > held[0]:
            e.soft = False
        if e.loose and not core[i] and not (held[i] >= WRAPPER and held[i] >= (1 - OUTSIDE) * held[0]):
            e.bad = True
        e.bad |= elements[e.parent].bad
        e.soft |= not e.fence and elements[e.parent].soft


FEATURES = ["base", "length", "links", "sentences", "prose", "item", "heading", "article", "good", "bad", "soft", "rights", "first", "last"]


def features(elements: list[Element], blocks: list[Block]) -> np.ndarray:
    """A row of FEATURES for each block."""
    rows = np.zeros((len(blocks), len(FEATURES)))
    many = len(blocks) >= 8  # the ends of a page tell something if there is a middle
    for k, b in enumerate(blocks):
        e, n = elements[b.element], len(b.text)
        ends = sum(map(b.text.count, ".!?。"))
        rows[k] = (
            1, min(4.0, np.log1p(n / 20)), min(1.0, b.n_link / n), min(3, ends) * (b.n_link < n / 2), e.tag in ("p", "blockquote", "pre", "math"), e.tag in ("li", "td", "dd"),
            e.tag in ("h1", "h2", "h3", "h4"), e.article, e.good, e.bad, e.soft and not e.bad, n < 200 and RIGHTS.search(b.text) is not None, many and k < 2, many and k >= len(blocks) - 2,
        )
    return rows


def steps(elements: list[Element], a: int, b: int) -> int:
    """Edges between two elements of the tree."""
    n = 0
    while a != b:
        if elements[a].depth >= elements[b].depth:
            a = elements[a].parent
        else:
            b = elements[b].parent
        n += 1
    return n


@dataclass(frozen=True)
class PageModel:
    """Weights of FEATURES; strength of the tie between neighbours, and how it fades with each step in the tree."""

    weights: tuple[float, ...]
    tie: float
    fade: float = 0.7


def capacities(elements: list[Element], blocks: list[Block], model: PageModel) -> tuple[list[float], list[float], dict[tuple[int, int], float]]:
    """(cost of dropping, cost of keeping, ties) of the blocks."""
    x = np.clip(features(elements, blocks) @ np.array(model.weights), -30, 30)
    x[[elements[b.element].hidden for b in blocks]] = -30  # no reader sees it
    edges: dict[tuple[int, int], float] = {}
    last: dict[int, int] = {}
    for i, b in enumerate(blocks):
        if i:
            edges[i - 1, i] = model.tie * model.fade ** steps(elements, blocks[i - 1].element, b.element)
        parent = elements[b.element].parent
        if parent in last and last[parent] != i - 1:
            edges[last[parent], i] = model.tie * model.fade**2
        last[parent] = i
    return np.logaddexp(0, x).tolist(), np.logaddexp(0, -x).tolist(), edges


def labels(elements: list[Element], blocks: list[Block], model: PageModel) -> list[int]:
    """1 for content: the minimum cut of the page's graph."""
    return cut(*capacities(elements, blocks, model))


def composed_page(rng: random.Random) -> tuple[str, list[tuple[str, int]]]:
    """A page made of known regions, and (text, 1 for content) of its blocks in order.

    Regions are marked by their tag, by a class, or not at all; a class is now and then a misleading one.
    """
    parts: list[str] = []
    truth: list[tuple[str, int]] = []
    word = lambda: "".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randrange(2, 9)))
    words = lambda n: " ".join(word() for _ in range(n))

    def prose(n: int) -> str:
        return " ".join(words(rng.randrange(5, 15)).capitalize() + rng.choice("....!?") for _ in range(n))

    def block(tag: str, text: str, good: int, link: bool = False) -> None:
        truth.append((text, good))
        inner = f'<a href="/x">{text}</a>' if link else text
        parts.append(f"<{tag}>{inner}</{tag}>")

    def region(tag: str, names: list[str], fill) -> None:
        how = rng.random()
        name = rng.choice(names) if rng.random() > 0.05 else rng.choice(["text", "box", "sidebar", "main"])
        opened, closed = (f"<{tag}>", f"</{tag}>") if how < 0.4 else (f'<div class="{name}">', "</div>") if how < 0.75 else ("<div>", "</div>")
        parts.append(opened)
        fill()
        parts.append(closed)

    def links() -> None:
        for _ in range(rng.randrange(2, 8)):
            block("li", words(rng.randrange(1, 4)), 0, True)

    def small() -> None:
        for _ in range(rng.randrange(1, 3)):
            block(rng.choice(["p", "div", "span"]), prose(rng.choice([1, 1, 2])) if rng.random() < 0.7 else words(rng.randrange(2, 7)), 0, rng.random() < 0.3)

    def remarks() -> None:
        for _ in range(rng.randrange(1, 5)):
            block("p", prose(rng.randrange(1, 5)), 0)

    def content() -> None:
        block("h1", words(rng.randrange(3, 10)), 1)
        for _ in range(rng.randrange(1, 10)):
            kind = rng.random()
            if kind < 0.65:
                block("p", prose(rng.randrange(1, 9)), 1)
            elif kind < 0.8:
                block(rng.choice(["p", "blockquote", "h2", "h3"]), words(rng.randrange(1, 6)), 1)
            elif kind < 0.95:
                for _ in range(rng.randrange(2, 5)):
                    block("li", words(rng.randrange(2, 12)), 1, rng.random() < 0.15)
            else:
                block("td", words(rng.randrange(1, 4)), 1)

    marked = lambda tag, names, fill, share: region(tag, names, fill) if rng.random() < share else None
    marked("header", ["masthead", "header"], small, 0.4)
    marked("nav", ["menu", "navbar", "breadcrumb"], links, 0.9)
    marked("aside", ["cookie-notice", "ad", "banner", "promo"], small, 0.6)
    region(rng.choice(["article", "main"]), ["content", "post-body", "entry", "story"], content)
    marked("aside", ["ad", "share", "related", "sidebar", "newsletter"], small, 0.6)
    marked("nav", ["related", "tags", "pager"], links, 0.4)
    if rng.random() < 0.4:
        parts.append(rng.choice(['<section class="comments">', '<div id="discussion">', "<form>"]))
        remarks()
        parts.append("</section></div></form>")
    region("footer", ["footer", "copyright"], lambda: block("p", rng.choice(["© 2020 ", "", "All rights reserved. "]) + words(rng.randrange(2, 9)), 0))
    return "<html><body>" + "".join(parts) + "</body></html>", truth


@lru_cache(1)
def page_model(pages: int = 500, seed: int = 3) -> PageModel:
    """Fit the classifier on composed pages (ridge logistic regression by Newton steps), then choose the tie that
    leaves the fewest wrong blocks on others of them."""
    rng = random.Random(seed)
    read = []
    for _ in range(pages):
        html, truth = composed_page(rng)
        elements, blocks = blocks_of(html)
        if [b.text for b in blocks] == [t for t, _ in truth]:
            read.append((elements, blocks, np.array([y for _, y in truth], dtype=float)))
    part = len(read) * 7 // 10
    x, y = np.concatenate([features(e, b) for e, b, _ in read[:part]]), np.concatenate([t for *_, t in read[:part]])
    w = np.zeros(len(FEATURES))
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w += np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.eye(len(w)), x.T @ (y - p) - w)

    def wrong(tie: float) -> int:
        model = PageModel(tuple(w.tolist()), tie)
        return sum(int((np.array(labels(e, b, model)) != t).sum()) for e, b, t in read[part:])

    return PageModel(tuple(w.tolist()), min([0.0, 0.5, 1.0, 1.5, 2.0, 3.0, 4.0], key=wrong))


def main_text(html: str | None, model: PageModel | None = None) -> str:
    """The blocks labelled as content, in page order, joined by a blank line; empty if there are none."""
    if not html:
        return ""
    elements, blocks = blocks_of(html)
    if len(elements) == 1:  # a page without tags is all text
        return "\n\n".join(b.text for b in blocks)
    return "\n\n".join(b.text for b, x in zip(blocks, labels(elements, blocks, model or page_model())) if x)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of pages. Null and empty html give the empty text.

    Each page is labelled on its own and whole, so nothing is shuffled; repeated rows, and ids that are null, give rows
    as they come; an empty table gives none. Equal costs keep a block. The scanner's time grows with a page's length,
    however broken it is. Columns beside these three are not read.
    """
    model = page_model()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [main_text(h, model) for h in texts_of(batch, "html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(text, pa.string()), pa.array(map(len, text), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return by_batch(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html"), work, "page_id long, url string, text string, n_chars long")
