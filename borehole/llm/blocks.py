"""Main text of web pages: flat text blocks, classified by a small decision tree.

A page is cut into blocks of text at block-level tags. A block is described by its words and link
density, those of its neighbours, and the kind of element it stands in. A decision tree, trained
on the labelled table below, tells main text from the rest; no rule beside it decides.

Scripts, styles, markup, form controls and the document head hold no blocks. Character references
are decoded, white space inside a block (a line break too) becomes one space, and the main blocks
are joined by a newline in page order. Null and empty pages, and pages without main text, give the
empty string. A page that ends inside an element is read to its end. Rows that repeat are repeated.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from borehole.session import ship_package

FEATURES = (
    "words", "links", "words_before", "links_before", "words_after", "links_after", "article", "aside", "heading",
)

#: Labelled blocks: the features in the order of FEATURES, then 1 for main text. ``article`` is
#: 1 in an article or main element, -1 outside of the page's, 0 on pages without; ``aside`` tells that a navigation, footer,
#: advert, comment or similar element is. Densities are shares of words inside links.
LABELLED = [
    # paragraphs and headings of articles
    (120, 0.00, 85, 0.00, 90, 0.00, 1, 0, 0, 1), (64, 0.05, 120, 0.00, 7, 0.00, 1, 0, 0, 1),
    (7, 0.00, 9, 0.00, 75, 0.00, 1, 0, 1, 1), (1, 0.00, 40, 0.00, 1, 0.00, 1, 0, 0, 1),
    (1, 0.00, 1, 0.00, 220, 0.00, 1, 0, 0, 1), (2, 0.00, 0, 0.00, 0, 0.00, 1, 0, 0, 1),
    (14, 0.00, 9, 0.00, 14, 0.00, 1, 0, 1, 1), (18, 0.60, 45, 0.00, 50, 0.10, 1, 0, 0, 1),
    (3, 1.00, 70, 0.00, 33, 0.00, 1, 0, 0, 1), (900, 0.00, 3, 0.00, 12, 0.00, 1, 0, 0, 1),
    (30, 0.00, 6, 1.00, 25, 0.00, 1, 0, 0, 1), (26, 0.10, 55, 0.00, 8, 1.00, 1, 0, 0, 1),
    (4, 0.00, 8, 0.00, 90, 0.00, 1, 0, 1, 1), (11, 0.00, 60, 0.00, 5, 0.20, 1, 0, 0, 1),
    (20, 0.00, 50, 0.00, 1, 0.00, 1, 0, 0, 1), (40, 0.00, 30, 0.00, 2, 0.00, 1, 0, 0, 1),
    (12, 0.00, 80, 0.00, 0, 0.00, 1, 0, 0, 1), (10, 0.90, 5, 0.00, 22, 0.00, 1, 0, 0, 1),
    (6, 0.00, 2, 0.00, 3, 0.00, 1, 0, 1, 1), (55, 0.40, 20, 1.00, 1, 1.00, 1, 0, 0, 1),
    (9, 0.00, 1, 1.00, 9, 0.00, 1, 0, 1, 1), (5, 1.00, 2, 1.00, 6, 1.00, 1, 0, 0, 1),
    # the same pages' menus, adverts, notices, footers and comments
    (1, 1.00, 0, 0.00, 1, 1.00, 0, 1, 0, 0), (1, 1.00, 1, 1.00, 9, 0.00, 0, 1, 0, 0),
    (9, 0.00, 1, 1.00, 12, 0.00, 0, 1, 0, 0), (8, 0.00, 44, 0.00, 0, 0.00, 0, 1, 0, 0),
    (40, 0.00, 90, 0.00, 35, 0.00, 0, 1, 0, 0), (35, 0.00, 40, 0.00, 0, 0.00, 1, 1, 0, 0),
    (3, 0.00, 60, 0.00, 40, 0.00, 1, 1, 1, 0), (12, 0.50, 80, 0.00, 70, 0.00, 1, 1, 0, 0),
    (22, 0.00, 110, 0.00, 95, 0.00, 1, 1, 0, 0), (150, 0.00, 20, 0.00, 30, 0.00, 0, 1, 0, 0),
    (2, 0.00, 1, 1.00, 1, 1.00, 0, 1, 1, 0), (6, 0.80, 2, 1.00, 3, 1.00, 0, 1, 0, 0),
    (40, 0.00, 90, 0.00, 120, 0.00, 0, 1, 0, 0), (150, 0.00, 100, 0.00, 80, 0.00, 0, 1, 0, 0),
    (30, 0.00, 20, 0.00, 100, 0.00, 0, 1, 0, 0), (9, 0.00, 6, 1.00, 140, 0.00, 0, 1, 0, 0),
    (60, 0.00, 45, 0.00, 70, 0.00, 0, 1, 0, 0), (4, 0.00, 35, 0.00, 66, 0.00, 0, 1, 1, 0),
    # stray blocks beside an article
    (30, 0.00, 1, 1.00, 10, 0.00, -1, 0, 0, 0), (7, 0.00, 40, 0.00, 8, 0.00, -1, 0, 0, 0),
    (3, 1.00, 0, 0.00, 14, 0.00, -1, 0, 0, 0), (12, 0.00, 0, 0.00, 6, 0.00, -1, 0, 1, 0),
    (90, 0.05, 50, 0.00, 4, 0.00, -1, 0, 0, 0), (2, 0.00, 70, 0.00, 0, 0.00, -1, 0, 0, 0),
    # pages without article elements
    (80, 0.00, 60, 0.00, 95, 0.00, 0, 0, 0, 1), (45, 0.04, 8, 0.00, 70, 0.00, 0, 0, 0, 1),
    (19, 0.00, 75, 0.00, 64, 0.00, 0, 0, 0, 1), (130, 0.02, 0, 0.00, 0, 0.00, 0, 0, 0, 1),
    (6, 0.00, 3, 1.00, 88, 0.00, 0, 0, 1, 1), (9, 0.00, 50, 0.00, 72, 0.00, 0, 0, 1, 1),
    (25, 0.00, 30, 0.00, 4, 0.60, 0, 0, 0, 1), (60, 0.10, 2, 1.00, 5, 1.00, 0, 0, 0, 1),
    (40, 0.00, 60, 0.00, 20, 0.00, 0, 0, 0, 1), (30, 0.00, 10, 0.00, 12, 0.00, 0, 0, 0, 1),
    (70, 0.00, 40, 0.00, 35, 0.00, 0, 0, 0, 1), (13, 0.00, 28, 0.00, 45, 0.00, 0, 0, 0, 1),
    (3, 1.00, 2, 1.00, 4, 1.00, 0, 0, 0, 0), (2, 1.00, 0, 0.00, 2, 1.00, 0, 0, 0, 0),
    (5, 0.90, 40, 0.00, 3, 1.00, 0, 0, 0, 0), (8, 0.70, 3, 1.00, 60, 0.00, 0, 0, 0, 0),
    (4, 0.00, 2, 1.00, 3, 1.00, 0, 0, 0, 0), (5, 0.00, 50, 0.00, 0, 0.00, 0, 0, 0, 0),
    (20, 0.85, 10, 0.90, 15, 1.00, 0, 0, 0, 0), (12, 0.50, 6, 1.00, 2, 1.00, 0, 0, 0, 0),
]

BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary "
    "table tbody td tfoot th thead tr ul".split()
)
#: Elements whose content is no text of the page.
SILENT = frozenset(
    "script style noscript template title textarea select option button iframe object canvas svg math head".split()
)
RAW = frozenset(["script", "style", "textarea", "title", "iframe", "noscript"])
MAIN_TAGS = frozenset(["article", "main"])
ASIDE_TAGS = frozenset(["nav", "footer", "aside", "form", "dialog", "menu"])
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])
ASIDE_WORD = re.compile(
    r"ad|ads|advert\w*|banner|sponsor\w*|promo\w*|nav|navbar|navigation|menu|breadcrumbs?|footer|"
    r"sidebar|side|widget|related|recommended|share|social|comments?|respond|replies|disqus|cookies?|consent|gdpr|"
    r"notice|alert|popup|modal|newsletter|subscribe|signup|login|header|masthead|toolbar|pagination|pager"
)
#: Words that say where or how an element stands, not what it holds.
PLACE_WORDS = frozenset(
    "area bar block bottom box buttons container content global inner item left links list main outer page primary "
    "right secondary section site slot top unit wrap wrapper".split()
)
TAG = re.compile(
    r"<(?:!--.*?(?:-->|\Z)|([!?])[^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z))",
    re.S,
)
NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)


def aside_name(names: str) -> bool:
    """Whether a class, id or role names an aside by all of its words, as ``site-footer`` but not ``side-effects``."""
    for name in re.sub(r"([a-z])([A-Z])", r"\1-\2", names).lower().split():
        words = [w for w in re.split(r"[^a-z]+", name) if w and w not in PLACE_WORDS]
        if words and all(ASIDE_WORD.fullmatch(w) for w in words):
            return True
    return False


@dataclass
class Block:
    text: str
    words: int
    links: float
    article: bool
    aside: bool
    heading: bool


@dataclass
class Tree:
    """A decision node, or a leaf if ``feature`` is negative."""

    feature: int
    cut: float
    main: bool
    low: Tree | None = None
    high: Tree | None = None

    def decide(self, row: tuple) -> bool:
        node = self
        while node.feature >= 0:
            node = node.low if row[node.feature] <= node.cut else node.high
        return node.main


def train(rows: np.ndarray, labels: np.ndarray, depth: int = 6) -> Tree:
    """The tree of smallest Gini impurity at each step; ties go to the first feature and cut."""
    share = labels.mean()
    leaf = Tree(-1, 0.0, bool(share >= 0.5))
    if depth == 0 or share in (0.0, 1.0):
        return leaf
    best = (len(labels) * share * (1 - share) - 1e-12, -1, 0.0)
    for f in range(rows.shape[1]):
        values = np.unique(rows[:, f])
        for cut in (values[1:] + values[:-1]) / 2:
            low = rows[:, f] <= cut
            cost = sum(len(part) * part.mean() * (1 - part.mean()) for part in (labels[low], labels[~low]))
            if cost < best[0] - 1e-12:
                best = (cost, f, float(cut))
    if best[1] < 0:
        return leaf
    low = rows[:, best[1]] <= best[2]
    return Tree(
        best[1], best[2], leaf.main, train(rows[low], labels[low], depth - 1), train(rows[~low], labels[~low], depth - 1)
    )


def trained(table: list[tuple] | None = None) -> Tree:
    data = np.array(LABELLED if table is None else table, float)
    return train(data[:, :-1], data[:, -1])


def page_blocks(page: str) -> list[Block]:
    """The text blocks of a page, in order."""
    out: list[Block] = []
    stack: list[tuple[str, bool, bool]] = []  # tag, article around, aside around
    pieces: list[tuple[str, bool]] = []
    link = heading = silent = 0
    article = aside = False

    def close() -> None:
        nonlocal pieces
        if not pieces:
            return
        text = " ".join(html.unescape("".join([p for p, _ in pieces])).split())
        if text:
            inside = "".join([p for p, in_link in pieces if in_link])
            words = len(text.split(" "))
            out.append(Block(text, words, min(1.0, len(inside.split()) / words), article, aside, heading > 0))
        pieces = []

    at, end = 0, len(page)
    while at < end:
        m = TAG.search(page, at)
        if m is None:
            if not silent:
                pieces.append((page[at:], link > 0))
            break
        if m.start() > at and not silent:
            pieces.append((page[at : m.start()], link > 0))
        at = m.end()
        tag = m[3]
        if tag is None:
            continue
        tag = tag.lower()
        if m[2]:
            if tag == "a":
                link = 0
            elif tag in BLOCK_TAGS or tag in SILENT:
                if tag in BLOCK_TAGS:
                    close()
                if any(t == tag for t, *_ in stack):
                    while stack:
                        t, article, aside = stack.pop()
                        silent -= t in SILENT
                        heading -= t in HEADINGS
                        if t == tag:
                            break
            continue
        if tag == "a":
            link = 1
        elif tag == "br":
            if not silent:
                pieces.append((" ", link > 0))
        elif tag in BLOCK_TAGS or tag in SILENT:
            if tag in BLOCK_TAGS:
                close()
                link = 0
            if tag == "p" or tag in HEADINGS:  # these end an open paragraph or heading
                while stack and (stack[-1][0] == "p" or stack[-1][0] in HEADINGS):
                    t, article, aside = stack.pop()
                    heading -= t in HEADINGS
            if tag in VOID or m[4].rstrip().endswith("/") and tag in ("svg", "math"):
                continue
            if tag in RAW:
                done = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
                at = done.end() if done else end
                continue
            stack.append((tag, article, aside))
            silent += tag in SILENT
            heading += tag in HEADINGS
            if tag in MAIN_TAGS:
                article = True
            elif tag in ASIDE_TAGS or tag == "header" and not article:
                aside = True
            if tag not in ("html", "body", "article", "main") and not aside and m[4]:
                names = " ".join([x for found in NAMES.findall(m[4]) for x in found if x])
                aside = aside_name(names)
    close()
    return out


def features(blocks: list[Block]) -> list[tuple]:
    """The features of every block, in the order of FEATURES."""
    out = []
    outside = -any(b.article for b in blocks)
    for i, b in enumerate(blocks):
        before = (blocks[i - 1].words, blocks[i - 1].links) if i else (0, 0.0)
        after = (blocks[i + 1].words, blocks[i + 1].links) if i + 1 < len(blocks) else (0, 0.0)
        out.append((b.words, b.links, *before, *after, 1 if b.article else outside, b.aside, b.heading))
    return out


def main_text(page: str | None, tree: Tree) -> str:
    blocks = page_blocks(page or "")
    return "\n".join([b.text for b, row in zip(blocks, features(blocks), strict=True) if tree.decide(row)])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` for every page."""
    ship_package(pages.sparkSession)
    tree = trained()

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                text = [main_text(page.as_py(), tree) for page in part.column(2)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(text, pa.string()),
                     pa.array([len(t) for t in text], pa.int64())],
                    names=["page_id", "url", "text", "n_chars"],
                )

    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
        F.col(html_col).cast("string").alias("html"),
    )
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
