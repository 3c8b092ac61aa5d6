"""Main text of web pages: flat text blocks described by their own and their neighbours' word count and link density, told
apart by a decision tree that is trained on a small labelled table.

Blocks are the runs of text between block-level tags. A block in a container whose tag or class says what it is (menus, headers,
footers, side bars, notices, adverts, forms, comments) has that as a feature; script, style and similar content is never text.

Defined cases: null html is empty; a page without text gives an empty text; unclosed or cut tags end where the page ends;
repeated rows and null ids stay; an empty table gives no rows; pages of any length are read whole; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm.text import lean

#: Fixed values of HTML: elements that start a new block, that have no content, and whose content is not text.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frame h1 h2 h3 h4 h5 h6 head header hr html legend li main"
    " menu nav noscript ol optgroup option p pre section select summary table tbody td template textarea tfoot th thead title tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = frozenset("script style noscript template svg math iframe object canvas audio video textarea select button title head".split())
#: What a container says of its content, by tag and by words of class, id and role.
SAID_BY_TAG = {"nav": "menu", "menu": "menu", "header": "header", "footer": "footer", "aside": "side", "form": "form", "fieldset": "form", "dialog": "notice", "article": "article", "main": "article"}
SAID_BY_WORD = (
    ("menu", "nav navbar navigation menu breadcrumb breadcrumbs pagination pager tabs toc skip"),
    ("header", "header masthead topbar banner"),
    ("footer", "footer copyright colophon"),
    ("side", "sidebar aside widget related recommended trending rail sidenav promoted teaser share social sharing"),
    ("notice", "cookie cookies consent gdpr notice popup modal overlay newsletter subscribe signup alert paywall"),
    ("ad", "ad ads advert advertisement adsense sponsor sponsored promo"),
    ("form", "form login search searchbox"),
    ("comment", "comment comments disqus replies reply respond discussion"),
    ("article", "article content post entry story body main"),
)
WORD_SAYS = {w: kind for kind, words in SAID_BY_WORD for w in words.split()}
#: Words that leave a word's meaning as it is when joined to it by - or _, as in site-header and ad-box.
JOINED = frozenset("site page main global top bottom left right primary secondary outer inner wrapper wrap container box bar block section area list item links text content panel slot unit".split())
#: Fixed values of HTML: open elements that a new element ends, up to the nearest of the elements that bound the search.
P_ENDS = BLOCK_TAGS - {"br", "caption", "col", "dd", "dt", "head", "body", "html", "li", "legend", "option", "optgroup", "summary", "tbody", "td", "tfoot", "th", "thead", "tr", "title", "select", "textarea", "noscript", "template"}
ENDS = {
    "li": (("li",), ("ul", "ol", "menu", "dir")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr",), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
    "tbody": (("thead", "tbody", "tfoot"), ("table",)), "thead": (("thead", "tbody", "tfoot"), ("table",)), "tfoot": (("thead", "tbody", "tfoot"), ("table",)), "option": (("option",), ("select", "datalist")),
} | dict.fromkeys(P_ENDS, (("p",), ("button", "td", "th", "table", "caption", "object", "body")))
BOILERPLATE = ("menu", "header", "footer", "side", "notice", "ad", "form", "comment")

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)", re.S)
NAMED = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
SPACES = re.compile(r"\s+")
def _says(tag: str, attributes: str) -> str | None:
    """What an element says of its content: by its tag, or by whole words of its class, id and role. The page's own elements say nothing."""
    if tag in ("html", "body"):
        return None
    if tag in SAID_BY_TAG and tag not in ("article", "main"):
        return SAID_BY_TAG[tag]
    found = None
    if "=" in attributes or "hidden" in attributes:
        for name, value in NAMED.findall(attributes):
            name, value = name.lower(), value.strip("\"'").lower()
            if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
                return "hidden"
            if name in ("class", "id", "role"):
                for word in value.split():
                    kind = WORD_SAYS.get(word)
                    if not kind:
                        # A joined word counts if all its other parts leave the meaning as it is: no-sidebar and with-ad do not.
                        parts = re.split("[-_]+", word)
                        known = [p for p in parts if p not in JOINED]
                        kind = WORD_SAYS.get(known[0]) if len(parts) > 1 and len(known) == 1 else None
                    if kind and (kind != "article" or not found):
                        found = kind
    return found if found and found != "article" else SAID_BY_TAG.get(tag, found)


def text_blocks(page: str) -> list[tuple[str, int, str, str]]:
    """(text, characters of it in links, what its containers say, tag) of each block that has text, in page order.

    The time is linear in the page: what the containers say is kept with each open element, and counts tell which are open.
    """
    out: list[tuple[str, int, str, str]] = []
    #: Open elements: tag, the innermost boilerplate around (or hidden), whether an article is around.
    stack: list[tuple[str, str | None, bool]] = []
    opened: dict[str, int] = {}
    parts: list[str] = []
    linked = in_link = 0
    tag_now = "body"

    def end_block() -> None:
        nonlocal linked, parts
        if parts:
            text = SPACES.sub(" ", entities.unescape("".join(parts))).strip()
            if text:
                kind, inside = stack[-1][1:] if stack else (None, False)
                out.append((text, min(linked, len(text)), kind or ("article" if inside else "plain"), tag_now))
            parts, linked = [], 0

    def close(tags: tuple[str, ...], within: tuple[str, ...] = ()) -> None:
        """Ends the innermost open element among tags, with all in it, unless one of within stands between."""
        if any(opened.get(t) for t in tags):
            k = len(stack) - 1
            while stack[k][0] not in tags and stack[k][0] not in within:
                k -= 1
            if stack[k][0] in tags:
                while len(stack) > k:
                    opened[stack.pop()[0]] -= 1

    at, n = 0, len(page)
    while at < n:
        m = TOKEN.search(page, at)
        piece = page[at : m.start() if m else n]
        if piece:
            parts.append(piece)
            if in_link:
                linked += len(piece)
        if not m:
            break
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                parts.append(entities.escape(m[0][9:-3]))
            continue
        tag, closing = m[2].lower(), bool(m[1])
        if tag in RAW_TAGS and not closing and not m[3].endswith("/"):
            shut = re.compile(rf"</{tag}\s*>|<body\b" if tag == "head" else rf"</{tag}\b[^>]*>", re.I).search(page, at)
            end_block() if tag in BLOCK_TAGS else None
            at = (shut.start() if shut and shut[0].lower().startswith("<body") else shut.end()) if shut else n
            continue
        if tag in BLOCK_TAGS:
            end_block()
            tag_now = tag if not closing else "body"
        if tag == "a":
            in_link = 0 if closing else 1
        if tag in VOID_TAGS:
            continue
        if closing:
            close((tag,), ("article", "main", "body", "td", "th") if tag in ("p", "b", "i", "a", "em", "strong", "span", "li") else ())
        else:
            if tag in ENDS:
                close(*ENDS[tag])
            if not m[3].rstrip().endswith("/"):
                kind = _says(tag, m[3])
                around, inside = stack[-1][1:] if stack else (None, False)
                if around != "hidden" and kind and kind != "article":
                    around = kind
                stack.append((tag, around, inside or kind == "article"))
                opened[tag] = opened.get(tag, 0) + 1
    end_block()
    return out


FEATURES = ("words", "link_density", "words_before", "link_density_before", "words_after", "link_density_after", "in_boilerplate", "in_article", "page_has_article", "is_heading")
#: A labelled table (fixed values): the features of a block in the order above, and whether it belongs to the main text.
#: Of pages without an article the neighbours decide: a short block or a link between link lists is a menu's label or entry, the same
#: between paragraphs is a subheading or a sentence that is a link.
LABELLED = (
    ((2, 0.0, 3, 1.0, 2, 1.0, 0, 0, 0, 0), 0),
    ((1, 0.0, 2, 0.9, 4, 1.0, 0, 0, 0, 0), 0),
    ((4, 0.0, 5, 1.0, 3, 0.9, 0, 0, 0, 0), 0),
    ((3, 0.0, 2, 1.0, 2, 1.0, 0, 0, 0, 1), 0),
    ((5, 0.0, 1, 1.0, 6, 1.0, 0, 0, 0, 1), 0),
    ((1, 0.0, 0, 0.0, 1, 0.0, 1, 0, 0, 0), 0),
    ((1, 0.0, 0, 0.0, 40, 0.0, 1, 0, 0, 0), 0),
    ((3, 0.0, 70, 0.0, 60, 0.0, 1, 0, 0, 0), 0),
    ((5, 0.0, 30, 0.0, 2, 0.0, 1, 0, 0, 0), 0),
    ((9, 0.0, 20, 0.0, 80, 0.0, 1, 0, 0, 1), 0),
    ((14, 0.1, 0, 0.0, 55, 0.0, 1, 0, 0, 0), 0),
    ((30, 0.0, 60, 0.0, 70, 0.0, 1, 0, 0, 0), 0),
    ((45, 0.0, 80, 0.0, 0, 0.0, 1, 0, 0, 0), 0),
    ((80, 0.0, 0, 0.0, 30, 0.0, 1, 0, 0, 0), 0),
    ((150, 0.0, 60, 0.0, 90, 0.0, 1, 0, 0, 0), 0),
    ((6, 1.0, 60, 0.0, 70, 0.0, 1, 0, 0, 0), 0),
    ((60, 0.3, 10, 0.0, 45, 0.0, 1, 0, 0, 0), 0),
    ((2, 0.0, 3, 1.0, 60, 0.0, 0, 1, 1, 0), 1),
    ((1, 1.0, 4, 1.0, 70, 0.0, 0, 1, 1, 0), 1),
    ((3, 0.0, 2, 1.0, 80, 0.0, 0, 1, 1, 1), 1),
    ((1, 0.5, 2, 1.0, 100, 0.0, 0, 1, 1, 0), 1),
    ((2, 1.0, 0, 0.0, 3, 1.0, 0, 1, 1, 0), 1),
    ((3, 1.0, 60, 0.0, 2, 1.0, 0, 1, 1, 0), 1),
    ((10, 0.0, 4, 1.0, 20, 0.0, 0, 1, 1, 0), 1),
    ((4, 0.0, 3, 1.0, 2, 1.0, 0, 1, 1, 0), 1),
    ((20, 0.9, 2, 1.0, 5, 1.0, 0, 1, 1, 0), 1),
    ((1, 0.0, 2, 0.0, 3, 0.0, 0, 0, 0, 0), 1),
    ((2, 0.0, 0, 0.0, 5, 0.0, 0, 0, 0, 0), 1),
    ((4, 0.0, 6, 0.0, 1, 0.0, 0, 0, 0, 0), 1),
    ((1, 0.0, 30, 0.0, 10, 0.0, 0, 0, 0, 0), 1),
    ((6, 0.1, 12, 0.0, 40, 0.0, 0, 0, 0, 0), 1),
    ((15, 0.0, 2, 0.0, 0, 0.0, 0, 0, 0, 0), 1),
    ((5, 0.0, 25, 0.2, 30, 0.1, 0, 0, 0, 1), 1),
    ((2, 1.0, 0, 0.0, 3, 1.0, 0, 0, 0, 0), 0),
    ((1, 1.0, 60, 0.0, 2, 1.0, 0, 0, 0, 0), 0),
    ((3, 1.0, 9, 0.0, 2, 1.0, 0, 0, 0, 0), 0),
    ((8, 0.9, 45, 0.0, 5, 1.0, 0, 0, 0, 0), 0),
    ((2, 1.0, 3, 1.0, 70, 0.0, 0, 0, 0, 0), 0),
    ((4, 1.0, 2, 1.0, 30, 0.0, 0, 0, 0, 0), 0),
    ((9, 1.0, 4, 0.9, 55, 0.0, 0, 0, 0, 0), 0),
    ((9, 0.0, 12, 0.0, 2, 1.0, 0, 0, 0, 0), 1),
    ((40, 0.0, 70, 0.0, 3, 1.0, 0, 0, 0, 0), 1),
    ((30, 0.1, 3, 1.0, 2, 1.0, 0, 0, 0, 0), 1),
    ((60, 0.0, 4, 1.0, 5, 1.0, 0, 0, 0, 0), 1),
    ((25, 0.0, 2, 1.0, 2, 1.0, 0, 0, 0, 0), 1),
    ((8, 1.0, 60, 0.0, 70, 0.0, 0, 0, 0, 0), 1),
    ((12, 0.9, 45, 0.0, 80, 0.0, 0, 0, 0, 0), 1),
    ((6, 0.8, 90, 0.1, 50, 0.0, 0, 0, 0, 0), 1),
    ((4, 0.0, 70, 0.0, 3, 1.0, 0, 0, 0, 0), 1),
    ((5, 0.0, 2, 1.0, 60, 0.0, 0, 0, 0, 1), 1),
    ((1, 1.0, 0, 0.0, 1, 1.0, 1, 0, 1, 0), 0),
    ((2, 1.0, 1, 1.0, 2, 1.0, 1, 0, 1, 0), 0),
    ((12, 0.0, 1, 1.0, 9, 0.0, 1, 0, 1, 0), 0),
    ((60, 0.0, 4, 0.5, 30, 0.0, 1, 0, 1, 0), 0),
    ((45, 0.0, 40, 0.0, 52, 0.0, 1, 0, 1, 0), 0),
    ((8, 0.0, 80, 0.0, 0, 0.0, 1, 0, 1, 0), 0),
    ((25, 0.2, 80, 0.0, 6, 0.0, 1, 0, 0, 0), 0),
    ((70, 0.0, 20, 0.0, 45, 0.0, 1, 0, 0, 0), 0),
    ((3, 0.0, 1, 1.0, 2, 1.0, 1, 0, 0, 1), 0),
    ((9, 0.0, 10, 0.0, 12, 0.0, 0, 1, 1, 1), 1),
    ((12, 0.0, 9, 0.0, 60, 0.0, 0, 1, 1, 0), 1),
    ((1, 0.0, 40, 0.0, 50, 0.0, 0, 1, 1, 0), 1),
    ((2, 0.0, 0, 0.0, 1, 0.0, 0, 1, 1, 0), 1),
    ((90, 0.0, 12, 0.0, 75, 0.0, 0, 1, 1, 0), 1),
    ((200, 0.1, 75, 0.0, 0, 0.0, 0, 1, 1, 0), 1),
    ((30, 0.4, 60, 0.0, 80, 0.0, 0, 1, 1, 0), 1),
    ((6, 1.0, 60, 0.0, 80, 0.0, 0, 1, 1, 0), 1),
    ((4, 1.0, 6, 1.0, 5, 1.0, 0, 1, 1, 0), 1),
    ((14, 0.0, 3, 1.0, 2, 0.0, 0, 0, 1, 0), 0),
    ((80, 0.0, 60, 0.0, 3, 0.0, 0, 0, 1, 0), 0),
    ((3, 1.0, 2, 1.0, 4, 1.0, 0, 0, 1, 0), 0),
    ((3, 1.0, 2, 1.0, 4, 1.0, 0, 0, 0, 0), 0),
    ((5, 1.0, 8, 0.9, 6, 1.0, 0, 0, 0, 0), 0),
    ((9, 0.8, 3, 1.0, 40, 0.0, 0, 0, 0, 0), 0),
    ((20, 0.7, 5, 1.0, 9, 1.0, 0, 0, 0, 0), 0),
    ((9, 0.0, 4, 1.0, 70, 0.0, 0, 0, 0, 1), 1),
    ((70, 0.0, 9, 0.0, 80, 0.0, 0, 0, 0, 0), 1),
    ((12, 0.0, 70, 0.0, 66, 0.0, 0, 0, 0, 0), 1),
    ((25, 0.1, 12, 0.0, 45, 0.0, 0, 0, 0, 0), 1),
    ((3, 0.0, 70, 0.0, 66, 0.0, 0, 0, 0, 0), 1),
    ((40, 0.3, 66, 0.0, 3, 0.5, 0, 0, 0, 0), 1),
    ((5, 0.0, 60, 0.0, 0, 0.0, 0, 0, 1, 0), 0),
    ((20, 0.0, 80, 0.0, 4, 0.0, 0, 0, 1, 0), 0),
    ((40, 0.0, 0, 0.0, 30, 0.0, 0, 0, 1, 0), 0),
    ((85, 0.0, 30, 0.0, 9, 0.0, 0, 0, 1, 0), 0),
    ((120, 0.0, 50, 0.0, 0, 0.0, 0, 0, 1, 0), 0),
    ((200, 0.0, 20, 0.0, 60, 0.0, 0, 0, 1, 0), 0),
    ((9, 0.0, 0, 0.0, 70, 0.0, 0, 0, 1, 0), 0),
    ((80, 0.0, 12, 0.0, 75, 0.0, 0, 1, 1, 0), 1),
    ((85, 0.0, 0, 0.0, 60, 0.0, 0, 1, 1, 0), 1),
    ((120, 0.0, 85, 0.0, 90, 0.0, 0, 1, 1, 0), 1),
    ((300, 0.0, 1, 0.0, 2, 0.0, 0, 1, 1, 0), 1),
    ((500, 0.0, 0, 0.0, 0, 0.0, 0, 1, 1, 0), 1),
    ((78, 0.0, 40, 0.0, 3, 0.0, 0, 1, 1, 0), 1),
    ((5, 0.0, 0, 0.0, 0, 0.0, 0, 1, 1, 0), 1),
    ((1, 0.0, 1, 0.0, 1, 0.0, 0, 1, 1, 0), 1),
    ((80, 0.0, 60, 0.0, 70, 0.0, 0, 0, 0, 0), 1),
    ((85, 0.0, 9, 0.0, 0, 0.0, 0, 0, 0, 0), 1),
    ((120, 0.0, 0, 0.0, 40, 0.0, 0, 0, 0, 0), 1),
    ((300, 0.0, 80, 0.0, 0, 0.0, 0, 0, 0, 0), 1),
    ((2, 0.0, 60, 0.0, 50, 0.0, 1, 0, 1, 0), 0),
    ((40, 0.0, 60, 0.0, 50, 0.0, 1, 0, 1, 0), 0),
    ((80, 0.0, 60, 0.0, 50, 0.0, 1, 0, 1, 0), 0),
    ((150, 0.0, 60, 0.0, 50, 0.0, 1, 0, 1, 0), 0),
    ((400, 0.0, 60, 0.0, 50, 0.0, 1, 0, 1, 0), 0),
    ((3, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, 0), 1),
    ((12, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, 0), 1),
    ((60, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, 0), 1),
    ((12, 0.0, 0, 0.0, 15, 0.0, 0, 0, 0, 0), 1),
)


class Tree:
    """A binary decision tree grown by Gini impurity until its leaves are pure or DEPTH is reached."""

    DEPTH = 8

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int = DEPTH) -> None:
        self.feature, self.value = -1, float(y.mean()) if len(y) else 0.0
        if depth == 0 or self.value in (0.0, 1.0):
            return
        best = (self._gini(y) * len(y) - 1e-9, -1, 0.0)
        for f in range(x.shape[1]):
            levels = np.unique(x[:, f])
            for cut in (levels[1:] + levels[:-1]) / 2:
                left = x[:, f] <= cut
                cost = self._gini(y[left]) * left.sum() + self._gini(y[~left]) * (~left).sum()
                if cost < best[0] - 1e-12:
                    best = (cost, f, float(cut))
        if best[1] >= 0:
            _, self.feature, self.cut = best
            left = x[:, self.feature] <= self.cut
            self.low, self.high = Tree(x[left], y[left], depth - 1), Tree(x[~left], y[~left], depth - 1)

    @staticmethod
    def _gini(y: np.ndarray) -> float:
        p = y.mean() if len(y) else 0.0
        return 2 * p * (1 - p)

    def __call__(self, row: tuple) -> float:
        node = self
        while node.feature >= 0:
            node = node.low if row[node.feature] <= node.cut else node.high
        return node.value


def trained(table: tuple = LABELLED) -> Tree:
    return Tree(np.array([x for x, _ in table], float), np.array([y for _, y in table], float))


def main_text(page: str | None, tree: Tree) -> str:
    found = [b for b in text_blocks(page or "") if b[2] != "hidden"]
    sizes = [(len(t.split()), linked / len(t)) for t, linked, _, _ in found]
    has_article = int(any(c == "article" for _, _, c, _ in found))
    edge = (0, 0.0)
    keep = []
    for i, (text, _, context, tag) in enumerate(found):
        before, after = sizes[i - 1] if i else edge, sizes[i + 1] if i + 1 < len(sizes) else edge
        row = (*sizes[i], *before, *after, int(context in BOILERPLATE), int(context == "article"), has_article, int(tag in ("h1", "h2", "h3", "h4", "h5", "h6")))
        if tree(row) >= 0.5:
            keep.append(text)
    return "\n".join(keep)


def extract(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns keep and text, the main text of html."""
    source = pages.select(*keep, F.col(html).alias("_html"))
    tree = trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py(), tree) for x in batch.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(keep))], pa.array(texts, pa.string())], names=[*keep, "text"])

    return source.mapInArrow(lean(run), source.select(*keep, F.col("_html").cast("string").alias("text")).schema)


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").cast("long"), "url", "html")).withColumn("n_chars", F.length("text").cast("long"))
