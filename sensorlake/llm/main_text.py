"""Main text of web pages by two passes over their blocks.

A page is read as a stream of tags and text and cut into blocks at block-level tags. First
pass: each block is judged by itself. Blocks within menus, headers, footers, sidebars,
notices, adverts, forms, comments and the like are bad, and so are blocks that are mostly
links; long blocks with many stop words are good, and so are blocks without a link in an
article or main element; headings, other short blocks, and blocks without a link that have
few stop words (names, commands, other languages) stay open. Second pass: an open block
takes the label of the nearest decided block; in an article only blocks of that article
count, and long blocks without a link outside articles do not look at menus, lists of
links, footers and the like.

Defined cases: null or empty html gives the empty string; unclosed and unmatched tags,
comments and scripts that never end, and text without any tag are read as far as they go;
null and repeated ids are treated like any other row; the whole page is read, however long.
Added columns replace columns of their own name only; all others are kept.
"""

from __future__ import annotations

import re
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorlake.llm.columns import others

# Elements by kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark meter output q rp rt ruby s samp"
    " small span strike strong sub sup time tt u var wbr".split()
)
NO_TEXT = frozenset(
    "head script style noscript template nav header footer aside form button select option textarea title iframe object"
    " svg math canvas audio video map menu dialog noembed noframes xmp".split()
)
MAIN = frozenset(("article", "main"))
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
# An open element of the first kind ends where one of its list begins.
ENDS = {
    "p": frozenset(
        "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav"
        " ol p pre section table ul".split()
    ),
    "li": frozenset(("li",)),
    "dt": frozenset(("dt", "dd")),
    "dd": frozenset(("dt", "dd")),
    "tr": frozenset(("tr", "tbody", "tfoot")),
    "td": frozenset(("td", "th", "tr", "tbody", "tfoot")),
    "th": frozenset(("td", "th", "tr", "tbody", "tfoot")),
    "option": frozenset(("option",)),
    "head": frozenset(("body",)),
}
# Words of a class, id or role that name something other than the main text.
ASIDE_WORDS = frozenset(
    "ad ads adbox advert adverts advertisement advertising alert banner breadcrumb breadcrumbs comment comments"
    " commentlist complementary consent contentinfo cookie cookies discussion disqus footer footnav gdpr header hidden"
    " login masthead menu modal nav navbar navigation newsletter notice notification outbrain overlay pager pagination"
    " popup promo promotion recommended related replies reply respond search share sharing sidebar signup skip social"
    " sponsor sponsored subscribe taboola toolbar topbar tracking widget widgets".split()
)
# Those that also hold for an article or main element.
NOT_MAIN_WORDS = frozenset("ad ads advert advertisement comment comments promo related reply sponsored teaser".split())
# Stop words of four languages.
STOP_WORDS = frozenset(
    (
        "a about after all also an and are as at be been but by can for from had has have he her his if in into is it its"
        " more no not of on one or other she so that the their there they this to was we were which who will with would"
        " you aber als am an auch auf aus bei bis das dass dem den der des die durch ein eine einem einen einer er es für"
        " hat ich im in ist kann man mit nach nicht noch nur oder sich sie sind so über um und von vor war wie wird zu zum"
        " zur au aux avec ce ces cette dans de des du elle en est et il ils je la le les leur mais ne nous on ou où par"
        " pas plus pour qu que qui sa se ses son sont sur un une vous al como con del el ella ellos entre era esta este"
        " fue ha han hay lo los las más muy o para pero por se ser sin sobre su sus también un una y ya"
    ).split()
)

_TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:-->|--!>|\Z))|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)"
    r"|<([a-zA-Z][^\s/>]*)((?:[^\"'>=]++|=\s*+(?:\"[^\"]*\"|'[^']*')?|[\"'])*+)(?:>|\Z)",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_WORD = re.compile(r"(?<![A-Za-z])(?:(?:has|with|no|without)[-_ ]+\w+)|[A-Z]?[a-z]+|[A-Z]+")


def set_aside(tag: str, attributes: str) -> bool:
    """Whether an element holds something other than the main text."""
    if tag in NO_TEXT:
        return True
    if not attributes or tag in ("html", "body"):
        return False
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or "").strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
        if name in ("class", "id", "role"):
            words = {w[0].lower() for w in _WORD.finditer(value)}
            if words & (NOT_MAIN_WORDS if tag in MAIN else ASIDE_WORDS):
                return True
    return False


class Block:
    def __init__(self, aside: bool, article: int, heading: bool) -> None:
        self.aside, self.article, self.heading = aside, article, heading
        self.parts: list[str] = []
        self.linked = 0
        self.text = ""


def blocks(html: str) -> list[Block]:
    """The page's blocks with text, in order."""
    out: list[Block] = []
    # Open elements: (tag, stands aside, number of its article or 0).
    stack: list[tuple[str, bool, int]] = []
    articles, links, block = 0, 0, Block(False, 0, False)

    def cut() -> None:
        nonlocal block
        block.text = " ".join(unescape("".join(block.parts)).split())
        if block.text:
            out.append(block)
        top = stack[-1] if stack else ("", False, 0)
        block = Block(top[1], top[2], any(t[0] in HEADINGS for t in stack[-3:]))

    def text(s: str) -> None:
        if s:
            block.parts.append(s)
            if links:
                block.linked += len(s)

    at, low = 0, None
    while (m := _TOKEN.search(html, at)) is not None:
        text(html[at : m.start()])
        at = m.end()
        if m[1]:
            tag = m[1].lower()
            if tag == "a":
                links = max(0, links - 1)
            if any(t[0] == tag for t in stack):
                while stack.pop()[0] != tag:
                    pass
            if tag not in INLINE:
                cut()
        elif m[2]:
            tag, attributes = m[2].lower(), m[3] or ""
            if tag == "br":
                text(" ")
                continue
            while stack and tag in ENDS.get(stack[-1][0], ()):
                stack.pop()
            if tag == "p" and (i := next((i for i, t in enumerate(stack) if t[0] == "p"), -1)) >= 0:
                del stack[i:]  # inline elements left open in the paragraph before
            if tag in RAW:
                low = html.lower() if low is None else low
                end = low.find(f"</{tag}", at)
                at = len(html) if end < 0 else end
            if tag == "a":
                links += 1
            if tag in VOID or attributes.endswith("/") and tag not in INLINE:
                if tag not in INLINE:
                    cut()
                continue
            aside, article = (stack[-1][1], stack[-1][2]) if stack else (False, 0)
            aside = aside or set_aside(tag, attributes)
            if tag in MAIN and not aside:
                articles += 1
                article = articles
            stack.append((tag, aside, article))
            if tag not in INLINE or aside != block.aside:
                cut()
                links = links if tag == "a" else 0
    text(html[at:])
    cut()
    return out


def first_pass(b: Block, short: int, long: int, max_links: float, stop_low: float) -> bool | None:
    """Good, bad or open (None)."""
    if b.aside:
        return False
    size, linked = len(b.text), b.linked / max(1, len(b.text))
    if linked > (0.8 if b.article else max_links):
        return False
    if b.article and not b.heading and not b.linked:
        return True
    if not b.article and "©" in b.text:
        return False
    if b.heading or size < short:
        return None
    if b.article:
        return True
    words = b.text.lower().split()
    stops = sum(w.strip(".,;:!?\"'()") in STOP_WORDS for w in words) / len(words)
    if stops >= stop_low:
        return True if size >= long or linked == 0 else None
    return None if linked == 0 else False


def second_pass(found: list[Block], labels: list[bool | None], short: int, max_links: float) -> list[bool]:
    """Open blocks take the label of the nearest decided block; an article's block looks at
    blocks of its own article only, and a block of ``short`` characters or more without a
    link, outside articles, not at menus, lists of links and copyright notes. Between equally
    near ones, or where there is none, an article's block is good, and any other is good if no
    decided block near it is bad. Other open blocks then see the labels of those long ones."""

    def own(b: Block) -> bool:
        return not b.article and not b.heading and not b.linked and len(b.text) >= short

    def frame(b: Block) -> bool:
        return b.aside or b.linked > max_links * len(b.text) or not b.article and "©" in b.text

    free = [label is None and own(b) for b, label in zip(found, labels, strict=True)]
    if any(free):
        judged = [None if frame(b) else label for b, label in zip(found, labels, strict=True)]
        told = by_neighbours(found, judged)
        labels = [told[i] if free[i] else label for i, label in enumerate(labels)]
    return by_neighbours(found, labels)


def by_neighbours(found: list[Block], labels: list[bool | None]) -> list[bool]:
    """All blocks' labels, open ones by the nearest decided block."""

    def nearest(order: range) -> list[int | None]:
        last: dict[int, int] = {}
        at: list[int | None] = [None] * len(found)
        for i in order:
            at[i] = last.get(found[i].article)
            if labels[i] is not None:
                last[0] = last[0 if found[i].aside else found[i].article] = i
        return at

    before, after = nearest(range(len(found))), nearest(range(len(found) - 1, -1, -1))
    out = []
    for i, label in enumerate(labels):
        if label is None:
            near = sorted((abs(j - i), labels[j]) for j in (before[i], after[i]) if j is not None)
            if near and (len(near) == 1 or near[0][0] < near[1][0]):
                label = near[0][1]
            else:
                label = bool(found[i].article) or all(good for _, good in near)
        out.append(bool(label))
    return out


def main_text(html: str | None, short: int = 70, long: int = 140, max_links: float = 0.33, stop_low: float = 0.25) -> str:
    if not html:
        return ""
    found = blocks(html)
    labels = [first_pass(b, short, long, max_links, stop_low) for b in found]
    return " ".join(b.text for b, good in zip(found, second_pass(found, labels, short, max_links), strict=True) if good)


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` with text and n_chars instead of the html."""

    @F.pandas_udf("string")
    def extracted(column: pd.Series) -> pd.Series:
        return pd.Series([main_text(h) for h in column], dtype=object)

    kept = others(pages, html.lower(), "text", "n_chars")
    text = extracted.asNondeterministic()(F.col(f"`{html}`").cast("string"))
    found = pages.select(*kept, text.alias("text"))
    return found.withColumn("n_chars", F.length("text").cast("long"))
