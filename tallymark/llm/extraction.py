"""Main text of HTML pages by two-pass block rules.

A page is cut into blocks at block-level tags. The first pass decides every
block alone: markup that names itself boilerplate (menus, footers, sidebars,
adverts, forms, comments) is bad, on elements of every kind; otherwise stop-word density, length and
link density make it good, nearly good, short or bad. The second pass lets
nearly good and short blocks inherit from the nearest decided blocks before
and behind. Both passes see all blocks. That a block lies in a marked article
is one more clue: it lifts the block's grade by one, and the article's borders
count as good neighbours of the blocks inside. Text outside counts too, where
the two passes alone find it good.

A page is one pass over its tags, whatever its length; nothing is shuffled.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters below which a block is short, and from which stop words make it good rather than nearly good.
SHORT, LONG = 70, 200
#: Stop words among the words of good text, and characters inside links of a block that is a menu.
STOP_DENSITY, LINK_DENSITY = 0.25, 0.5
#: Blocks of links in a row that make a menu even inside an article.
MENU_BLOCKS = 3

# Elements and names of page parts that are not the article.
RAW = {"script", "style", "title", "noscript", "template", "textarea", "iframe", "svg", "math", "object", "canvas", "audio", "video"}
DROPPED = {"nav", "footer", "aside", "form", "button", "select", "dialog", "menu"}
NAMES = {"ad", "ads", "advert", "adverts", "advertisement", "sponsor", "sponsored", "promo", "promotion", "banner", "cookie", "cookies", "consent",
         "notice", "notices", "popup", "modal", "overlay", "sidebar", "aside", "nav", "navbar", "navigation", "menu", "menubar", "breadcrumb",
         "breadcrumbs", "footer", "masthead", "comment", "comments", "commentlist", "reply", "replies", "disqus", "share", "sharing", "social",
         "related", "recommended", "newsletter", "subscribe", "signup", "login", "widget", "pagination", "pager", "toolbar", "form", "search"}
#: Words that say a name is about what an element contains or lacks.
WRAPPERS = {"with", "has", "no", "without"}
HEADER_NAMES = {"header", "pageheader", "siteheader", "topbar"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar"}
NESTING = {"html", "body", "div", "section", "article", "main", "header", "table", "ul", "ol", "dl", "figure", "blockquote", "details", "fieldset",
           "center", "td", "tr"} | DROPPED
BREAKS = NESTING | {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "th", "tbody", "thead", "tfoot", "caption", "pre", "hr", "address",
                    "figcaption", "summary", "option", "legend", "hgroup"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Elements that end where the next of their list does, without a closing tag.
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
STOP_WORDS = frozenset("""
a about after all also an and are as at be been but by can for from had has have he her his how i if in into is it its more no not of on one only
or our out she so some than that the their them there they this to up was we were what when which who will with would you your
au aux avec ce ces comme dans de des du elle en est et eux il ils je la le les leur lui mais me même ne nous on ou par pas plus pour qu que qui sa
se ses son sont sur tu un une vous y
aber als am an auch auf aus bei bin bis das dass dem den der des die doch du ein eine einem einen einer er es für hat ich ihr im in ist ja kann
mit nach nicht noch nur oder sein sich sie sind so über um und uns von vor war was wie wir wird zu zum zur
al algo como con cual cuando de del desde donde el ella en entre era es esta este fue ha hay la las lo los más me mi muy no nos o para pero por que
se sin sobre su sus también te un una y ya
""".split())

# quotes count only behind an equals sign; what is not closed ends with the page
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>=]++|=\s*\"[^\"]*\"|=\s*'[^']*'|=)*)(?:>|\Z)", re.S)
_NAMED = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_PART = re.compile(r"[a-z]+")
_EDGE = re.compile(r"^\W+|\W+$")


@dataclass
class Block:
    """Text of one block and what is known of it."""

    parts: list[str] = field(default_factory=list)
    linked: int = 0
    dropped: bool = False
    article: bool = False
    heading: bool = False
    text: str = ""


def _boilerplate(tag: str, attributes: str, in_article: bool) -> bool:
    if tag in DROPPED or (tag == "header" and not in_article):
        return True
    if tag in ("html", "body", "main"):
        return False
    for name, *values in _NAMED.findall(attributes) if "=" in attributes or "hidden" in attributes else ():
        value, name = next((v for v in values if v), "").lower(), name.lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return True
        if name == "role" and value in ROLES:
            return True
        if name in ("class", "id"):
            parts = set(_PART.findall(value))
            if parts & WRAPPERS:
                continue
            if parts & NAMES or (parts & HEADER_NAMES and not in_article):
                return True
    return False


def blocks_of(page: str) -> list[Block]:
    """Blocks with text, in page order."""
    out, block, stack, opened = [], Block(), [], Counter()  # stack: (tag, dropped here, article here, hidden here)
    dropped = article = hidden = links = at = 0
    heading = False

    def finish():
        nonlocal block
        text = " ".join("".join(block.parts).split())
        if text:
            block.text = text
            out.append(block)
        block = Block()

    def close(tag: str):
        nonlocal dropped, article, hidden
        while True:  # what is still open inside ends with it
            open_tag, drop, main, hide = stack.pop()
            opened[open_tag] -= 1
            dropped, article, hidden = dropped - drop, article - main, hidden - hide
            if open_tag == tag:
                break

    def close_open(tags: set[str]):
        for open_tag, *_ in reversed(stack):
            if open_tag in NESTING:
                break
            if open_tag in tags:
                close(open_tag)
                break

    def add(raw: str):
        if raw and not hidden:
            text = html.unescape(raw) if "&" in raw else raw
            if not block.parts:
                block.dropped, block.article, block.heading = dropped > 0, article > 0, heading
            block.parts.append(text)
            if links:
                block.linked += len("".join(text.split()))

    while True:
        match = _TOKEN.search(page, at)
        if not match:
            add(page[at:])
            break
        add(page[at:match.start()])
        at = match.end()
        if match[2] is None:
            continue
        tag, closing = match[2].lower(), match[1] == "/"
        if tag in RAW:
            if not closing and not match[3].endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\s*(?:>|\Z)", re.I).search(page, at)
                at = end.end() if end else len(page)
            continue
        if tag == "a":
            links = 0 if closing else 1
        elif tag == "br":
            block.parts.append(" ") if block.parts else None
        if tag in BREAKS:
            finish()
            heading = not closing and tag in HEADINGS
            if hidden and not closing:
                close_open({"p"} | SIBLINGS.get(tag, set()))
        if closing:
            if opened[tag]:
                close(tag)
        elif tag in NESTING:
            drop, main = _boilerplate(tag, match[3], article > 0), tag in ("article", "main")
            stack.append((tag, drop, main, False))
            opened[tag] += 1
            dropped, article = dropped + drop, article + main
        elif tag not in VOID and not match[3].endswith("/"):
            # of the other elements, those that are boilerplate are kept in mind, and elements of their name inside them
            hide = _boilerplate(tag, match[3], article > 0)
            if hide or opened[tag]:
                stack.append((tag, False, False, hide))
                opened[tag] += 1
                hidden += hide
    finish()
    return out


def _label(block: Block) -> str:
    """First pass: what a block is on its own. An article lifts its blocks by one grade."""
    if block.dropped:
        return "outside"
    length = len(block.text)
    words = [_EDGE.sub("", w).lower() for w in block.text.split()]
    dense = sum(w in STOP_WORDS for w in words) >= STOP_DENSITY * len(words)
    if block.linked > LINK_DENSITY * max(1, length - block.text.count(" ")):
        return "link" if block.article else "bad"
    if length < SHORT:
        return "bad" if block.linked and not block.article else "short"
    grade = dense + (length >= LONG) + block.article
    return "bad" if grade == 0 else "near" if grade == 1 else "good"


def _inherit(blocks: list[Block], labels: list[str], article: bool, lone: bool) -> list[bool]:
    """Second pass over the blocks inside articles, or over the others."""
    run = 0  # links in a row inside an article
    for i in range(len(labels) + 1):
        if i < len(labels) and labels[i] == "link":
            run += 1
            continue
        labels[i - run:i] = ["bad" if run >= MENU_BLOCKS else "short"] * run
        run = 0
    edge = "good" if article else "bad"
    ahead, seen = [edge] * len(labels), edge
    for i in range(len(labels) - 1, -1, -1):
        ahead[i] = seen
        seen = labels[i] if labels[i] in ("good", "bad") else seen
    out, seen = [], edge
    for block, label, behind in zip(blocks, labels, ahead):
        if label == "near":
            out.append(lone or "good" in (seen, behind))
        elif label == "short":
            out.append(seen == behind == "good" or ((article or block.heading) and behind == "good") or (article and seen == "good"))
        else:
            out.append(label == "good")
        seen = label if label in ("good", "bad") else seen
    return out


def classify(blocks: list[Block]) -> list[bool]:
    """Which blocks are main text."""
    labels, kept = [_label(b) for b in blocks], [False] * len(blocks)
    lone = "good" not in labels  # nothing decided good: nearly good text is the best there is
    for article in (True, False):
        at = [i for i, b in enumerate(blocks) if b.article == article]
        for i, keep in zip(at, _inherit([blocks[i] for i in at], [labels[i] for i in at], article, lone)):
            kept[i] = keep
    return kept


def main_text(page: str | None) -> str:
    """Main text of a page; empty for a null or empty page and where nothing is main text."""
    blocks = blocks_of(page or "")
    return " ".join(b.text for b, keep in zip(blocks, classify(blocks)) if keep)


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row; repeated rows stay repeated."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [main_text(h) for h in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()),
                                                  pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(
        run, "page_id bigint, url string, text string, n_chars bigint")
