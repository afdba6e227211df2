"""Main text of web pages by rules over blocks, in two passes.

Pass one judges each block by itself: where it stands (menu, footer, advert, article ...), the share of its characters
inside links, its length and the share of stop words among its words. Pass two settles what stays open: short blocks take
the label that their nearest decided neighbours share, headings go with the text they introduce.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The most common function words of the languages that are told apart from lists and labels.
STOP_WORDS = frozenset(
    "a an and are as at be but by for from had has have he her his i in is it its not of on or she that the their there they this to was we were "
    "which who will with you "
    "aber als am an auch auf aus bei bin bis das dass dem den der des die durch ein eine einem einen einer er es für hat ich im in ist mit nach nicht "
    "noch nur oder sein sich sie sind so über um und uns von vor war wie wir zu zum zur "
    "au aux avec ce ces cette dans de des du elle en est et il ils je la le les leur mais ne nous on ou où par pas plus pour qu que qui sa se ses son "
    "sont sur un une vous y "
    "al como con cual del desde donde el ella ellos entre era es esta este fue ha hay las lo los más me mi muy no nos o para pero por porque se ser si "
    "sin sobre su sus también una uno "
    "che da dei della di il nel per più sono da do dos em foi mas na nas nos não os pelo um uma de een het van niet op voor zijn".split()
)
# Names of elements by their role in HTML.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav noscript ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
RAW = frozenset("script style template textarea title iframe noframes noembed svg math object select datalist canvas audio video button".split())
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ASIDE = frozenset("nav footer aside form menu dialog search noscript head".split())
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog".split())
# Words in class names and ids of what surrounds an article.
OUTER_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner promo promotion sponsor sponsored "
    "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager toc skip "
    "footer header masthead sidebar aside widget related recommended trending share sharing social newsletter subscribe subscription signup login "
    "cookie cookies consent gdpr notice notices notification alert popup modal overlay disclaimer copyright legal "
    "comment comments commentlist reply replies respond disqus discussion reactions form search".split()
)
MAIN_NAMES = frozenset("article main content post story entry body text page".split())

SHORT, LONG = 70, 200  # characters
FEW, MANY = 0.30, 0.32  # stop words among words
LINKED = 0.2  # characters in links
HEADING_REACH = 200  # characters between a heading and its text

TOKEN = re.compile(
    r"""<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z][^\s/>]*(?:[^>"']|(?<==)"[^"]*(?:"|\Z)|(?<==)'[^']*(?:'|\Z)|["'])*+(?:>|\Z)|</[^>]*(?:>|\Z)""",
    re.DOTALL,
)
NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
NAMES = re.compile(r"""[\s"'/](class|id|role|itemprop|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?""", re.IGNORECASE)
PARTS = re.compile(r"[^a-zA-Z]+|(?<=[a-z])(?=[A-Z])")
LETTERS = re.compile(r"[^\W\d_]+")


class Block(NamedTuple):
    text: str
    linked: int  # characters inside links
    heading: bool
    listed: bool
    outer: bool
    article: bool


class _Element(NamedTuple):
    name: str
    outer: bool  # inside something that surrounds an article
    article: bool
    listed: bool
    hidden: bool


def _element(name: str, tag: str, parent: _Element) -> _Element:
    outer, article, hidden = parent.outer, parent.article, parent.hidden
    found = {a.lower(): v.strip("\"'") for a, v in NAMES.findall(tag)}
    words = {w.lower() for w in PARTS.split(f"{found.get('class', '')} {found.get('id', '')}") if w}
    roles = set(found.get("role", "").lower().split())
    body = "articlebody" in found.get("itemprop", "").lower()
    style = found.get("style", "").replace(" ", "").lower()
    hidden = hidden or "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in style or "visibility:hidden" in style
    named = words & OUTER_NAMES and name not in ("html", "body") and not (name in ("article", "main") and words & MAIN_NAMES)
    outer = outer or name in ASIDE or bool(roles & ROLES) or (bool(named) and not body) or (name == "header" and not article)
    article = article or body or name in ("article", "main") or bool(roles & {"article", "main"})
    return _Element(name, outer, article, parent.listed or name in ("ul", "ol", "dl", "menu"), hidden)


def blocks_of(page: str) -> list[Block]:
    """Blocks of a page with text, in order. Tags need not be closed; a comment, raw element or quote left open reaches the end."""
    root = _Element("", False, False, False, False)
    stack, out = [root], []
    parts: list[str] = []
    linked, links = 0, 0

    def flush(at: _Element) -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split()) if "&" in (whole := "".join(parts)) else " ".join(whole.split())
            if text and not at.hidden:
                heading = any(e.name in HEADINGS for e in stack[-3:])
                out.append(Block(text, min(linked, len(text)), heading, at.listed, at.outer, at.article))
            parts.clear()
        linked = 0

    def say(text: str) -> None:
        nonlocal linked
        parts.append(text)
        if links:
            linked += len("".join(text.split()))

    at, end = 0, len(page)
    while at < end:
        tag = TOKEN.search(page, at)
        if tag is None:
            say(page[at:])
            break
        if tag.start() > at:
            say(page[at : tag.start()])
        at = tag.end()
        token = tag.group()
        named = NAME.match(token)
        if named is None or not token.endswith(">"):
            continue
        name, closes = named.group(1).lower(), token[1] == "/"
        if name in RAW and not closes:
            if not token.endswith("/>") or name not in ("svg", "math"):
                close = re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.IGNORECASE).search(page, at)
                at = close.end() if close else end
            parts.append(" ")
            continue
        if name == "br":
            parts.append(" ")
        elif name == "a":
            links = 0 if closes else 1
        elif name in BLOCKS:
            flush(stack[-1])
            links = 0
            if closes:
                if any(e.name == name for e in stack):
                    while stack.pop().name != name:
                        pass
            else:
                _close_open(name, stack)
                if name not in EMPTY:
                    stack.append(_element(name, token, stack[-1]))
        elif not closes and name not in EMPTY and ("class" in token or "hidden" in token or "style" in token):
            element = _element(name, token, stack[-1])
            if element.hidden and not stack[-1].hidden:  # hidden words inside a line
                close = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.IGNORECASE).search(page, at)
                at = close.end() if close else end
    flush(stack[-1])
    return out


def _close_open(name: str, stack: list[_Element]) -> None:
    """A paragraph, item, row or cell ends where its like begins; a paragraph ends before any block."""
    top = stack[-1].name
    if top == "p" or top in HEADINGS and name in HEADINGS:
        stack.pop()
    for likes, holders in ((("li",), ("ul", "ol", "menu")), (("dt", "dd"), ("dl",)), (("td", "th"), ("tr", "table")), (("tr",), ("table", "tbody", "thead", "tfoot"))):
        if name in likes:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name in holders:
                    break
                if stack[i].name in likes:
                    del stack[i:]
                    break


GOOD, BAD, NEAR, SMALL = "good", "bad", "near", "short"


def judge(block: Block, framed: bool) -> str:
    """The label of a block by itself; framed: the page marks its article."""
    n = len(block.text)
    if block.outer or (framed and not block.article):
        return BAD
    density = block.linked / n
    if framed:
        return BAD if block.listed and density > 0.5 else GOOD
    if density > LINKED:
        return BAD
    if n < SHORT:
        return BAD if block.linked else SMALL
    words = [w.lower() for w in LETTERS.findall(block.text)]
    stops = sum(w in STOP_WORDS for w in words) / max(1, len(words))
    if stops >= MANY:
        return GOOD if n > LONG else NEAR
    return NEAR if stops >= FEW else BAD


def labels_of(blocks: list[Block]) -> list[bool]:
    """Which blocks are main text."""
    framed = any(b.article and not b.outer for b in blocks)
    first = [judge(b, framed) for b in blocks]

    def neighbours(labels: list[str], wanted: tuple[str, ...]) -> tuple[list[str], list[str]]:
        """For each block the nearest label of those wanted before and after it; the page's ends count as bad."""
        before, after, last = [], [], BAD
        for x in labels:
            before.append(last)
            last = x if x in wanted else last
        last = BAD
        for x in reversed(labels):
            after.append(last)
            last = x if x in wanted else last
        return before, after[::-1]

    # headings shortly before good text are held back from the vote of their neighbours
    reach, held = None, [False] * len(blocks)
    for i in range(len(blocks) - 1, -1, -1):
        if first[i] == GOOD:
            reach = 0
        elif reach is not None:
            held[i] = blocks[i].heading and first[i] in (SMALL, NEAR) and reach <= HEADING_REACH
            reach += len(blocks[i].text)
    before, after = neighbours(first, (GOOD, BAD))
    near_before, near_after = neighbours(first, (GOOD, BAD, NEAR))
    second = list(first)
    for i, x in enumerate(first):
        if x == SMALL:
            if before[i] == after[i]:
                second[i] = before[i]
            else:  # a short block between text and frame goes with almost good text on the frame's side
                second[i] = GOOD if (BAD == before[i] and near_before[i] == NEAR) or (BAD == after[i] and near_after[i] == NEAR) else BAD
    before, after = neighbours(second, (GOOD, BAD))
    for i, x in enumerate(second):
        if x == NEAR:
            second[i] = BAD if before[i] == after[i] == BAD and any(y == GOOD for y in second) else GOOD
        if held[i]:
            second[i] = GOOD
    return [x == GOOD for x in second]


def extract(page: str) -> str:
    """Main text of a page: its blocks in order, joined by line ends."""
    blocks = blocks_of(page)
    return "\n".join(b.text for b, good in zip(blocks, labels_of(blocks)) if good)


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every row of pages(page_id, url, html).

    Null, empty and textless pages have an empty text and no characters. Rows are independent, so repeated rows give
    repeated results; null ids and urls stay null; other columns are ignored; no rows give no rows. Pages are read whole,
    in one pass.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(page) for page in batch["html"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch["page_id"], batch["url"], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"]
            )

    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    return rows.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
