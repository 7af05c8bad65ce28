"""Main text of web pages by two passes of block rules.

First each block is judged by itself: its share of links, its length, its share of stop words and the element it is
in make it good, bad or, if it is short or middling, undecided. Being inside an article element speaks for a block
as many stop words do, being outside of the page's article against it; links speak against it anywhere. Then
undecided blocks take the label of their nearest decided neighbours; between a good and a bad one, the good side
wins for blocks that were nearly good. The edge of a page counts as bad, that of an article as good. Elements that
cannot hold an article (menus, forms, scripts, adverts, comments and so on) give no blocks. Time is linear in the page.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import slices, table, utf8

# Elements, class words and stop words.
RAW = ("script", "style", "noscript", "template", "textarea", "title", "svg", "math", "iframe", "object", "select", "canvas")
NEVER = ("head", "nav", "footer", "aside", "form", "button", "fieldset", "dialog", "menu", "header")
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
BLOCK = (
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form",
    "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
)
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
BAD_WORDS = (
    "ad", "ads", "adbox", "adslot", "advert", "adverts", "advertisement", "advertising", "alert", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "commentlist", "consent", "cookie", "cookies",
    "disclaimer", "discussion", "disqus", "footer", "gdpr", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "notification", "outbrain", "overlay",
    "pager", "pagination", "paywall", "popup", "promo", "promoted", "promotion", "related", "replies", "reply", "respond", "search", "share", "sharing", "sidebar", "signup", "skip", "social", "sponsor",
    "sponsored", "subscribe", "subscription", "taboola", "teaser", "toolbar", "topbar", "widget",
)
BAD_ROLES = ("alert", "alertdialog", "banner", "complementary", "contentinfo", "dialog", "form", "menu", "menubar", "navigation", "search", "toolbar")
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "he", "in", "is", "it", "not", "of", "on", "or", "she", "that", "the", "they", "this", "to", "was", "we", "were", "which", "with", "you",
    "avec", "ce", "dans", "de", "des", "du", "elle", "en", "est", "et", "il", "la", "le", "les", "ne", "ou", "par", "pas", "pour", "qui", "que", "se", "son", "sur", "un", "une",
    "auf", "aus", "das", "dem", "den", "der", "des", "die", "ein", "eine", "er", "für", "ich", "im", "ist", "mit", "nicht", "sich", "sie", "und", "von", "war", "wie", "zu",
    "al", "como", "con", "del", "el", "es", "las", "lo", "los", "más", "no", "o", "para", "pero", "por", "sin", "su", "sus", "una", "y",
)

#: Share of characters in links that makes a block bad, lengths below which it is short and from which it is long, shares of stop words.
LINKS, SHORT, LONG, STOP_LOW, STOP_HIGH = 0.2, 70, 200, 0.15, 0.25
#: Share of characters in links that makes a block of an article bad, and one next to which MENU_ITEMS blocks like it make a menu.
ARTICLE_LINKS, MENU_LINKS, MENU_ITEMS = 0.5, 0.8, 3

NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
QUOTE = re.compile(r"""[>"']""")
COMMENT_END = re.compile(r"--!?>")
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_RAW, _NEVER, _VOID, _BLOCK, _BAD, _ROLES, _STOP = map(frozenset, (RAW, NEVER, VOID, BLOCK, BAD_WORDS, BAD_ROLES, STOP_WORDS))


@dataclass
class Block:
    tag: str
    article: bool
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    label: str = ""
    text: str = ""


def _refused(tag: str, attributes: str) -> bool:
    """Whether an element's name, role, class or id says that it holds no article."""
    if tag in _NEVER:
        return True
    if not attributes:
        return False
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), (a or b or c).lower()
        if name == "hidden" or name == "role" and value in _ROLES or name == "aria-hidden" and value == "true":
            return True
        if name in ("class", "id") and not _BAD.isdisjoint(re.split(r"[^a-z]+", value)):
            return True
    return False


def tags(page: str) -> Iterator[tuple[int, int, bool, str, str]]:
    """Start, end, whether it closes, name ('' for comments and declarations) and attributes of each tag.

    A quote that is never closed is plain text, and so are all quotes after it. What starts like a tag and never ends is text.
    The receiver may send the place to go on from.
    """
    at, loose = 0, False
    while (at := page.find("<", at)) >= 0:
        name = NAME.match(page, at)
        if page.startswith("<!--", at):
            m = COMMENT_END.search(page, at + 4)
            end = m.end() if m else len(page)
        elif name or page[at + 1 : at + 2] in ("!", "?"):
            end = page.find(">", at) + 1
            if not end:
                return
            if name and not loose:
                m = QUOTE.search(page, name.end())
                while m and m[0] != ">":
                    close = page.find(m[0], m.end())
                    m = QUOTE.search(page, close + 1) if close >= 0 else None
                loose = not m
                end = m.end() if m else end
        else:
            at += 1
            continue
        sent = yield at, end, bool(name and name[1]), name[2].lower() if name else "", page[name.end() : end - 1] if name else ""
        at = end if sent is None else sent
        if sent is not None:
            yield at, at, False, "", ""


def blocks_of(page: str) -> list[Block]:
    """The text blocks of a page that lie in no refused element, in page order."""
    out: list[Block] = []
    now = Block("body", False)
    opened: list[tuple[str, bool, bool]] = []  # tag, refused, article
    refused = article = links = breaks = headers = 0
    seen = False
    at, size, many = 0, len(page), Counter()

    def cut(tag: str) -> None:
        nonlocal now
        now.text = " ".join("".join(now.parts).split())
        if now.text:
            out.append(now)
        now = Block(tag, article > 0)

    def put(raw: str) -> None:
        nonlocal breaks
        if raw and not (refused and not (now.tag in HEADINGS and titled())):
            text = html.unescape(raw)
            now.parts.append(text)
            if not text.isspace():
                breaks = 0
            if links:
                now.linked += len("".join(text.split()))

    def titled() -> bool:
        """Inside an article's own header, and nothing else that is refused."""
        return article > 0 and refused == headers

    found = tags(page)
    for start, end, closing, tag, attributes in found:
        put(page[at:start])
        at = end
        if not tag:
            continue
        if tag == "br":
            breaks += 1
            if breaks > 1:
                cut(now.tag)
            else:
                now.parts.append(" ")
            continue
        if tag in _RAW:
            if not closing and not attributes.endswith("/"):
                m = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, at)
                at = (page.find(">", m.end()) + 1 or size) if m else size
                found.send(at)
            continue
        if tag == "a":
            links = 0 if closing else 1
        if tag in _BLOCK:
            breaks = 0
            cut("body" if closing else tag)
        if closing:
            while many[tag]:
                t, r, a = opened.pop()
                many[t] -= 1
                refused, article, headers = refused - r, article - a, headers - (r and t == "header")
                if t == tag:
                    if tag in _BLOCK:
                        now.article = article > 0
                    break
        elif tag in _BLOCK and tag not in ("p", "hr", "html", "body") or tag in ("button", "span", "a") and attributes:
            inner = tag in ("article", "main")
            bad = (tag in _NEVER or tag not in ("html", "body", "main", "article")) and _refused(tag, attributes)
            if inner and not seen and refused and not any(r and t in _NEVER for t, r, _ in opened):
                opened, refused, headers = [(t, False, a) for t, _, a in opened], 0, 0  # an advert or notice that was never closed
            seen |= inner
            if not attributes.endswith("/"):
                opened.append((tag, bad, inner))
                many[tag] += 1
                refused, article, headers = refused + bad, article + inner, headers + (bad and tag == "header")
            if tag in _BLOCK:
                now.article = article > 0
    put(page[at:])
    cut("body")
    return out


def judge(b: Block, outside: bool = False) -> str:
    """First pass: good, bad, near (nearly good) or short. outside: the page has an article, and the block is not in it."""
    words = [re.sub(r"[\W_]+", "", w) for w in b.text.lower().split()]
    stop = sum(w in _STOP for w in words) / len(words)
    n = len(b.text)
    if outside or b.linked > (ARTICLE_LINKS if b.article else LINKS) * n:
        return "bad"
    if b.article:
        return "short" if n < SHORT else "good" if stop >= STOP_LOW or n >= LONG else "near"
    if "©" in b.text and n < LONG:
        return "bad"
    if n < SHORT:
        return "bad" if b.linked else "near" if b.tag == "p" else "short"
    if stop >= STOP_HIGH:
        return "good" if n >= LONG else "near"
    return "near" if stop >= STOP_LOW or b.tag == "p" and not b.linked else "bad"


def _menus(found: list[Block]) -> set[int]:
    """Numbers of list items that are links, where MENU_ITEMS or more follow one another."""
    out, run = set(), []
    for k, b in enumerate([*found, Block("", True)]):
        if b.tag == "li" and b.linked > MENU_LINKS * len("".join(b.text.split())):
            run.append(k)
            continue
        out.update(run if len(run) >= MENU_ITEMS else ())
        run = []
    return out


def label_blocks(found: list[Block]) -> None:
    """Both passes: sets each label to good or bad."""
    named = any(b.article for b in found)
    menus = _menus(found)
    first = ["bad" if k in menus else judge(b, named and not b.article) for k, b in enumerate(found)]
    for k, b in enumerate(found):  # links of an article that are no menu
        if b.article and first[k] == "bad" and k not in menus and len(b.text) < SHORT:
            first[k] = "short"
    if not named and "good" not in first:  # a page of middling blocks only
        first = ["good" if f == "near" and len(b.text) >= SHORT else f for f, b in zip(first, found, strict=True)]
    sides: list[list[str]] = []
    for order in (range(len(found)), range(len(found) - 1, -1, -1)):
        last, inside, side = "bad", False, [""] * len(found)
        for k in order:
            if found[k].article != inside:
                inside = found[k].article
                last = "good" if inside else "bad"
            side[k] = last
            last = first[k] if first[k] in ("good", "bad") else last
        sides.append(side)
    for k, b in enumerate(found):
        left, right = sides[0][k], sides[1][k]
        one = "good" if b.article or first[k] == "near" else "bad"
        b.label = first[k] if first[k] in ("good", "bad") else left if left == right else one
    after = "bad"
    for k in range(len(found) - 1, -1, -1):  # a heading belongs to what follows it
        b = found[k]
        if b.tag not in HEADINGS:
            after = b.label
        elif not b.article and first[k] != "bad":
            b.label = after


def main_text(page: str) -> str:
    """The good blocks of a page, one a line."""
    found = blocks_of(page)
    label_blocks(found)
    return "\n".join(b.text for b in found if b.label == "good")


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars for pages (page_id, url, html; other columns are ignored).

    Null, empty and textless html gives an empty text. Repeated rows keep a row each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            texts = [main_text(h.decode(errors="replace")) if h else "" for h in utf8(batch.column("html"))]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op6_block_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main texts of all pages; see extracted() for nulls and empty pages."""
    return extracted(table(spark, sf_dir, "pages"))
