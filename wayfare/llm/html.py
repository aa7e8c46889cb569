"""Main text of HTML pages by tag-path ratios.

A page is read into blocks of text, each with its root-to-leaf path of block elements (names, and classes of generic
ones). Over all visible blocks, per path, text length and punctuation per block and the share of text outside links
are aggregated; in page order the first two are smoothed with a small Gaussian, and the logarithms of both are fused
with the share by their product. A path is a content path if its blocks' mean reaches ``SHARE`` standard deviations of
the page's, or ``GENERIC_SHARE`` if it ends in an element that says nothing of its text (div, section, ...).

The article is the least element that holds ``COVER`` of the text on content paths, each character counted by its
path's ratio, or the outermost article or main element around it; the blocks on content paths inside it are returned,
and the headings right before one. Paths decide which blocks are content; two priors come before them: text that
markup itself declares apart (scripts, styles, navigation, footers, asides, forms; role, class or id of adverts,
notices, comments) has no path, and weaker words (``MAYBE_WORDS``) do so except for long text outside links within an
article.

Markup may be broken: unclosed and misnested elements are closed as browsers imply, stray end tags ignored, unclosed
comments and raw texts run to the end. Defined results: null and empty html, and pages without content, give the empty
text; equal rows equal texts; any length and depth is read whole, page by page, in time that follows the length.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARE, GENERIC_SHARE = 0.25, 1.0
COVER = 0.9
KERNEL = (0.25, 0.5, 0.25)
#: A block of weaker words is text of the article from this mean length on.
LONG_TEXT = 60

# Element names and the class, id and role words that declare text apart.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript template iframe svg math xmp noembed noframes".split())
APART = frozenset("head nav footer aside form button select option datalist dialog menu object canvas audio video map".split()) | RAW
BLOCKS = frozenset("html body address article aside blockquote caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul button head".split())
CLOSES_P = BLOCKS - frozenset("html body head td th tr tbody thead tfoot caption option".split())
SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
APART_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored cookie cookies consent gdpr notice notices popup modal overlay menu nav navbar navigation breadcrumb breadcrumbs "
    "sidebar comments disqus footer masthead login signin signup subscribe newsletter search pagination pager skip".split()
)
MAYBE_WORDS = frozenset("side widget widgets related recommended share sharing social promo promotion alert toolbar comment reply replies respond discussion hidden".split())
GENERIC = frozenset("html body div section center main address details dir".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
HEADER_WORDS = frozenset({"header", "topbar"})
APART_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？]")

ATTRIBUTES = r"(?:[^>=]|=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>\"'][^\s>]*)?)*+"
MARKUP = re.compile(r"<(?:!--(.*?)(?:--!?>|\Z)|(/?)([a-zA-Z][^\s/>]*)(" + ATTRIBUTES + r")>|(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|[!?/][^>]*(?:>|\Z))", re.S)
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>][^\s>]*)))?")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
PARTS = re.compile(r"[^a-z]+")

NO, MAYBE, YES = 0, 1, 2


def _named(value: str, words: frozenset[str]) -> bool:
    """Whether a name of a class or id attribute is one of the words, or begins or ends with one (ad-top, main_menu)."""
    for name in value.split():
        parts = [p for p in PARTS.split(name) if p]
        if parts and (parts[0] in words or parts[-1] in words):
            return True
    return False


def _apart(tag: str, attributes: str, inside_article: bool) -> int:
    """Whether markup declares an element apart from the article."""
    if tag in APART or (tag == "header" and not inside_article):
        return YES
    out = NO
    for m in ATTRIBUTE.finditer(attributes) if attributes.strip(" /") else ():
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name in ("class", "id") and tag not in ("html", "body", "main"):
            if _named(value, APART_WORDS) or (not inside_article and _named(value, HEADER_WORDS)):
                return YES
            if any(n in MAYBE_WORDS for n in value.split()):
                out = MAYBE
        elif name == "role" and value.strip() in APART_ROLES or name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and HIDDEN.search(value):
            return YES
    return out


class Block:
    """Text, its characters inside links, its element and its path; ``maybe``: under a weaker word, ``heading``: in one."""

    __slots__ = ("generic", "heading", "linked", "maybe", "node", "path", "text")

    def __init__(self, text, linked, node, path, tag, maybe):
        self.text, self.linked, self.node, self.path, self.maybe = text, linked, node, path, maybe
        self.generic, self.heading = tag in GENERIC or not tag, tag in HEADINGS


class Page:
    """The blocks of a page that are not declared apart, in page order, and its elements: ``parent`` and ``tag`` by
    number, an element coming after its parent. Paths are numbered, as pairs of the path before and a name."""

    def __init__(self, page: str):
        self.blocks: list[Block] = []
        self.parent, self.tag = [-1], [""]
        self.paths: dict[tuple[int, str], int] = {}
        self._read(page)

    def _read(self, page: str) -> None:
        stack = [("", 0, -1, NO, False)]  # tag, element, path, apart, inside an article
        opened: Counter[str] = Counter()
        held: list[str] = []
        linked = 0
        link = 0  # depth of the stack at an open link, 0 without one

        def flush():
            nonlocal linked
            if held:
                text = " ".join(entities.unescape("".join(held)).split())
                held.clear()
                tag, node, path, apart, _ = stack[-1]
                if text and apart != YES:
                    self.blocks.append(Block(text, min(linked, len(text)), node, path, tag, apart == MAYBE))
            linked = 0

        def pop_to(k: int):
            nonlocal link
            for tag, *_ in stack[k:]:
                opened[tag] -= 1
            del stack[k:]
            link = 0 if link > k else link

        def close_one(tags, stops):
            """Close the innermost of some tags unless a stop comes first."""
            if any(opened[t] for t in tags):
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] in tags:
                        pop_to(k)
                        return
                    if stack[k][0] in stops:
                        return

        at, n = 0, len(page)
        while at < n:
            m = MARKUP.search(page, at)
            text = page[at : m.start() if m else n]
            if text:
                held.append(text)
                linked += len(text) if link else 0
            if m is None:
                break
            at = m.end()
            closing, tag, attributes = (m[2], m[3], m[4]) if m[3] else (m[5], m[6], m[7])
            if not tag:
                continue
            tag = tag.lower()
            if tag == "a":
                link = 0 if closing else len(stack)
            elif closing:
                if tag in BLOCKS or tag in APART:
                    if opened[tag]:
                        flush()
                        close_one((tag,), ())
                elif tag == "br":
                    held.append(" ")
            elif tag in RAW:
                if not attributes.rstrip().endswith("/") or tag not in ("svg", "math"):
                    end = re.compile(rf"</{re.escape(tag)}\s*[^>]*>", re.I).search(page, at)
                    at = end.end() if end else n
                held.append(" ")
            elif tag in VOID:
                if tag == "hr":
                    flush()
                held.append(" ")
            elif tag in BLOCKS or tag in APART:  # other elements are transparent
                flush()
                if tag in CLOSES_P:
                    close_one(("p",), ("td", "th", "caption", "button", "article", "section", "div", "li"))
                if tag in SIBLINGS:
                    close_one(*SIBLINGS[tag])
                name = tag
                if tag in ("div", "section", "ul", "table") and attributes:
                    name += "".join(f".{w}" for a in ATTRIBUTE.finditer(attributes) if a[1].lower() == "class" for w in (a[2] or a[3] or a[4] or "").split()[:2])
                _, above, path, apart, inside = stack[-1]
                apart = max(apart if tag != "main" else NO, _apart(tag, attributes, inside))
                stack.append((tag, len(self.parent), self.paths.setdefault((path, name), len(self.paths)), apart, inside or tag in ("article", "main")))
                opened[tag] += 1
                self.parent.append(above)
                self.tag.append(tag)
        flush()


def _smoothed(series: list[float]) -> list[float]:
    last = len(series) - 1
    return [sum(w * series[min(max(i + d, 0), last)] for d, w in zip((-1, 0, 1), KERNEL, strict=True)) for i in range(len(series))]


def path_ratios(found: list[Block]) -> tuple[dict[int, float], float]:
    """The mean fused ratio of each path, and the standard deviation over the blocks."""
    totals: dict[int, list[float]] = {}
    for b in found:
        t = totals.setdefault(b.path, [0, 0, 0, 0])
        for k, x in enumerate((1, len(b.text), len(PUNCTUATION.findall(b.text)), b.linked)):
            t[k] += x
    length = _smoothed([totals[b.path][1] / totals[b.path][0] for b in found])
    points = _smoothed([totals[b.path][2] / totals[b.path][0] for b in found])
    fused = [math.log2(1 + x) * math.log2(2 + y) * (1 - totals[b.path][3] / totals[b.path][1]) for b, x, y in zip(found, length, points, strict=True)]
    mean = sum(fused) / len(fused)
    sums = dict.fromkeys(totals, 0.0)
    for b, x in zip(found, fused, strict=True):
        sums[b.path] += x
    return {p: sums[p] / totals[p][0] for p in totals}, math.sqrt(sum((x - mean) ** 2 for x in fused) / len(fused))


def content_paths(found: list[Block], share: float = SHARE, generic_share: float = GENERIC_SHARE) -> dict[int, float]:
    """Paths whose ratio reaches the threshold, and their ratios; the best path always does."""
    ratios, spread = path_ratios(found)
    generic = {b.path: b.generic for b in found}
    best = max(ratios.values())
    return {p: x for p, x in ratios.items() if x >= min(best, (generic_share if generic[p] else share) * spread)}


def main_text(page: str | None, share: float = SHARE, generic_share: float = GENERIC_SHARE) -> str:
    read = Page(page or "")
    found = read.blocks
    inside = _within(read, [k for k, t in enumerate(read.tag) if t in ("article", "main")])
    lengths: dict[int, list[int]] = {}
    for b in found:
        t = lengths.setdefault(b.path, [0, 0, 0])
        for k, x in enumerate((1, len(b.text), b.linked)):
            t[k] += x
    long_text = {p for p, (n, size, linked) in lengths.items() if size >= LONG_TEXT * n and 2 * linked < size}
    found = [b for b in found if not b.maybe or (inside[b.node] and b.path in long_text)]
    if not found:
        return ""
    chosen = content_paths(found, share, generic_share)
    under = [0.0] * len(read.parent)
    for b in found:
        if b.path in chosen:
            under[b.node] += len(b.text) * (chosen[b.path] + 1e-9)
    for k in range(len(under) - 1, 0, -1):
        under[read.parent[k]] += under[k]
    line = [k for k, x in enumerate(under) if x >= COVER * under[0]]  # from the root down
    article = next((k for k in line if read.tag[k] in ("article", "main")), line[-1])
    if read.tag[article] == "p":  # one long paragraph: its element's siblings belong to it
        article = read.parent[article]
    within = _within(read, [article])
    kept, follows = [], False
    for b in reversed(found):
        if within[b.node]:
            content = b.path in chosen
            if content or (b.heading and follows):
                kept.append(b.text)
            follows = content or (b.heading and follows)
    return " ".join(reversed(kept))


def _within(read: Page, roots: list[int]) -> list[bool]:
    """Whether each element is one of some elements or inside one."""
    out = [False] * len(read.parent)
    for k in roots:
        out[k] = True
    for k in range(1, len(out)):
        out[k] = out[k] or out[read.parent[k]]
    return out


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text for every row."""
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.col("html"), F.lit("")).alias("html"))

    def run(batches):
        for batch in batches:
            texts = [main_text(h) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return base.mapInArrow(run, "page_id long, url string, text string")
