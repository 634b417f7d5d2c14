"""Main text of web pages by the distribution of text over lines.

1. Markup is stripped into lines: one per block element, with white space and inline markup inside a block as one space.
   Text inside containers that never hold the article (menus, headers, footers, sidebars, forms, adverts, notices,
   comments, scripts, styles) and text of links keeps its line but counts nothing. Containers are known by whole words of
   class or id. A page's only article inside such a container counts, and so does one that holds more than those outside.
   Containers whose class or id only contains such a word as one part are side containers if they hold less text than the rest.
   Headlines in the header of a marked article count.
2. Over the lines' counted lengths, less their text in links, sums over sliding windows of `WINDOW` lines are taken. A page's
   threshold is the part `SURGE` of the median character's window sum, but at most `ENOUGH` characters. A surge point is
   the first line with its share of the threshold in a stretch of windows that reach it; the last such line is the dive
   point. A headline at most `WINDOW` lines before a surge point moves it there.
3. The counted lines of all runs between surge and dive points are kept, and those that stand in the same container as a
   line that surges, however short. Where a page marks its article (article or main), only lines inside it count, each
   mark is one container, and lines made of links, captions and formulas count. Elsewhere a line of links counts if the
   counted lines before and after it stand in the same container and it does too, as a list in mid-text does.
   What is cut so: taglines, copyright lines and teasers in containers of their own, away from the text.

Character references are decoded once. A page without counted text has an empty result, as have null and empty pages.
Pages cut off in the middle of a tag or element are read as far as they go. Rows stay rows; pages are read whole.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WINDOW, SURGE, ENOUGH = 3, 0.25, 120
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "select", "object", "annotation", "annotation-xml", "xmp"}
SIDE = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "head"}
BLOCK = {
    "address", "article", "blockquote", "body", "center", "dd", "details", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
    "header", "hr", "html", "li", "main", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul", "aside", "menu", "dialog", "button", "head", "option", "legend", "caption",
}
VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr", "param"}
MARK = {"article", "main"}
HOLDER = {"body", "html", "div", "section", "center", "td", "article", "main", "details"}
_SIDE = r"(?:ads?|advert\w*|banner|promo\w*|sponsor\w*|cookies?|consent|notice|popup|modal|newsletter|subscribe|share|sharing|social|sidebar|side|related|recommend\w*|comments?|replies|discussion|disqus|breadcrumbs?|nav\w*|menu|footer|header|masthead|pagination|pager|widget|toolbar|login|search|tags|copyright|legal)"
#: A whole class or id that names a container outside the article: such words alone, behind a place of the site or before a kind of box.
NAMED = re.compile(rf"(?:(?:site|main|top|global)[_-]+)?{_SIDE}(?:[_-]+{_SIDE})*(?:[_-]+(?:list|links|box|container|wrapper|bar|form|area|block|unit|slot))?", re.I)
#: Parts of a class or id that name such a container if it holds less text than the rest, unless another part negates them.
PART = re.compile(r"ads?|advert\w*|promo\w*|sponsor\w*|cookies?|consent|newsletter|subscribe|disqus|comments?|sidebar|related", re.I)
STATE = re.compile(r"has|no|not|with|without|is|open|closed", re.I)
HEADLINE = {"h1", "h2", "h3", "h4", "h5", "h6"}
ROLE = re.compile(r"navigation|banner|contentinfo|complementary|search|dialog|alert|menu|form", re.I)
TAG = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?>[^>=]+|=\s*\"[^\"]*(?:\"|$)|=\s*'[^']*(?:'|$)|=)*+)(?:>|$)", re.S)
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)(?:\"|$)|'([^']*)(?:'|$)|([^\s\"'>][^\s>]*)))?")
UNSEEN = re.compile(r"display\s*:\s*none", re.I)


def _attributes(text: str) -> dict[str, str]:
    """The first value of each attribute, by name in lower case."""
    found: dict[str, str] = {}
    for name, *values in ATTRIBUTE.findall(text):
        found.setdefault(name.lower(), html.unescape("".join(values)))
    return found


def _outside(name: str, text: str) -> bool:
    if name in SIDE:
        return True
    if not text or name in ("html", "body", "article", "main"):
        return False
    own = _attributes(text)
    if "hidden" in own or own.get("aria-hidden", "").strip().lower() == "true" or UNSEEN.search(own.get("style", "")):
        return True
    return bool(ROLE.search(own.get("role", ""))) or any(NAMED.fullmatch(word) for key in ("class", "id") for word in own.get(key, "").split())


def _loose(name: str, text: str) -> bool:
    """Whether a part of a class or id names a side container."""
    if not text or name in ("html", "body", "article", "main"):
        return False
    own = _attributes(text)
    words = [re.split("[_-]+", word) for key in ("class", "id") for word in own.get(key, "").split()]
    return any(any(map(PART.fullmatch, parts)) and not any(map(STATE.fullmatch, parts)) for parts in words)


@dataclass
class Line:
    """A line of a page; one of links outside a marked article has its length counted below zero."""

    text: str
    counted: int
    linked: int
    inside: bool  # a marked article
    wrapped: bool  # that article is in a side container
    loose: bool  # in a container that may be a side container
    headline: bool
    holders: list[int]  # numbers of its containers, the page and its body as 0
    mark: int  # number of its marked article, 0 without


def lines_of(page: str) -> list[Line]:
    lines: list[Line] = []
    stack: list[tuple[str, bool, bool, int, bool]] = []  # element, outside the article, marks the article, position, loosely named
    parts: list[str] = []
    linked = 0
    at: int | None = None  # depth of the block that holds the open link
    position, size = 0, len(page)

    def close_line() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        parts.clear()
        if text:
            marks = [i for i, s in enumerate(stack) if s[2]]
            # An article inside an article is a comment or the like; main only holds them.
            top = next((i for i in marks if stack[i][0] == "article"), marks[-1] if marks else 0)
            headline = any(s[0] in HEADLINE for s in stack)
            side = any(s[1] and not (marks and headline and s[0] == "header") for s in stack[top:])
            lines.append(Line(
                text, 0 if side else -len(text) if linked >= len(text) and not marks else len(text), min(linked, len(text)),
                bool(marks), any(s[1] for s in stack[:top]), any(s[4] for s in stack[top:]), headline,
                [0, *(s[3] for s in stack if s[0] in HOLDER and s[0] not in ("html", "body"))], stack[top][3] if marks else 0,
            ))
        linked = 0

    def close_link() -> None:
        nonlocal at
        if at is not None and len(stack) < at:
            at = None

    while position < size:
        found = TAG.search(page, position)
        stop = found.start() if found else size
        if stop > position:
            piece = html.unescape(page[position:stop])
            parts.append(piece)
            if at is not None:
                linked += len(piece.strip())
        if not found:
            break
        position = found.end()
        name = (found[2] or "").lower()
        if not name:
            continue
        if found[1]:
            if name in BLOCK:
                close_line()
            if name == "a":
                at = None
            elif any(s[0] == name for s in stack):
                while stack.pop()[0] != name:
                    pass
                close_link()
            continue
        if name in RAW:
            end = re.compile(rf"</{name}\b[^>]*(?:>|$)", re.I).search(page, position)
            position = end.end() if end else size
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name in BLOCK:
            close_line()
            if name in ("p", "li", "dt", "dd", "td", "th", "tr", "option") and stack and stack[-1][0] == name:
                stack.pop()
            elif stack and stack[-1][0] == "p":
                stack.pop()
            close_link()
        if name == "a":
            at = len(stack) if "href" in _attributes(found[3]) else None
        elif name in BLOCK and name not in VOID and not found[3].endswith("/"):
            stack.append((name, _outside(name, found[3]), name in MARK, position, _loose(name, found[3])))
    close_line()
    return lines


def _lists_in_text(counted: np.ndarray, holders: list[list[int]]) -> np.ndarray:
    """Lengths with lines of links counted where the text before and after shares a holder with them, else zero."""
    out, at = np.maximum(counted, 0), np.flatnonzero(counted > 0)
    for before, after in zip(at[:-1], at[1:]):
        holder = holders[before][-1]
        if holder == holders[after][-1]:
            for i in range(before + 1, after):
                if counted[i] < 0 and holder in holders[i]:
                    out[i] = -counted[i]
    return out


def counted_lengths(lines: list[Line]) -> np.ndarray:
    """Length of every line that can belong to the main text, zero for others."""
    counted = np.array([line.counted for line in lines], np.int64)
    inside, wrapped, loose = (np.array([getattr(line, name) for line in lines], bool) for name in ("inside", "wrapped", "loose"))
    own = counted[inside & ~wrapped].sum()
    if own and own >= counted[wrapped].sum():
        counted = np.where(wrapped, 0, counted)
    if own:
        counted = np.where(inside, counted, 0)
    if np.maximum(counted[loose], 0).sum() < np.maximum(counted[~loose], 0).sum():
        counted = np.where(loose, 0, counted)
    return _lists_in_text(counted, [line.holders for line in lines])


def surges(strength: np.ndarray) -> tuple[list[tuple[int, int]], float]:
    """(first and last line of every run, the least strength of a line that surges)."""
    n = len(strength)
    sums = np.convolve(strength, np.ones(WINDOW, np.int64))[WINDOW - 1 :]  # of the window that begins at each line
    ranked = np.sort(sums)
    middle = ranked[np.searchsorted(np.cumsum(ranked), ranked.sum() / 2)]
    threshold = min(SURGE * middle, ENOUGH)
    strong = np.zeros(n + 1, bool)
    for at in np.flatnonzero(sums >= threshold):
        strong[at : min(at + WINDOW, n)] = True
    runs, least = [], threshold / WINDOW
    edges = np.flatnonzero(np.diff(strong.astype(np.int8), prepend=0))
    for start, stop in zip(edges[::2], edges[1::2]):
        peaks = start + np.flatnonzero(strength[start:stop] >= least)
        if len(peaks):
            runs.append((int(peaks[0]), int(peaks[-1])))
    return runs, least


def main_text(page: str) -> str:
    lines = lines_of(page)
    counted = counted_lengths(lines) if lines else np.zeros(0, np.int64)
    if not counted.any():
        return ""
    strength = np.where(counted > 0, counted - np.array([0 if line.inside else line.linked for line in lines]), 0)
    if not strength.any():
        strength = counted
    runs, least = surges(strength)
    kept = np.zeros(len(lines), bool)
    homes: set[int] = set()
    for first, last in runs:
        heads = [i for i in range(max(0, first - WINDOW), first) if lines[i].headline and counted[i]]
        kept[heads[0] if heads else first : last + 1] = True
        homes |= {lines[i].mark or lines[i].holders[-1] for i in range(first, last + 1) if strength[i] >= least}
    for i, line in enumerate(lines):
        # A line directly in the body shares it with others there; containers in the body are apart.
        around = [line.mark] if line.mark else [h for h in line.holders if h] or [0]
        kept[i] |= not homes.isdisjoint(around)
    return "\n".join(line.text for line, stays, length in zip(lines, kept, counted) if stays and length)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = pa.array([main_text(page) if page else "" for page in batch.column("__html").to_pylist()], pa.string())
        yield batch.drop_columns(["__html"]).append_column("main_text", texts)


def extract(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """-> `keep` columns and main_text string."""
    carried = pages.select(*keep, F.col(html_col).alias("__html"))
    schema = T.StructType([f for f in carried.schema if f.name != "__html"] + [T.StructField("main_text", T.StringType())])
    return carried.mapInArrow(_extract, schema)
