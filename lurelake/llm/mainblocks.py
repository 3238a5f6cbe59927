"""Main text of web pages: the distribution of text over line blocks, cut at its surge and dive points."""

from __future__ import annotations

import html as markup
import re
from collections import Counter
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from lurelake.llm.common import shipped

#: Lines of a sliding window.
WINDOW = 3
#: Characters outside links that a window needs to count as a surge, on pages that mark no article.
SURGE = 80

#: Elements that break the line; all others run on.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup "
    "option p pre search section select summary table tbody tfoot thead tr ul".split())
#: Elements that part words but not lines.
SPACES = frozenset("br td th img input".split())
VOID = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
#: Elements whose content is no markup.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Elements that never hold main text.
OUTSIDE = frozenset(
    "script style noscript template head title nav footer aside form button select textarea iframe svg canvas "
    "object dialog menu noembed noframes datalist".split())
#: Roles of such elements.
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar".split())
#: Parts of class names and ids of such elements.
LABELS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense banner banners sponsor sponsored "
    "promo promotion menu menus nav navbar navigation breadcrumb breadcrumbs header masthead footer sidebar "
    "sidebars aside notice notices cookie cookies consent gdpr popup modal newsletter subscribe login comment "
    "comments disqus replies".split())
#: Such a part before one of these tells of the page's layout, not of the element.
LAYOUT = frozenset("has no with without".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: An open element of the key ends where one of the values starts.
ENDED_BY = {"p": BLOCKS, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"},
            "th": {"td", "th", "tr"}, "option": {"option"}}
ENDING = frozenset().union(*ENDED_BY.values())

TAG = re.compile(
    r"<!--(?:.*?-->|.*\Z)|<[!?][^>]*>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^<>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+|[\"'])*+)>", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z][\w:-]*)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
MAIN_ROLE = re.compile(r"\brole\s*=\s*[\"']?main\b", re.I)
WORD = re.compile(r"[a-z0-9]+")


class Line(NamedTuple):
    text: str
    linked: int  # characters inside links
    heading: bool
    article: bool  # inside what the page marks as its article


def _labelled(name: str, attributes: str, in_article: bool) -> bool:
    """Whether role, class or id tell that an element is none of the main text."""
    if name in ("html", "body", "main"):
        return False
    for key, *values in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), "".join(values).lower()
        if key == "role" and value.strip() in ROLES:
            return True
        if key in ("class", "id"):
            for token in value.split():
                parts = WORD.findall(token)
                if not LAYOUT.isdisjoint(parts) or (in_article and "header" in parts):
                    continue
                if not LABELS.isdisjoint(parts):
                    return True
    return False


def lines_of(page: str) -> list[Line]:
    """The lines of text of a page.  Parts that hold no main text leave WINDOW empty lines."""
    lines: list[Line] = []
    parts: list[str] = []
    stack: list[tuple[str, bool, bool]] = []  # name, outside, article
    opened: Counter = Counter()
    outside = articles = links = headings = linked = 0
    heading = False

    def end_line():
        nonlocal parts, linked, heading
        text = " ".join("".join(parts).split()) if parts else ""
        if text:
            lines.append(Line(text, min(linked, len(text)), heading, articles > 0))
        parts, linked, heading = [], 0, headings > 0

    def pop():
        nonlocal outside, articles, links, headings
        name, out, article = stack.pop()
        if name in BLOCKS or out:
            end_line()
        opened[name] -= 1
        links -= name == "a"
        headings -= name in HEADINGS
        articles -= article
        if out:
            outside -= 1
            if not outside:
                lines.extend([Line("", 0, False, articles > 0)] * WINDOW)

    def add(text: str):
        nonlocal linked, heading
        if text and not outside:
            text = markup.unescape(text) if "&" in text else text
            parts.append(text)
            linked += len(text) if links else 0
            heading |= headings > 0

    at, last = 0, page.rfind(">")
    while (m := TAG.search(page, at, last + 1)) is not None:
        add(page[at:m.start()])
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<!--") and not m[0].endswith("-->"):
                at = len(page)
                break
            continue
        name = m[2].lower()
        if m[1]:
            if name in BLOCKS:
                end_line()
            elif name in SPACES:
                add(" ")
            if opened[name]:
                if name not in BLOCKS:  # an inline element does not end the blocks in it
                    k = len(stack) - 1
                    while stack[k][0] != name and stack[k][0] not in BLOCKS:
                        k -= 1
                    if stack[k][0] != name:
                        continue
                while stack[-1][0] != name:
                    pop()
                pop()
            continue
        while name in ENDING and stack and name in ENDED_BY.get(block := _open_block(stack), ()):
            while stack[-1][0] != block:
                pop()
            pop()
        if name in BLOCKS:
            end_line()
        elif name in SPACES:
            add(" ")
        if name in VOID or m[3].endswith("/") and name not in BLOCKS and name not in RAW:
            continue
        article = name in ("article", "main") or "main" in m[3] and MAIN_ROLE.search(m[3]) is not None
        reader = name == "article" and opened["article"] > 0  # an article in an article is a reader's
        out = (name in OUTSIDE or reader or name == "header" and not articles
               or bool(m[3]) and _labelled(name, m[3], articles > 0))
        if out:
            end_line()
            if not outside:
                lines.extend([Line("", 0, False, articles > 0)] * WINDOW)
            outside += 1
        stack.append((name, out, article))
        opened[name] += 1
        links += name == "a"
        headings += name in HEADINGS
        articles += article
        if name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, at)
            add(page[at:end.start()] if end else page[at:])
            at = end.start() if end else len(page)
    rest = page[at:]
    add(rest[:rest.index("<!--")] if "<!--" in rest else rest)
    while stack:
        pop()
    end_line()
    return lines


def _open_block(stack) -> str:
    """The innermost open element that a start tag may end, seen through inline elements alone."""
    for name, _, _ in reversed(stack):
        if name in BLOCKS or name in ENDED_BY:
            return name
    return ""


def surges(weights: np.ndarray, window: int, least: int) -> list[tuple[int, int]]:
    """(surge, dive): stretches of lines, end excluded, between a window that comes to hold ``least``
    characters and the next that holds none."""
    n = len(weights)
    sums = np.convolve(weights, np.ones(window, np.int64))[window - 1:]  # sums[i]: lines i to i + window - 1
    found, i = [], 0
    full, empty = np.flatnonzero(sums >= least), np.flatnonzero(sums == 0)
    while (k := np.searchsorted(full, i)) < len(full):
        surge = int(full[k])
        d = np.searchsorted(empty, surge)
        dive = int(empty[d]) if d < len(empty) else n
        found.append((surge, dive))
        i = dive
    return found


def main_text(page: str | None, window: int = WINDOW, least: int = SURGE) -> str:
    """The article of one page; see ``extract_main_text``."""
    if not page:
        return ""
    lines = lines_of(page)
    if not lines:
        return ""
    marked = any(line.article and line.text for line in lines)
    if marked:
        weights, least = np.array([len(line.text) * line.article for line in lines], np.int64), 1
    else:
        weights = np.array([len(line.text) - line.linked for line in lines], np.int64)
        least = max(1, min(least, int(np.convolve(weights, np.ones(window, np.int64)).max())))
    kept: list[str] = []
    for surge, dive in surges(weights, window, least):
        within = [k for k in range(surge, dive) if lines[k].text and lines[k].article >= marked]
        if not marked:
            within = _trimmed(lines, weights, within, surge + window, least)
        kept += [lines[k].text for k in within]
    return "\n\n".join(kept)


def _trimmed(lines, weights, within: list[int], window_end: int, least: int) -> list[int]:
    """Without the short lines that only share the surge's window: the text starts at a heading or at a
    line that holds a window's share by itself.  Lines of links alone at the end are no text."""
    start = next((k for k in within if k < window_end and (lines[k].heading or weights[k] * WINDOW >= least)), within[0])
    while within and weights[within[-1]] == 0:
        within = within[:-1]
    return [k for k in within if k >= start]


def extract_main_text(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, url, text, n_chars): the main text of every page, its blocks joined by two line feeds.

    Markup is stripped to lines; the text lengths of WINDOW lines are summed as the window slides; a surge is
    the first line whose window holds enough text, the dive the next whose window holds none; lines between
    are the text.  Elements that say of themselves that they are none of the article (menus, headers, footers,
    sidebars, notices, adverts, forms, scripts, styles, reader comments) leave a window of empty lines.  On
    pages that mark an article every text in it makes a surge; on others SURGE characters outside links do, or,
    where no window has as many, those of the fullest.

    Character references are decoded; white space inside a block, line breaks included, is one space.  Null and
    empty pages, and pages without text, give an empty text.  Unclosed elements end with what holds them, cut
    tags count as text.  Repeated rows and null keys are treated as any row; an empty table gives an empty result.
    Other columns are left out.  A page is worked on in one pass, whatever its length.
    """
    shipped(pages.sparkSession)

    def texts(column: pd.Series) -> pd.Series:
        return pd.Series([main_text(page) for page in column], dtype=object)

    found = pages.select(F.col(key), F.col(url), F.pandas_udf(texts, "string")(F.col(html)).alias("text"))
    return found.withColumn("n_chars", F.char_length("text").cast("long"))
