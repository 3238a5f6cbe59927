"""Page column functions over raw markup.

Comments, scripts and style sheets are matched by one alternation, leftmost first,
so a tag quoted inside a script or a comment is never counted.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from lurelake.functions import urls as U
from lurelake.functions.arrays import in_list, py_round

OPAQUE = (
    r"(?is)<!--.*?-->|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>"
)
LINE_BREAKS = "\r\n|[\n\x0b\x0c\r\x1c\x1d\x1e\x85\u2028\u2029]"
HREF = r"(?is)<a\s(?:[^>]*?[\s\"'])?href\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)"


def opaque_blocks(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(OPAQUE), F.lit(0))


def markup_only(html: Column) -> Column:
    return F.regexp_replace(html, OPAQUE, "")


def lines(html: Column) -> Column:
    parts = F.split(html, LINE_BREAKS)
    dangling = F.element_at(parts, -1) == ""
    return F.when(html == "", F.array().cast("array<string>")).when(
        dangling, F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    ).otherwise(parts)


def script_count(blocks: Column) -> Column:
    """Scripts with a source plus inline scripts with a body."""
    def counts(b):
        sourced = F.regexp_extract(b, r"(?is)^<script\b([^>]*)>", 1).rlike(
            r"(?i)\bsrc\s*=\s*[\"']?[^\s\"'>]"
        )
        body = F.regexp_extract(b, r"(?is)^<script\b[^>]*>(.*?)</script", 1)
        return b.rlike(r"(?i)^<script") & (sourced | (body != ""))

    return F.size(F.filter(blocks, counts))


def hrefs(markup: Column) -> Column:
    found = F.regexp_extract_all(markup, F.lit(HREF), F.lit(1))
    return F.transform(found, lambda h: F.trim(F.regexp_replace(h, "^[\"']|[\"']$", "")))


def external_refs(links: Column, page_host: Column) -> Column:
    def outside(h):
        target = U.host(h)
        return h.startswith("http") & (target != "") & (target != page_host)

    return F.size(F.filter(links, outside))


def self_refs(links: Column, page_host: Column) -> Column:
    def inside(h):
        return F.when(h.startswith("http"), U.host(h) == page_host).otherwise(
            ~h.rlike("^(mailto:|tel:|#|javascript:)")
        )

    return F.size(F.filter(links, inside))


def has_social(links: Column, social) -> Column:
    def social_link(h):
        return h.startswith("http") & in_list(F.regexp_replace(U.host(h), r"^www\.", ""), social)

    return F.exists(links, social_link).cast("int")


def has_description(markup: Column) -> Column:
    tags = F.regexp_extract_all(markup, F.lit(r"(?is)<meta\s[^>]*>"), F.lit(0))
    named = F.filter(tags, lambda t: t.rlike(r"(?i)[\s\"']name\s*=\s*[\"']?description[\"'\s/>]"))
    first = F.try_element_at(named, F.lit(1))
    quoted = F.regexp_extract(first, r"(?is)[\s\"']content\s*=\s*(?:\"([^\"]*)\"|'([^']*)')", 0)
    bare = F.regexp_extract(first, r"(?is)[\s\"']content\s*=\s*([^\s\"'>]+)", 1)
    value = F.regexp_replace(quoted, r"(?is)^[\s\"']content\s*=\s*[\"']|[\"']$", "")
    return F.coalesce((F.trim(F.concat(value, bare)) != "").cast("int"), F.lit(0))


def plain_entities(text: Column) -> Column:
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"),
                       ("&nbsp;", "\u00a0"), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


def title(markup: Column) -> Column:
    raw = F.regexp_extract(markup, r"(?is)<title[^>]*>(.*?)</title", 1)
    return F.lower(F.trim(plain_entities(raw)))


def host_stem(page_host: Column) -> Column:
    bare = F.regexp_replace(page_host, r"^www\.", "")
    return F.when(bare.contains("."), F.regexp_replace(bare, r"\.[^.]*$", "")).otherwise(bare)


def shared_run(needle: Column, hay: Column) -> Column:
    """Length of the longest common substring.

    Scanning end positions left to right, the best length can grow by at most one
    per position, so one containment test per character is enough.
    """
    def step(best, j):
        longer = needle.substr(j - best, best + 1)
        return F.when(hay.contains(longer), best + 1).otherwise(best)

    return F.aggregate(F.sequence(F.lit(1), F.length(needle)), F.lit(0), step)


def title_match_score(page_host: Column, title_col: Column) -> Column:
    stem = host_stem(page_host)
    run = shared_run(stem, title_col)
    return F.when((stem == "") | (title_col == ""), F.lit(0.0)).otherwise(
        py_round(run / F.length(stem) * 100, 6)
    )


def stylesheet_count(blocks: Column, markup: Column) -> Column:
    styles = F.size(F.filter(blocks, lambda b: b.rlike(r"(?i)^<style")))
    links = F.regexp_extract_all(markup, F.lit(r"(?is)<link\s[^>]*>"), F.lit(0))
    sheets = F.filter(links, lambda t: t.rlike(r"(?is)[\s\"']rel\s*=\s*[\"']?[^\"'>]*\bstylesheet\b"))
    return styles + F.size(sheets)


def has_favicon(markup: Column) -> Column:
    links = F.regexp_extract_all(markup, F.lit(r"(?is)<link\s[^>]*>"), F.lit(0))
    icons = F.exists(links, lambda t: t.rlike(
        r"(?is)[\s\"']rel\s*=\s*(?:[\"'](?:[^\"'>]*\s)?icon[\s\"']|icon[\s/>])"))
    return icons.cast("int")


def visible_text(html: Column, max_chars: int | None = None) -> Column:
    """Text nodes outside script, style, noscript, iframe and head, joined by a blank."""
    hidden = (
        r"(?is)<!--.*?-->|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>"
        r"|<noscript\b[^>]*>.*?</noscript\s*>|<iframe\b[^>]*>.*?</iframe\s*>"
        r"|<head\b[^>]*>.*?</head\s*>|<!doctype[^>]*>"
    )
    nodes = F.split(F.regexp_replace(html, hidden, ""), r"<[^>]*>")
    texts = F.transform(nodes, lambda t: F.regexp_replace(
        plain_entities(t), r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    text = F.array_join(F.filter(texts, lambda t: t != ""), " ")
    return text if max_chars is None else F.left(text, F.lit(max_chars))


def page_links(html: Column, max_links: int | None = None) -> Column:
    links = F.filter(hrefs(markup_only(html)), lambda h: h.startswith("http"))
    return links if max_links is None else F.slice(links, 1, max_links)


def tag_count(markup: Column, name: str | None = None) -> Column:
    pattern = rf"(?i)<{name}[\s/>]" if name else r"<[a-zA-Z][^\s/>]*[\s/>]"
    return F.regexp_count(markup, F.lit(pattern))
