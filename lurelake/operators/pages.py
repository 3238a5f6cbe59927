"""Page operators over a table of fetched pages (url, html)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lurelake import params as P
from lurelake.functions import html as H, urls as U
from lurelake.functions.arrays import any_contained


def html_features(pages: DataFrame, url_col: str = "url", html_col: str = "html",
                  social=P.SOCIAL_DOMAINS) -> DataFrame:
    """Nine page features plus stylesheet count and favicon flag; NULL html gives NULLs."""
    html, host = F.col(html_col), F.col("_host")
    blocks, markup, links, rows = (F.col(c) for c in ("_blocks", "_markup", "_links", "_lines"))
    staged = (
        pages.withColumn("_host", U.host(U.normalize(F.col(url_col))))
        .withColumn("_blocks", H.opaque_blocks(html))
        .withColumn("_markup", H.markup_only(html))
        .withColumn("_links", H.hrefs(markup))
        .withColumn("_lines", H.lines(html))
        .withColumn("_title", H.title(markup))
    )
    values = {
        "NoOfExternalRef": H.external_refs(links, host),
        "NoOfSelfRef": H.self_refs(links, host),
        "LineOfCode": F.size(rows),
        "NoOfImage": H.tag_count(markup, "img"),
        "LargestLineLength": F.coalesce(
            F.array_max(F.transform(rows, lambda x: F.length(x))), F.lit(0)),
        "HasDescription": H.has_description(markup),
        "HasSocialNet": H.has_social(links, social),
        "NoOfJS": H.script_count(blocks),
        "URLTitleMatchScore": H.title_match_score(host, F.col("_title")),
        "CntFilesCSS": H.stylesheet_count(blocks, markup),
        "HasFavicon": H.has_favicon(markup),
    }
    fetched = html.isNotNull()
    out = staged.withColumns({k: F.when(fetched, v) for k, v in values.items()})
    return out.drop("_host", "_blocks", "_markup", "_links", "_lines", "_title")


def page_usability(pages: DataFrame, html_col: str = "html", status_col: str = "status_code",
                   type_col: str = "content_type", max_bytes: int | None = None) -> DataFrame:
    """Status valid/blocked/no_html/dead with the reason, from response and body.

    ``max_bytes`` bounds the reported size, for bodies that a crawl cuts there.
    """
    html, code = F.col(html_col), F.col(status_col)
    ctype = F.lower(F.coalesce(F.col(type_col), F.lit("")))
    size = F.octet_length(html) if max_bytes is None else F.least(F.octet_length(html), F.lit(max_bytes))
    staged = (
        pages.withColumn("_size", size)
        .withColumn("_blocked", any_contained(F.lower(html), P.BLOCKED_PHRASES))
        .withColumn("_markup", H.markup_only(html))
        .withColumn("_blocks", H.opaque_blocks(html))
    )
    opaque_tags = F.size(F.filter(F.col("_blocks"), lambda b: ~b.startswith("<!--")))
    scripts = F.size(F.filter(F.col("_blocks"), lambda b: b.rlike("(?i)^<script")))
    tags = H.tag_count(F.col("_markup")) + opaque_tags
    staged = staged.withColumn("_tags", tags)
    not_html = ~ctype.contains("text/html") & ~ctype.contains("text/plain")
    small = F.col("_size") < P.MIN_BODY_BYTES
    cases = [
        (code.isNull() | html.isNull(), "dead", F.lit("timeout")),
        (code.isin(list(P.DEAD_STATUS)), "dead",
         F.concat(F.lit("server_error_"), code.cast("string"))),
        (not_html, "no_html", F.concat(F.lit("content_type: "), ctype)),
        (small, "no_html",
         F.concat(F.lit("body_too_small: "), F.col("_size").cast("string"), F.lit(" bytes"))),
        (F.col("_blocked"), "blocked", F.lit("bot_blocked")),
        (F.col("_tags") < 5, "no_html",
         F.concat(F.lit("too_few_tags: "), F.col("_tags").cast("string"))),
    ]
    status, reason = F.lit("valid"), F.lit("ok")
    for test, name, why in reversed(cases):
        status = F.when(test, F.lit(name)).otherwise(status)
        reason = F.when(test, why).otherwise(reason)
    staged = staged.withColumn("status", status).withColumn("reason", reason)
    valid = F.col("status") == "valid"
    return staged.withColumns({
        "html_size": F.when(
            F.col("reason").rlike("^(server_error|content_type|timeout)"), F.lit(0)
        ).otherwise(F.col("_size")),
        "num_tags": F.when(valid, F.col("_tags")).otherwise(F.lit(0)),
        "has_images": (valid & (H.tag_count(F.col("_markup"), "img") > 0)).cast("int"),
        "has_links": (valid & (H.tag_count(F.col("_markup"), "a") > 0)).cast("int"),
        "has_scripts": (valid & (scripts > 0)).cast("int"),
    }).drop("_size", "_blocked", "_markup", "_blocks", "_tags")


def visible_text(pages: DataFrame, html_col: str = "html", max_chars: int | None = None) -> DataFrame:
    return pages.withColumn("visible_text", H.visible_text(F.col(html_col), max_chars))


def page_links(pages: DataFrame, html_col: str = "html", max_links: int | None = None) -> DataFrame:
    return pages.withColumn("links", H.page_links(F.col(html_col), max_links))


def usability_report(checked: DataFrame, label_col: str = "label") -> DataFrame:
    """Status shares, ten commonest failure reasons, accessible share by label, status codes.

    One pass aggregates by all four dimensions; only that small table is split up.
    """
    total = F.sum("n")
    base = checked.groupBy(
        "status", "reason", F.col("status_code").cast("string").alias("code"),
        F.col(label_col).cast("string").alias("label"),
    ).agg(F.count(F.lit(1)).alias("n"))
    failed = base.where(F.col("status") != "valid")

    def section(df, name, key, top=None):
        out = df.groupBy(key.alias("item")).agg(total.alias("n"))
        if top:
            out = out.orderBy(F.desc("n"), F.asc("item")).limit(top)
        return out.select(F.lit(name).alias("section"), "item", "n")

    by_label = F.concat(
        F.col("label"), F.lit(":"),
        F.when(F.col("status") == "valid", F.lit("accessible")).otherwise(F.lit("inaccessible")),
    )
    return (
        section(base, "status", F.col("status"))
        .unionByName(section(failed, "reason", F.col("reason"), 10))
        .unionByName(section(base, "label", by_label))
        .unionByName(section(failed, "code", F.coalesce(F.col("code"), F.lit("none")), 10))
    )
