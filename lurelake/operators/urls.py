"""URL operators: normalisation, keys, cleaning and the lexical feature job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lurelake import params as P
from lurelake.functions import text as T, urls as U
from lurelake.functions.arrays import first_by_key, let, occurrences, py_round, round6


def url_normalize(df: DataFrame, url_col: str = "url") -> DataFrame:
    return df.withColumn("normalized_url", U.normalize(F.col(url_col)))


def url_refang(df: DataFrame, url_col: str = "url") -> DataFrame:
    return df.withColumn("refanged_url", U.refang(F.col(url_col)))


def url_parts(df: DataFrame, url_col: str = "url") -> DataFrame:
    n = "_n"
    return (
        df.withColumn(n, F.translate(U.normalize(F.col(url_col)), "\t\r\n", ""))
        .withColumn("scheme", U.scheme(F.col(n)))
        .withColumn("netloc", U.netloc(F.col(n)))
        .withColumn("host", U.host_of_netloc(F.col("netloc")))
        .withColumn("path", U.path(F.col(n)))
        .withColumn("query", U.query(F.col(n)))
        .withColumn("path_ext", U.path_extension(F.col("path")))
        .drop(n)
    )


def registered_domain(df: DataFrame, col: str = "url", suffixes=P.PUBLIC_SUFFIXES) -> DataFrame:
    return df.withColumn("registered_domain", U.registered_domain(F.col(col), suffixes))


def registered_domain_simple(df: DataFrame, col: str = "url") -> DataFrame:
    """Registered domain, suffix and subdomain count without a suffix table."""
    h = F.col("_h")
    return (
        df.withColumn("_h", U.host(U.normalize(F.col(col))))
        .withColumn("registered_domain", U.registered_simple(h))
        .withColumn("tld", U.tld_simple(h))
        .withColumn("subdomain_count", U.subdomain_count(h))
        .drop("_h")
    )


def group_key(df: DataFrame, col: str = "url", shared_hosts=P.SHARED_HOSTS,
              suffixes=P.PUBLIC_SUFFIXES) -> DataFrame:
    """Add ``group_key``.

    One expression with bound values instead of staged columns: a filter on the key that
    the optimizer pushes below the projection then copies it once, not at every use.
    """
    def key(h):
        return let(U.registered_of_host(h, suffixes), lambda r: U.group_key(h, r, shared_hosts))

    return df.withColumn("group_key", let(U.group_host(F.col(col)), key))


def group_key_basic(df: DataFrame, id_col: str, col: str = "url",
                    suffixes=P.PUBLIC_SUFFIXES) -> DataFrame:
    """Registered-domain key; rows without one get a key of their own."""
    own = F.concat(F.lit("unknown_"), F.col(id_col).cast("string"))

    def key(h):
        return let(U.suffix_of(h, suffixes), lambda s: let(
            U.registered_from(h, s), lambda r: U.group_key_basic(h, s, r)))

    found = let(U.basic_host(F.col(col)), key)
    return df.withColumn("group_key", F.coalesce(found, own))


def url_valid_content(df: DataFrame, url_col: str = "url") -> DataFrame:
    return df.where(U.content_url(F.col(url_col)))


def url_domain_match(df: DataFrame, domain_col: str, url_col: str = "url") -> DataFrame:
    net = F.lower(U.netloc(F.trim(F.col(url_col))))
    d = F.col(domain_col)
    return df.where((net == d) | F.endswith(net, F.concat(F.lit("."), d)))


def url_clean_batch(df: DataFrame, urls_col: str = "urls") -> DataFrame:
    """Clean and deduplicate the URL list of each row, order kept."""
    clean = F.filter(F.transform(F.col(urls_col), U.cleaned_link), lambda u: u.isNotNull())
    return df.withColumn("clean_urls", first_by_key(clean, lambda u: F.lower(u)))


def url_merge_provided(df: DataFrame, urls_col: str = "urls", text_col: str = "text") -> DataFrame:
    return df.withColumn("clean_urls", T.merge_links(F.col(urls_col), F.col(text_col)))


def url_has_path_stats(df: DataFrame, label_col: str = "label", url_col: str = "url") -> DataFrame:
    has_path = ~U.path(F.col(url_col)).isin("", "/")
    return df.groupBy(label_col).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(has_path).alias("with_path"),
        round6(F.count_if(has_path) / F.count(F.lit(1))).alias("ratio"),
    )


def autolink_filter(df: DataFrame, links_col: str = "links", body_col: str = "body",
                    max_links: int | None = None) -> DataFrame:
    """Keep http links that are not automatic links of an e-mail domain in the body."""
    body = F.col(body_col)

    def real(link):
        h = U.host(link)
        root = U.path(link).isin("", "/") & (U.query(link) == "")
        auto = root & body.contains(F.concat(F.lit("@"), h)) & ~body.contains(
            F.concat(F.lit("://"), h))
        return link.startswith("http") & ~auto

    links = F.filter(F.col(links_col), real)
    return df.withColumn("links", links if max_links is None else F.slice(links, 1, max_links))


def numeric_coerce(df: DataFrame, columns) -> DataFrame:
    return df.withColumns({c: F.expr(f"try_cast(trim(`{c}`) AS DOUBLE)") for c in columns})


def select_features(df: DataFrame, features, keep=()) -> DataFrame:
    return df.select(*keep, *features)


def drop_columns(df: DataFrame, columns) -> DataFrame:
    return df.drop(*columns)


def discover_url_column(df: DataFrame, candidates=P.URL_COLUMN_CANDIDATES) -> str | None:
    return next((c for c in candidates if c in df.columns), None)


def combine_features(url_features: DataFrame, html_features: DataFrame, labels: DataFrame,
                     key: str = "url") -> DataFrame:
    """One row per URL with both feature sets, the label and a merged error text.

    The inputs may carry ``url_error`` / ``html_error`` columns.
    """
    def with_error(df, name):
        return df if name in df.columns else df.withColumn(name, F.lit(None).cast("string"))

    joined = (
        labels.join(with_error(url_features, "url_error"), key, "left")
        .join(with_error(html_features, "html_error"), key, "left")
    )
    error = F.concat_ws(
        " | ",
        F.concat(F.lit("URL Error: "), F.col("url_error")),
        F.concat(F.lit("HTML Error: "), F.col("html_error")),
    )
    return joined.withColumn("error", F.when(error != "", error)).drop("url_error", "html_error")


def limit_rows(df: DataFrame, key: str, n: int) -> DataFrame:
    return df.orderBy(key).limit(n)


def complete_rows(df: DataFrame, features=P.HTML_MODEL_FEATURES) -> DataFrame:
    return df.dropna(how="any", subset=list(features))


def retention(df: DataFrame, features=P.HTML_MODEL_FEATURES) -> DataFrame:
    """Rows before and after keeping complete rows, in one aggregate."""
    complete = F.lit(True)
    for f in features:
        complete = complete & F.col(f).isNotNull()
    kept = F.count_if(complete)
    return df.agg(
        F.count(F.lit(1)).alias("total_rows"), kept.alias("kept_rows"),
        round6(kept / F.count(F.lit(1))).alias("retention"),
    )


def url_lexical_features(df: DataFrame, url_col: str = "url", variant: str = "current") -> DataFrame:
    """The 27 lexical columns, as one map-only projection over the URL text.

    ``variant='notebook'`` drops blank query parameters and the octet range check;
    ``variant='legacy'`` uses the older ratios (see ``ratios_legacy``).
    """
    n, f, h, p, q = (F.col(c) for c in ("_n", "_f", "_h", "_p", "_q"))
    base = (
        df.withColumn("_n", U.normalize(F.col(url_col)))
        .withColumn("_t", F.translate(F.col("_n"), "\t\r\n", ""))
        .withColumn("_f", U.without_scheme(n))
        .withColumn("_h", U.host(F.col("_t")))
        .withColumn("_p", U.path(F.col("_t")))
        .withColumn("_q", U.query(F.col("_t")))
        .withColumn("_l", F.lower(f))
    )
    size = F.greatest(F.length(f), F.lit(1))
    alnum = F.regexp_count(f, F.lit(r"[\p{L}\p{N}]"))
    plain_special = F.length(f) - alnum - sum(
        (occurrences(f, c) for c in ("=", "?", "&")), F.lit(0)
    )
    keep_blank = variant != "notebook"
    is_ip = U.is_ipv4(h) if keep_blank else h.rlike(r"^\d{1,3}(\.\d{1,3}){3}$")
    columns = {
        "IsHTTPS": F.lower(n).startswith("https://").cast("int"),
        "LetterRatioInURL": round6(F.regexp_count(f, F.lit(r"\p{L}")) / size),
        "NoOfSubDomain": F.when(h == "", F.lit(0)).otherwise(
            F.greatest(occurrences(h, ".") - 1, F.lit(0))),
        "DegitRatioInURL": round6(F.regexp_count(f, F.lit(r"\p{Nd}")) / size),
        "SpacialCharRatioInURL": round6(plain_special / size),
        "DomainLength": F.length(h),
        "URLLength": F.length(f),
        "HostLength": F.length(h),
        "PathLength": F.length(p),
        "QueryLength": F.length(q),
        "PathDepth": F.size(F.filter(F.split(p, "/"), lambda s: s != "")),
        "NumQueryParams": F.size(U.query_keys(q, keep_blank)),
        "HasIPAddress": is_ip.cast("int"),
        "HasAtSymbol": f.contains("@").cast("int"),
        "HyphenCount": occurrences(f, "-"),
        "DotCount": occurrences(f, "."),
        "SlashCount": occurrences(f, "/"),
        "EqualCount": occurrences(f, "="),
        "QuestionMarkCount": occurrences(f, "?"),
        "AmpersandCount": occurrences(f, "&"),
        "PercentCount": occurrences(f, "%"),
        "URLEntropy": U.entropy(f),
        "DomainEntropy": U.entropy(h),
        "PathEntropy": U.entropy(p),
        "SuspiciousKeywordCount": U.words_contained(F.col("_l"), P.URL_SUSPICIOUS_WORDS),
        "SensitiveKeywordCount": U.words_contained(F.col("_l"), P.URL_SENSITIVE_WORDS),
        "BrandKeywordCount": U.words_contained(F.col("_l"), P.URL_BRAND_WORDS),
    }
    out = base.withColumns(columns)
    if variant == "legacy":
        out = ratios_legacy(out, url_col)
    return out.drop("_n", "_t", "_f", "_h", "_p", "_q", "_l")


def url_extra_features(df: DataFrame, url_col: str = "url") -> DataFrame:
    """URLComplexity, URLLetterRatio, HavingPath, HavingAnchor and HasSSL of the raw URL."""
    u = F.col(url_col)
    bare = F.regexp_replace(F.regexp_replace(u, "^https?://", ""), r"^www\.", "")
    return df.withColumns({
        "URLComplexity": F.regexp_count(u, F.lit(r"\p{Nd}"))
        + F.regexp_count(u, F.lit(r"[^a-zA-Z0-9./:]")),
        "URLLetterRatio": F.when(u == "", F.lit(0.0)).otherwise(
            round6(F.regexp_count(bare, F.lit(r"\p{L}")) / F.greatest(F.length(u), F.lit(1)))),
        "HavingPath": (~U.path(u).isin("", "/")).cast("int"),
        "HavingAnchor": u.contains("#").cast("int"),
        "HasSSL": (U.scheme(u) == "https").cast("int"),
    })


def ratios_legacy(df: DataFrame, url_col: str = "url") -> DataFrame:
    """Older ratio definitions: last character dropped, denominator length-1, three digits."""
    u = F.col(url_col)
    s = F.replace(F.replace(F.replace(u, F.lit("https://"), F.lit("")),
                            F.lit("http://"), F.lit("")), F.lit("www."), F.lit(""))
    s = F.substring(s, F.lit(1), F.greatest(F.length(s) - 1, F.lit(0)))
    size = F.greatest(F.length(u) - 1, F.lit(1))
    special = F.length(s) - F.regexp_count(s, F.lit(r"[\p{L}\p{N}]")) - sum(
        (occurrences(s, c) for c in ("=", "?", "&")), F.lit(0)
    )
    return df.withColumns({
        "LetterRatioInURL": py_round(F.regexp_count(s, F.lit(r"\p{L}")) / size, 3),
        "DegitRatioInURL": py_round(F.regexp_count(s, F.lit(r"\p{Nd}")) / size, 3),
        "SpacialCharRatioInURL": py_round(special / size, 3),
    })


def resume_pending(inputs: DataFrame, done: DataFrame, key: str = "url") -> DataFrame:
    """Input rows whose key is not in the finished output (only the key is read from it)."""
    return inputs.join(done.select(key), key, "left_anti")


def latest_per_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """Row with the largest order value per key.

    An aggregate rather than a window: partial aggregation shrinks a hot key before
    the shuffle, so no task ever holds all of its rows.
    """
    best = F.max_by(F.struct(*df.columns), F.col(order)).alias("row")
    return df.groupBy(key).agg(best).select("row.*")


def first_n_per_key(df: DataFrame, key: str | Column, order, n: int) -> DataFrame:
    """First n rows per key; the rank filter is pushed below the shuffle by Spark."""
    w = W.partitionBy(key).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")
