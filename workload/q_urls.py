"""URL, page and lexical-feature queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lurelake import params as P
from lurelake.functions import urls as U
from lurelake.operators import pages as OP, suffixes as SU, urls as OU
from workload import duck as D
from workload.bridge import cte, view
from workload.registry import query, table

HOSTS = cte("hosts")
RICH = cte("pages_rich")


def joined(col):
    return F.array_join(col, " | ")


@query("url_normalize", f"WITH {HOSTS} SELECT page_id, {D.norm('url')} AS normalized_url FROM hosts")
def url_normalize(spark, sf):
    return OU.url_normalize(view(spark, sf, "hosts")).select("page_id", "normalized_url")


@query("url_refang", f"WITH {HOSTS} SELECT page_id, {D.refang('url')} AS refanged_url FROM hosts")
def url_refang(spark, sf):
    return OU.url_refang(view(spark, sf, "hosts")).select("page_id", "refanged_url")


PARTS = f"""{HOSTS}, n AS (SELECT page_id, url, {D.norm('url')} AS u FROM hosts),
parts AS (SELECT page_id, url, u, {D.host('u')} AS host, {D.path('u')} AS path,
  {D.query('u')} AS query, {D.netloc('u')} AS netloc,
  regexp_replace(regexp_replace(u, '^https?://', '', 'i'), '^www[.]', '', 'i') AS f FROM n)"""


@query("url_parts", f"""WITH {PARTS} SELECT page_id, lower(split_part(u, ':', 1)) AS scheme, netloc,
host, path, query, lower(regexp_extract(regexp_extract(rtrim(path, '/'), '[^/]*$', 0),
'[^.]([.][^.]+)$', 1)) AS path_ext FROM parts""")
def url_parts(spark, sf):
    return OU.url_parts(view(spark, sf, "hosts")).select(
        "page_id", "scheme", "netloc", "host", "path", "query", "path_ext")


@query("registered_domain", f"""WITH {HOSTS}, {D.SUFFIXES}, h AS (
SELECT page_id, {D.address_host('url')} AS h FROM hosts)
SELECT page_id, {D.registered('h')} AS registered_domain FROM h""")
def registered_domain(spark, sf):
    return OU.registered_domain(view(spark, sf, "hosts")).select("page_id", "registered_domain")


SIMPLE = """CASE WHEN ends_with(host, '.com.vn') THEN array_to_string(string_split(host, '.')[-3:], '.')
 ELSE array_to_string(string_split(host, '.')[-2:], '.') END"""
SIMPLE_TLD = "CASE WHEN ends_with(host, '.com.vn') THEN 'com.vn' ELSE string_split(host, '.')[-1] END"
SIMPLE_SUB = """greatest(len(string_split(host, '.')) -
 CASE WHEN ends_with(host, '.com.vn') THEN 3 ELSE 2 END, 0)"""


@query("registered_domain_simple", f"""WITH {PARTS} SELECT page_id, {SIMPLE} AS registered_domain,
{SIMPLE_TLD} AS tld, {SIMPLE_SUB} AS subdomain_count FROM parts""")
def registered_domain_simple(spark, sf):
    return OU.registered_domain_simple(view(spark, sf, "hosts")).select(
        "page_id", "registered_domain", "tld", "subdomain_count")


GROUP = f"""g0 AS (SELECT page_id, url, label, rtrim(trim(url), '.') AS v FROM hosts),
g1 AS (SELECT page_id, url, label, CASE WHEN contains(v, '://') THEN v
  ELSE 'http://' || regexp_replace(v, '^[^@]*@', '') END AS v FROM g0),
g2 AS (SELECT page_id, url, label, rtrim({D.host('v')}, '.') AS h FROM g1),
g3 AS (SELECT page_id, url, label, h, {D.registered('h')} AS r FROM g2),
keyed AS (SELECT page_id, url, label, CASE WHEN h = '' THEN NULL
  WHEN regexp_matches(h, '^[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+$') AND
   list_max(list_transform(string_split(h, '.'), lambda x: CAST(x AS INT))) <= 255 THEN h
  WHEN r = '' THEN h WHEN r IN ({D.quoted(P.SHARED_HOSTS)}) AND r <> h THEN h ELSE r END
  AS group_key FROM g3)"""


@query("group_key", f"WITH {HOSTS}, {D.SUFFIXES}, {GROUP} SELECT page_id, group_key FROM keyed")
def group_key(spark, sf):
    return OU.group_key(view(spark, sf, "hosts")).select("page_id", "group_key")


@query("group_key_basic", f"""WITH {HOSTS}, {D.SUFFIXES}, h AS (SELECT page_id,
 {D.address_host("CASE WHEN contains(trim(url), '://') OR contains(trim(url), '@') THEN trim(url) ELSE 'http://' || trim(url) END")} AS h FROM hosts)
SELECT page_id, CASE WHEN r <> '' THEN r WHEN regexp_matches(h, '^[0-9.]+$') AND
 list_max(list_transform(string_split(h, '.'), lambda x: CAST(x AS INT))) <= 255 THEN h
 ELSE coalesce(nullif(string_split(h, '.')[-1], ''), 'unknown_' || page_id) END AS group_key
FROM (SELECT page_id, h, {D.registered('h')} AS r FROM h)""")
def group_key_basic(spark, sf):
    return OU.group_key_basic(view(spark, sf, "hosts"), "page_id").select("page_id", "group_key")


#: Rules as lines of a table: the parameter list, a wildcard and an exception.
SUFFIX_LINES = (*P.PUBLIC_SUFFIXES, "*.example.org", "!www.example.org", "// comment", "")
SUFFIX_TABLE = f"""lines AS (SELECT unnest({D.lst(SUFFIX_LINES)}) AS line),
rules AS (SELECT regexp_replace(line, '^(!|[*][.])', '') AS tail, CASE WHEN starts_with(line, '!') THEN -1 WHEN starts_with(line, '*.') THEN 1 ELSE 0 END AS kind
 FROM lines WHERE line <> '' AND NOT starts_with(line, '//')),
hosted AS (SELECT page_id, {{host}} AS h FROM hosts),
tails AS (SELECT DISTINCT h, unnest(range(1, len(string_split(h, '.')) + 1)) AS pos FROM hosted WHERE h <> ''),
met AS (SELECT h, pos - kind AS start, kind FROM tails JOIN rules ON array_to_string(list_slice(string_split(h, '.'), pos, len(string_split(h, '.'))), '.') = tail WHERE pos - kind >= 1),
chosen AS (SELECT h, coalesce(min(start) FILTER (kind = -1), min(start) FILTER (kind >= 0)) AS start FROM met GROUP BY h),
known AS (SELECT DISTINCT h, CASE WHEN regexp_matches(h, '^[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+$') THEN NULL ELSE coalesce(start, len(string_split(h, '.'))) END AS start
 FROM hosted LEFT JOIN chosen USING (h)),
reg AS (SELECT h, CASE WHEN start >= 2 THEN array_to_string(list_slice(string_split(h, '.'), start - 1, len(string_split(h, '.'))), '.') ELSE '' END AS r FROM known)"""


def suffix_lines(spark):
    return spark.createDataFrame([(line,) for line in SUFFIX_LINES], "suffix string")


@query("registered_domain_table", f"""WITH {HOSTS}, {SUFFIX_TABLE.format(host=D.address_host('url'))}
SELECT page_id, coalesce(r, '') AS registered_domain FROM hosted LEFT JOIN reg USING (h)""")
def registered_domain_table(spark, sf):
    return SU.registered_domain(view(spark, sf, "hosts"), suffix_lines(spark)).select("page_id", "registered_domain")


@query("group_key_table", f"""WITH {HOSTS}, {GROUP[:GROUP.index("g3 AS")].rstrip().rstrip(",")},
{SUFFIX_TABLE.format(host="h").replace("FROM hosts)", "FROM g2)")}
SELECT page_id, CASE WHEN h = '' THEN NULL WHEN coalesce(r, '') = '' THEN h WHEN r IN ({D.quoted(P.SHARED_HOSTS)}) AND r <> h THEN h ELSE r END AS group_key
FROM hosted LEFT JOIN reg USING (h)""")
def group_key_table(spark, sf):
    return SU.group_key(view(spark, sf, "hosts"), suffix_lines(spark)).select("page_id", "group_key")


@query("url_valid_content", f"""WITH {HOSTS}, p AS (SELECT page_id, trim(url) AS url,
 {D.path('trim(url)')} AS path FROM hosts)
SELECT page_id, url FROM p WHERE regexp_matches(url, '^https?:', 'i') AND {D.netloc('url')} <> ''
AND path NOT IN ('', '/') AND lower(regexp_extract(regexp_extract(rtrim(path, '/'), '[^/]*$', 0),
'[^.]([.][^.]+)$', 1)) NOT IN ({D.quoted(P.SKIP_EXTENSIONS)})""")
def url_valid_content(spark, sf):
    return OU.url_valid_content(view(spark, sf, "hosts")).select("page_id", "url")


@query("url_domain_match", f"""WITH d AS (SELECT page_id, url,
 CASE WHEN page_id % 2 = 0 THEN 'example.com' ELSE 'example.net' END AS domain FROM pages)
SELECT page_id, url, domain FROM d WHERE lower({D.netloc('url')}) = domain
 OR ends_with(lower({D.netloc('url')}), '.' || domain)""")
def url_domain_match(spark, sf):
    df = table(spark, sf, "pages").select("page_id", "url", F.when(
        F.col("page_id") % 2 == 0, "example.com").otherwise("example.net").alias("domain"))
    return OU.url_domain_match(df, "domain")


URL_LISTS = """lists AS (SELECT conv_id, list(url ORDER BY turn, url) AS urls FROM (
 SELECT c.conv_id, c.turn, CASE c.turn % 4 WHEN 0 THEN replace(p.url, 'example', 'Sample') || '.,)'
 WHEN 1 THEN upper(replace(p.url, 'example', 'sample')) WHEN 2 THEN p.url ELSE 'http://a.b' END AS url
 FROM conversations c JOIN pages p ON p.page_id = (c.conv_id * 3 + c.turn // 2) % (SELECT count(*) FROM pages)) GROUP BY conv_id)"""
CLEAN = """cleaned AS (SELECT conv_id, i, u FROM (SELECT conv_id, i,
  rtrim(trim(urls[i]), '.,;:!?)>"''') AS u FROM (SELECT *, unnest(range(1, len(urls) + 1)) AS i FROM lists))
  WHERE length(u) >= 10 AND regexp_matches(u, '^(https?://|www[.])', 'i') AND NOT regexp_matches(u,
  '(\\[URL\\]|<URL>|example\\.com|placeholder|localhost|127\\.0\\.0\\.\\d)', 'i')
  QUALIFY row_number() OVER (PARTITION BY conv_id, lower(u) ORDER BY i) = 1)"""


def url_lists(spark, sf):
    c, p = table(spark, sf, "conversations"), table(spark, sf, "pages")
    slot = F.expr(f"(conv_id * 3 + turn div 2) % {p.count()}")
    u = F.expr("""CASE turn % 4 WHEN 0 THEN replace(url, 'example', 'Sample') || '.,)'
      WHEN 1 THEN upper(replace(url, 'example', 'sample')) WHEN 2 THEN url ELSE 'http://a.b' END""")
    both = c.join(p, p["page_id"] == slot).select("conv_id", "turn", u.alias("url"))
    return both.groupBy("conv_id").agg(F.array_sort(
        F.collect_list(F.struct("turn", "url"))).alias("s")).select(
            "conv_id", F.col("s.url").alias("urls"))


@query("url_clean_batch", f"""WITH {URL_LISTS}, {CLEAN}
SELECT conv_id, string_agg(u, ' | ' ORDER BY i) AS clean_urls FROM cleaned GROUP BY conv_id""")
def url_clean_batch(spark, sf):
    df = OU.url_clean_batch(url_lists(spark, sf)).where(F.size("clean_urls") > 0)
    return df.select("conv_id", joined(F.col("clean_urls")).alias("clean_urls"))


@query("url_has_path_stats", f"""WITH {HOSTS} SELECT label, count(*) AS rows,
 count(*) FILTER ({D.path('url')} NOT IN ('', '/')) AS with_path,
 round_even(count(*) FILTER ({D.path('url')} NOT IN ('', '/')) / count(*), 6) AS ratio
FROM hosts GROUP BY label""")
def url_has_path_stats(spark, sf):
    return OU.url_has_path_stats(view(spark, sf, "hosts"))


@query("autolink_filter", """WITH d AS (SELECT page_id, ['http://' || h || '/', url, 'ftp://x.org/a', 'https://' || h || '/?q=1'] AS links,
 CASE WHEN page_id % 2 = 0 THEN 'mail me @' || h ELSE 'see ://' || h || ' or @' || h END AS body
 FROM (SELECT page_id, url, regexp_extract(url, '//([^/]*)', 1) AS h FROM pages))
SELECT page_id, array_to_string(list_filter(links, lambda l: starts_with(l, 'http') AND NOT (
 regexp_matches(l, '^https?://[^/?#]*/?(#.*)?$') AND contains(body, '@' || regexp_extract(l, '//([^/]*)', 1))
 AND NOT contains(body, '://' || regexp_extract(l, '//([^/]*)', 1)))), ' | ') AS links FROM d""")
def autolink_filter(spark, sf):
    h = F.regexp_extract("url", "//([^/]*)", 1)
    df = table(spark, sf, "pages").select(
        "page_id",
        F.array(F.concat(F.lit("http://"), h, F.lit("/")), F.col("url"), F.lit("ftp://x.org/a"),
                F.concat(F.lit("https://"), h, F.lit("/?q=1"))).alias("links"),
        F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("mail me @"), h)).otherwise(
            F.concat(F.lit("see ://"), h, F.lit(" or @"), h)).alias("body"))
    return OU.autolink_filter(df).select("page_id", joined(F.col("links")).alias("links"))


@query("numeric_coerce", """SELECT event_id, coalesce(TRY_CAST(CASE WHEN event_id % 7 = 0
 THEN 'n/a' ELSE CAST(value AS VARCHAR) END AS DOUBLE), -1) AS feature FROM events""")
def numeric_coerce(spark, sf):
    df = table(spark, sf, "events").select("event_id", F.when(
        F.col("event_id") % 7 == 0, "n/a").otherwise(F.col("value").cast("string")).alias("feature"))
    return OU.numeric_coerce(df, ["feature"]).na.fill({"feature": -1.0})


def lexical(spark, sf, variant="current"):
    return OU.url_lexical_features(view(spark, sf, "hosts"), variant=variant)


LEX = {
    "IsHTTPS": "CAST(starts_with(lower(u), 'https://') AS INT)",
    "LetterRatioInURL": "round_even(len(regexp_extract_all(f, '\\p{L}')) / greatest(length(f), 1), 6)",
    "NoOfSubDomain": "greatest(len(string_split(host, '.')) - 2, 0)",
    "DegitRatioInURL": "round_even(len(regexp_extract_all(f, '\\p{Nd}')) / greatest(length(f), 1), 6)",
    "SpacialCharRatioInURL": "round_even(len(regexp_extract_all(f, '[^\\p{L}\\p{N}=?&]')) / greatest(length(f), 1), 6)",
    "DomainLength": "length(host)",
    "URLLength": "length(f)", "HostLength": "length(host)", "PathLength": "length(path)",
    "QueryLength": "length(query)",
    "PathDepth": "len(list_filter(string_split(path, '/'), lambda s: s <> ''))",
    "NumQueryParams": "len(list_distinct(list_transform(list_filter(string_split(query, '&'), lambda s: s <> ''), lambda s: url_decode(split_part(s, '=', 1)))))",
    "HasIPAddress": "CAST(regexp_matches(host, '^[0-9]{1,3}([.][0-9]{1,3}){3}$') AND list_max(list_transform(string_split(host, '.'), lambda x: coalesce(TRY_CAST(x AS INT), 999))) <= 255 AS INT)",
    "HasAtSymbol": "CAST(contains(f, '@') AS INT)",
    "HyphenCount": D.count_of("f", "-"), "DotCount": D.count_of("f", "."),
    "SlashCount": D.count_of("f", "/"), "EqualCount": D.count_of("f", "="),
    "QuestionMarkCount": D.count_of("f", "?"), "AmpersandCount": D.count_of("f", "&"),
    "PercentCount": D.count_of("f", "%"),
    "URLEntropy": D.entropy("f"), "DomainEntropy": D.entropy("host"), "PathEntropy": D.entropy("path"),
    "SuspiciousKeywordCount": D.contains_count("lower(f)", P.URL_SUSPICIOUS_WORDS),
    "SensitiveKeywordCount": D.contains_count("lower(f)", P.URL_SENSITIVE_WORDS),
    "BrandKeywordCount": D.contains_count("lower(f)", P.URL_BRAND_WORDS),
}
LEX_SQL = (f"WITH {PARTS} SELECT page_id, "
           + ", ".join(f'{v} AS "{k}"' for k, v in LEX.items()) + " FROM parts")


@query("url_lexical_features", LEX_SQL)
def url_lexical_features(spark, sf):
    return lexical(spark, sf).select("page_id", *P.URL_FEATURES)


GROUPS = {
    "IsHTTPS": ["IsHTTPS"],
    "DomainLength": ["DomainLength", "HostLength"],
    "NoOfSubDomain": ["NoOfSubDomain"],
    "letter_digit_ratios": ["LetterRatioInURL", "DegitRatioInURL"],
    "SpacialCharRatioInURL": ["SpacialCharRatioInURL"],
    "url_lengths": ["URLLength", "PathLength", "QueryLength"],
    "PathDepth": ["PathDepth"],
    "NumQueryParams": ["NumQueryParams"],
    "HasIPAddress": ["HasIPAddress"],
    "char_counts": ["HasAtSymbol", "HyphenCount", "DotCount", "SlashCount", "EqualCount",
                    "QuestionMarkCount", "AmpersandCount", "PercentCount"],
    "url_entropies": ["URLEntropy", "DomainEntropy", "PathEntropy"],
    "keyword_counts": ["SuspiciousKeywordCount", "SensitiveKeywordCount", "BrandKeywordCount"],
}


def _lexical_group(name, columns):
    sql = (f"WITH {PARTS} SELECT page_id, "
           + ", ".join(f'{LEX[c]} AS "{c}"' for c in columns) + " FROM parts")

    @query(name, sql)
    def run(spark, sf):
        return lexical(spark, sf).select("page_id", *columns)


for _name, _columns in GROUPS.items():
    _lexical_group(_name, _columns)


@query("url_extra_features", f"""WITH {HOSTS} SELECT page_id,
 len(regexp_extract_all(url, '\\p{{Nd}}')) + len(regexp_extract_all(url, '[^a-zA-Z0-9./:]')) AS "URLComplexity",
 round_even(len(regexp_extract_all(regexp_replace(regexp_replace(url, '^https?://', ''), '^www[.]', ''), '\\p{{L}}')) / length(url), 6) AS "URLLetterRatio",
 CAST({D.path('url')} NOT IN ('', '/') AS INT) AS "HavingPath",
 CAST(contains(url, '#') AS INT) AS "HavingAnchor",
 CAST(regexp_matches(url, '^https:', 'i') AS INT) AS "HasSSL" FROM hosts""")
def url_extra_features(spark, sf):
    return OU.url_extra_features(view(spark, sf, "hosts")).select(
        "page_id", "URLComplexity", "URLLetterRatio", "HavingPath", "HavingAnchor", "HasSSL")


def _legacy(cls):
    s = "left(replace(replace(replace(url, 'https://', ''), 'http://', ''), 'www.', ''), -1)"
    return f"round_even(len(regexp_extract_all({s}, '{cls}')) / greatest(length(url) - 1, 1), 3)"


@query("ratios_legacy", f"""WITH {HOSTS} SELECT page_id, {_legacy('[' + chr(92) + 'p{L}]')} AS "LetterRatioInURL",
 {_legacy('[' + chr(92) + 'p{Nd}]')} AS "DegitRatioInURL",
 {_legacy('[^' + chr(92) + 'p{L}' + chr(92) + 'p{N}=?&]')} AS "SpacialCharRatioInURL" FROM hosts""")
def ratios_legacy(spark, sf):
    return OU.ratios_legacy(view(spark, sf, "hosts")).select(
        "page_id", "LetterRatioInURL", "DegitRatioInURL", "SpacialCharRatioInURL")


SEL = ", ".join(f'{LEX[c]} AS "{c}"' for c in P.URL_MODEL_FEATURES)


@query("select_features", f"WITH {PARTS} SELECT page_id, {SEL} FROM parts")
def select_features(spark, sf):
    return OU.select_features(lexical(spark, sf), P.URL_MODEL_FEATURES, keep=("page_id",))


@query("drop_columns", "SELECT page_id, url FROM pages")
def drop_columns(spark, sf):
    return OU.drop_columns(table(spark, sf, "pages"), ["html", "Title", "TLD"])


@query("discover_url_column", f"WITH {HOSTS} SELECT page_id, 'url' AS url_column, url AS value FROM hosts")
def discover_url_column(spark, sf):
    df = view(spark, sf, "hosts")
    found = OU.discover_url_column(df)
    return df.select("page_id", F.lit(found).alias("url_column"), F.col(found).alias("value"))


@query("limit_rows", "SELECT page_id, url FROM pages ORDER BY page_id LIMIT 100")
def limit_rows(spark, sf):
    return OU.limit_rows(table(spark, sf, "pages").select("page_id", "url"), "page_id", 100)


# ---- pages ----

OPAQUE = "(?is)<!--.*?-->|<script\\b[^>]*>.*?</script\\s*>|<style\\b[^>]*>.*?</style\\s*>"
HREF = "(?is)<a\\s(?:[^>]*?[\\s\"''])?href\\s*=\\s*(\"[^\"]*\"|''[^'']*''|[^\\s\"''>]+)"
HTML_CTE = f"""{RICH}, h0 AS (SELECT page_id, label, html, status_code, content_type, {D.host(D.norm('url'))} AS host,
 regexp_extract_all(html, '{OPAQUE}') AS blocks, regexp_replace(html, '{OPAQUE}', '', 'g') AS markup FROM pages_rich),
h1 AS (SELECT *, list_transform(regexp_extract_all(markup, '{HREF}', 1), lambda h: trim(trim(h, '"'''))) AS links,
 lower(trim(replace(regexp_extract(markup, '(?is)<title[^>]*>(.*?)</title', 1), '&amp;', '&'))) AS title,
 regexp_replace(regexp_replace(host, '^www[.]', ''), '[.][^.]*$', '') AS stem,
 regexp_split_to_array(html, '\\r\\n|[\\n\\x0b\\x0c\\r\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]') AS raw_lines FROM h0),
h2 AS (SELECT *, list_transform(links, lambda l: {D.host('l')}) AS hosts,
 CASE WHEN raw_lines[-1] = '' THEN raw_lines[:-2] ELSE raw_lines END AS ln FROM h1)"""
HTML = {
    "NoOfExternalRef": "len(list_filter(links, lambda l: starts_with(l, 'http') AND " + D.host("l") + " NOT IN ('', host)))",
    "NoOfSelfRef": "len(list_filter(links, lambda l: CASE WHEN starts_with(l, 'http') THEN " + D.host("l") + " = host ELSE NOT regexp_matches(l, '^(mailto:|tel:|#|javascript:)') END))",
    "LineOfCode": "len(ln)",
    "NoOfImage": "len(regexp_extract_all(markup, '(?i)<img[\\s/>]'))",
    "LargestLineLength": "list_max(list_transform(ln, lambda x: length(x)))",
    "HasDescription": "CAST(regexp_matches(markup, '(?i)<meta name=\"description\" content=\"\\s*[^\\s\"]') AS INT)",
    "HasSocialNet": f"CAST(len(list_filter(links, lambda l: starts_with(l, 'http') AND regexp_replace({D.host('l')}, '^www[.]', '') IN ({D.quoted(P.SOCIAL_DOMAINS)}))) > 0 AS INT)",
    "NoOfJS": "len(list_filter(blocks, lambda b: starts_with(lower(b), '<script') AND (regexp_matches(b, '(?i)^<script[^>]*\\bsrc=') OR NOT regexp_matches(b, '(?is)^<script[^>]*></script'))))",
    "URLTitleMatchScore": """CASE WHEN stem = '' OR title = '' THEN 0.0 ELSE round_even(coalesce(list_max(flatten(
      list_transform(range(1, length(stem) + 1), lambda i: list_transform(range(1, length(stem) - i + 2),
      lambda n: CASE WHEN contains(title, substr(stem, i, n)) THEN n ELSE 0 END)))), 0) / length(stem) * 100, 6) END""",
    "CntFilesCSS": "len(list_filter(blocks, lambda b: starts_with(lower(b), '<style'))) + len(regexp_extract_all(markup, '(?i)<link rel=\"stylesheet\"'))",
    "HasFavicon": "CAST(regexp_matches(markup, '(?i)<link rel=\"icon\"') AS INT)",
}


def _html_sql(columns):
    return (f"WITH {HTML_CTE} SELECT page_id, "
            + ", ".join(f'CASE WHEN html IS NOT NULL THEN {HTML[c]} END AS "{c}"' for c in columns)
            + " FROM h2")


def html(spark, sf):
    return OP.html_features(view(spark, sf, "pages_rich"))


ALL_HTML = P.HTML_MODEL_FEATURES + ("CntFilesCSS", "HasFavicon")


@query("html_features", _html_sql(ALL_HTML))
def html_features(spark, sf):
    return html(spark, sf).select("page_id", *ALL_HTML)


HTML_GROUPS = {
    "LineOfCode": ["LineOfCode", "LargestLineLength"],
    "NoOfImage": ["NoOfImage"], "NoOfJS": ["NoOfJS"],
    "NoOfExternalRef": ["NoOfExternalRef"], "NoOfSelfRef": ["NoOfSelfRef"],
    "HasDescription": ["HasDescription"], "HasSocialNet": ["HasSocialNet"],
    "URLTitleMatchScore": ["URLTitleMatchScore"], "CntFilesCSS": ["CntFilesCSS"],
    "HasFavicon": ["HasFavicon"],
}


def _html_group(name, columns):
    @query(name, _html_sql(columns))
    def run(spark, sf):
        return html(spark, sf).select("page_id", *columns)


for _name, _columns in HTML_GROUPS.items():
    _html_group(_name, _columns)

USABLE = f"""{HTML_CTE}, us AS (SELECT page_id, label, status_code, html, strlen(html) AS size,
 lower(content_type) AS ct, len(regexp_extract_all(markup, '<[a-zA-Z][^\\s/>]*[\\s/>]'))
 + len(list_filter(blocks, lambda b: NOT starts_with(b, '<!--'))) AS tags,
 len(regexp_extract_all(markup, '(?i)<img[\\s/>]')) > 0 AS img, len(regexp_extract_all(markup, '(?i)<a[\\s/>]')) > 0 AS a,
 len(list_filter(blocks, lambda b: starts_with(lower(b), '<script'))) > 0 AS js,
 {D.any_of('lower(html)', P.BLOCKED_PHRASES)} AS blocked FROM h0),
checked AS (SELECT *, CASE WHEN html IS NULL THEN 'timeout'
 WHEN status_code IN (502,503,504,521,522,523,524,530) THEN 'server_error_' || status_code
 WHEN NOT contains(ct, 'text/html') AND NOT contains(ct, 'text/plain') THEN 'content_type: ' || ct
 WHEN size < 500 THEN 'body_too_small: ' || size || ' bytes' WHEN blocked THEN 'bot_blocked'
 WHEN tags < 5 THEN 'too_few_tags: ' || tags ELSE 'ok' END AS reason FROM us),
status AS (SELECT *, CASE WHEN reason = 'timeout' OR starts_with(reason, 'server') THEN 'dead'
 WHEN reason = 'ok' THEN 'valid' WHEN reason = 'bot_blocked' THEN 'blocked' ELSE 'no_html' END AS status FROM checked)"""


@query("page_usability", f"""WITH {USABLE} SELECT page_id, status, reason,
 CASE WHEN status = 'dead' OR starts_with(reason, 'content') THEN 0 ELSE size END AS html_size,
 CASE WHEN status = 'valid' THEN tags ELSE 0 END AS num_tags,
 CAST(status = 'valid' AND img AS INT) AS has_images, CAST(status = 'valid' AND a AS INT) AS has_links,
 CAST(status = 'valid' AND js AS INT) AS has_scripts FROM status""")
def page_usability(spark, sf):
    return OP.page_usability(view(spark, sf, "pages_rich")).select(
        "page_id", "status", "reason", "html_size", "num_tags", "has_images", "has_links",
        "has_scripts")


@query("usability_report", f"""WITH {USABLE}, r AS (
SELECT 'status' AS section, status AS item, count(*) AS n FROM status GROUP BY status
UNION ALL (SELECT 'reason', reason, count(*) AS n FROM status WHERE status <> 'valid' GROUP BY reason ORDER BY n DESC, reason LIMIT 10)
UNION ALL SELECT 'label', label || ':' || CASE WHEN status = 'valid' THEN 'accessible' ELSE 'inaccessible' END, count(*) FROM status GROUP BY 2
UNION ALL (SELECT 'code', CAST(status_code AS VARCHAR), count(*) AS n FROM status WHERE status <> 'valid' GROUP BY status_code ORDER BY n DESC, 2 LIMIT 10))
SELECT * FROM r""")
def usability_report(spark, sf):
    return OP.usability_report(OP.page_usability(view(spark, sf, "pages_rich")))


HIDDEN = (OPAQUE + "|<noscript\\b[^>]*>.*?</noscript\\s*>|<iframe\\b[^>]*>.*?</iframe\\s*>"
          "|<head\\b[^>]*>.*?</head\\s*>|<!doctype[^>]*>")


@query("visible_text", f"""WITH {RICH} SELECT page_id, array_to_string(list_filter(list_transform(
 regexp_split_to_array(regexp_replace(html, '{HIDDEN}', '', 'g'), '<[^>]*>'), lambda t: trim(replace(replace(replace(
 replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', chr(160)), '&amp;', '&'),
 chr(160) || ' ' || chr(9) || chr(10) || chr(13))), lambda t: t <> ''), ' ') AS visible_text FROM pages_rich""")
def visible_text(spark, sf):
    return OP.visible_text(view(spark, sf, "pages_rich")).select("page_id", "visible_text")


@query("page_links", f"""WITH {HTML_CTE} SELECT page_id, array_to_string(list_filter(links,
 lambda l: starts_with(l, 'http')), ' | ') AS links FROM h2""")
def page_links(spark, sf):
    return OP.page_links(view(spark, sf, "pages_rich")).select(
        "page_id", joined(F.col("links")).alias("links"))


@query("combine_features", f"""WITH {PARTS}, {HTML_CTE.replace(RICH + ',', RICH + ',', 1)}
SELECT p.page_id, p.label, {', '.join(f'u."{c}"' for c in P.URL_MODEL_FEATURES)},
 {', '.join(f'h."{c}"' for c in P.HTML_MODEL_FEATURES)},
 CASE WHEN u.page_id % 40 = 7 AND h.page_id IS NULL THEN 'URL Error: bad' ELSE
  CASE WHEN u.page_id % 40 = 7 THEN 'URL Error: bad' END END AS error
FROM pages_rich p LEFT JOIN (SELECT page_id, {SEL} FROM parts) u ON u.page_id = p.page_id
LEFT JOIN (SELECT page_id, {', '.join(f'CASE WHEN html IS NOT NULL THEN {HTML[c]} END AS "{c}"' for c in P.HTML_MODEL_FEATURES)} FROM h2) h ON h.page_id = p.page_id""")
def combine_features(spark, sf):
    lex = lexical(spark, sf).select("page_id", *P.URL_MODEL_FEATURES, F.when(
        F.col("page_id") % 40 == 7, "bad").alias("url_error"))
    page = html(spark, sf).select("page_id", *P.HTML_MODEL_FEATURES)
    return OU.combine_features(lex, page, view(spark, sf, "pages_rich").select("page_id", "label"),
                               key="page_id")


@query("complete_rows", f"""WITH {HTML_CTE} SELECT count(*) AS total_rows, count(html) AS kept_rows,
 round_even(count(html) / count(*), 6) AS retention FROM h2""")
def complete_rows(spark, sf):
    return OU.retention(html(spark, sf))


@query("url_merge_provided", f"""WITH {URL_LISTS.replace('lists AS', 'raw AS')}, lists AS (SELECT r.conv_id,
 r.urls || [rtrim(b, '.,;:!?)"]}}''')] || [regexp_replace(rtrim(b, '.,;:!?)"]}}'''), '^https?://', '')] AS urls
 FROM raw r JOIN (SELECT conv_id, 'https://w' || conv_id || '.shop-site.xyz/in' AS b FROM raw) USING (conv_id)), {CLEAN}
SELECT conv_id, string_agg(u, ' | ' ORDER BY i) AS clean_urls FROM cleaned GROUP BY conv_id""")
def url_merge_provided(spark, sf):
    df = url_lists(spark, sf).withColumn("text", F.concat(
        F.lit("go to (https://w"), F.col("conv_id").cast("string"), F.lit(".shop-site.xyz/in). bye")))
    return OU.url_merge_provided(df).select("conv_id", joined(F.col("clean_urls")).alias("clean_urls"))


__all__ = ["U"]
