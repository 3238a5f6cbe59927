"""URL column functions.

All of them are built-in expressions, so a URL table is profiled in one map-only
pass.  ``parse_url`` is not used: it keeps host case and gives NULL for hosts with
an underscore or paths with a bar.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from lurelake import params as P
from lurelake.functions.arrays import any_contained, in_list, let, literal_array


def normalize(url: Column) -> Column:
    u = F.trim(F.coalesce(url, F.lit("")))
    return (
        F.when(u == "", F.lit(""))
        .when(u.rlike("(?i)^https?://"), u)
        .otherwise(F.concat(F.lit("http://"), u))
    )


def defang_undo(text: Column) -> Column:
    t = F.replace(text, F.lit("[.]"), F.lit("."))
    t = F.replace(t, F.lit("(.)"), F.lit("."))
    t = F.replace(t, F.lit("hxxps://"), F.lit("https://"))
    return F.replace(t, F.lit("hxxp://"), F.lit("http://"))


def refang(url: Column) -> Column:
    """Undo defanging, then give the link a scheme when it has none."""
    u = defang_undo(F.trim(F.coalesce(url, F.lit(""))))
    return F.regexp_replace(u, "^(?!https?://)", "http://")


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.\-]*):", 1))


def netloc(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//([^/?#]*)", 1)


def host(url: Column) -> Column:
    """Lower-case host without credentials, port or IPv6 brackets."""
    return host_of_netloc(netloc(url))


def host_of_netloc(net: Column) -> Column:
    bare = F.regexp_replace(net, r"^.*@", "")
    return F.lower(
        F.when(bare.startswith("["), F.regexp_extract(bare, r"^\[([^\]]*)", 1))
        .otherwise(F.substring_index(bare, ":", 1))
    )


def path(url: Column) -> Column:
    raw = F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    return F.regexp_replace(raw, r";[^/]*$", "")


def query(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def path_extension(path_col: Column) -> Column:
    """Lower-case suffix of the last path segment, '' when it has none."""
    name = F.regexp_extract(F.rtrim(path_col, F.lit("/")), r"([^/]*)$", 1)
    return F.lower(F.regexp_extract(name, r"[^.](\.[^.]+)$", 1))


def without_scheme(url: Column) -> Column:
    return F.regexp_replace(
        F.regexp_replace(url, "(?i)^https?://", ""), r"(?i)^www\.", ""
    )


def is_ipv4(host_col: Column) -> Column:
    octet = r"(?:0*(?:25[0-5]|2[0-4]\d|1\d\d|\d{1,2}))"
    return host_col.rlike(r"^\d{1,3}(\.\d{1,3}){3}$") & host_col.rlike(
        rf"^{octet}(\.{octet}){{3}}$"
    )


def is_ip(host_col: Column) -> Column:
    """Strict IPv4 (no leading zeros) or an IPv6 literal."""
    octet = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
    v6 = host_col.contains(":") & host_col.rlike(
        r"^(?:(?:[0-9a-f]{1,4}:){7}[0-9a-f]{1,4}"
        r"|(?=(?:[0-9a-f:]*::[0-9a-f:]*)$)(?!.*::.*::)(?:[0-9a-f]{0,4}:){1,7}[0-9a-f]{0,4})$"
    )
    return host_col.rlike(rf"^{octet}(\.{octet}){{3}}$") | v6


def suffix_of(host_col: Column, suffixes=P.PUBLIC_SUFFIXES) -> Column:
    """Longest known public suffix of a host (up to three labels), '' when unknown."""
    out = F.lit("")
    for depth in (1, 2, 3):
        names = [s for s in suffixes if s.count(".") == depth - 1]
        if names:
            tail = F.substring_index(host_col, ".", -depth)
            out = F.when(in_list(tail, names), tail).otherwise(out)
    return out


def registered_name(domain: str, suffixes=P.PUBLIC_SUFFIXES) -> str:
    """Registered domain of a parameter value given as a plain host name."""
    labels = domain.lower().strip().split(".")
    known = set(suffixes)
    for i in range(1, len(labels)):
        if ".".join(labels[i:]) in known:
            return ".".join(labels[i - 1:])
    return ""


def registered_from(host_col: Column, suf: Column) -> Column:
    """Registered domain of a host whose public suffix is already known."""
    head = F.substring(host_col, F.lit(1), F.length(host_col) - F.length(suf) - 1)
    label = F.substring_index(head, ".", -1)
    known = (suf != "") & (F.length(host_col) > F.length(suf) + 1) & (label != "")
    return F.when(known, F.concat(label, F.lit("."), suf)).otherwise(F.lit(""))


def registered_of_host(host_col: Column, suffixes=P.PUBLIC_SUFFIXES) -> Column:
    """Registered domain: the public suffix and the label before it, else ''."""
    return let(host_col, lambda h: let(
        suffix_of(h, suffixes), lambda s: registered_from(h, s)))


def address_host(value: Column) -> Column:
    """Host part of a URL, e-mail address, display-name address or bare host."""
    v = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    v = F.replace(F.replace(v, F.lit("[.]"), F.lit(".")), F.lit("(.)"), F.lit("."))
    v = F.replace(F.replace(v, F.lit("hxxp://"), F.lit("http://")),
                  F.lit("hxxps://"), F.lit("https://"))
    v = F.substring_index(v, "@", -1)
    v = F.regexp_replace(v, r"^[a-z][a-z0-9+.\-]*://|^//", "")
    v = F.regexp_extract(v, r"^[^/?#:>\s,;\"]*", 0)
    return F.rtrim(v, F.lit("."))


def registered_domain(value: Column, suffixes=P.PUBLIC_SUFFIXES) -> Column:
    return registered_of_host(address_host(value), suffixes)


def registered_simple(host_col: Column) -> Column:
    """Last two labels, or three under com.vn; no suffix table needed."""
    labels = F.filter(F.split(F.lower(host_col), r"\."), lambda p: p != "")
    n = F.size(labels)
    vn = (n >= 3) & (F.array_join(F.slice(labels, F.greatest(n - 1, F.lit(1)), 2), ".") == "com.vn")
    keep = F.when(vn, 3).otherwise(2)
    start = F.greatest(n - keep + 1, F.lit(1))
    joined = F.array_join(F.slice(labels, start, 3), ".")
    return F.when(n == 0, F.lit("")).when(n == 1, host_col).otherwise(joined)


def tld_simple(host_col: Column) -> Column:
    labels = F.filter(F.split(F.lower(host_col), r"\."), lambda p: p != "")
    n = F.size(labels)
    last_two = F.array_join(F.slice(labels, F.greatest(n - 1, F.lit(1)), 2), ".")
    return (
        F.when((n >= 3) & (last_two == "com.vn"), F.lit("com.vn"))
        .when(n > 0, F.element_at(labels, -1))
        .otherwise(F.lit(""))
    )


def subdomain_count(host_col: Column) -> Column:
    n = F.size(F.filter(F.split(host_col, r"\."), lambda p: p != ""))
    taken = F.when(tld_simple(host_col) == "com.vn", 3).otherwise(2)
    return F.greatest(n - taken, F.lit(0))


def entropy(text: Column) -> Column:
    """Shannon entropy in bits over the characters, 0 for an empty text."""
    n = F.length(text)
    chars = F.array_distinct(F.split(text, ""))

    def term(acc, c):
        p = (n - F.length(F.replace(text, c, F.lit("")))) / n
        return acc - p * F.log2(p)

    bits = F.aggregate(F.filter(chars, lambda c: c != ""), F.lit(0.0), term)
    return F.when(n > 0, F.round(bits, 6)).otherwise(F.lit(0.0))


def query_keys(query_col: Column, keep_blank: bool = True) -> Column:
    """Distinct decoded parameter names."""
    pairs = F.filter(F.split(query_col, "&"), lambda p: p != "")
    if not keep_blank:
        pairs = F.filter(pairs, lambda p: p.rlike("=."))
    names = F.transform(pairs, lambda p: F.substring_index(p, "=", 1))
    return F.array_distinct(F.transform(names, lambda k: F.coalesce(F.try_url_decode(k), k)))


def words_contained(text: Column, words) -> Column:
    """How many of the words occur in the text (each counted once)."""
    return F.size(F.filter(literal_array(words), lambda w: text.contains(w)))


def group_host(value: Column) -> Column:
    """Host for grouping: bare IPs, credentials without scheme and trailing dots allowed."""
    def with_scheme(v):
        bare = F.concat(F.lit("http://"), F.regexp_replace(v, r"^[^@]*@", ""))
        return F.when(v.contains("://"), v).otherwise(bare)

    url = let(F.rtrim(F.trim(value), F.lit(".")), with_scheme)
    return F.nullif(F.rtrim(let(netloc(url), host_of_netloc), F.lit(".")), F.lit(""))


def group_key(h: Column, reg: Column, shared_hosts=P.SHARED_HOSTS) -> Column:
    """Split key of a host: IPs and shared-hosting hosts as they are, else the registered
    domain, else the host itself."""
    own_host = is_ip(h) | (reg == "") | (in_list(reg, shared_hosts) & (h != reg))
    return F.when(own_host, h).otherwise(reg)


def group_key_basic(h: Column, suf: Column, reg: Column) -> Column:
    """Registered domain, else the domain label when the suffix is unknown, else NULL."""
    label = F.when(is_ipv4(h), h).otherwise(F.substring_index(h, ".", -1))
    return F.when(reg != "", reg).when((suf == "") & (label != ""), label)


def basic_host(value: Column) -> Column:
    v = F.trim(value)
    return address_host(
        F.when(v.contains("://") | v.contains("@"), v).otherwise(F.concat(F.lit("http://"), v))
    )


CLEAN_REJECT = r"(?i)(\[URL\]|<URL>|example\.com|placeholder|localhost|127\.0\.0\.\d)"


def cleaned_link(url: Column) -> Column:
    """Link without trailing punctuation, or NULL when it is no usable URL."""
    bare = F.rtrim(F.trim(url), F.lit(".,;:!?)>\"'"))

    def usable(u):
        ok = (F.length(u) >= 10) & u.rlike(r"(?i)^(https?://|www\.)") & ~u.rlike(CLEAN_REJECT)
        return F.when(ok, u)

    return let(bare, usable)


def content_url(url: Column) -> Column:
    """True for an http(s) page URL with a real path and no asset extension."""
    u = F.trim(url)
    p = path(u)
    return (
        scheme(u).isin("http", "https")
        & (netloc(u) != "")
        & ~p.isin("", "/")
        & ~in_list(path_extension(p), P.SKIP_EXTENSIONS)
    )


def squatting(domain: Column, official: Column) -> Column:
    """True where the domain's main label imitates the official one."""
    usable = (F.trim(domain) != "") & (F.trim(official) != "")
    imitates = let(
        F.struct(squat_main(domain).alias("d"), squat_main(official).alias("o")),
        lambda s: (s["d"] != s["o"])
        & (squat_by_affix(s["d"], s["o"]) | squat_by_distance(s["d"], s["o"])),
    )
    return usable & imitates


def squat_main(domain: Column) -> Column:
    d = F.lower(F.trim(domain))
    return F.when(d.contains("."), F.regexp_replace(d, r"\.[^.]*$", "")).otherwise(d)


def has_squat_affix(main: Column) -> Column:
    return any_contained(main, P.SQUAT_AFFIXES)


def squat_by_affix(d: Column, o: Column) -> Column:
    return has_squat_affix(d) & d.contains(o)


def squat_by_distance(d: Column, o: Column) -> Column:
    """Cheap length tests first, then shared letters, then bounded edit distance."""
    shared = F.size(F.array_intersect(F.split(d, ""), F.split(o, "")))
    shorter = F.least(F.length(d), F.length(o))
    return (
        (F.abs(F.length(d) - F.length(o)) <= 3)
        & (F.length(d) > 3)
        & (F.length(o) > 3)
        & (shared >= shorter / 2)
        & (F.levenshtein(d, o, 2) >= 0)
    )
