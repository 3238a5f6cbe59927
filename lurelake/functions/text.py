"""Message text column functions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

from lurelake import params as P
from lurelake.functions import urls as U
from lurelake.functions.arrays import first_by_key, let

# --- Fixed values: patterns that decide what counts as an address, link or placeholder ---
ZERO_WIDTH = "\u200b\ufeff"
BLANKS = " \t\n\x0b\f\r\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200b))) + "\u2028\u2029\u202f\u205f\u3000"
EMAIL = r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,7}\b"
LINK_END = r"[^\s\p{Z}<>'\"\)\]]"
EXPLICIT_URL = rf"(?i)https?://{LINK_END}+|(?<!@)www\.{LINK_END}+"

# --- Fixed values: suffixes a bare domain may end in ---
BARE_SUFFIXES = (
    "com\\.vn|com|net|org|vn|edu|gov|info|biz|io|co|xyz|top|icu|click|work|support|live|site"
    "|shop|online|monster|buzz|cyou|quest"
)
MASK_SUFFIXES = (
    "com\\.vn|gov\\.vn|edu\\.vn|org\\.vn|net\\.vn|com|net|org|io|co|info|me|app|dev|xyz|site"
    "|online|vn|top|club|biz|cc|vip|shop|work|live|click|support"
)
TYPED_LINKS = (
    "FORM_REGISTRATION|SOCIAL_PROFILE|SOCIAL_GROUP|SOCIAL_MESSAGE|OFFICIAL_PORTAL"
    "|THIRD_PARTY_HOSTED_PAGE|PAYMENT_PORTAL|EVENT_REGISTRATION|DELIVERY_TRACKING"
)

# --- Fixed values: patterns built from the lists above ---
BARE_DOMAIN = (
    rf"(?i)(?<![@\p{{L}}\p{{N}}_.\-])(?:[a-zA-Z0-9\-]{{1,63}}\.)+(?:{BARE_SUFFIXES})"
    rf"(?:/{LINK_END}*)?"
)
RAW_LINK = (
    rf"(?<![@\p{{L}}\p{{N}}_.\-])(?:(?:https?://|www\.){LINK_END}+"
    rf"|(?:[a-z0-9](?:[a-z0-9\-]{{0,61}}[a-z0-9])?\.)+(?:{MASK_SUFFIXES})(?:/{LINK_END}*)?)"
    r"(?![\p{L}\p{N}_.\-])"
)
TYPED_TOKEN = rf"\[(?:{TYPED_LINKS})_LINK_\d+\]"
URL_TOKEN = r"<\|\[?\[?URL\]?\]?\|>|\[\[?URL\]?\]|<URL>|\[URL\]"
LINK_TOKEN = rf"(?i){TYPED_TOKEN}|\[LINK_\d+\]|{URL_TOKEN}|{RAW_LINK}"
#: What every link token holds one of, and what stands for a token in a text without it.
LINK_MARKS = (".", "://", "[", "<")
GAP = "\ufdd0"
ANY_PLACEHOLDER = r"(?i)\[[A-Z_]*LINK_\d+\]"


def strip_zero_width(text: Column) -> Column:
    t = F.coalesce(text, F.lit(""))
    for mark in ZERO_WIDTH:
        t = F.replace(t, F.lit(mark), F.lit(""))
    return stripped(t)


def stripped(text: Column) -> Column:
    r"""Text without white space ([\s\p{Z}]) at its ends; the pattern, which looks at every character, runs only
    where a last next-line character, which it takes for the end of a line, makes a difference."""
    return let(text, lambda t: F.when(
        t.endswith("\x85"), F.regexp_replace(t, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")).otherwise(F.btrim(t, F.lit(BLANKS))))


def pieces_with(text: Column, *marks: str) -> Column:
    """The pieces between spaces that hold one of the marks, joined by spaces.  A pattern whose matches hold a mark
    and no space, and that looks at one character around them, finds in them what it finds in the text."""
    def marked(piece):
        test = piece.contains(marks[0])
        for m in marks[1:]:
            test = test | piece.contains(m)
        return test

    return F.array_join(F.filter(F.split(text, " "), marked), " ")


@F.pandas_udf(StringType())
def _nfkc(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v))


def nfkc(text: Column) -> Column:
    """Unicode NFKC; call through ``operators.messages.nfkc_normalize``."""
    return _nfkc(text)


def sender_address(sender: Column) -> Column:
    s = F.trim(F.coalesce(sender, F.lit("")))
    angled = F.regexp_extract(s, r"<\s*([^<>\s]+@[^<>\s]+)\s*>", 1)
    token = F.regexp_extract(s, EMAIL, 0)
    return F.lower(F.when(angled != "", angled).when(token != "", token).otherwise(s))


def extract_links(text: Column) -> Column:
    """Ordered links of a text as array<struct<norm, raw>>, first spelling of each kept.

    Explicit URLs come first, then bare domains (e-mail addresses are blanked before).  Links and addresses
    hold a dot or a scheme and no space, so pieces of the text without either are not searched.
    """
    def found(t):
        explicit = F.regexp_extract_all(t, F.lit(EXPLICIT_URL), F.lit(0))
        bare = F.regexp_extract_all(F.regexp_replace(t, EMAIL, " "), F.lit(BARE_DOMAIN), F.lit(0))
        return F.concat(explicit, bare)

    held = let(U.defang_undo(pieces_with(F.coalesce(text, F.lit("")), ".", "://")), found)
    trimmed = F.transform(held, lambda u: F.trim(u, F.lit(".,;:!?)\"]}'")))
    links = F.transform(
        F.filter(trimmed, lambda u: u != ""),
        lambda u: F.struct(U.refang(u).alias("norm"), u.alias("raw")),
    )
    return first_by_key(links, lambda s: F.lower(s["norm"]))


def provided_links(urls: Column) -> Column:
    """A given list of URLs in the same form as ``extract_links`` gives."""
    return F.transform(
        F.filter(urls, lambda u: F.trim(u) != ""),
        lambda u: F.struct(U.refang(u).alias("norm"), u.alias("raw")),
    )


def merge_links(provided: Column, text: Column) -> Column:
    """Provided URLs then those found in the text, cleaned and deduplicated."""
    found = F.transform(extract_links(text), lambda s: s["raw"])
    everything = F.concat(F.coalesce(provided, F.array().cast("array<string>")), found)
    clean = F.filter(F.transform(everything, U.cleaned_link), lambda u: u.isNotNull())
    return first_by_key(clean, lambda u: F.lower(u))


def collapse_whitespace(text: Column) -> Column:
    t = F.replace(F.coalesce(text, F.lit("")), F.lit("\r\n"), F.lit("\n"))
    t = F.replace(F.replace(t, F.lit("\r"), F.lit("\n")), F.lit("\t"), F.lit(" "))
    t = let(t, lambda s: F.when(s.contains("  "), F.regexp_replace(s, " {2,}", " ")).otherwise(s))
    t = let(t, lambda s: F.when(s.contains("\n\n\n"), F.regexp_replace(s, "\n{3,}", "\n\n")).otherwise(s))
    return stripped(t)


def truncate_at_word(text: Column, limit: int, marker: str = "[TRUNCATED]") -> Column:
    def shortened(t):
        head = F.left(t, F.lit(limit))
        cut = F.trim(F.regexp_replace(head, " [^ ]*$", ""))
        kept = F.when(cut != "", cut).otherwise(F.trim(head))
        return F.when(F.length(t) <= limit, t).otherwise(F.concat(kept, F.lit(f" {marker}")))

    return let(text, shortened)


def prepared(text: Column, limit: int | None = None) -> Column:
    t = collapse_whitespace(text)
    return t if limit is None else truncate_at_word(t, limit)


def link_tokens(text: Column) -> Column:
    held = pieces_with(F.coalesce(text, F.lit("")), *LINK_MARKS)
    return F.regexp_extract_all(held, F.lit(LINK_TOKEN), F.lit(0))


def link_gaps(text: Column) -> Column:
    """The text between its link tokens; pieces between spaces without a mark of a token are not searched."""
    def marked(piece):
        test = piece.contains(LINK_MARKS[0])
        for m in LINK_MARKS[1:]:
            test = test | piece.contains(m)
        return F.when(test, F.regexp_replace(piece, LINK_TOKEN, GAP)).otherwise(piece)

    def gaps(t):
        quick = F.split(F.array_join(F.transform(F.split(t, " "), marked), " "), GAP)
        return F.when(t.contains(GAP), F.split(t, LINK_TOKEN)).otherwise(quick)

    return let(F.coalesce(text, F.lit("")), gaps)


def split_link_token(token: Column) -> Column:
    """(url, suffix) of one token: placeholders have no url, URLs lose end punctuation."""
    is_url = ~token.rlike(rf"(?i)^(?:{TYPED_TOKEN}|\[LINK_\d+\]|{URL_TOKEN})$")
    url = F.when(is_url, F.rtrim(token, F.lit(".,;:!?)>\"'"))).otherwise(F.lit(""))
    return let(url, lambda u: F.struct(
        u.alias("url"),
        F.when(u != "", F.substring(token, F.length(u) + 1, F.length(token))).otherwise(
            F.lit("")).alias("suffix")))


def masked_text(text: Column, tokens: Column, already: Column) -> Column:
    """Replace the tokens by numbered placeholders, counting on from ``already``."""
    pieces = link_gaps(text)

    def piece(p, i):
        token = F.get(tokens, i)
        mark = F.concat(
            F.lit("[LINK_"), (already + i + 1).cast("string"), F.lit("]"),
            split_link_token(token)["suffix"],
        )
        return F.concat(p, F.when(token.isNull(), F.lit("")).otherwise(mark))

    return F.array_join(F.transform(pieces, piece), "")


def labelled(label: str, value: Column) -> Column:
    return F.when(value != "", F.concat(F.lit(f"{label}: "), value))


def prompt(subject: Column, sender: Column, body: Column, attachment: Column,
           is_sms: Column) -> Column:
    return F.concat_ws(
        "\n",
        F.when(~is_sms, labelled("Subject", subject)),
        labelled("Sender", sender),
        labelled("Body", body),
        labelled("Attachment", attachment),
    )


def word_hits(text: Column, words) -> Column:
    alternatives = "|".join(words)
    return F.regexp_count(
        text, F.lit(rf"(?iu)(?<![\p{{L}}\p{{N}}_])(?:{alternatives})(?![\p{{L}}\p{{N}}_])")
    )


def detect_language(text: Column) -> Column:
    accents = text.rlike(f"[{P.VI_ACCENTS}{P.VI_ACCENTS.upper()}]")
    more = word_hits(text, P.VI_STOP_WORDS) > word_hits(text, P.EN_STOP_WORDS)
    return F.when(accents | more, F.lit("VI")).otherwise(F.lit("EN"))


def auth_status(headers: Column, key: str) -> Column:
    found = F.lower(F.regexp_extract(headers, rf"(?i)\b{key}\s*=\s*([a-zA-Z]+)", 1))
    return F.when(found == "", F.lit("none")).otherwise(F.coalesce(found, F.lit("none")))


def header_address(headers: Column, name: str) -> Column:
    """Address text of a mail header; the display name of From is skipped."""
    if name == "Message-ID":
        return F.regexp_extract(headers, r"(?im)^Message-ID:\s*<[^@\s]+@([^>\s]+)>", 1)
    if name == "From":
        line = F.regexp_extract(headers, r"(?im)^From:[ \t]*([^\n]*)", 1)
        return let(line, sender_address)
    return F.regexp_extract(headers, rf"(?im)^{name}:\s*<?([^>\s]+)>?", 1)


def header_domain(headers: Column, name: str, suffixes=P.PUBLIC_SUFFIXES) -> Column:
    address = header_address(headers, name)
    return F.coalesce(U.registered_domain(address, suffixes), F.lit(""))


def compact(text: Column) -> Column:
    return F.regexp_replace(F.replace(F.lower(text), F.lit(" "), F.lit("")), "[^a-z0-9]+", "")


def stable_hash(value: Column, seed: int = 42) -> Column:
    """Deterministic ordering key, equal in every partitioning of the data."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), value.cast("string")))
