"""Brand expressions: mentions, footers, senders."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from lurelake import params as P
from lurelake.functions import text as T, urls as U
from lurelake.functions.arrays import any_contained, constant, in_list, let, text_lookup

WORD_START, WORD_END = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
JAVA_SPECIAL = r"([\\.\[\]{}()*+?^$|\-#&~])"


BRAND_ROW = ("array<struct<brand:string,compact:string,words:array<string>,"
             "official:array<string>,first_official:string>>")


def official_names(official) -> list[str]:
    return [official] if isinstance(official, str) else list(official)


def brand_table(brands: dict, suffixes=P.PUBLIC_SUFFIXES) -> Column:
    """The brand dictionary as one constant array<struct>, folded by the optimizer."""
    rows = []
    for name, official in brands.items():
        low, domains = name.lower().strip(), official_names(official)
        if low:
            rows.append({
                "brand": low, "compact": re.sub("[^a-z0-9]", "", low), "words": low.split(),
                "official": [U.registered_name(d, suffixes) for d in domains],
                "first_official": domains[0] if domains else "",
            })
    return constant(rows, BRAND_ROW)


def bounded(brand: Column) -> Column:
    """Pattern of a brand with Unicode word boundaries; the brand comes first, so what stands before it is looked
    at where the brand is, not everywhere."""
    own = F.regexp_replace(brand, JAVA_SPECIAL, r"\\$1")
    return F.concat(own, F.lit(WORD_START[:-1]), own, F.lit(")"), F.lit(WORD_END))


def mentioned(brand: Column, compact: Column, low_text: Column, compact_text: Column) -> Column:
    """Brand mentioned in a text.

    A word-boundary match of a brand with four or more letters or digits always implies
    that its compact form is contained in the compact text, so the regular expression is
    needed for shorter brands only.
    """
    return F.when(F.length(compact) >= 4, compact_text.contains(compact)).otherwise(
        low_text.contains(brand) & F.regexp_like(low_text, bounded(brand))
    )


def named_entity(brand: Column, words: Column, entities: Column) -> Column:
    """Brand equal to an entity, or all of its words among the entity's words."""
    def same(e):
        low = F.lower(F.trim(e))
        parts = F.split(low, r"\s+")
        return (low == brand) | F.forall(words, lambda w: F.array_contains(parts, w))

    return F.exists(entities, same)


def footer_context(brand: str, low_text: Column) -> Column:
    """First mention of the brand stands within 300 characters of a footer phrase."""
    own = re.escape(brand)
    pattern = own + WORD_START[:-1] + own + ")" + WORD_END

    def near(at):
        start = F.greatest(at - 300, F.lit(1))
        return F.when(at > 0, let(low_text.substr(start, at + len(brand) + 300 - start), named)).otherwise(F.lit(False))

    def named(context):
        test = F.lit(False)
        for phrase in P.FOOTER_PHRASES:
            test = test | context.rlike("(?iu)" + phrase)
        return test

    return let(F.regexp_instr(low_text, F.lit(pattern)), near)


def sms_sender_valid(sender: Column, brand_compact: Column) -> Column:
    return let(T.compact(sender), lambda s: _sender_matches(s, brand_compact))


def _sender_matches(s: Column, e: Column) -> Column:
    short = F.coalesce(text_lookup(s, P.SENDER_SHORT_NAMES) == e, F.lit(False)) | F.coalesce(
        text_lookup(e, P.SENDER_SHORT_NAMES) == s, F.lit(False))
    overlap = (F.length(s) >= 3) & ~in_list(s, P.GENERIC_SENDERS) & (
        e.contains(s) | s.contains(e))
    return (s != "") & (e != "") & ((s == e) | short | overlap)


def org_like(entity: Column) -> Column:
    return any_contained(entity, P.ORG_WORDS)
