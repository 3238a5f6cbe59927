"""Expressions over structured model answers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from lurelake import params as P
from lurelake.functions import text as T
from lurelake.functions.arrays import constant, in_list, let, py_round, weighted_lookup
from lurelake.functions.brands import JAVA_SPECIAL

ANSWER_SCHEMA = (
    "struct<label:string,signals:array<string>,evidence:array<struct<signal:string,"
    "exact_span:string,severity:string,char_start:int,char_end:int,verified:boolean>>>"
)


def unwrapped(raw: Column) -> Column:
    """Answer text without think or tool blocks and code fences."""
    t = F.regexp_replace(F.coalesce(raw, F.lit("")), "(?is)<think>.*?</think>", "")
    t = F.regexp_replace(t, "(?is)<tool_call>.*?</tool_call>", "")
    t = F.regexp_replace(t, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")
    return F.regexp_replace(F.regexp_replace(t, r"^```(?:json)?\s*", ""), r"\s*```$", "")


def first_object(text: Column) -> Column:
    """The text from its first brace to the one that closes it, else NULL; braces in JSON strings do not count.

    Escaped characters are blanked, strings are single tokens, and the depth runs over the tokens.
    """
    opened = text.substr(F.position(F.lit("{"), text), F.length(text))
    tokens = F.regexp_extract_all(F.regexp_replace(opened, r"(?s)\\.", "__"), F.lit(r'"[^"]*+"?|[{}]|[^"{}]++'), F.lit(0))
    nothing = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("at"), F.lit(0).alias("end"))

    def step(state, token):
        depth = state["depth"] + F.when(token == "{", 1).when(token == "}", -1).otherwise(0)
        at = state["at"] + F.length(token)
        closed = (state["end"] == 0) & (depth == 0)
        return F.struct(depth.alias("depth"), at.alias("at"), F.when(closed, at).otherwise(state["end"]).alias("end"))

    end = F.aggregate(tokens, nothing, step, lambda state: state["end"])
    found = let(F.struct(opened.alias("text"), end.alias("end")),
                lambda o: F.when(o["end"] > 0, F.left(o["text"], o["end"])))
    return F.when(F.position(F.lit("{"), text) > 0, found)


def label_of(value: Column) -> Column:
    v = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    return (F.when(v.isin(list(P.PHISHING_WORDS)), F.lit("phishing"))
            .when(v.isin(list(P.LEGIT_WORDS)), F.lit("legit")).otherwise(F.lit("unknown")))


def signal_of(value: Column, taxonomy=P.ANSWER_SIGNALS) -> Column:
    v = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    return F.when(in_list(v, taxonomy), v).otherwise(F.lit(""))


def severity_of(value: Column) -> Column:
    v = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    return F.when(v.isin("low", "medium", "high"), v).otherwise(F.lit("medium"))


def flexible(span: Column) -> Column:
    """Case-insensitive pattern of a span whose blanks match any white space."""
    escaped = F.regexp_replace(F.trim(span), JAVA_SPECIAL, r"\\$1")
    return F.concat(F.lit("(?isu)"), F.regexp_replace(escaped, r"\s+", r"\\s+"))


def find_span(span: Column, text: Column) -> Column:
    """struct<s, e> of the first occurrence (0-based, end exclusive), else NULL.

    Plain search first; the regular expression runs only where that fails.
    """
    def by_pattern(pattern):
        at = F.regexp_instr(text, pattern)
        return let(at, lambda q: F.when(q > 0, F.struct(
            (q - 1).alias("s"),
            (q - 1 + F.length(F.regexp_substr(text, pattern))).alias("e"))))

    def search(p):
        return F.when(p > 0, F.struct(
            (p - 1).alias("s"), (p - 1 + F.length(span)).alias("e"))).otherwise(
                F.when(span.rlike(r"\s"), let(flexible(span), by_pattern)))

    found = let(F.position(F.lower(span), F.lower(text)), search)
    return F.when((F.trim(span) != "") & (text != ""), found)


def link_like(span: Column) -> Column:
    return span.rlike("(?i)" + T.RAW_LINK) | span.rlike(T.ANY_PLACEHOLDER)


def risk_score(label: Column, evidence: Column) -> Column:
    """Base plus weighted evidence plus combinations, capped; all inside the row."""
    def add(total, e):
        factor = weighted_lookup(e["severity"], P.ANSWER_SEVERITY_FACTORS, 0.75)
        return total + weighted_lookup(e["signal"], P.ANSWER_SIGNAL_WEIGHTS, 0.05) * factor

    base = 0.50 + F.aggregate(evidence, F.lit(0.0), add)
    names = F.transform(evidence, lambda e: e["signal"])

    def pairs(ns):
        total = F.lit(0.0)
        for a, b in P.ANSWER_PAIRS:
            total = total + F.when(F.array_contains(ns, a) & F.array_contains(ns, b), 0.08).otherwise(0.0)
        return total

    score = py_round(F.least(base + let(names, pairs), F.lit(0.98)), 4)
    return (F.when(label == "legit", F.lit(0.05))
            .when((label != "phishing") | (F.size(evidence) == 0), F.lit(0.50)).otherwise(score))


def reason(label: Column, evidence: Column) -> Column:
    def part(e):
        span = F.when(F.length(e["exact_span"]) <= 120, e["exact_span"]).otherwise(
            F.concat(F.left(e["exact_span"], F.lit(117)), F.lit("...")))
        name = F.coalesce(F.try_element_at(
            constant(P.ANSWER_DESCRIPTIONS, "map<string,string>"), e["signal"]), e["signal"])
        return F.concat(name, F.lit(": “"), span, F.lit("”"))

    texts = F.array_join(F.transform(F.slice(evidence, 1, 3), part), "; ")
    return (F.when((label == "phishing") & (F.size(evidence) > 0),
                   F.concat(F.lit(P.REASON_PHISHING), texts, F.lit(".")))
            .when(label == "legit", F.lit(P.REASON_LEGIT))
            .otherwise(F.lit(P.REASON_UNGROUNDED)))
