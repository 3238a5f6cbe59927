"""Structured answers: parse, normalise, ground in the message, score.

Answers arrive as a table (a raw text per message).  Every step stays inside the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lurelake import params as P
from lurelake.functions import answers as A
from lurelake.functions.arrays import exploded, first_by_key, let
from lurelake.operators.messages import build_prompt, mask_links, prepared_fields

FIELDS = ("subject", "sender", "body", "attachment")


def parse_json(df: DataFrame, raw_col: str = "raw_answer") -> DataFrame:
    """Add ``parsed`` (struct or NULL) and ``json_parsed``.

    Only texts that do not parse as they are searched for their first balanced object.
    """
    out = df.withColumn("_text", A.unwrapped(F.col(raw_col)))
    out = out.withColumn("_ok", F.try_parse_json("_text").isNotNull())
    out = out.withColumn("_object", A.first_object(F.when(~F.col("_ok"), F.col("_text"))))
    out = out.withColumn("_json", F.when(F.col("_ok"), F.col("_text")).when(
        F.try_parse_json("_object").isNotNull(), F.col("_object")))
    is_object = F.ltrim("_json").startswith("{")
    return out.withColumns({
        "json_parsed": F.coalesce(is_object, F.lit(False)),
        "parsed": F.when(is_object, F.from_json("_json", A.ANSWER_SCHEMA)),
    }).drop("_text", "_ok", "_object", "_json")


def normalize(df: DataFrame, taxonomy=P.ANSWER_SIGNALS) -> DataFrame:
    """Add ``answer_label``, ``pred_signals`` and ``items`` with normalised values."""
    items = F.transform(
        F.filter(F.coalesce(F.col("parsed.evidence"), F.from_json(
            F.lit("[]"), A.ANSWER_SCHEMA.split("evidence:")[1][:-1])), lambda e: e.isNotNull()),
        lambda e: F.struct(
            A.signal_of(e["signal"], taxonomy).alias("signal"),
            F.trim(F.coalesce(e["exact_span"], F.lit(""))).alias("exact_span"),
            A.severity_of(e["severity"]).alias("severity"),
            e["char_start"].alias("char_start"), e["char_end"].alias("char_end")))
    signals = F.array_sort(F.array_distinct(F.filter(F.transform(
        F.coalesce(F.col("parsed.signals"), F.array().cast("array<string>")),
        lambda s: A.signal_of(s, taxonomy)), lambda s: s != "")))
    return df.withColumns({
        "answer_label": A.label_of(F.col("parsed.label")), "pred_signals": signals,
        "items": items})


def ground(df: DataFrame) -> DataFrame:
    """Add ``grounded``: evidence found in the masked fields, offsets into the original text."""
    usable = F.filter("items", lambda e: (e["signal"] != "") & (e["exact_span"] != "")
                      & ~A.link_like(e["exact_span"]))
    unique = first_by_key(usable, lambda e: F.concat_ws(
        "\x01", e["signal"], F.lower(e["exact_span"])))
    fields = F.array(*[F.struct(
        F.lit(f).alias("field"), F.col(f).alias("own"), F.col(f"{f}_masked").alias("seen"))
        for f in FIELDS])

    def locate(e):
        places = F.filter(F.transform(F.col("_fields"), lambda f: F.struct(
            f["field"].alias("field"), f["own"].alias("own"), f["seen"].alias("seen"),
            A.find_span(e["exact_span"], f["seen"]).alias("at"))), lambda f: f["at"].isNotNull())
        first = F.get(places, F.lit(0))

        def place(p):
            own = A.find_span(e["exact_span"], p["own"])
            return let(own, lambda o: F.struct(
                e["signal"].alias("signal"),
                F.when(o.isNotNull(), p["own"].substr(o["s"] + 1, o["e"] - o["s"])).otherwise(
                    p["seen"].substr(p["at"]["s"] + 1, p["at"]["e"] - p["at"]["s"]))
                .alias("exact_span"),
                e["severity"].alias("severity"), p["field"].alias("field"),
                F.coalesce(o["s"], p["at"]["s"]).alias("char_start"),
                F.coalesce(o["e"], p["at"]["e"]).alias("char_end"),
                F.lit(True).alias("verified")))

        return let(first, lambda p: F.when(p.isNotNull(), place(p)))

    out = df.withColumn("_fields", fields).withColumn("_unique", unique)
    return out.withColumn("grounded", F.array_compact(F.transform("_unique", locate))).drop(
        "_fields", "_unique")


def sanity(df: DataFrame) -> DataFrame:
    """Drop attachment evidence without an attachment cue and urgency without a time cue."""
    has_file = (F.trim("attachment") != "") | F.col("prompt").rlike(P.ATTACHMENT_CUE)
    return df.withColumn("_file", has_file).withColumn("grounded", F.filter(
        "grounded", lambda e: F.when(e["signal"] == "suspicious_attachment", F.col("_file"))
        .when(e["signal"] == "urgency", e["exact_span"].rlike(P.TIME_CUE))
        .otherwise(F.lit(True)))).drop("_file")


def contract(df: DataFrame) -> DataFrame:
    """Legit answers carry no evidence; phishing without evidence becomes unknown."""
    raw = F.col("answer_label")
    label = F.when((raw == "phishing") & (F.size("grounded") == 0), F.lit("unknown")).otherwise(raw)
    evidence = F.when(raw == "legit", F.slice("grounded", 1, 0)).otherwise(F.col("grounded"))
    out = df.withColumn("grounded", evidence).withColumn("answer_label", label)
    signals = F.array_sort(F.array_distinct(F.transform("grounded", lambda e: e["signal"])))
    none = F.array().cast("array<string>")
    return out.withColumn("answer_signals", F.when(
        F.col("answer_label").isin("legit"), none).otherwise(signals))


def score(df: DataFrame) -> DataFrame:
    label, evidence = F.col("answer_label"), F.col("grounded")
    failed = ~F.col("json_parsed")
    return df.withColumns({
        "answer_score": F.when(failed, F.lit(0.50)).otherwise(A.risk_score(label, evidence)),
        "answer_reason": F.when(failed, F.lit("Qwen vLLM inference failed.")).otherwise(
            A.reason(label, evidence)),
        "answer_error": F.when(failed, F.lit("unparsable answer")),
    })


def masked_messages(df: DataFrame) -> DataFrame:
    """Prepared fields, masked fields and the prompt of each message."""
    return build_prompt(mask_links(prepared_fields(df)))


def answer_layer(df: DataFrame) -> DataFrame:
    """Messages with ``raw_answer`` -> label, score, grounded evidence, signals and reason."""
    return score(contract(sanity(ground(normalize(parse_json(masked_messages(df)))))))


def evidence_table(df: DataFrame, id_col: str = "msg_id", col: str = "grounded") -> DataFrame:
    return exploded(df, id_col, col).select(id_col, "pos", "item.*")


def span_occurrences(docs: DataFrame, spans: DataFrame, id_col: str, text_col: str,
                     span_col: str = "span") -> DataFrame:
    """All occurrences of spans in their documents, not touching a word on either side.

    ``spans`` has (id, span); matching ignores case and the kind of white space.  Rows come
    as (id, span, start, end), 0-based.
    """
    pairs = spans.join(docs.select(id_col, F.col(text_col).alias("_text")), id_col)
    span = F.trim(F.col(span_col))
    letter = r"[\p{L}\p{N}_]"
    core = F.substring(A.flexible(span), 7, 1_000_000)
    pattern = F.concat(
        F.lit("(?isu)"),
        F.when(F.left(span, F.lit(1)).rlike(letter), F.lit(rf"(?<!{letter})")).otherwise(F.lit("")),
        core,
        F.when(F.right(span, F.lit(1)).rlike(letter), F.lit(rf"(?!{letter})")).otherwise(F.lit("")))
    out = pairs.where(span != "").withColumn("_p", pattern)
    out = out.withColumn("_gap", F.split(F.col("_text"), F.col("_p"))).where(F.size("_gap") > 1)
    # the length of a match is its span's, but where white space may differ
    out = out.withColumn("_hit", F.when(span.rlike(r"\s"), F.transform(
        F.regexp_extract_all("_text", F.col("_p"), F.lit(0)), lambda h: F.length(h))).otherwise(
            F.array_repeat(F.length(span), F.size("_gap") - 1)))
    # start of match i = lengths of the gaps up to i plus lengths of the matches before it
    steps = F.transform("_hit", lambda h, i: F.struct(F.length(F.get(F.col("_gap"), i)).alias("gap"), h.alias("hit")))
    walked = F.aggregate(
        steps,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,e:int>>").alias("out")),
        lambda acc, st: F.struct(
            (acc["at"] + st["gap"] + st["hit"]).alias("at"),
            F.concat(acc["out"], F.array(F.struct(
                (acc["at"] + st["gap"]).alias("s"),
                (acc["at"] + st["gap"] + st["hit"]).alias("e")))).alias("out")),
        lambda acc: acc["out"])
    return exploded(out.withColumn("_at", walked), (id_col, span_col), "_at").select(
        id_col, span_col, F.col("item.s").alias("start"), F.col("item.e").alias("end"))


def _clusters(hits: DataFrame, id_col: str) -> DataFrame:
    """The hits with ``cluster``: a sweep over a document's starts opens a new one where no earlier hit reaches."""
    order = W.partitionBy(id_col).orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1))
    opened = hits.withColumn("_open", F.coalesce((F.col("start") >= reach), F.lit(True)).cast("int"))
    return opened.withColumn("cluster", F.sum("_open").over(order.rowsBetween(W.unboundedPreceding, 0))).drop("_open")


def resolve_spans(hits: DataFrame, id_col: str, span_col: str = "span", nested: bool = False) -> DataFrame:
    """(id, span, start, end): the hits that are marked when the longest come first.

    Hits are taken by falling length of their span, then start, then span.  One that meets a taken one goes; with
    ``nested`` it stays if it lies inside every taken one that it meets.  Only hits that overlap, directly or
    through others, are compared, in one array each.  Equal hits count once, empty ones never.
    """
    own = hits.where(F.col("end") > F.col("start")).select(id_col, F.col(span_col).alias("span"), "start", "end").distinct()
    ranked = F.struct((-F.length("span")).alias("n"), F.col("start").alias("s"), "span", F.col("end").alias("e"))
    groups = _clusters(own, id_col).groupBy(id_col, "cluster").agg(F.sort_array(F.collect_list(ranked)).alias("hits"))

    def take(kept, h):
        def clash(k):
            met = (k["s"] < h["e"]) & (h["s"] < k["e"])
            return met & ~((k["s"] <= h["s"]) & (h["e"] <= k["e"])) if nested else met

        return F.when(F.exists(kept, clash), kept).otherwise(F.concat(kept, F.array(h)))

    # the first always stays; the rest are folded onto it
    kept = F.aggregate(F.slice("hits", 2, F.size("hits")), F.slice("hits", 1, 1), take)
    out = exploded(groups.withColumn("_kept", kept), (id_col, "cluster"), "_kept")
    return out.select(id_col, F.col("item.span").alias(span_col), F.col("item.s").alias("start"), F.col("item.e").alias("end"))


def _bare_link(value) -> Column:
    low = F.lower(F.trim(value))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(low, "^https?://", ""), r"^www\.", ""), "/$", "")


def link_targets(docs: DataFrame, spans: DataFrame, id_col: str, links_col: str = "links",
                 span_col: str = "span") -> DataFrame:
    """(id, link, span): for each link of a document the longest of its link-like spans (with a dot, a slash or
    a leading http) that holds the link or is held by it, compared without scheme, ``www.`` and last slash.

    ``docs`` has an array of links a row.  Empty links and spans match nothing; of equally long spans the least
    is taken.
    """
    value = F.col(span_col)
    like = spans.where(value.startswith("http") | value.contains(".") | value.contains("/")).select(
        id_col, F.trim(value).alias("_span"), _bare_link(value).alias("_bare")).where("_bare <> ''")
    offered = like.groupBy(id_col).agg(F.sort_array(F.collect_set(F.struct(
        (-F.length("_span")).alias("n"), "_span", "_bare"))).alias("_offered"))
    links = docs.select(id_col, F.explode_outer(F.array_distinct(links_col)).alias("link")).withColumn("_own", _bare_link(F.col("link")))
    met = links.where("_own <> ''").join(offered, id_col)
    first = F.get(F.filter("_offered", lambda o: F.col("_own").contains(o["_bare"]) | o["_bare"].contains(F.col("_own"))), F.lit(0))
    return met.select(id_col, "link", first["_span"].alias(span_col)).where(F.col(span_col).isNotNull())
