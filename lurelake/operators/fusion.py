"""URL scores, layer scores and the fused verdict; one expression set over one joined row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lurelake import params as P
from lurelake.functions.arrays import py_round
from lurelake.operators.joins import join_layers


def url_model_score(df: DataFrame, policy: P.UrlModelPolicy = P.UrlModelPolicy()) -> DataFrame:
    lex, html = F.col("lexical_score"), F.col("html_score")
    mixed = (1.0 - policy.html_weight) * lex + policy.html_weight * html
    return df.withColumn("phishing_score", F.when(html.isNull(), lex).otherwise(mixed))


def url_verdict(df: DataFrame, policy: P.UrlModelPolicy = P.UrlModelPolicy()) -> DataFrame:
    """Label, confidence and signals of scored URLs; a ``url_error`` gives an empty result."""
    p = F.col("phishing_score")
    failed = F.col("url_error").isNotNull() if "url_error" in df.columns else F.lit(False)
    phishing = p > policy.threshold
    empty = F.array().cast("array<string>")
    return df.withColumns({
        "url_label": F.when(failed, F.lit("")).when(phishing, F.lit("Phishing"))
        .otherwise(F.lit("Legitimate")),
        "confidence": F.when(failed, F.lit(0.0)).otherwise(
            py_round(F.when(phishing, p).otherwise(1.0 - p), 4)),
        "phishing_score": F.when(failed, F.lit(0.0)).otherwise(py_round(p, 4)),
        "fetch_success": ~failed & F.col("html_score").isNotNull(),
        "signals": F.when(~failed & phishing, F.array(F.lit("domain_spoofing"))).otherwise(empty),
    })


def url_score_by_message(urls: DataFrame, id_col: str = "msg_id", order: str = "page_id",
                         shown: int = 3) -> DataFrame:
    """Highest score, first phishing URLs and signals per message.

    The shown URLs are ranked first with a limit Spark applies before the shuffle, so a
    message with very many URLs is never collected into one group.
    """
    flagged = urls.where(F.col("url_label") == "Phishing")
    rank = F.row_number().over(W.partitionBy(id_col).orderBy(order))
    top = (
        flagged.select(id_col, order, "url").withColumn("_rn", rank).where(F.col("_rn") <= shown)
        .groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("_rn", "url"))).alias("_u"))
        .select(id_col, F.col("_u.url").alias("phishing_urls"))
    )
    scores = urls.groupBy(id_col).agg(
        F.max("phishing_score").alias("url_score"),
        F.count_if(F.col("url_label") == "Phishing").alias("phishing_url_count"),
    )
    n = F.col("phishing_url_count")
    return scores.join(top, id_col, "left").withColumns({
        "url_layer_label": F.when(n > 0, F.lit("phishing")).otherwise(F.lit("legitimate")),
        "url_signals": F.when(n > 0, F.array(F.lit("domain_spoofing"))).otherwise(
            F.array().cast("array<string>")),
        "phishing_urls": F.coalesce("phishing_urls", F.array().cast("array<string>")),
    })


def risk_level(score: Column, policy: P.FusionPolicy = P.FusionPolicy()) -> Column:
    return (F.when(score >= policy.high_at, F.lit("high"))
            .when(score >= policy.medium_at, F.lit("medium"))
            .when(score >= 0.0, F.lit("low")).otherwise(F.lit("uncertain")))


def action(label: Column, level: Column) -> Column:
    return (F.when((label == "phishing") & (level == "high"), F.lit("block"))
            .when(label.isin("phishing", "suspicious"), F.lit("warn"))
            .when(label == "legit", F.lit("allow")).otherwise(F.lit("review")))


def layer_scores(df: DataFrame) -> DataFrame:
    """rule_layer_score, url_layer_score and answer_layer_score; NULL means not usable."""
    verdict = F.upper(F.col("verdict"))
    rule = F.when(verdict == "PHISHING", F.lit(0.90)).when(verdict == "SAFE", F.lit(0.05))
    usable = F.col("answer_label").isNotNull() & (F.lower("answer_label") != "unknown")
    if "answer_error" in df.columns:
        usable = usable & F.col("answer_error").isNull()
    return df.withColumns({
        "rule_layer_score": rule,
        "url_layer_score": py_round(F.col("url_score"), 4),
        "answer_layer_score": F.when(usable, py_round(F.col("answer_score"), 4)),
    })


def _two_digits(score: Column) -> Column:
    return F.format_string("%.2f", py_round(score, 2))


def fuse_verdict(df: DataFrame, policy: P.FusionPolicy = P.FusionPolicy()) -> DataFrame:
    """Fused score, label, level, action and confidence from the layer scores of one row."""
    layers = ("fastscan", "catboost", "qwen")
    scores = dict(zip(layers, ("rule_layer_score", "url_layer_score", "answer_layer_score")))

    def weight(layer):
        out = F.lit(policy.weights["email"][layer])
        for kind, table in policy.weights.items():
            if kind != "email":
                out = F.when(F.col("message_type") == kind, table[layer]).otherwise(out)
        return F.when(F.col(scores[layer]).isNotNull(), out).otherwise(F.lit(0.0))

    out = df.withColumns({f"_w_{k}": weight(k) for k in layers})
    total = sum((F.col(f"_w_{k}") for k in layers[1:]), F.col(f"_w_{layers[0]}"))
    out = out.withColumn("_total", total).withColumn("_n", sum(
        (F.col(c).isNotNull().cast("int") for c in scores.values()), F.lit(0)))
    out = out.withColumns({
        f"weight_{k}": F.when(F.col("_total") > 0, F.col(f"_w_{k}") / F.col("_total"))
        for k in layers
    })
    parts = [F.coalesce(F.col(f"weight_{k}") * F.col(scores[k]), F.lit(0.0)) for k in layers]
    fused = py_round(F.greatest(F.least(sum(parts[1:], parts[0]), F.lit(1.0)), F.lit(0.0)), 4)
    active = F.col("_n") > 0
    spread = py_round(F.greatest(*scores.values()) - F.least(*scores.values()), 4)
    out = out.withColumns({
        "risk_score": F.when(active, fused).otherwise(F.lit(0.50)),
        "disagreement": F.when(F.col("_n") >= 2, spread).otherwise(F.lit(0.0)),
    })
    risk, gap = F.col("risk_score"), F.col("disagreement")
    label = (
        F.when(~active, F.lit("unknown"))
        .when(risk >= policy.phishing_at, F.lit("phishing"))
        .when((risk >= policy.suspicious_at) | (gap > policy.disagreement_bump),
              F.lit("suspicious"))
        .otherwise(F.lit("legit"))
    )
    confidence = py_round(F.least(
        (0.5 + 0.15 * F.col("_n")) * (1 - 0.5 * gap), F.lit(1.0)), 4)
    out = out.withColumns({
        "label": label,
        "risk_level": F.when(active, risk_level(risk, policy)).otherwise(F.lit("uncertain")),
        "confidence": F.when(active, confidence).otherwise(F.lit(0.0)),
    })
    named = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{k}="), _two_digits(F.col(c))))
             for k, c in scores.items()]
    reason = F.concat(
        F.lit("Fusion ("), F.col("message_type"), F.lit("): risk="), _two_digits(risk),
        F.lit(", layers=["), F.concat_ws(", ", *named), F.lit("], disagreement="),
        _two_digits(gap))
    out = out.withColumns({
        "action": action(F.col("label"), F.col("risk_level")),
        "fusion_reason": F.when(active, reason).otherwise(
            F.lit("No layers returned usable results.")),
        "layer_scores": F.map_filter(F.create_map(*[
            x for k, c in scores.items() for x in (F.lit(k), F.col(c))]),
            lambda k, v: v.isNotNull()),
    })
    return out.drop("_total", "_n", *[f"_w_{k}" for k in layers])


def fusion_evidence(df: DataFrame) -> DataFrame:
    """Tagged evidence texts, layer labels and merged signals of a fused row."""
    has_urls = F.col("url_layer_score").isNotNull()
    has_answer = F.col("answer_layer_score").isNotNull()
    links = F.array_join("phishing_urls", ", ")
    evidence = F.array_compact(F.array(
        F.when(F.coalesce("reason", F.lit("")) != "",
               F.concat(F.lit("[FastScan] "), F.col("reason"))),
        F.when(has_urls & (F.size("phishing_urls") > 0),
               F.concat(F.lit("[CatBoost] Phishing URL(s): "), links)),
        F.when(has_answer & (F.coalesce("answer_reason", F.lit("")) != ""),
               F.concat(F.lit("[Qwen] "), F.col("answer_reason"))),
    ))
    none = F.array().cast("array<string>")
    signals = F.array_distinct(F.concat(
        F.when(has_urls, F.coalesce("url_signals", none)).otherwise(none),
        F.when(has_answer, F.coalesce("answer_signals", none)).otherwise(none)))
    labels = F.map_filter(F.create_map(
        F.lit("fastscan"), F.col("verdict"),
        F.lit("catboost"), F.when(has_urls, F.col("url_layer_label")),
        F.lit("qwen"), F.when(has_answer, F.col("answer_label"))),
        lambda k, v: v.isNotNull())
    return df.withColumns({
        "evidence": evidence, "fused_signals": signals, "layer_labels": labels})


def fuse(rules: DataFrame, urls: DataFrame, answers: DataFrame,
         policy: P.FusionPolicy = P.FusionPolicy(), id_col: str = "msg_id") -> DataFrame:
    """Join the three layers by message and fuse them."""
    joined = join_layers(rules, urls, answers, id_col)
    joined = joined.withColumn("message_type", F.coalesce("message_type", F.lit("email")))
    return fusion_evidence(fuse_verdict(layer_scores(joined), policy))
