"""Explanations: URL reasons, evidence items, ranking and the report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lurelake import params as P, texts as X
from lurelake.functions import urls as U
from lurelake.functions.arrays import (
    constant, exploded, in_list, literal_array, py_round, text_lookup, weighted_lookup,
)
from lurelake.operators.rules import severity_rank

CATALOG = "map<string,struct<category:string,title:string,severity:string,priority:int>>"
RULE_TEXTS = "map<string,struct<signal:string,title:string,shown:string,risk:string,action:string>>"
ITEM = ("category", "signal", "severity", "title", "description", "source_layer",
        "matched_text", "why_suspicious", "user_risk", "safe_action", "location", "confidence")


def catalog_entry(signal: Column) -> Column:
    rows = {k: dict(zip(("category", "title", "severity", "priority"), v))
            for k, v in X.SIGNAL_CATALOG.items()}
    category, title, severity, priority = X.CATALOG_DEFAULT
    default = F.struct(
        F.lit(category).alias("category"), F.concat(F.lit(title), signal).alias("title"),
        F.lit(severity).alias("severity"), F.lit(priority).alias("priority"))
    return F.coalesce(F.try_element_at(constant(rows, CATALOG), signal), default)


def join_signal_catalog(items: DataFrame, signal_col: str = "signal") -> DataFrame:
    """Catalog category, title, severity and priority per row, defaults for unknown signals."""
    return items.withColumn("_c", catalog_entry(F.col(signal_col))).select(
        *items.columns, F.col("_c.category").alias("catalog_category"),
        F.col("_c.title").alias("catalog_title"), F.col("_c.severity").alias("catalog_severity"),
        F.col("_c.priority").alias("catalog_priority"))


def url_facts(urls: DataFrame, url_col: str = "url") -> DataFrame:
    u, d, p = F.col("_u"), F.col("domain"), F.col("_p")
    raw = F.trim(F.coalesce(F.col(url_col), F.lit("")))
    with_scheme = F.when(raw == "", raw).when(
        raw.rlike(r"^[a-zA-Z][a-zA-Z0-9+.\-]*://"), raw).otherwise(F.concat(F.lit("http://"), raw))
    decoded = F.coalesce(F.try_url_decode(F.replace(p, F.lit("+"), F.lit("%2B"))), p)
    lower = F.lower(F.col(url_col))
    keys = F.filter(U.query_keys(U.query(u)), lambda k: F.exists(
        literal_array(X.SENSITIVE_QUERY_KEYS), lambda s: F.lower(k).contains(s)))
    return (
        urls.withColumn("_u", with_scheme)
        .withColumn("domain", F.trim(U.host(u), F.lit(".")))
        .withColumn("_p", U.path(u)).withColumn("_p", decoded)
        .withColumn("_reg", U.registered_simple(d)).withColumn("_tld", U.tld_simple(d))
        .withColumn("_subs", U.subdomain_count(d))
        .withColumn("_words", F.filter(literal_array(sorted(X.URL_KEYWORDS)),
                                       lambda w: lower.contains(w)))
        .withColumn("_keys", F.array_sort(keys))
        .withColumn("_ext", _risky_extension(F.lower(p)))
    )


def _risky_extension(path: Column) -> Column:
    by_length = sorted(X.RISKY_EXTENSIONS, key=len, reverse=True)
    return F.coalesce(F.get(F.filter(literal_array(by_length), lambda e: F.endswith(path, e)
                      | path.contains(F.concat(e, F.lit("?")))), F.lit(0)), F.lit(""))


def url_reasons(urls: DataFrame, url_col: str = "url") -> DataFrame:
    """Add ``domain`` and ``reasons``: array<struct<code, text, severity>> in rule order."""
    d, u = F.col("domain"), F.col("_u")
    hyphens = F.length(d) - F.length(F.replace(d, F.lit("-"), F.lit("")))
    mixed = F.exists(F.split("_reg", r"\."), lambda s: s.rlike("[a-zA-Z]") & s.rlike(r"[0-9]"))
    meanings = constant(X.URL_KEYWORDS, "map<string,string>")
    readable = F.array_join(F.transform(F.slice("_words", 1, 6), lambda w: F.concat(
        w, F.lit(" ("), F.try_element_at(meanings, w), F.lit(")"))), ", ")

    def reason(test, code, text, severity="medium"):
        severity = F.lit(severity) if isinstance(severity, str) else severity
        return F.when(test, F.struct(F.lit(code).alias("code"), text.alias("text"),
                                     severity.alias("severity")))

    def say(*parts):
        return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])

    mild = in_list(F.col("_ext"), X.MILD_EXTENSIONS)
    reasons = F.array_compact(F.array(
        reason(~F.lower(F.trim(F.col(url_col))).startswith("https://"), "no_https",
               say("liên kết không hiển thị HTTPS rõ ràng")),
        reason(U.netloc(u).contains("@"), "userinfo_in_url",
               say("URL chứa ký tự '@', có thể che giấu domain thật phía sau"), "high"),
        reason(U.is_ip(d), "ip_domain",
               say("URL dùng địa chỉ IP thay vì tên miền tổ chức rõ ràng"), "high"),
        reason(d.rlike(r"(^|\.)xn--"), "punycode_domain",
               say("domain chứa punycode dạng 'xn--', có thể liên quan đến giả mạo ký tự "
                   "giống nhau"), "high"),
        reason(in_list(F.col("_tld"), P.RISKY_TLDS), "risky_tld",
               say("domain sử dụng đuôi .", F.col("_tld"),
                   ", thường cần kiểm tra kỹ hơn nguồn gửi")),
        reason(in_list(F.col("_reg"), P.SHORTENERS), "url_shortener",
               say("domain ", F.col("_reg"),
                   " là dịch vụ rút gọn link, che khuất đích đến thật")),
        reason(F.col("_subs") >= 3, "many_subdomains",
               say("domain có nhiều tầng subdomain (", F.col("_subs"),
                   "), dễ làm người dùng nhầm domain chính")),
        reason(hyphens >= 2, "many_hyphens",
               say("domain chứa nhiều dấu gạch ngang (", hyphens,
                   "), thường gặp ở domain giả mạo hoặc domain tạo tự động")),
        reason(mixed, "mixed_alpha_digit",
               say("domain trộn chữ và số trong cùng nhãn, có thể dùng để bắt chước tên "
                   "thương hiệu")),
        reason(F.length(d) >= 55, "long_domain",
               say("domain dài bất thường (", F.length(d),
                   " ký tự), khó kiểm tra nhanh bằng mắt")),
        reason(F.length(u) >= 140, "long_url",
               say("URL rất dài (", F.length(u),
                   " ký tự), có thể dùng để che giấu phần nguy hiểm")),
        reason(F.length("_p") >= 90, "long_path",
               say("đường dẫn phía sau domain dài bất thường (", F.length("_p"), " ký tự)")),
        reason(F.size("_words") > 0, "suspicious_keywords",
               say("URL chứa từ khóa nhạy cảm: ", readable)),
        reason(F.col("_ext") != "", "risky_file_extension",
               say("đường dẫn URL trỏ tới tệp có đuôi ", F.col("_ext"),
                   ", cần thận trọng trước khi mở/tải"),
               F.when(mild, F.lit("medium")).otherwise(F.lit("high"))),
        reason(F.size("_keys") > 0, "sensitive_query_keys",
               say("tham số URL chứa tên gợi ý thông tin nhạy cảm: ",
                   F.array_join(F.slice("_keys", 1, 6), ", ")), "high"),
    ))
    out = url_facts(urls, url_col).withColumn("reasons", reasons)
    return out.drop("_u", "_p", "_reg", "_tld", "_subs", "_words", "_keys", "_ext")


def reason_table(explained: DataFrame, id_col: str) -> DataFrame:
    return exploded(explained, id_col, "reasons").select(id_col, "pos", "item.*")


def score_band(score: Column) -> Column:
    return (F.when(score >= X.VERY_HIGH_RISK_AT, F.lit("rất cao"))
            .when(score >= X.HIGH_RISK_AT, F.lit("cao"))
            .when(score >= X.MODEL_EVIDENCE_AT, F.lit("trung bình-cao"))
            .otherwise(F.lit("thấp")))


def url_severity(score: Column, reasons: Column) -> Column:
    critical = (score >= 0.95) | F.exists(
        reasons, lambda r: in_list(r["code"], X.CRITICAL_CODES))
    high = score >= X.HIGH_RISK_AT
    return (F.when(critical & high, F.lit("critical")).when(critical | high, F.lit("high"))
            .otherwise(F.lit("medium")))


def _item(**values) -> Column:
    cols = []
    for name in ITEM:
        v = values.get(name)
        if v is None:
            v = F.lit(None).cast("double" if name == "confidence" else "string")
        cols.append((F.lit(v) if isinstance(v, str) else v).alias(name))
    return F.struct(*cols)


def url_evidence_gate(urls: DataFrame) -> DataFrame:
    """URLs labelled phishing or suspicious, or with a score from 0.55."""
    return urls.where(F.lower(F.trim("url_label")).isin("phishing", "suspicious")
                      | (F.col("phishing_score") >= X.MODEL_EVIDENCE_AT))


def url_evidence(urls: DataFrame, url_col: str = "url") -> DataFrame:
    """Add ``items``: the model item (score from 0.55) and one item per reason."""
    score, domain, raw = F.col("phishing_score"), F.col("domain"), F.trim(F.col(url_col))
    rules = {k: dict(zip(("signal", "title", "shown", "risk", "action"), v))
             for k, v in X.URL_RULES.items()}
    table = constant(rules, RULE_TEXTS)
    info = catalog_entry(F.lit("domain_spoofing"))
    target = F.when(domain != "", F.concat(F.lit("domain `"), domain, F.lit("`"))).otherwise(
        F.lit("domain không đọc được rõ ràng"))
    why = F.when(F.size("reasons") == 0, F.lit(X.NO_REASON)).otherwise(
        F.array_join(F.transform("reasons", lambda r: r["text"]), "; "))
    description = F.concat(
        F.lit("Liên kết `"), raw, F.lit("` trỏ tới "), target,
        F.lit(". URL model đánh giá điểm rủi ro "), F.format_string("%.2f", py_round(score, 2)),
        F.lit(" ("), score_band(score), F.lit("). Lý do cụ thể: "), why,
        F.lit(". " + X.URL_RISK_TAIL))
    model = F.when(score >= X.MODEL_EVIDENCE_AT, F.array(_item(
        category="url", signal="domain_spoofing", severity=url_severity(score, F.col("reasons")),
        title=info["title"], description=description, source_layer="catboost", matched_text=raw,
        why_suspicious=X.URL_WHY, user_risk=X.URL_USER_RISK, safe_action=X.URL_SAFE_ACTION,
        location="url", confidence=score)))
    by_url = ("long_url", "long_path", "no_https")

    def of_reason(r):
        rule = F.coalesce(F.try_element_at(table, r["code"]), F.try_element_at(
            table, F.lit("structure")))
        shown = F.when(in_list(r["code"], by_url) | (rule["shown"] == "url"), raw).otherwise(domain)
        return _item(
            category="url", signal=rule["signal"], severity=r["severity"], title=rule["title"],
            description=F.concat(
                F.lit("Bằng chứng cụ thể: "), r["text"], F.lit(". Vì sao đáng ngờ: "),
                rule["risk"], F.lit(" Cách xử lý an toàn: "), rule["action"]),
            source_layer="url_rules", matched_text=shown, why_suspicious=rule["risk"],
            user_risk=X.URL_USER_RISK, safe_action=rule["action"], location="url",
            confidence=score)

    rule_items = F.transform("reasons", of_reason)
    return url_reasons(urls, url_col).withColumn("items", F.when(
        raw == "", F.slice(rule_items, 1, 0)).when(
            model.isNotNull(), F.concat(model, rule_items)).otherwise(rule_items))


def _advice(signal: Column, part: int) -> Column:
    own = text_lookup(signal, {k: v[part] for k, v in X.SIGNAL_ADVICE.items()})
    text = X.DEFAULT_ADVICE[part]
    if "{}" in text:
        head, tail = text.split("{}")
        return F.coalesce(own, F.concat(F.lit(head), signal, F.lit(tail)))
    return F.coalesce(own, F.lit(text))


def answer_items(evidence_col: str = "grounded") -> Column:
    """Items of verified evidence; one-word urgency and call_to_action spans are dropped."""
    soft = ("urgency", "call_to_action")

    def usable(e):
        words = F.size(F.filter(F.split(e["exact_span"], r"\s+"), lambda w: w != ""))
        return (F.coalesce(e["verified"], F.lit(False)) & (e["signal"] != "")
                & (e["exact_span"] != "") & ~(in_list(e["signal"], soft) & (words <= 1)))

    def item(e):
        info = catalog_entry(e["signal"])
        severity = F.when(e["severity"].isin("critical", "high", "medium", "low"),
                          e["severity"]).otherwise(info["severity"])
        why = _advice(e["signal"], 0)
        return _item(
            category=info["category"], signal=e["signal"], severity=severity,
            title=info["title"], description=why, source_layer="qwen",
            matched_text=e["exact_span"], why_suspicious=why, user_risk=_advice(e["signal"], 1),
            safe_action=_advice(e["signal"], 2), location=e["field"])

    return F.transform(F.filter(evidence_col, usable), item)


def rule_items() -> Column:
    """Item of the rule layer when its verdict is PHISHING."""
    item = _item(category="entity", signal="fastscan_rule", severity="high",
                 title=X.RULE_ITEM_TITLE, description=F.trim(F.col("reason")),
                 source_layer="fastscan", why_suspicious="", user_risk="", safe_action="",
                 location="")
    usable = (F.upper("verdict") == "PHISHING") & (F.coalesce("reason", F.lit("")) != "")
    return F.when(usable, F.array(item))


def disagreement_items() -> Column:
    item = _item(category="disagreement", signal="layer_disagreement", severity="medium",
                 title=X.DISAGREEMENT_TITLE, description=X.DISAGREEMENT_TEXT,
                 source_layer="fusion", why_suspicious="", user_risk="", safe_action="",
                 location="")
    return F.when(F.col("disagreement") > 0.50, F.array(item))


def evidence_items(fused: DataFrame, urls: DataFrame, id_col: str = "msg_id",
                   url_order: str = "page_id") -> DataFrame:
    """Long table of all items: (id, source, seq, item columns), in building order."""
    own = fused.withColumns({
        "_q": F.transform(answer_items(), lambda x, i: F.struct(
            F.lit(1).alias("source"), F.lit(0).cast("long").alias("seq"), i.alias("pos"), x.alias("item"))),
        "_r": F.transform(rule_items(), lambda x, i: F.struct(
            F.lit(3).alias("source"), F.lit(0).cast("long").alias("seq"), i.alias("pos"), x.alias("item"))),
        "_d": F.transform(disagreement_items(), lambda x, i: F.struct(
            F.lit(4).alias("source"), F.lit(0).cast("long").alias("seq"), i.alias("pos"), x.alias("item"))),
    })
    none = F.slice("_q", 1, 0)
    own = own.withColumn("_all", F.concat(*[F.coalesce(c, none) for c in ("_q", "_r", "_d")]))
    own_rows = exploded(own, id_col, "_all").select(
        id_col, "item.source", "item.seq", F.col("item.pos").alias("pos"), "item.item.*")
    linked = url_evidence(url_evidence_gate(urls))
    url_rows = exploded(linked, (id_col, url_order), "items").select(
        id_col, F.lit(2).alias("source"), F.col(url_order).cast("long").alias("seq"),
        F.col("pos"), "item.*")
    return own_rows.unionByName(url_rows)


def evidence_topk(items: DataFrame, id_col: str = "msg_id", limit: int = 8) -> DataFrame:
    """Deduplicated items of each message in order of harm, at most ``limit``.

    Duplicates collapse in a partial aggregate and the rank limit works before its shuffle,
    so a message with very many items costs no single task much.
    """
    matched = F.lower(F.trim(F.coalesce("matched_text", F.lit(""))))
    rest = [c for c in items.columns if c not in (id_col, "source_layer", "signal")]
    unique = (
        items.groupBy(id_col, "source_layer", "signal", matched.alias("_m"))
        .agg(F.min_by(F.struct(*rest), F.struct("source", "seq", "pos")).alias("x"))
        .select(id_col, "source_layer", "signal", "x.*")
    )
    order = (
        weighted_lookup(F.col("signal"), X.DIRECT_HARM, 0.0).desc(),
        severity_rank(F.col("severity")).desc(),
        (F.coalesce("matched_text", F.lit("")) != "").desc(),
        (F.coalesce("why_suspicious", F.lit("")) != "").desc(),
        catalog_entry(F.col("signal"))["priority"].desc(),
        F.col("source"), F.col("seq"), F.col("pos"),
    )
    rank = F.row_number().over(W.partitionBy(id_col).orderBy(*order))
    return unique.withColumn("rank", rank).where(F.col("rank") <= limit)


def recommendation(label: Column, level: Column) -> Column:
    return (F.when((label == "phishing") & (level == "high"), F.lit(X.ADVICE_BLOCK))
            .when(label.isin("phishing", "suspicious"), F.lit(X.ADVICE_WARN))
            .when(label == "legit", F.lit(X.ADVICE_ALLOW)).otherwise(F.lit(X.ADVICE_REVIEW)))


def _two(score: Column) -> Column:
    return F.format_string("%.2f", py_round(score, 2))


def _fill(template: str, **values) -> Column:
    """A template with {names} as a concatenation of columns."""
    parts, rest = [], template
    while "{" in rest:
        head, rest = rest.split("{", 1)
        name, rest = rest.split("}", 1)
        parts += [F.lit(head), values[name]]
    return F.concat(*parts, F.lit(rest))


def summary(top: Column) -> Column:
    """Summary of a fused row and its first item."""
    label = F.col("label")
    score = _two(F.coalesce("risk_score", F.lit(0.5)))
    matched, why = F.coalesce(top["matched_text"], F.lit("")), F.coalesce(
        top["why_suspicious"], F.lit(""))
    quote = F.when(matched != "", F.concat(F.lit("“"), matched, F.lit("”"))).otherwise(top["title"])
    because = F.when(why != "", why).otherwise(top["description"])
    risky = F.concat(_fill(X.SUMMARY_RISK, label=label, score=score),
                     _fill(X.SUMMARY_TOP, quote=quote, why=because))
    return (F.when(label.isin("phishing", "suspicious") & top.isNotNull(), risky)
            .when(label == "legit", F.concat(
                _fill(X.SUMMARY_LEGIT, score=score), F.lit(X.SUMMARY_LEGIT_TAIL)))
            .otherwise(F.lit(X.SUMMARY_OPEN)))


def layer_explanations() -> Column:
    """map<layer, text>; weights are read under the layers' own names."""
    scores, labels = F.col("layer_scores"), F.col("layer_labels")

    def share(col):
        return F.format_string("%.0f%%", py_round(F.coalesce(col, F.lit(0.0)) * 100, 0))

    content = F.concat(
        F.lit("Nội dung văn bản đóng góp "), share(F.col("weight_qwen")),
        F.lit(" vào quyết định. LLM đánh giá nội dung là "), labels["qwen"],
        F.lit(" với điểm "), _two(scores["qwen"]),
        F.lit(", chủ yếu dựa trên các câu đáng ngờ được highlight."))
    links = F.concat(
        F.lit("URL đóng góp "), share(F.col("weight_catboost")),
        F.lit(" vào quyết định. URL model đánh giá điểm rủi ro "), _two(scores["catboost"]),
        F.lit("; các yếu tố như domain, từ khóa trong URL, HTTPS và cấu trúc link được dùng để "
              "đánh giá."))
    rules = F.concat(
        F.lit("FastScan phát hiện kết quả "), labels["fastscan"],
        F.lit("; đây là tầng luật nhanh để bắt các dấu hiệu rõ ràng như mạo danh thương hiệu, "
              "sender bất thường hoặc rule nguy hiểm."))
    return F.map_filter(F.create_map(
        F.lit("qwen"), F.when(F.map_contains_key(scores, "qwen"), content),
        F.lit("catboost"), F.when(F.map_contains_key(scores, "catboost"), links),
        F.lit("fastscan"), F.when(F.map_contains_key(labels, "fastscan"), rules)),
        lambda k, v: v.isNotNull())


def explain_report(fused: DataFrame, urls: DataFrame, id_col: str = "msg_id",
                   limit: int = 8) -> DataFrame:
    """One report per message: summary, ranked items, top signals, advice, layer texts."""
    ranked = evidence_topk(evidence_items(fused, urls, id_col), id_col, limit)
    packed = ranked.groupBy(id_col).agg(F.array_sort(F.collect_list(
        F.struct("rank", F.struct(*ITEM).alias("item")))).alias("_p")).select(
            id_col, F.transform("_p", lambda x: x["item"]).alias("evidence_items"))
    narrow = fused.select(
        id_col, "label", "risk_score", "risk_level", "layer_scores", "layer_labels",
        "weight_qwen", "weight_catboost", "fused_signals")
    joined = narrow.join(packed, id_col, "left").withColumn(
        "evidence_items", F.coalesce("evidence_items", F.slice("evidence_items", 1, 0)))
    signals = F.array_distinct(F.transform("evidence_items", lambda x: x["signal"]))
    has = F.coalesce(F.size("evidence_items"), F.lit(0)) > 0
    return joined.withColumns({
        "summary": summary(F.get("evidence_items", F.lit(0))),
        "top_signals": F.slice(F.when(has, signals).otherwise(F.col("fused_signals")), 1, 5),
        "recommendation": recommendation(F.col("label"), F.col("risk_level")),
        "layer_explanations": layer_explanations(),
    }).drop("layer_scores", "layer_labels", "weight_qwen", "weight_catboost", "fused_signals")
