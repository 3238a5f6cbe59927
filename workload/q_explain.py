"""Queries over explanations."""

from __future__ import annotations

from pyspark.sql import functions as F

from lurelake import params as P, texts as X
from lurelake.operators import explain as OE
from workload import duck as D
from workload.bridge import cte, view
from workload.q_answers import LAYERS, URLS, fused, layer, scored
from workload.q_messages import rule_layer
from workload.q_urls import SIMPLE, SIMPLE_SUB, SIMPLE_TLD
from workload.registry import query

WORDS = sorted(X.URL_KEYWORDS)
MEANING = "map {" + ", ".join(f"'{k}': '{v}'" for k, v in sorted(X.URL_KEYWORDS.items())) + "}"
EXTS = sorted(X.RISKY_EXTENSIONS, key=len, reverse=True)
XNORM = "CASE WHEN regexp_matches(trim(url), '^[a-zA-Z][a-zA-Z0-9+.-]*://') THEN trim(url) ELSE 'http://' || trim(url) END"


def reasons_cte(source, id_col):
    return f"""x0 AS (SELECT {id_col}, url, {XNORM} AS u FROM {source}),
x1 AS (SELECT *, {D.host('u')} AS host, url_decode(replace({D.path('u')}, '+', '%2B')) AS path, {D.query('u')} AS q FROM x0),
x2 AS (SELECT *, {SIMPLE} AS reg, {SIMPLE_TLD} AS tld, {SIMPLE_SUB} AS subs, {D.count_of('host', '-')} AS hy,
 list_filter({D.lst(WORDS)}, lambda w: contains(lower(url), w))[:6] AS words,
 list_filter({D.lst(EXTS)}, lambda e: ends_with(lower(path), e) OR contains(lower(path), e || '?'))[1] AS ext,
 list_sort(list_distinct(list_filter(list_transform(list_filter(string_split(q, '&'), lambda s: s <> ''), lambda s: split_part(s, '=', 1)),
  lambda k: regexp_matches(lower(k), '{"|".join(X.SENSITIVE_QUERY_KEYS)}'))))[:6] AS qk FROM x1),
reasons AS (
 SELECT {id_col}, url, host, 1 AS k, 'no_https' AS code, 'medium' AS severity, 'liên kết không hiển thị HTTPS rõ ràng' AS text FROM x2 WHERE NOT starts_with(lower(trim(url)), 'https://')
 UNION ALL SELECT {id_col}, url, host, 2, 'userinfo_in_url', 'high', 'URL chứa ký tự ''@'', có thể che giấu domain thật phía sau' FROM x2 WHERE contains({D.netloc('u')}, '@')
 UNION ALL SELECT {id_col}, url, host, 3, 'ip_domain', 'high', 'URL dùng địa chỉ IP thay vì tên miền tổ chức rõ ràng' FROM x2 WHERE regexp_matches(host, '^[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+$') AND list_max(list_transform(string_split(host, '.'), lambda p: coalesce(TRY_CAST(p AS INT), 999))) < 256
 UNION ALL SELECT {id_col}, url, host, 4, 'punycode_domain', 'high', 'domain chứa punycode dạng ''xn--'', có thể liên quan đến giả mạo ký tự giống nhau' FROM x2 WHERE regexp_matches(host, '(^|[.])xn--')
 UNION ALL SELECT {id_col}, url, host, 5, 'risky_tld', 'medium', 'domain sử dụng đuôi .' || tld || ', thường cần kiểm tra kỹ hơn nguồn gửi' FROM x2 WHERE tld IN ({D.quoted(P.RISKY_TLDS)})
 UNION ALL SELECT {id_col}, url, host, 6, 'url_shortener', 'medium', 'domain ' || reg || ' là dịch vụ rút gọn link, che khuất đích đến thật' FROM x2 WHERE reg IN ({D.quoted(P.SHORTENERS)})
 UNION ALL SELECT {id_col}, url, host, 7, 'many_subdomains', 'medium', 'domain có nhiều tầng subdomain (' || subs || '), dễ làm người dùng nhầm domain chính' FROM x2 WHERE subs >= 3
 UNION ALL SELECT {id_col}, url, host, 8, 'many_hyphens', 'medium', 'domain chứa nhiều dấu gạch ngang (' || hy || '), thường gặp ở domain giả mạo hoặc domain tạo tự động' FROM x2 WHERE hy >= 2
 UNION ALL SELECT {id_col}, url, host, 9, 'mixed_alpha_digit', 'medium', 'domain trộn chữ và số trong cùng nhãn, có thể dùng để bắt chước tên thương hiệu' FROM x2 WHERE len(list_filter(string_split(reg, '.'), lambda p: regexp_matches(p, '[a-zA-Z]') AND regexp_matches(p, '[0-9]'))) > 0
 UNION ALL SELECT {id_col}, url, host, 10, 'long_domain', 'medium', 'domain dài bất thường (' || length(host) || ' ký tự), khó kiểm tra nhanh bằng mắt' FROM x2 WHERE length(host) >= 55
 UNION ALL SELECT {id_col}, url, host, 11, 'long_url', 'medium', 'URL rất dài (' || length(u) || ' ký tự), có thể dùng để che giấu phần nguy hiểm' FROM x2 WHERE length(u) >= 140
 UNION ALL SELECT {id_col}, url, host, 12, 'long_path', 'medium', 'đường dẫn phía sau domain dài bất thường (' || length(path) || ' ký tự)' FROM x2 WHERE length(path) >= 90
 UNION ALL SELECT {id_col}, url, host, 13, 'suspicious_keywords', 'medium', 'URL chứa từ khóa nhạy cảm: ' || array_to_string(list_transform(words, lambda w: w || ' (' || {MEANING}[w] || ')'), ', ') FROM x2 WHERE len(words) > 0
 UNION ALL SELECT {id_col}, url, host, 14, 'risky_file_extension', CASE WHEN ext IN ({D.quoted(X.MILD_EXTENSIONS)}) THEN 'medium' ELSE 'high' END, 'đường dẫn URL trỏ tới tệp có đuôi ' || ext || ', cần thận trọng trước khi mở/tải' FROM x2 WHERE ext IS NOT NULL
 UNION ALL SELECT {id_col}, url, host, 15, 'sensitive_query_keys', 'high', 'tham số URL chứa tên gợi ý thông tin nhạy cảm: ' || array_to_string(qk, ', ') FROM x2 WHERE len(qk) > 0)"""


@query("url_reasons", f"""WITH {cte('hosts')}, {reasons_cte('hosts', 'page_id')}
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY k) AS rank, code, severity, text FROM reasons""")
def url_reasons(spark, sf):
    df = OE.url_reasons(view(spark, sf, "hosts").select("page_id", "url"))
    return OE.reason_table(df, "page_id").select(
        "page_id", (F.col("pos") + 1).alias("rank"), "code", "severity", "text")


SCORED_URLS = "us"
URL_X = f"""{URLS}, {reasons_cte('us', 'page_id')},
crit AS (SELECT s.page_id, s.msg_id, s.url, phishing_score, url_label, count(*) FILTER (code IN ({D.quoted(X.CRITICAL_CODES)})) > 0 AS crit, any_value(host) AS host
 FROM us s LEFT JOIN reasons r ON r.page_id = s.page_id GROUP BY ALL),
sev AS (SELECT *, CASE WHEN phishing_score >= 0.95 OR crit THEN CASE WHEN phishing_score >= 0.8 THEN 'critical' ELSE 'high' END WHEN phishing_score >= 0.8 THEN 'high' ELSE 'medium' END AS severity FROM crit),
gate AS (SELECT * FROM sev WHERE url_label = 'Phishing' OR phishing_score >= 0.55)"""


@query("url_severity", f"WITH {URL_X} SELECT page_id, severity FROM sev")
def url_severity(spark, sf):
    df = OE.url_reasons(scored(spark, sf))
    return df.select("page_id", OE.url_severity(F.col("phishing_score"), F.col("reasons")).alias("severity"))


@query("url_evidence_gate", f"WITH {URL_X} SELECT page_id, url FROM gate")
def url_evidence_gate(spark, sf):
    return OE.url_evidence_gate(scored(spark, sf)).select("page_id", "url")


RULE_ROWS = ", ".join("('" + "', '".join([k, *(s.replace("'", "''") for s in v)]) + "')" for k, v in X.URL_RULES.items())
URL_ITEMS = f"""{URL_X}, rt(code, signal, title, shown, risk, act) AS (VALUES {RULE_ROWS}),
uitems AS (SELECT msg_id, page_id, 0 AS k, 'domain_spoofing' AS signal, severity, '{X.SIGNAL_CATALOG["domain_spoofing"][1]}' AS title, 'catboost' AS source_layer, url AS matched_text, '{X.URL_WHY}' AS why FROM gate WHERE phishing_score >= 0.55
 UNION ALL SELECT g.msg_id, g.page_id, r.k, t.signal, r.severity, t.title, 'url_rules', CASE WHEN t.shown = 'url' OR r.code IN ('long_url', 'long_path', 'no_https') THEN g.url ELSE r.host END, t.risk
 FROM gate g JOIN reasons r ON r.page_id = g.page_id JOIN rt t ON t.code = CASE WHEN r.code IN (SELECT code FROM rt) THEN r.code ELSE 'structure' END)"""


@query("url_evidence", f"WITH {URL_ITEMS} SELECT page_id, signal, severity, title, source_layer, matched_text, why FROM uitems")
def url_evidence(spark, sf):
    from lurelake.functions.arrays import exploded

    df = OE.url_evidence(OE.url_evidence_gate(scored(spark, sf)))
    return exploded(df, "page_id", "items").select(
        "page_id", "item.signal", "item.severity", "item.title", "item.source_layer", "item.matched_text",
        F.col("item.why_suspicious").alias("why"))


CATALOG_ROWS = ", ".join(f"('{k}', '{c}', '{t}', '{s}', {p})" for k, (c, t, s, p) in X.SIGNAL_CATALOG.items())
HARM = ", ".join(f"('{k}', {v})" for k, v in X.DIRECT_HARM.items())


def advice_rows(part):
    return ", ".join(f"('{k}', '{v[part]}')" for k, v in X.SIGNAL_ADVICE.items())


WHY = X.DEFAULT_ADVICE[0].split("{}")
ANS_ITEMS = f"""cat(signal, category, title, severity, priority) AS (VALUES {CATALOG_ROWS}), adv(signal, why) AS (VALUES {advice_rows(0)}),
qitems AS (SELECT a.msg_id, a.i, a.signal, a.severity, coalesce(c.title, 'Dấu hiệu rủi ro: ' || a.signal) AS title, a.exact_span AS matched_text, coalesce(v.why, '{WHY[0]}' || a.signal || '{WHY[1]}') AS why
 FROM asn a JOIN al l ON l.msg_id = a.msg_id LEFT JOIN cat c ON c.signal = a.signal LEFT JOIN adv v ON v.signal = a.signal
 WHERE l.label0 <> 'legit' AND NOT (a.signal IN ('urgency', 'call_to_action') AND NOT regexp_matches(trim(a.exact_span), '\\s')))"""


@query("llm_evidence_items", f"WITH {LAYERS}, {ANS_ITEMS} SELECT msg_id, signal, severity, title, matched_text, why FROM qitems")
def llm_evidence_items(spark, sf):
    from lurelake.functions.arrays import exploded

    df = layer(spark, sf).withColumn("items", OE.answer_items())
    return exploded(df, "msg_id", "items").select(
        "msg_id", "item.signal", "item.severity", "item.title", "item.matched_text", F.col("item.why_suspicious").alias("why"))


@query("rule_evidence_items", f"WITH {LAYERS} SELECT msg_id, 'fastscan_rule' AS signal, 'high' AS severity, rule_reason AS description FROM jl WHERE verdict = 'PHISHING'")
def rule_evidence_items(spark, sf):
    from lurelake.functions.arrays import exploded

    df = rule_layer(spark, sf).withColumn("items", OE.rule_items())
    return exploded(df, "msg_id", "items").select("msg_id", "item.signal", "item.severity", "item.description")


@query("disagreement_item", f"WITH {LAYERS} SELECT msg_id, 'layer_disagreement' AS signal, 'medium' AS severity FROM fused WHERE gap > 0.5")
def disagreement_item(spark, sf):
    from lurelake.functions.arrays import exploded

    df = fused(spark, sf).withColumn("items", OE.disagreement_items())
    return exploded(df, "msg_id", "items").select("msg_id", "item.signal", "item.severity")


ALL_ITEMS = f"""{LAYERS}, {ANS_ITEMS}, {URL_ITEMS.replace(URLS + ', ', '', 1)},
items AS (SELECT msg_id, 1 AS src, 0 AS seq, i AS k, 'qwen' AS source_layer, signal, severity, title, matched_text, why, why AS descr FROM qitems
 UNION ALL SELECT msg_id, 2, page_id, k, source_layer, signal, severity, title, matched_text, why, why FROM uitems
 UNION ALL SELECT msg_id, 3, 0, 0, 'fastscan', 'fastscan_rule', 'high', '{X.RULE_ITEM_TITLE}', NULL, '', rule_reason FROM jl WHERE verdict = 'PHISHING'
 UNION ALL SELECT msg_id, 4, 0, 0, 'fusion', 'layer_disagreement', 'medium', '{X.DISAGREEMENT_TITLE}', NULL, '', '{X.DISAGREEMENT_TEXT}' FROM fused WHERE gap > 0.5),
harm(signal, h) AS (VALUES {HARM}),
uniq AS (SELECT * FROM items QUALIFY row_number() OVER (PARTITION BY msg_id, source_layer, signal, lower(trim(coalesce(matched_text, ''))) ORDER BY src, seq, k) = 1),
topk AS (SELECT u.*, row_number() OVER (PARTITION BY msg_id ORDER BY coalesce(h, 0) DESC, CASE u.severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END DESC,
 (coalesce(matched_text, '') <> '') DESC, (why <> '') DESC, coalesce(priority, 10) DESC, src, seq, k) AS rank FROM uniq u LEFT JOIN harm USING (signal) LEFT JOIN (SELECT signal, priority FROM cat) USING (signal) QUALIFY rank <= 8),
firsts AS (SELECT msg_id, signal, min(rank) AS r FROM topk GROUP BY msg_id, signal),
rep AS (SELECT f.*, t.title AS ttitle, t.matched_text AS tm, t.why AS tw, t.descr AS td, (SELECT array_to_string(list(signal ORDER BY r)[:5], ' | ') FROM firsts s WHERE s.msg_id = f.msg_id) AS sigs,
 w2 / (w1 + w2 + w3) AS ww2, w3 / (w1 + w2 + w3) AS ww3 FROM fused f LEFT JOIN topk t ON t.msg_id = f.msg_id AND t.rank = 1)"""


@query("evidence_topk", f"WITH {ALL_ITEMS} SELECT msg_id, rank, source_layer, signal, severity, title, coalesce(matched_text, '') AS matched_text FROM topk")
def evidence_topk(spark, sf):
    items = OE.evidence_items(fused(spark, sf), scored(spark, sf))
    return OE.evidence_topk(items).select("msg_id", "rank", "source_layer", "signal", "severity", "title",
                                          F.coalesce("matched_text", F.lit("")).alias("matched_text"))


def report(spark, sf):
    return OE.explain_report(fused(spark, sf), scored(spark, sf))


FALLBACK = "coalesce(sigs, concat_ws(' | ', CASE WHEN url_layer_label = 'phishing' THEN 'domain_spoofing' END, CASE WHEN s3 IS NOT NULL THEN nullif(answer_signals, '') END))"


@query("top_signals", f"WITH {ALL_ITEMS} SELECT msg_id, {FALLBACK} AS top_signals FROM rep")
def top_signals(spark, sf):
    return report(spark, sf).select("msg_id", F.array_join("top_signals", " | ").alias("top_signals"))


SUMMARY = f"""CASE WHEN label IN ('phishing', 'suspicious') AND ttitle IS NOT NULL THEN 'Nội dung được đánh giá là ' || label || ' với điểm rủi ro ' || printf('%.2f', round_even(risk, 2)) || '. Bằng chứng quan trọng nhất là '
 || CASE WHEN coalesce(tm, '') <> '' THEN '“' || tm || '”' ELSE ttitle END || '. Lý do: ' || CASE WHEN tw <> '' THEN tw ELSE td END
 WHEN label = 'legit' THEN 'Nội dung được đánh giá là an toàn hơn, điểm rủi ro ' || printf('%.2f', round_even(risk, 2)) || '. {X.SUMMARY_LEGIT_TAIL}' ELSE '{X.SUMMARY_OPEN}' END"""
ADVICE = f"CASE WHEN label = 'phishing' AND risk_level = 'high' THEN '{X.ADVICE_BLOCK}' WHEN label IN ('phishing', 'suspicious') THEN '{X.ADVICE_WARN}' WHEN label = 'legit' THEN '{X.ADVICE_ALLOW}' ELSE '{X.ADVICE_REVIEW}' END"


@query("summary", f"WITH {ALL_ITEMS} SELECT msg_id, {SUMMARY} AS summary FROM rep")
def summary(spark, sf):
    return report(spark, sf).select("msg_id", "summary")


@query("recommendation", f"WITH {LAYERS} SELECT msg_id, {ADVICE} AS recommendation FROM fused")
def recommendation(spark, sf):
    return fused(spark, sf).select("msg_id", OE.recommendation(F.col("label"), F.col("risk_level")).alias("recommendation"))


PCT = "printf('%.0f', round_even({} * 100, 0)) || '%'"


@query("layer_explanations", f"""WITH {ALL_ITEMS} SELECT msg_id, coalesce(CASE WHEN s3 IS NOT NULL THEN 'Nội dung văn bản đóng góp ' || {PCT.format('ww3')} || ' vào quyết định. LLM đánh giá nội dung là ' || answer_label || ' với điểm '
 || printf('%.2f', round_even(s3, 2)) || ', chủ yếu dựa trên các câu đáng ngờ được highlight.' END, '') AS content_text,
 coalesce(CASE WHEN s2 IS NOT NULL THEN 'URL đóng góp ' || {PCT.format('ww2')} || ' vào quyết định. URL model đánh giá điểm rủi ro ' || printf('%.2f', round_even(s2, 2)) || '; các yếu tố như domain, từ khóa trong URL, HTTPS và cấu trúc link được dùng để đánh giá.' END, '') AS url_text,
 coalesce('FastScan phát hiện kết quả ' || verdict || '; đây là tầng luật nhanh để bắt các dấu hiệu rõ ràng như mạo danh thương hiệu, sender bất thường hoặc rule nguy hiểm.', '') AS rule_text FROM rep""")
def layer_explanations(spark, sf):
    m = OE.layer_explanations()
    return fused(spark, sf).withColumn("m", m).select("msg_id", *[
        F.coalesce(F.try_element_at("m", F.lit(k)), F.lit("")).alias(a)
        for k, a in (("qwen", "content_text"), ("catboost", "url_text"), ("fastscan", "rule_text"))])


@query("explain_report", f"""WITH {ALL_ITEMS} SELECT msg_id, label, risk AS risk_score, risk_level, {SUMMARY} AS summary, {FALLBACK} AS top_signals,
 coalesce((SELECT count(*) FROM topk t WHERE t.msg_id = rep.msg_id), 0) AS n_items, {ADVICE} AS recommendation FROM rep""")
def explain_report(spark, sf):
    return report(spark, sf).select(
        "msg_id", "label", "risk_score", "risk_level", "summary", F.array_join("top_signals", " | ").alias("top_signals"),
        F.coalesce(F.size("evidence_items"), F.lit(0)).alias("n_items"), "recommendation")


@query("join_signal_catalog", f"""WITH {LAYERS}, {ANS_ITEMS}, s AS (SELECT DISTINCT signal FROM ranked UNION SELECT DISTINCT signal FROM asn)
SELECT s.signal, coalesce(category, 'content') AS catalog_category, coalesce(title, 'Dấu hiệu rủi ro: ' || s.signal) AS catalog_title, coalesce(severity, 'medium') AS catalog_severity, coalesce(priority, 10) AS catalog_priority
FROM s LEFT JOIN cat c ON c.signal = s.signal""")
def join_signal_catalog(spark, sf):
    from lurelake.operators import answers as OA, rules as OR
    from lurelake.operators.answers import ground, masked_messages, normalize, parse_json, sanity

    a = OR.signal_table(rule_layer(spark, sf)).select("signal")
    b = OA.evidence_table(sanity(ground(normalize(parse_json(masked_messages(view(spark, sf, "answers"))))))).select("signal")
    return OE.join_signal_catalog(a.union(b).distinct())
