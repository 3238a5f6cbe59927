"""Queries over structured answers, layer scores and the fused verdict."""

from __future__ import annotations

from pyspark.sql import functions as F

from lurelake import params as P
from lurelake.functions import answers as A
from lurelake.functions.arrays import py_round
from lurelake.operators import answers as OA, fusion as OF, joins as OJ
from workload import duck as D
from workload.bridge import cte, view
from workload.q_messages import RULES, collapse, rule_layer, truncated
from workload.registry import query, table

SIGNALS = D.quoted(P.ANSWER_SIGNALS)
ANS = f"""{cte('answers')},
ap AS (SELECT msg_id, message_type, gold_label, raw_answer, CASE WHEN message_type = 'sms' THEN '' ELSE {truncated(collapse('subject'), 500)} END AS subject,
 {collapse('sender')} AS sender, {truncated(collapse('body'), 4500)} AS body FROM answers),
aj0 AS (SELECT *, regexp_replace(regexp_replace(trim(regexp_replace(raw_answer, '(?is)<think>.*?</think>', '', 'g'), ' ' || chr(10)), '^```(json)?\\s*', ''), '\\s*```$', '') AS t FROM ap),
aj AS (SELECT *, CASE WHEN json_valid(t) THEN t ELSE nullif(regexp_extract(t, '(?s)\\{{.*\\}}'), '') END AS j FROM aj0),
al AS (SELECT *, j IS NOT NULL AS ok, CASE WHEN lower(trim(json_extract_string(j, '$.label'))) IN ({D.quoted(P.PHISHING_WORDS)}) THEN 'phishing'
 WHEN lower(trim(json_extract_string(j, '$.label'))) IN ({D.quoted(P.LEGIT_WORDS)}) THEN 'legit' ELSE 'unknown' END AS label0 FROM aj),
ae AS (SELECT msg_id, message_type, subject, sender, body, i, lower(trim(json_extract_string(j, '$.evidence[' || i || '].signal'))) AS signal, trim(json_extract_string(j, '$.evidence[' || i || '].exact_span')) AS span,
 CASE WHEN lower(json_extract_string(j, '$.evidence[' || i || '].severity')) IN ('low', 'medium', 'high') THEN lower(json_extract_string(j, '$.evidence[' || i || '].severity')) ELSE 'medium' END AS severity,
 coalesce(CAST(json_extract(j, '$.evidence[' || i || '].char_start') AS INT), -1) AS cs, coalesce(CAST(json_extract(j, '$.evidence[' || i || '].char_end') AS INT), -1) AS ce
 FROM (SELECT *, unnest(range(0, CAST(json_array_length(j, '$.evidence') AS INT))) AS i FROM al)),
af AS (SELECT msg_id, i, signal, severity, field, txt, CASE WHEN strpos(lower(seen), lower(span)) > 0 THEN substr(txt, strpos(lower(txt), lower(span)), length(span))
  ELSE regexp_extract(txt, '(?is)' || regexp_replace(span, '\\s+', '\\\\s+', 'g')) END AS found,
 row_number() OVER (PARTITION BY msg_id, i ORDER BY fo) AS fr FROM (
 SELECT *, regexp_replace(txt, '(https?://|www[.])[^\\s]+', '[L]', 'g') AS seen FROM (
  SELECT *, 1 AS fo, 'subject' AS field, subject AS txt FROM ae UNION ALL SELECT *, 2, 'sender', sender FROM ae UNION ALL SELECT *, 3, 'body', body FROM ae))
 WHERE signal IN ({SIGNALS}) AND span <> '' AND txt <> '' AND (strpos(lower(seen), lower(span)) > 0 OR
  (regexp_matches(span, '\\s') AND regexp_matches(seen, '(?is)' || regexp_replace(span, '\\s+', '\\\\s+', 'g'))))),
ag AS (SELECT msg_id, i, signal, found AS exact_span, severity, field, strpos(lower(txt), lower(found)) - 1 AS char_start,
 strpos(lower(txt), lower(found)) - 1 + length(found) AS char_end FROM af WHERE fr = 1),
asn AS (SELECT g.* FROM ag g JOIN ap p ON p.msg_id = g.msg_id WHERE (signal <> 'suspicious_attachment' OR regexp_matches(coalesce(p.subject, '') || ' ' || p.sender || ' ' || p.body,
 '(?i)(^|[^\\p{{L}}\\p{{N}}_])(attachment|attached|file|document)([^\\p{{L}}\\p{{N}}_]|$)|đính\\s*kèm')) AND (signal <> 'urgency' OR
 regexp_matches(exact_span, '(?i)khẩn|gấp|urgent|immediately|right\\s+now|within\\s+\\d+\\s*(minute|hour|day)|deadline|expires?\\s+today'))),
ac AS (SELECT l.msg_id, ok, CASE WHEN label0 = 'phishing' AND count(a.signal) = 0 THEN 'unknown' ELSE label0 END AS label,
 CASE WHEN label0 = 'legit' THEN '' ELSE coalesce(string_agg(DISTINCT a.signal, ' | ' ORDER BY a.signal), '') END AS signals,
 CASE WHEN label0 = 'legit' THEN [] ELSE coalesce(list({{'s': a.signal, 'v': a.severity, 'x': a.exact_span}} ORDER BY a.i) FILTER (a.signal IS NOT NULL), []) END AS ev
 FROM al l LEFT JOIN asn a ON a.msg_id = l.msg_id GROUP BY l.msg_id, ok, label0),
ascore AS (SELECT *, CASE WHEN NOT ok THEN 0.5::DOUBLE WHEN label = 'legit' THEN 0.05::DOUBLE WHEN label <> 'phishing' OR len(ev) = 0 THEN 0.5::DOUBLE ELSE round_even(least(0.98::DOUBLE,
 0.5::DOUBLE + list_reduce(list_transform(ev, lambda e: map {{{', '.join(f"'{k}': {v}::DOUBLE" for k, v in P.ANSWER_SIGNAL_WEIGHTS.items())}}}[e.s]
  * CASE e.v WHEN 'low' THEN 0.5::DOUBLE WHEN 'medium' THEN 0.75::DOUBLE ELSE 1.0::DOUBLE END), lambda a, b: a + b, 0.0::DOUBLE)
 + {' + '.join(f"(CASE WHEN contains(signals, '{a}') AND contains(signals, '{b}') THEN 0.08::DOUBLE ELSE 0.0::DOUBLE END)" for a, b in P.ANSWER_PAIRS)}), 4) END AS score,
 CASE WHEN NOT ok THEN 'Qwen vLLM inference failed.' WHEN label = 'phishing' THEN '{P.REASON_PHISHING}' || array_to_string(list_transform(ev[:3], lambda e:
  map {{{', '.join(f"'{k}': '{v}'" for k, v in P.ANSWER_DESCRIPTIONS.items())}}}[e.s] || ': “' || CASE WHEN length(e.x) <= 120 THEN e.x ELSE left(e.x, 117) || '...' END || '”'), '; ') || '.'
  WHEN label = 'legit' THEN '{P.REASON_LEGIT}' ELSE '{P.REASON_UNGROUNDED}' END AS reason FROM ac)"""


def answers(spark, sf):
    return view(spark, sf, "answers")


def layer(spark, sf):
    return OA.answer_layer(answers(spark, sf))


@query("llm_parse_json", f"WITH {ANS} SELECT msg_id, CAST(ok AS INT) AS json_parsed, coalesce(json_extract_string(j, '$.label'), '') AS label, coalesce(json_array_length(j, '$.evidence'), 0) AS n_evidence FROM al")
def llm_parse_json(spark, sf):
    return OA.parse_json(answers(spark, sf)).select(
        "msg_id", F.col("json_parsed").cast("int").alias("json_parsed"),
        F.coalesce("parsed.label", F.lit("")).alias("label"),
        F.coalesce(F.size("parsed.evidence"), F.lit(0)).alias("n_evidence"))


@query("llm_normalize", f"""WITH {ANS} SELECT l.msg_id, label0 AS label, coalesce((SELECT string_agg(CASE WHEN signal IN ({SIGNALS}) THEN signal ELSE '' END || ':' || severity, ' | ' ORDER BY i)
 FROM ae e WHERE e.msg_id = l.msg_id), '') AS items FROM al l""")
def llm_normalize(spark, sf):
    return OA.normalize(OA.parse_json(answers(spark, sf))).select(
        "msg_id", F.col("answer_label").alias("label"),
        F.array_join(F.transform("items", lambda e: F.concat_ws(":", e["signal"], e["severity"])), " | ").alias("items"))


EV = "msg_id, signal, exact_span, severity, field, char_start, char_end"


@query("evidence_ground", f"WITH {ANS} SELECT {EV} FROM ag")
def evidence_ground(spark, sf):
    df = OA.ground(OA.normalize(OA.parse_json(OA.masked_messages(answers(spark, sf)))))
    return OA.evidence_table(df).selectExpr(*EV.split(", "))


@query("evidence_sanity", f"WITH {ANS} SELECT {EV} FROM asn")
def evidence_sanity(spark, sf):
    df = OA.sanity(OA.ground(OA.normalize(OA.parse_json(OA.masked_messages(answers(spark, sf))))))
    return OA.evidence_table(df).selectExpr(*EV.split(", "))


@query("signals_from_evidence", f"WITH {ANS} SELECT msg_id, signals FROM ac")
def signals_from_evidence(spark, sf):
    return layer(spark, sf).select("msg_id", F.array_join("answer_signals", " | ").alias("signals"))


@query("llm_contract", f"WITH {ANS} SELECT msg_id, label, len(ev) AS n_evidence FROM ac")
def llm_contract(spark, sf):
    return layer(spark, sf).select("msg_id", F.col("answer_label").alias("label"), F.size("grounded").alias("n_evidence"))


@query("llm_risk_score", f"WITH {ANS} SELECT msg_id, label, score FROM ascore")
def llm_risk_score(spark, sf):
    return layer(spark, sf).select("msg_id", F.col("answer_label").alias("label"), F.col("answer_score").alias("score"))


@query("llm_reason", f"WITH {ANS} SELECT msg_id, reason FROM ascore")
def llm_reason(spark, sf):
    return layer(spark, sf).select("msg_id", F.col("answer_reason").alias("reason"))


LETTER = "[\\p{L}\\p{N}_]"
SPAN_SQL = f"""WITH sp AS (SELECT doc_id, text, regexp_extract(text, '{LETTER}+') AS span FROM documents),
hit AS (SELECT doc_id, span, text, unnest(range(1, length(text) - length(span) + 2)) AS p FROM sp WHERE length(span) > 0)
SELECT doc_id, span, p - 1 AS "start", p - 1 + length(span) AS "end" FROM hit
WHERE lower(substr(text, p, length(span))) = lower(span) AND NOT regexp_matches(substr(text, p - 1, CASE WHEN p > 1 THEN 1 ELSE 0 END), '{LETTER}')
AND NOT regexp_matches(substr(text, p + length(span), 1), '{LETTER}')"""


@query("span_locate_boundary", SPAN_SQL)
def span_locate_boundary(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    spans = docs.select("doc_id", F.regexp_extract("text", r"[\p{L}\p{N}_]+", 0).alias("span"))
    return OA.span_occurrences(docs, spans, "doc_id", "text")


#: Spans of three, two and one different words from the head of each text; brute force over all hits of a document.
RESOLVED_SQL = f"""WITH sp AS (SELECT doc_id, text, unnest([regexp_extract(text, '{LETTER}+'), regexp_extract(text, '{LETTER}+ {LETTER}+'), regexp_extract(text, '{LETTER}+ {LETTER}+ {LETTER}+')]) AS span FROM documents),
one AS (SELECT DISTINCT doc_id, text, span FROM sp WHERE span <> '' AND len(list_distinct(string_split(lower(span), ' '))) = len(string_split(span, ' '))),
hit AS (SELECT doc_id, span, text, unnest(range(1, length(text) - length(span) + 2)) AS p FROM one),
own AS (SELECT doc_id, span, p - 1 AS s, p - 1 + length(span) AS e FROM hit
WHERE lower(substr(text, p, length(span))) = lower(span) AND NOT regexp_matches(substr(text, p - 1, CASE WHEN p > 1 THEN 1 ELSE 0 END), '{LETTER}')
AND NOT regexp_matches(substr(text, p + length(span), 1), '{LETTER}')),
long AS (SELECT doc_id, list({{'n': -length(span), 's': s, 'span': span, 'e': e}} ORDER BY -length(span), s, span, e) AS hits FROM own GROUP BY doc_id),
kept AS (SELECT doc_id, unnest(list_reduce(list_transform(hits, lambda h: [h]), lambda k, h: CASE WHEN len(list_filter(k, lambda x: x.s < h[1].e AND h[1].s < x.e)) > 0 THEN k ELSE k || h END)) AS h FROM long)
SELECT doc_id, h.span AS span, h.s AS "start", h.e AS "end" FROM kept"""


@query("span_resolve", RESOLVED_SQL)
def span_resolve(spark, sf):
    """Every place that a text's first word, two words or three words mark, the longest first."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    word = r"[\p{L}\p{N}_]+"
    heads = [F.regexp_extract("text", " ".join([word] * n), 0) for n in (1, 2, 3)]
    spans = docs.select("doc_id", F.explode(F.array_distinct(F.array(*heads))).alias("span")).where(
        "span <> '' AND size(array_distinct(split(lower(span), ' '))) = size(split(span, ' '))")
    return OA.resolve_spans(OA.span_occurrences(docs, spans, "doc_id", "text"), "doc_id")


@query("span_link_targets", """WITH l AS (SELECT page_id, url, regexp_extract(url, '//([^/]*)', 1) AS host FROM pages),
s AS (SELECT page_id, url, unnest([host, upper(host) || '/', url]) AS span FROM l)
SELECT page_id, url AS link, arg_min(span, (-length(span), span)) AS span FROM s GROUP BY page_id, url""")
def span_link_targets(spark, sf):
    """A page's link against its host in two spellings and the whole link, the longest of which wins."""
    pages = table(spark, sf, "pages").select("page_id", "url", F.regexp_extract("url", "//([^/]*)", 1).alias("host"))
    spans = pages.select("page_id", F.explode(F.array("host", F.concat(F.upper("host"), F.lit("/")), "url")).alias("span"))
    return OA.link_targets(pages.select("page_id", F.array("url").alias("links")), spans, "page_id")


# ---- URL scores and fusion ----

URLS = f"""{cte('scored')}, us0 AS (SELECT *, CASE WHEN html_score IS NULL THEN lexical_score ELSE 0.75::DOUBLE * lexical_score + 0.25::DOUBLE * html_score END AS p FROM scored),
us AS (SELECT page_id, msg_id, url, label, p, lexical_score, html_score, CASE WHEN p > 0.9 THEN 'Phishing' ELSE 'Legitimate' END AS url_label,
 round_even(CASE WHEN p > 0.9 THEN p ELSE 1.0::DOUBLE - p END, 4) AS confidence, round_even(p, 4) AS phishing_score FROM us0),
um AS (SELECT msg_id, max(phishing_score) AS url_score, CASE WHEN count(*) FILTER (url_label = 'Phishing') > 0 THEN 'phishing' ELSE 'legitimate' END AS url_layer_label,
 coalesce(list(url ORDER BY page_id) FILTER (url_label = 'Phishing'), [])[:3] AS phishing_urls FROM us GROUP BY msg_id)"""


def scored(spark, sf):
    return OF.url_verdict(OF.url_model_score(view(spark, sf, "scored")))


@query("url_model_score", f"WITH {URLS} SELECT page_id, round_even(p, 6) AS phishing_score FROM us")
def url_model_score(spark, sf):
    return OF.url_model_score(view(spark, sf, "scored")).select("page_id", py_round(F.col("phishing_score"), 6).alias("phishing_score"))


@query("url_verdict", f"WITH {URLS} SELECT page_id, url_label, confidence, phishing_score, CASE WHEN url_label = 'Phishing' THEN 'domain_spoofing' ELSE '' END AS signals FROM us")
def url_verdict(spark, sf):
    return scored(spark, sf).select("page_id", "url_label", "confidence", "phishing_score", F.array_join("signals", ",").alias("signals"))


@query("url_score_by_message", f"WITH {URLS} SELECT msg_id, url_score, url_layer_label, array_to_string(phishing_urls, ' | ') AS phishing_urls FROM um")
def url_score_by_message(spark, sf):
    return OF.url_score_by_message(scored(spark, sf)).select(
        "msg_id", "url_score", "url_layer_label", F.array_join("phishing_urls", " | ").alias("phishing_urls"))


def two(x):
    return f"printf('%.2f', round_even({x}, 2))"


LAYERS = f"""{RULES}, {ANS}, {URLS},
jl AS (SELECT coalesce(r.msg_id, u.msg_id, a.msg_id) AS msg_id, coalesce(m.message_type, 'email') AS message_type, r.verdict, r.reason AS rule_reason,
 CASE WHEN r.verdict = 'PHISHING' THEN 0.9::DOUBLE END AS s1, u.url_score AS s2, CASE WHEN a.label <> 'unknown' AND a.ok THEN a.score END AS s3,
 u.url_layer_label, u.phishing_urls, a.label AS answer_label, a.signals AS answer_signals, a.reason AS answer_reason
 FROM rules r FULL JOIN um u ON u.msg_id = r.msg_id FULL JOIN ascore a ON a.msg_id = coalesce(r.msg_id, u.msg_id) LEFT JOIN messages m ON m.msg_id = r.msg_id),
f0 AS (SELECT *, (s1 IS NOT NULL)::INT + (s2 IS NOT NULL)::INT + (s3 IS NOT NULL)::INT AS n, CASE WHEN s1 IS NULL THEN 0 ELSE 0.05::DOUBLE END AS w1,
 CASE WHEN s2 IS NULL THEN 0 ELSE 0.2::DOUBLE END AS w2, CASE WHEN s3 IS NULL THEN 0 ELSE 0.75::DOUBLE END AS w3 FROM jl),
f1 AS (SELECT *, CASE WHEN n = 0 THEN 0.5::DOUBLE ELSE round_even((w1 / (w1 + w2 + w3) * coalesce(s1, 0) + w2 / (w1 + w2 + w3) * coalesce(s2, 0)) + w3 / (w1 + w2 + w3) * coalesce(s3, 0), 4) END AS risk,
 CASE WHEN n >= 2 THEN round_even(greatest(coalesce(s1, 0), coalesce(s2, 0), coalesce(s3, 0)) - least(coalesce(s1, 9), coalesce(s2, 9), coalesce(s3, 9)), 4) ELSE 0.0 END AS gap FROM f0),
f2 AS (SELECT *, CASE WHEN n = 0 THEN 'unknown' WHEN risk >= 0.65 THEN 'phishing' WHEN risk >= 0.4 OR gap > 0.5 THEN 'suspicious' ELSE 'legit' END AS label,
 CASE WHEN n = 0 THEN 'uncertain' WHEN risk >= 0.75 THEN 'high' WHEN risk >= 0.45 THEN 'medium' ELSE 'low' END AS risk_level,
 CASE WHEN n = 0 THEN 0.0 ELSE CAST(printf('%.4f', least((0.5::DOUBLE + 0.15::DOUBLE * n) * (1 - 0.5::DOUBLE * gap), 1.0)) AS DOUBLE) END AS confidence FROM f1),
fused AS (SELECT *, CASE WHEN label = 'phishing' AND risk_level = 'high' THEN 'block' WHEN label IN ('phishing', 'suspicious') THEN 'warn' WHEN label = 'legit' THEN 'allow' ELSE 'review' END AS action,
 CASE WHEN n = 0 THEN 'No layers returned usable results.' ELSE 'Fusion (' || message_type || '): risk=' || {two('risk')} || ', layers=[' || concat_ws(', ', 'fastscan=' || {two('s1')}, 'catboost=' || {two('s2')}, 'qwen=' || {two('s3')})
 || '], disagreement=' || {two('gap')} END AS fusion_reason FROM f2)"""


def fused(spark, sf):
    rules = rule_layer(spark, sf).select("msg_id", "message_type", "verdict", "reason")
    urls = OF.url_score_by_message(scored(spark, sf))
    ans = layer(spark, sf).select("msg_id", "answer_label", "answer_score", "answer_error",
                                  "answer_signals", "answer_reason", "grounded")
    return OF.fuse(rules, urls, ans)


@query("join_layers", f"WITH {LAYERS} SELECT msg_id, coalesce(verdict, '') AS verdict, coalesce(url_layer_label, '') AS url_layer_label, coalesce(answer_label, '') AS answer_label FROM jl")
def join_layers(spark, sf):
    rules = rule_layer(spark, sf).select("msg_id", "verdict")
    urls = OF.url_score_by_message(scored(spark, sf)).select("msg_id", "url_layer_label")
    ans = layer(spark, sf).select("msg_id", "answer_label")
    return OJ.join_layers(rules, urls, ans).na.fill("")


@query("layer_scores", f"WITH {LAYERS} SELECT msg_id, coalesce(s1, -1) AS rule_score, coalesce(s2, -1) AS url_score, coalesce(s3, -1) AS answer_score FROM jl")
def layer_scores(spark, sf):
    return fused(spark, sf).select("msg_id", *[F.coalesce(a, F.lit(-1.0)).alias(b) for a, b in (
        ("rule_layer_score", "rule_score"), ("url_layer_score", "url_score"), ("answer_layer_score", "answer_score"))])


@query("fuse_verdict", f"WITH {LAYERS} SELECT msg_id, label, risk, risk_level, action, confidence, gap, fusion_reason FROM fused")
def fuse_verdict(spark, sf):
    return fused(spark, sf).select("msg_id", "label", F.col("risk_score").alias("risk"), "risk_level", "action",
                                   "confidence", F.col("disagreement").alias("gap"), "fusion_reason")


@query("risk_level", f"WITH {URLS} SELECT page_id, CASE WHEN p >= 0.75 THEN 'high' WHEN p >= 0.45 THEN 'medium' ELSE 'low' END AS risk_level FROM us")
def risk_level(spark, sf):
    df = OF.url_model_score(view(spark, sf, "scored"))
    return df.select("page_id", OF.risk_level(F.col("phishing_score")).alias("risk_level"))


@query("action", f"""WITH {LAYERS} SELECT label, risk_level, action, count(*) AS n FROM fused GROUP BY ALL""")
def action(spark, sf):
    return fused(spark, sf).groupBy("label", "risk_level", "action").agg(F.count(F.lit(1)).alias("n"))


@query("fusion_evidence", f"""WITH {LAYERS} SELECT msg_id, array_to_string(list_filter(['[FastScan] ' || rule_reason, CASE WHEN s2 IS NOT NULL AND len(phishing_urls) > 0 THEN
 '[CatBoost] Phishing URL(s): ' || array_to_string(phishing_urls, ', ') END, CASE WHEN s3 IS NOT NULL THEN '[Qwen] ' || answer_reason END], lambda x: x IS NOT NULL), ' ## ') AS evidence,
 concat_ws(' | ', CASE WHEN url_layer_label = 'phishing' THEN 'domain_spoofing' END, CASE WHEN s3 IS NOT NULL THEN nullif(answer_signals, '') END) AS signals FROM fused""")
def fusion_evidence(spark, sf):
    return fused(spark, sf).select("msg_id", F.array_join("evidence", " ## ").alias("evidence"),
                                   F.array_join("fused_signals", " | ").alias("signals"))


__all__ = ["A"]
