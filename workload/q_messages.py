"""Message text and rule-layer queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lurelake import params as P
from lurelake.functions import text as T
from lurelake.operators import messages as OM, rules as OR, urls as OU
from workload import duck as D
from workload.bridge import BLACKLIST, BRANDS, cte, view
from workload.registry import query, table

MSGS = cte("messages")
LISTS = P.RuleLists(brands=BRANDS)
LINK_CHAR = "[^\\s\\p{Z}<>''\"\\)\\]]"
EMAIL = "\\b[A-Za-z0-9._%+\\-]+@[A-Za-z0-9.\\-]+\\.[A-Za-z]{2,7}\\b"
BARE = (f"(?i)[^@\\p{{L}}\\p{{N}}_.\\-]((?:[a-zA-Z0-9\\-]{{1,63}}\\.)+(?:{T.BARE_SUFFIXES})"
        f"(?:/{LINK_CHAR}*)?)")
SPACES = "' ' || chr(9) || chr(10) || chr(13) || chr(160)"


def joined(col):
    return F.array_join(col, " | ")


def clean(c):
    return f"trim(replace(replace(coalesce({c}, ''), chr(8203), ''), chr(65279), ''), {SPACES})"


@query("strip_zero_width", f"WITH {MSGS} SELECT msg_id, {clean('body')} AS clean_text FROM messages")
def strip_zero_width(spark, sf):
    return OM.strip_zero_width(view(spark, sf, "messages")).select("msg_id", "clean_text")


@query("nfkc_normalize")
def nfkc_normalize(spark, sf):
    return OM.nfkc_normalize(view(spark, sf, "messages")).select("msg_id", "nfkc")


@query("sender_address", f"""WITH {MSGS} SELECT msg_id, lower(CASE WHEN contains(sender, '<') THEN
 regexp_extract(sender, '<([^>]*)>', 1) ELSE sender END) AS address FROM messages""")
def sender_address(spark, sf):
    return OM.sender_address(view(spark, sf, "messages")).select("msg_id", "address")


def links_cte(source, id_col, text):
    """links(id, i, norm, raw, low): deduplicated links of a text column in order."""
    t = D.undo(text)
    return f"""lk0 AS (SELECT {id_col}, {t} AS t FROM {source}),
lk1 AS (SELECT {id_col}, regexp_extract_all(t, '(?i)https?://{LINK_CHAR}+|www\\.{LINK_CHAR}+')
 || regexp_extract_all(' ' || regexp_replace(t, '{EMAIL}', ' ', 'g'), '{BARE}', 1) AS us FROM lk0),
lk2 AS (SELECT {id_col}, i, trim(us[i], '.,;:!?)"]}}''') AS raw FROM (SELECT *, unnest(range(1, len(us) + 1)) AS i FROM lk1)),
lk3 AS (SELECT {id_col}, i, raw, {D.refang('raw')} AS norm FROM lk2 WHERE raw <> ''),
links AS (SELECT {id_col}, row_number() OVER (PARTITION BY {id_col} ORDER BY i) AS i, raw, norm, lower(norm) AS low
 FROM (SELECT *, row_number() OVER (PARTITION BY {id_col}, lower(norm) ORDER BY i) AS rn FROM lk3) WHERE rn = 1)"""


LINKS_SQL = f"{MSGS}, {links_cte('messages', 'msg_id', 'body')}"


@query("extract_urls", f"WITH {LINKS_SQL} SELECT msg_id, i - 1 AS pos, norm AS url, raw AS raw_url FROM links")
def extract_urls(spark, sf):
    return OM.extract_urls(view(spark, sf, "messages"), text_col="body")


def collapse(c):
    return (f"trim(regexp_replace(regexp_replace(regexp_replace(coalesce({c}, ''), '\\r\\n?', chr(10), 'g'), "
            f"'[ \\t]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), {SPACES})")


def truncated(t, n):
    head = f"left({t}, {n})"
    return (f"CASE WHEN length({t}) <= {n} THEN {t} ELSE coalesce(nullif(trim(regexp_replace({head}, ' [^ ]*$', '')), ''), "
            f"trim({head})) || ' [TRUNCATED]' END")


@query("collapse_whitespace", f"""SELECT doc_id, {collapse("replace(text, '. ', '.  ' || chr(13) || chr(10) || chr(10) || chr(10))")} AS text FROM documents""")
def collapse_whitespace(spark, sf):
    df = table(spark, sf, "documents").select("doc_id", F.replace(
        "text", F.lit(". "), F.lit(".  \r\n\n\n")).alias("text"))
    return OM.collapse_whitespace(df, "text")


@query("truncate_at_word", f"SELECT doc_id, {truncated('text', 500)} AS text FROM documents")
def truncate_at_word(spark, sf):
    return OM.truncate_at_word(table(spark, sf, "documents").select("doc_id", "text"), "text", 500)


PREP = f"""{MSGS}, pr0 AS (SELECT msg_id, message_type, CASE WHEN message_type = 'sms' THEN '' ELSE {collapse('subject')} END AS subject,
 {collapse('sender')} AS sender, {collapse('body')} AS body FROM messages),
prep AS (SELECT msg_id, message_type, {truncated('subject', 500)} AS subject, sender, {truncated('body', 4500)} AS body, '' AS attachment FROM pr0)"""
MASK_LINK = (f"(?:https?://|www\\.){LINK_CHAR}+|(?:[a-z0-9](?:[a-z0-9\\-]{{0,61}}[a-z0-9])?\\.)+"
             f"(?:{T.MASK_SUFFIXES})(?:/{LINK_CHAR}*)?")
# A token is found with one character of context on either side; separators are doubled first
# so that neighbouring tokens never share one.
TOKEN = (f"(?i)(?:\\[(?:{T.TYPED_LINKS})_LINK_\\d+\\]|\\[LINK_\\d+\\]|{T.URL_TOKEN.replace(chr(39), chr(39) * 2)}"
         f"|{MASK_LINK})")


def mask_cte():
    out, n = [PREP], "0"
    for f in ("subject", "sender", "body"):
        out.append(f"""mk_{f} AS (SELECT msg_id, '{f}' AS field, {f} AS txt,
 list_transform(regexp_extract_all(' ' || {f} || ' ', '(?i)[^@\\p{{L}}\\p{{N}}_.\\-]({TOKEN})[^\\p{{L}}\\p{{N}}_.\\-]', 1), lambda x: rtrim(x, '')) AS toks FROM prep)""")
    return ",\n".join(out)


MASK = mask_cte() + """,
tk AS (SELECT *, unnest(range(1, len(toks) + 1)) AS j FROM (SELECT * FROM mk_subject UNION ALL SELECT * FROM mk_sender UNION ALL SELECT * FROM mk_body)),
tk2 AS (SELECT msg_id, field, j, rtrim(toks[j], '.,;:!?)>"''') AS url, row_number() OVER (PARTITION BY msg_id
 ORDER BY CASE field WHEN 'subject' THEN 1 WHEN 'sender' THEN 2 ELSE 3 END, j) AS n FROM tk)"""


@query("mask_links", f"""WITH {MASK} SELECT msg_id, field, url, '[LINK_' || n || ']' AS placeholder FROM tk2""")
def mask_links(spark, sf):
    return OM.link_table(OM.mask_links(OM.prepared_fields(view(spark, sf, "messages"))))


@query("masked_body")
def masked_body(spark, sf):
    return OM.mask_links(OM.prepared_fields(view(spark, sf, "messages"))).select(
        "msg_id", "subject_masked", "sender_masked", "body_masked")


@query("build_prompt", f"""WITH {PREP} SELECT msg_id, concat_ws(chr(10),
 CASE WHEN message_type <> 'sms' AND subject <> '' THEN 'Subject: ' || subject END,
 CASE WHEN sender <> '' THEN 'Sender: ' || sender END, CASE WHEN body <> '' THEN 'Body: ' || body END) AS prompt FROM prep""")
def build_prompt(spark, sf):
    return OM.build_prompt(OM.prepared_fields(view(spark, sf, "messages"))).select("msg_id", "prompt")


@query("build_text", f"""WITH {MSGS} SELECT msg_id, trim(concat_ws(chr(10), 'Subject: ' || nullif(trim(subject), ''),
 'Sender: ' || nullif(trim(sender), ''), 'Body: ' || nullif(trim(body), ''), 'URL: ' || nullif(trim(lang), ''))) AS built_text FROM messages""")
def build_text(spark, sf):
    df = view(spark, sf, "messages").select("msg_id", "subject", "sender", "body", F.col("lang").alias("href"))
    return OM.build_text(df).select("msg_id", "built_text")


def words_sql(ws):
    # separators doubled so that every word has its own boundary characters
    spaced = "regexp_replace(text, '([^\\p{L}\\p{N}_])', '\\1\\1', 'g')"
    return (f"len(regexp_extract_all(' ' || {spaced} || ' ', '(?i)[^\\p{{L}}\\p{{N}}_](?:{'|'.join(ws)})[^\\p{{L}}\\p{{N}}_]'))")


@query("detect_language", f"""SELECT doc_id, CASE WHEN regexp_matches(text, '[{P.VI_ACCENTS}{P.VI_ACCENTS.upper()}]')
 OR {words_sql(P.VI_STOP_WORDS)} > {words_sql(P.EN_STOP_WORDS)} THEN 'VI' ELSE 'EN' END AS language FROM documents""")
def detect_language(spark, sf):
    return OM.detect_language(table(spark, sf, "documents")).select("doc_id", "language")


STOP = {"en": ("the", "and", "of"), "fr": ("le", "la", "et"), "de": ("und", "die", "in")}


@query("stop_word_language", f"""SELECT doc_id, CASE WHEN greatest(e, f, g) = 0 THEN 'EN' WHEN e >= f AND e >= g THEN 'en'
 WHEN f >= g THEN 'fr' ELSE 'de' END AS language FROM (SELECT doc_id, {words_sql(STOP['en'])} AS e, {words_sql(STOP['fr'])} AS f,
 {words_sql(STOP['de'])} AS g FROM documents)""")
def stop_word_language(spark, sf):
    return OM.stop_word_language(table(spark, sf, "documents"), STOP).select("doc_id", "language")


@query("latest_in_thread", """SELECT conv_id, turn, role, text FROM conversations
 QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1""")
def latest_in_thread(spark, sf):
    return OM.latest_in_thread(table(spark, sf, "conversations"))


ROUTE = """SELECT conv_id, turn, CASE turn % 5 WHEN 0 THEN 'mail.google.com' WHEN 1 THEN 'outlook.office.com'
 WHEN 2 THEN 'messages.google.com' WHEN 3 THEN 'www.facebook.com' ELSE 'intranet.example.org' END AS host,
 role || CASE turn % 5 WHEN 0 THEN ' - Gmail' WHEN 1 THEN ' - Outlook' ELSE '' END AS title FROM """


@query("route_channel", f"""SELECT conv_id, turn, CASE WHEN contains(host, 'messages.google') OR contains(host, 'facebook') THEN 'sms'
 ELSE 'email' END AS message_type, CASE WHEN contains(host, 'messages.google') THEN 'SMS Message'
 ELSE trim(replace(replace(title, ' - Gmail', ''), ' - Outlook', '')) END AS subject FROM ({ROUTE} conversations)""")
def route_channel(spark, sf):
    df = spark.sql(ROUTE + "{c}", c=table(spark, sf, "conversations"))
    return OM.route_channel(df).select("conv_id", "turn", "message_type", "subject")


def hits_sql(text, words, limit):
    return f"array_to_string(list_filter({D.lst(sorted(set(words)))}, lambda w: contains({text}, w))[:{limit}], ', ')"


@query("keyword_hits", f"""WITH {MSGS} SELECT msg_id, {hits_sql("lower(subject || chr(10) || body)", P.SENSITIVE_KEYWORDS, 12)} AS sensitive_shown,
 {hits_sql("lower(subject || chr(10) || body)", P.URGENCY_KEYWORDS, 10)} AS urgency_shown FROM messages""")
def keyword_hits(spark, sf):
    return OM.keyword_hits(view(spark, sf, "messages")).select("msg_id", "sensitive_shown", "urgency_shown")


def auth(k):
    return f"coalesce(nullif(lower(regexp_extract(headers, '(?i)\\b{k}\\s*=\\s*([a-zA-Z]+)', 1)), ''), 'none')"


@query("auth_status", f"WITH {MSGS} SELECT msg_id, {auth('spf')} AS spf, {auth('dkim')} AS dkim, {auth('dmarc')} AS dmarc FROM messages")
def auth_status(spark, sf):
    return OM.auth_status(view(spark, sf, "messages")).select("msg_id", "spf", "dkim", "dmarc")


HEAD = f"""{D.SUFFIXES}, hd0 AS (SELECT msg_id, message_type, headers, {D.address_host("regexp_extract(headers, '(?m)^Return-Path: *<?([^> ]*)', 1)")} AS ret,
 {D.address_host("regexp_extract(headers, '(?m)^From: .*<([^>]*)>', 1)")} AS sent,
 {D.address_host("regexp_extract(headers, '(?m)^Reply-To: *<?([^> ]*)', 1)")} AS rep,
 {D.address_host("regexp_extract(headers, '(?m)^Message-ID: *<[^@]*@([^>]*)>', 1)")} AS mid FROM messages),
hd AS (SELECT msg_id, message_type, headers, {D.registered('ret')} AS ret, {D.registered('sent')} AS sent, {D.registered('rep')} AS rep, {D.registered('mid')} AS mid FROM hd0)"""


@query("header_domains", f"""WITH {MSGS}, {HEAD} SELECT msg_id, ret AS return_path_domain, sent AS from_domain,
 rep AS reply_to_domain, mid AS message_id_domain FROM hd""")
def header_domains(spark, sf):
    return OM.header_domains(view(spark, sf, "messages")).select(
        "msg_id", "return_path_domain", "from_domain", "reply_to_domain", "message_id_domain")


# ---- rule layer ----

def info_rows():
    return ", ".join(f"('{k}', '{v[0]}', '{v[1]}', {P.SIGNAL_WEIGHTS[k]}::DOUBLE, {str(k in P.CORE_SIGNALS).lower()})"
                     for k, v in P.SIGNAL_INFO.items())


def brand_rows():
    import re

    return ", ".join(f"('{b}', '{re.sub('[^a-z0-9]', '', b)}', {D.lst(d)}, '{d[0]}')" for b, d in BRANDS.items())


def mention(low, comp):
    return (f"CASE WHEN length(compact) >= 4 THEN contains({comp}, compact) ELSE regexp_matches({low}, "
            f"'(?:^|[^\\p{{L}}\\p{{N}}_])' || brand || '(?:[^\\p{{L}}\\p{{N}}_]|$)') END")


def comp(t):
    return f"regexp_replace({t}, '[^a-z0-9]', '', 'g')"


FOOTER = "|".join(P.FOOTER_PHRASES)
SKIP = sorted(set(P.BLACKLIST_SKIP_DOMAINS) | set(P.FREE_DOMAINS) | {d for v in BRANDS.values() for d in v})
MAIN_D, MAIN_O = "regexp_replace(sender_domain, '[.][^.]*$', '')", "regexp_replace(off1, '[.][^.]*$', '')"
SQUAT = f"""(sender_domain <> '' AND {MAIN_D} <> {MAIN_O} AND (({D.any_of(MAIN_D, P.SQUAT_AFFIXES)} AND contains({MAIN_D}, {MAIN_O}))
 OR (abs(length({MAIN_D}) - length({MAIN_O})) <= 3 AND length({MAIN_D}) > 3 AND length({MAIN_O}) > 3
 AND len(list_intersect(string_split({MAIN_D}, ''), string_split({MAIN_O}, ''))) >= least(length({MAIN_D}), length({MAIN_O})) / 2
 AND levenshtein({MAIN_D}, {MAIN_O}) <= 2)))"""
SHORT_PAIRS = " OR ".join(f"(sc = '{a}' AND compact = '{b}') OR (sc = '{b}' AND compact = '{a}')" for a, b in P.SENDER_SHORT_NAMES.items())
SMS_OK = f"""(sc <> '' AND (sc = compact OR {SHORT_PAIRS} OR (length(sc) >= 3 AND sc NOT IN ({D.quoted(P.GENERIC_SENDERS)})
 AND (contains(compact, sc) OR contains(sc, compact)))))"""

RULES = f"""{MSGS}, {HEAD}, ents AS (SELECT msg_id, regexp_extract(subject, '[A-Z][a-z]+ Trust Bank') AS ent FROM messages),
c0 AS (SELECT msg_id, message_type, {clean('sender')} AS s, {clean('subject')} AS subj, {clean('body')} AS b, body FROM messages),
c1 AS (SELECT *, subj || chr(10) || b AS fulltext, {D.address_host('s')} AS sh FROM c0),
ctx AS (SELECT *, {D.registered('sh')} AS sender_domain, lower(fulltext) AS low, lower(s) AS slow, lower(subj || chr(10) || left(b, 600)) AS early FROM c1),
{links_cte('ctx', 'msg_id', 'fulltext')},
l4 AS (SELECT *, {D.host('norm')} AS h, {D.address_host('norm')} AS ah FROM links),
lnk AS (SELECT msg_id, i, raw, norm, low, regexp_matches(h, '^[0-9]{{1,3}}([.][0-9]{{1,3}}){{3}}$') AS is_ip,
 CASE WHEN regexp_matches(h, '^[0-9]{{1,3}}([.][0-9]{{1,3}}){{3}}$') THEN '' ELSE {D.registered('ah')} END AS domain FROM l4),
ld AS (SELECT l.*, c.sender_domain, list_extract(string_split(domain, '.'), -1) AS tld, {D.any_of('l.low', P.SENSITIVE_KEYWORDS)} AS kw
 FROM lnk l JOIN ctx c USING (msg_id)),
brands(brand, compact, official, off1) AS (VALUES {brand_rows()}),
hit0 AS (SELECT c.msg_id, brand, compact, official, off1, message_type, s, sender_domain, low, {comp('slow')} AS sc,
 {mention('low', comp('low'))} AS in_text, {mention('slow', comp('slow'))} AS in_sender, {mention('early', comp('early'))} AS in_early FROM ctx c, brands),
hit AS (SELECT *, in_sender OR in_early AS claimed FROM hit0 WHERE (in_text OR in_sender) AND NOT (brand = 'zalo' AND in_text
 AND regexp_matches(substr(low, greatest(strpos(low, 'zalo') - 300, 1), strpos(low, 'zalo') + 304 - greatest(strpos(low, 'zalo') - 300, 1)), '(?i){FOOTER}'))),
tgt AS (SELECT msg_id, sender_domain AS d FROM ctx UNION SELECT msg_id, domain FROM lnk),
raw AS (
 SELECT msg_id, 1 AS g, 0 AS a, '' AS z, 1 AS k, 'spf_fail' AS signal, NULL AS matched_text FROM hd WHERE message_type = 'email' AND {auth('spf')} = 'fail'
 UNION ALL SELECT msg_id, 1, 0, '', 2, 'auth_soft_fail', NULL FROM hd WHERE message_type = 'email' AND {auth('spf')} IN ('softfail', 'neutral')
 UNION ALL SELECT msg_id, 1, 0, '', 3, 'dkim_fail', NULL FROM hd WHERE message_type = 'email' AND {auth('dkim')} = 'fail'
 UNION ALL SELECT msg_id, 1, 0, '', 4, 'dmarc_fail', NULL FROM hd WHERE message_type = 'email' AND {auth('dmarc')} = 'fail'
 UNION ALL SELECT msg_id, 1, 0, '', 5, 'header_from_mismatch', NULL FROM hd WHERE message_type = 'email' AND ret <> '' AND sent <> '' AND ret <> sent
 UNION ALL SELECT msg_id, 1, 0, '', 6, 'reply_to_mismatch', NULL FROM hd WHERE message_type = 'email' AND rep <> '' AND sent <> '' AND rep <> sent
 UNION ALL SELECT msg_id, 1, 0, '', 7, 'message_id_mismatch', NULL FROM hd WHERE message_type = 'email' AND mid <> '' AND sent <> '' AND mid <> sent
 UNION ALL SELECT msg_id, 2, 0, '', 0, 'many_urls', NULL FROM links GROUP BY msg_id HAVING count(*) >= 5
 UNION ALL SELECT msg_id, 2, i, '', 1, 'ip_url', norm FROM ld WHERE is_ip
 UNION ALL SELECT msg_id, 2, i, '', 2, 'punycode_domain', domain FROM ld WHERE contains(domain, 'xn--')
 UNION ALL SELECT msg_id, 2, i, '', 3, 'homograph', domain FROM ld WHERE regexp_matches(domain, '[^\\x00-\\x7F]')
 UNION ALL SELECT msg_id, 2, i, '', 4, 'url_shortener', norm FROM ld WHERE domain IN ({D.quoted(P.SHORTENERS)})
 UNION ALL SELECT msg_id, 2, i, '', 5, 'risky_tld', domain FROM ld WHERE tld IN ({D.quoted(P.RISKY_TLDS)})
 UNION ALL SELECT msg_id, 2, i, '', 6, 'no_https_url', norm FROM ld WHERE domain <> '' AND starts_with(raw, 'http://')
 UNION ALL SELECT msg_id, 2, i, '', 7, 'sensitive_url_keyword', norm FROM ld WHERE domain <> '' AND kw
 UNION ALL SELECT DISTINCT msg_id, 2, 100000, domain, 8, 'foreign_domain', domain FROM ld WHERE domain NOT IN ('', sender_domain) AND domain NOT IN ({D.quoted(P.SHORTENERS)})
 UNION ALL SELECT msg_id, 3, 0, d, 0, 'blacklist_hit', d FROM tgt WHERE d IN ({D.quoted(BLACKLIST)}) AND d NOT IN ({D.quoted(SKIP)})
 UNION ALL SELECT msg_id, 4, 0, brand, 1, 'trusted_sender', sender_domain FROM hit WHERE claimed AND message_type = 'email' AND list_contains(official, sender_domain)
 UNION ALL SELECT msg_id, 4, 0, brand, 1, 'trusted_sender', s FROM hit WHERE claimed AND message_type = 'sms' AND {SMS_OK}
 UNION ALL SELECT msg_id, 4, 0, brand, 2, 'entity_impersonation', s FROM hit WHERE claimed AND message_type = 'email' AND NOT list_contains(official, sender_domain)
 UNION ALL SELECT msg_id, 4, 0, brand, 2, 'entity_impersonation', s FROM hit WHERE claimed AND message_type = 'sms' AND NOT {SMS_OK}
 UNION ALL SELECT msg_id, 4, 0, brand, 3, 'cybersquatting', sender_domain FROM hit WHERE claimed AND message_type = 'email' AND NOT list_contains(official, sender_domain) AND {SQUAT}
 UNION ALL SELECT l.msg_id, 4, 0, brand, 3 + i, CASE WHEN list_contains(official, domain) THEN 'official_link' ELSE 'brand_link_mismatch' END, norm
  FROM ld l JOIN hit h ON l.msg_id = h.msg_id WHERE domain <> '' AND domain NOT IN ({D.quoted(P.SHORTENERS)}) AND (list_contains(official, domain) OR (kw AND claimed))
 UNION ALL SELECT e.msg_id, 4, 1, '', 0, 'unknown_entity_mentioned', ent FROM ents e JOIN ctx c ON c.msg_id = e.msg_id WHERE ent <> '' AND contains(early, lower(ent))
 UNION ALL SELECT msg_id, 5, 0, '', 1, 'sensitive_content_keyword', kws FROM (SELECT msg_id, {hits_sql('low', P.SENSITIVE_KEYWORDS, 12)} AS kws FROM ctx) WHERE kws <> ''
 UNION ALL SELECT msg_id, 5, 0, '', 2, 'urgency_keyword', kws FROM (SELECT msg_id, {hits_sql('low', P.URGENCY_KEYWORDS, 10)} AS kws FROM ctx) WHERE kws <> ''
 UNION ALL SELECT msg_id, 5, 0, '', 3, 'hidden_text_detected', NULL FROM ctx WHERE contains(body, chr(8203)) OR contains(body, chr(65279))),
info(signal, severity, title, weight, core) AS (VALUES {info_rows()}),
bo AS (SELECT brand, row_number() OVER () AS bi FROM brands),
sig0 AS (SELECT r.*, coalesce(bi, 0) AS bi FROM raw r LEFT JOIN bo ON bo.brand = r.z AND r.g = 4),
sig AS (SELECT s.msg_id, s.signal, severity, CASE WHEN message_type = 'sms' AND s.signal = 'trusted_sender' THEN 'Legitimate Brandname SMS Signature'
  WHEN message_type = 'sms' AND s.signal = 'entity_impersonation' THEN 'Spoofed Brandname SMS Content' ELSE title END AS title, matched_text, weight, core, g, a, z, k, s.bi
 FROM (SELECT *, row_number() OVER (PARTITION BY msg_id, signal, lower(coalesce(matched_text, '')) ORDER BY g, a, bi, z, k) AS rn FROM sig0) s
 JOIN info i ON i.signal = s.signal JOIN messages m ON m.msg_id = s.msg_id WHERE rn = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY msg_id ORDER BY CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END DESC,
 g, a, CASE WHEN g = 4 THEN bi ELSE 0 END, CASE WHEN g = 4 THEN '' ELSE z END, k) AS rk FROM sig),
ordered AS (SELECT c.msg_id, list(weight ORDER BY rk) FILTER (weight IS NOT NULL) AS ws, max(weight) FILTER (core) AS mx,
 list(weight ORDER BY rk) FILTER (NOT core AND weight > 0) AS pos, list(-weight ORDER BY rk) FILTER (NOT core AND weight < 0) AS neg
 FROM ctx c LEFT JOIN ranked USING (msg_id) GROUP BY c.msg_id),
score AS (SELECT msg_id, greatest(0, least(1, coalesce(mx, 0.0)::DOUBLE + least(CASE WHEN coalesce(mx, 0) > 0 THEN 0.20::DOUBLE ELSE 0.15::DOUBLE END,
 list_reduce(coalesce(pos, []), lambda a, b: a + b, 0.0::DOUBLE)) - list_reduce(coalesce(neg, []), lambda a, b: a + b, 0.0::DOUBLE))) AS score FROM ordered),
verd0 AS (SELECT s.msg_id, score, coalesce(list(signal ORDER BY rk) FILTER (signal IS NOT NULL), []) AS names, coalesce(list(title ORDER BY rk) FILTER (title IS NOT NULL), []) AS titles
 FROM score s LEFT JOIN ranked r ON r.msg_id = s.msg_id GROUP BY s.msg_id, score)"""


def verdict_cases():
    when = " ".join(
        f"WHEN {' AND '.join(f'list_contains(names, {chr(39)}{n}{chr(39)})' for n in need)} THEN '{text}'"
        for need, text in P.VERDICT_RULES)
    return f"CASE {when} WHEN score >= 0.5 THEN '{P.SUSPICIOUS_REASON}' || array_to_string(titles[:3], ', ') ELSE '{P.UNKNOWN_REASON}' END"


RULES += f""",
verd AS (SELECT *, {verdict_cases()} AS reason FROM verd0),
rules AS (SELECT *, CASE WHEN starts_with(reason, '{P.SUSPICIOUS_REASON}') THEN 'SUSPICIOUS' WHEN reason = '{P.UNKNOWN_REASON}' THEN 'UNKNOWN' ELSE 'PHISHING' END AS verdict FROM verd)"""


def rule_input(spark, sf):
    m = view(spark, sf, "messages")
    ent = F.regexp_extract("subject", "[A-Z][a-z]+ Trust Bank", 0)
    return m.withColumn("entities", F.array_compact(F.array(F.when(ent != "", ent))))


def blacklist(spark):
    return spark.createDataFrame([(d,) for d in BLACKLIST], "domain string")


def rule_layer(spark, sf):
    return OR.rule_layer(rule_input(spark, sf), LISTS, blacklist(spark))


KEYS = {
    "sig_spf_fail": "spf_fail", "sig_auth_soft_fail": "auth_soft_fail", "sig_dkim_fail": "dkim_fail",
    "sig_dmarc_fail": "dmarc_fail", "sig_header_from_mismatch": "header_from_mismatch",
    "sig_reply_to_mismatch": "reply_to_mismatch", "sig_message_id_mismatch": "message_id_mismatch",
    "sig_blacklist_hit": "blacklist_hit", "sig_many_urls": "many_urls", "sig_ip_url": "ip_url",
    "sig_punycode_domain": "punycode_domain", "sig_homograph": "homograph",
    "sig_url_shortener": "url_shortener", "sig_risky_tld": "risky_tld", "sig_no_https_url": "no_https_url",
    "sig_sensitive_url_keyword": "sensitive_url_keyword", "sig_foreign_domain": "foreign_domain",
    "sig_trusted_sender": "trusted_sender", "sig_entity_impersonation": "entity_impersonation",
    "sig_cybersquatting": "cybersquatting", "sig_official_link": "official_link",
    "sig_brand_link_mismatch": "brand_link_mismatch", "sig_unknown_entity": "unknown_entity_mentioned",
    "sig_sensitive_content_keyword": "sensitive_content_keyword", "sig_urgency_keyword": "urgency_keyword",
    "sig_hidden_text": "hidden_text_detected",
}


def _signal_query(key, name):
    @query(key, f"WITH {RULES} SELECT msg_id, signal, severity, title, coalesce(matched_text, '') AS matched_text FROM sig WHERE signal = '{name}'")
    def run(spark, sf):
        feed = blacklist(spark) if name == "blacklist_hit" else None
        found = OR.rule_signals(rule_input(spark, sf), LISTS, feed, only=(name,))
        return OR.signal_table(found).select("msg_id", "signal", "severity", "title", F.coalesce(
            "matched_text", F.lit("")).alias("matched_text"))


for _k, _v in KEYS.items():
    _signal_query(_k, _v)


@query("rule_signals", f"WITH {RULES} SELECT msg_id, rk AS rank, signal, severity, title, coalesce(matched_text, '') AS matched_text FROM ranked")
def rule_signals(spark, sf):
    found = OR.signal_order(OR.rule_signals(rule_input(spark, sf), LISTS, blacklist(spark)))
    return OR.signal_table(found).select(
        "msg_id", (F.col("pos") + 1).alias("rank"), "signal", "severity", "title",
        F.coalesce("matched_text", F.lit("")).alias("matched_text"))


@query("signal_order", f"WITH {RULES} SELECT msg_id, array_to_string(names, ' | ') AS names FROM verd0")
def signal_order(spark, sf):
    found = OR.signal_order(OR.rule_signals(rule_input(spark, sf), LISTS, blacklist(spark)))
    return found.select("msg_id", joined(F.transform("signals", lambda s: s["signal"])).alias("names"))


@query("brand_mentions", f"WITH {RULES} SELECT msg_id, brand FROM hit0 WHERE in_text OR in_sender")
def brand_mentions(spark, sf):
    from lurelake.operators import joins as OJ

    brands = spark.createDataFrame([(b,) for b in BRANDS], "brand string")
    m = view(spark, sf, "messages").select("msg_id", F.concat_ws("\n", "subject", "body").alias("text"), "sender")
    both = OJ.brand_mentions(m, brands, "text").unionByName(OJ.brand_mentions(m, brands, "sender"))
    return both.distinct()


@query("brand_claimed", f"WITH {RULES} SELECT msg_id, brand FROM hit WHERE claimed")
def brand_claimed(spark, sf):
    rules = OR.rule_signals(rule_input(spark, sf), LISTS, only=OR.ENTITY)
    return rules.select("msg_id", F.explode("brands").alias("b")).where("b.claimed").select("msg_id", "b.brand")


@query("footer_suppress", f"WITH {RULES} SELECT msg_id, brand FROM hit")
def footer_suppress(spark, sf):
    rules = OR.rule_signals(rule_input(spark, sf), LISTS, only=OR.ENTITY)
    return rules.select("msg_id", F.explode("brands").alias("b")).select("msg_id", "b.brand")


@query("sms_sender_valid", f"""WITH {RULES}, sv AS (SELECT msg_id, brand, {comp('slow')} AS sc, compact FROM ctx, brands WHERE message_type = 'sms')
SELECT msg_id, brand, CAST({SMS_OK} AS INT) AS valid FROM sv""")
def sms_sender_valid(spark, sf):
    from lurelake.functions import brands as B

    m = view(spark, sf, "messages").where("message_type = 'sms'")
    each = m.select("msg_id", "sender", F.explode(B.brand_table(BRANDS)).alias("b"))
    return each.select("msg_id", "b.brand", B.sms_sender_valid(
        F.col("sender"), F.col("b.compact")).cast("int").alias("valid"))


@query("rule_score", f"WITH {RULES} SELECT msg_id, round(score, 6) AS score FROM score")
def rule_score(spark, sf):
    return rule_layer(spark, sf).select("msg_id", F.round("score", 6).alias("score"))


@query("rule_verdict", f"WITH {RULES} SELECT msg_id, round(score, 6) AS score, verdict, reason FROM rules")
def rule_verdict(spark, sf):
    return rule_layer(spark, sf).select("msg_id", F.round("score", 6).alias("score"), "verdict", "reason")


@query("fast_lane", f"WITH {RULES} SELECT verdict, count(*) AS n, round(avg(round(score, 6)), 6) AS avg_score FROM rules GROUP BY verdict")
def fast_lane(spark, sf):
    return rule_layer(spark, sf).groupBy("verdict").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(F.round("score", 6)), 6).alias("avg_score"))


@query("rule_details", f"""WITH {RULES}, u AS (SELECT msg_id, count(*) AS n, coalesce(string_agg(DISTINCT domain, ' | ' ORDER BY domain) FILTER (domain <> ''), '') AS ds,
 coalesce(string_agg(norm, ' | ' ORDER BY i) FILTER (domain IN ({D.quoted(P.SHORTENERS)})), '') AS sh FROM lnk GROUP BY msg_id)
SELECT v.msg_id, coalesce(u.n, 0) AS url_count, len(names) AS signal_count, coalesce(ds, '') AS url_domains, coalesce(sh, '') AS shortener_urls,
 coalesce((SELECT string_agg(DISTINCT brand, ' | ' ORDER BY brand) FROM hit h WHERE h.msg_id = v.msg_id AND claimed), '') AS claimed
FROM verd0 v LEFT JOIN u USING (msg_id)""")
def rule_details(spark, sf):
    return OR.rule_details(rule_layer(spark, sf)).select(
        "msg_id", "url_count", "signal_count", joined(F.col("url_domains")).alias("url_domains"),
        joined(F.col("shortener_urls")).alias("shortener_urls"),
        joined(F.col("claimed_entities")).alias("claimed"))


__all__ = ["OU"]
