"""Deterministic views that give the driver tables the shape of the operators' inputs.

Each view is one SQL text both Spark and DuckDB can run, over whole tables.
"""

from __future__ import annotations

from workload.registry import table

NL = "chr(10)"

# documents -> messages: sender, headers and link follow from doc_id, the body is the whole text
MESSAGES = f"""
SELECT doc_id AS msg_id, lang, source,
  CASE WHEN doc_id % 5 = 4 THEN 'sms' ELSE 'email' END AS message_type,
  CASE doc_id % 5 WHEN 0 THEN 'Vietcombank Support <security@vietcombank-secure.com.vn>'
    WHEN 1 THEN 'user' || CAST(doc_id % 17 AS VARCHAR(20)) || '@mail.shopee.vn'
    WHEN 2 THEN 'no-reply@gmail.com'
    WHEN 3 THEN 'Alerts@xn--pple-43d.com' ELSE 'SCB' END AS sender,
  CASE WHEN doc_id % 5 = 4 THEN ''
    ELSE CASE doc_id % 4 WHEN 0 THEN 'Vietcombank notice' WHEN 1 THEN 'Shopee order update'
      WHEN 2 THEN 'Global Trust Bank statement' ELSE '' END END AS subject,
  CASE WHEN doc_id % 5 = 4 AND doc_id % 2 = 0 THEN 'Sacombank: ' ELSE '' END || text || {NL} ||
    CASE doc_id % 6 WHEN 0 THEN 'Please verify your account at '
      WHEN 1 THEN 'This is urgent, act immediately: '
      WHEN 2 THEN 'Enter your password now '
      WHEN 3 THEN 'A refund is waiting, contact us on Zalo: '
      WHEN 4 THEN 'Open the attached file ' ELSE 'See you soon ' END
    || CASE WHEN doc_id % 2 = 0 THEN 'https://' ELSE 'http://' END
    || CASE doc_id % 8 WHEN 0 THEN 'bit.ly' WHEN 1 THEN 'vcb-login.xyz'
      WHEN 2 THEN '192.168.10.7' WHEN 3 THEN 'xn--pypal-4ve.com'
      WHEN 4 THEN 'vietcombank.com.vn' WHEN 5 THEN 'www.shopee.vn'
      WHEN 6 THEN 'secure.account-update.top' ELSE 'news.site-mirror.org' END
    || '/' || lang || '/' || CAST(doc_id AS VARCHAR(20))
    || CASE WHEN doc_id % 3 = 0 THEN '/login?token=1&ref=' || source ELSE '' END
    || CASE WHEN doc_id % 10 = 3 THEN ' \u200bok' ELSE ' .' END AS body,
  CASE WHEN doc_id % 5 = 4 OR doc_id % 4 = 3 THEN NULL ELSE
    'Return-Path: <bounce@' || CASE WHEN doc_id % 7 = 0 THEN 'mailer-daemon.net'
      ELSE 'corp.example-mail.com' END || '>' || {NL} ||
    'From: Customer Care <care@corp.example-mail.com>' || {NL} ||
    'Reply-To: <' || CASE WHEN doc_id % 9 = 0 THEN 'x@reply-box.top' ELSE
      'care@corp.example-mail.com' END || '>' || {NL} ||
    'Message-ID: <' || CAST(doc_id AS VARCHAR(20)) || '@' || CASE WHEN doc_id % 11 = 0
      THEN 'relay.io' ELSE 'corp.example-mail.com' END || '>' || {NL} ||
    'Authentication-Results: mx; spf=' || CASE doc_id % 3 WHEN 0 THEN 'pass' WHEN 1 THEN 'fail'
      ELSE 'softfail' END || '; dkim=' || CASE WHEN doc_id % 13 = 0 THEN 'fail' ELSE 'pass' END
    || '; DMARC = ' || CASE WHEN doc_id % 17 = 0 THEN 'Fail' ELSE 'pass' END END AS headers
FROM documents
"""

# pages -> URLs over a few kinds of host, the original path kept
HOSTS = """
SELECT page_id, html, url AS page_url,
  CASE page_id % 8 WHEN 0 THEN url
    WHEN 1 THEN 'http://bit.ly/' || regexp_replace(url, '^https?://[^/]*/', '')
    WHEN 2 THEN 'https://192.168.10.' || CAST(page_id % 300 AS VARCHAR(20)) || ':8080/'
      || regexp_replace(url, '^https?://[^/]*/', '')
    WHEN 3 THEN 'user:pw@xn--pypal-4ve.com/' || regexp_replace(url, '^https?://[^/]*/', '')
    WHEN 4 THEN 'https://www.Vietcombank.com.vn/' || regexp_replace(url, '^https?://[^/]*/', '')
      || '&a=1&a=2&b'
    WHEN 5 THEN 'HTTP://Login-Secure-Pay.Account1.xyz/setup.exe?otp=1&'
      || CAST(page_id AS VARCHAR(20))
    WHEN 6 THEN 'https://a.b.c.github.io/' || repeat('long-path-', CAST(page_id % 20 AS INT))
      || regexp_replace(url, '^https?://[^/]*/', '')
    ELSE 'hxxp://evil[.]top/' || regexp_replace(url, '^https?://[^/]*/', '') || '.html' END AS url,
  CASE WHEN page_id % 3 = 0 THEN 0 ELSE 1 END AS label
FROM pages
"""

# pages with the markup the generator lacks: images, links, description, scripts, line breaks
PAGES_RICH = f"""
SELECT page_id, url, CASE WHEN page_id % 25 = 24 THEN NULL ELSE
  replace(html, '</head>',
    CASE WHEN page_id % 2 = 0 THEN '<meta name="description" content="About ' ||
      CAST(page_id AS VARCHAR(20)) || '">' ELSE '<meta name="description" content=" ">' END ||
    CASE WHEN page_id % 3 = 0 THEN '<link rel="stylesheet" href="/a.css"><link rel="icon" href="/f.ico">'
      ELSE '' END || '</head>')
  || CASE WHEN page_id % 4 < 2 THEN '<img src="a.png"><IMG alt=x>' ELSE '' END
  || '<a href="https://twitter.com/x">t</a>' || {NL}
  || '<script src="https://cdn.example.net/x.js"></script><script></script>'
  || CASE WHEN page_id % 5 = 0 THEN '<a class=k href=''https://www.facebook.com/p''>f</a>' || chr(13) || {NL}
    ELSE '<a href="mailto:a@b.com">m</a><a href="' || url || '">self</a>' END
  || '<!-- <img src=c.png> -->' END AS html,
  CASE page_id % 9 WHEN 0 THEN 503 WHEN 1 THEN 404 ELSE 200 END AS status_code,
  CASE WHEN page_id % 10 = 3 THEN 'application/pdf' ELSE 'text/html; charset=utf-8' END
    AS content_type,
  CASE WHEN page_id % 3 = 0 THEN 0 ELSE 1 END AS label
FROM pages
"""

# events -> threat feed; a third of all rows share one URL
FEED = """
SELECT event_id AS id, ts AS date,
  CASE WHEN event_id % 3 = 0 THEN 'http://hot.example.top/login'
    ELSE 'http://u' || CAST(user_id AS VARCHAR(20)) || '.feed.' || event_type || '/a' END AS url
FROM events
"""

# labels/documents -> raw structured answers with spans cut from the body
ANSWERS = f"""
SELECT m.msg_id, m.message_type, m.subject, m.sender, m.body, '' AS attachment,
  CASE WHEN coalesce(l.toxic, 0) = 1 THEN 'phishing' ELSE 'legit' END AS gold_label,
  CASE WHEN m.msg_id % 13 = 12 THEN 'no json {{ here'
    ELSE CASE WHEN m.msg_id % 11 = 0 THEN '```json' || {NL} ELSE '' END
      || CASE WHEN m.msg_id % 10 = 7 THEN '<think>maybe {{"label": 1}}</think>' ELSE '' END
      || CASE WHEN m.msg_id % 12 = 5 THEN 'Answer: ' ELSE '' END
      || '{{"label": "' || CASE WHEN (coalesce(l.toxic, 0) = 1) <> (m.msg_id % 9 = 0)
           OR m.msg_id % 4 = 1 THEN 'Phishing' ELSE 'safe' END
      || '", "signals": ["urgency"], "evidence": ['
      || '{{"signal": "call_to_action", "exact_span": "SEE  you soon", "severity": "low"}}, '
      || '{{"signal": "credential_request", "exact_span": "enter your Password", "severity": "high", "char_start": 5, "char_end": 24}}, '
      || '{{"signal": "urgency", "exact_span": "act immediately", "severity": "severe"}}, '
      || '{{"signal": "urgency", "exact_span": "refund", "severity": "low"}}, '
      || '{{"signal": "threat", "exact_span": "bit.ly/en", "severity": "low"}}, '
      || '{{"signal": "other", "exact_span": "the", "severity": "low"}}, '
      || '{{"signal": "financial_lure", "exact_span": "a refund is waiting", "severity": "medium"}}, '
      || '{{"signal": "suspicious_attachment", "exact_span": "' || CASE WHEN m.msg_id % 2 = 0
           THEN 'the attached file' ELSE 'verify your account' END || '", "severity": "high"}}]}}'
      || CASE WHEN m.msg_id % 11 = 0 THEN {NL} || '```' ELSE '' END
      || CASE WHEN m.msg_id % 12 = 5 THEN ' done.' ELSE '' END END AS raw_answer
FROM ({{messages}}) m LEFT JOIN labels l ON l.doc_id = m.msg_id
""".replace("{{", "{").replace("}}", "}").replace("{messages}", MESSAGES)

# pages -> scores as the URL models would give them, several URLs per message
SCORED = """
SELECT page_id, CAST(floor(page_id / 3) AS BIGINT) AS msg_id, url,
  CAST((page_id * 37) % 101 AS DOUBLE) / 100 AS lexical_score,
  CASE WHEN page_id % 4 = 3 THEN NULL ELSE CAST((page_id * 53) % 101 AS DOUBLE) / 100 END
    AS html_score,
  CASE WHEN (page_id * 37 + page_id % 7 * 9) % 101 > 50 THEN 0 ELSE 1 END AS label
FROM pages
"""

# documents + labels -> training corpus in four sources
CORPUS = """
SELECT d.doc_id AS id, d.text, d.lang,
  CASE WHEN d.lang = 'en' THEN CASE WHEN d.doc_id % 3 = 0 THEN 'sms_en' ELSE 'email_en' END
    ELSE CASE WHEN d.doc_id % 3 = 0 THEN 'sms_vie' ELSE 'email_vie' END END AS source,
  CASE WHEN coalesce(l.toxic, 0) = 1 OR d.doc_id % 5 = 0 THEN 1 ELSE 0 END AS label,
  CASE WHEN coalesce(l.toxic, 0) = 1 OR d.doc_id % 5 = 0 THEN CAST(d.doc_id % 5 AS INT) ELSE 0 END
    AS n_evidence
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
"""

BRANDS = {
    "vietcombank": ("vietcombank.com.vn", "vcb.com.vn"),
    "sacombank": ("sacombank.com.vn",),
    "shopee": ("shopee.vn", "shopee.com"),
    "zalo": ("zalo.me",),
    "mb": ("mbbank.com.vn",),
}
BLACKLIST = ("account-update.top", "vcb-login.xyz", "gmail.com", "reply-box.top")

SOURCES = {
    "messages": (MESSAGES, ("documents",)),
    "hosts": (HOSTS, ("pages",)),
    "pages_rich": (PAGES_RICH, ("pages",)),
    "feed": (FEED, ("events",)),
    "answers": (ANSWERS, ("documents", "labels")),
    "scored": (SCORED, ("pages",)),
    "corpus": (CORPUS, ("documents", "labels")),
}


def view(spark, sf_dir: str, name: str):
    """The named bridge view as a DataFrame (no temp views are left behind)."""
    text, tables = SOURCES[name]
    args = {t: table(spark, sf_dir, t) for t in tables}
    text = text.replace("{", "{{").replace("}", "}}")
    for t in tables:
        text = _as_argument(text, t)
    return spark.sql(text, **args)


def _as_argument(text: str, name: str) -> str:
    for word in ("FROM", "JOIN"):
        for end in ("\n", " ", ")"):
            text = text.replace(f"{word} {name}{end}", f"{word} {{{name}}}{end}")
    return text


def cte(*names: str) -> str:
    return ",\n".join(f"{n} AS ({SOURCES[n][0]})" for n in names)
