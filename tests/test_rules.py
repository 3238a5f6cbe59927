"""Hand-made messages with verdicts worked out from the rules."""

import pytest

from lurelake import params as P
from lurelake.operators import rules as R

BRANDS = {
    "northbank": ["northbank.com.vn", "nb-online.com"],
    "harborpay": ["harborpay.com.vn"],
    "quickmart": ["quickmart.vn", "quickmart.com"],
    "zalo": ["zalo.me"],
}
SCHEMA = ("msg_id long, message_type string, sender string, subject string, body string, "
          "headers string")
ROWS = [
    (1, "sms", "HRB", "Card", "Harborpay: please verify your card at http://harborpay.vn/verify-card", None),
    (2, "email", "orders@quickmart.vn", "Your parcel", "Follow it on quickmart.vn/parcel any time.", None),
    (3, "email", "Northbank Care <care@northbank-secure.com.vn>", "Locked",
     "Northbank has locked your card. Sign in at https://northbank-secure.com.vn/login", None),
    (4, "email", "a@b.com", "", "hello\u200b world", "Return-Path: <x@evil.top>\nFrom: A <a@b.com>"
     "\nspf=fail dkim=fail dmarc=fail"),
    (5, "email", "x@listed.top", "", "plain", None),
    (6, "email", "a@b.com", "", "Follow us on Zalo: zalo.me/page", None),
    (7, "email", "", "", "", None),
    (9, "email", "a@northbamk.com.vn", "Northbank", "plain words", None),
    (8, "email", "a@b.com", "", "go to http://10.0.0.1/x and http://999.1.1.1/y", None),
]


@pytest.fixture(scope="module")
def result(spark):
    messages = spark.createDataFrame(ROWS, SCHEMA)
    feed = spark.createDataFrame([("listed.top",), ("gmail.com",)], "domain string")
    out = R.rule_layer(messages, P.RuleLists(brands=BRANDS), feed)
    return {r["msg_id"]: r for r in out.collect()}


def names(row):
    return {s["signal"] for s in row["signals"]}


def test_sms_short_sender_is_not_a_brand_sender(result):
    assert "entity_impersonation" in names(result[1])
    assert "brand_link_mismatch" in names(result[1])
    assert result[1]["verdict"] == "PHISHING"


def test_bare_link_raises_no_https_signal(result):
    assert "no_https_url" not in names(result[2])
    assert {"trusted_sender", "official_link"} <= names(result[2])
    assert result[2]["verdict"] == "UNKNOWN"


def test_impersonation_with_a_mismatched_link(result):
    # main labels northbank-secure.com and northbank.com: neither contained nor close
    assert {"entity_impersonation", "brand_link_mismatch"} <= names(result[3])
    assert "cybersquatting" not in names(result[3])
    assert result[3]["verdict"] == "PHISHING"


def test_look_alike_domain_is_phishing(result):
    assert {"entity_impersonation", "cybersquatting"} <= names(result[9])
    assert result[9]["verdict"] == "PHISHING"


def test_header_signals_and_hidden_text(result):
    assert {"spf_fail", "dkim_fail", "dmarc_fail", "header_from_mismatch",
            "hidden_text_detected"} <= names(result[4])
    # 0.80 core + min(0.20, 0.20 + 0.20 + 0.15)
    assert abs(result[4]["score"] - 1.0) < 1e-9


def test_blacklist_and_footer_and_empty(result):
    assert names(result[5]) >= {"blacklist_hit"}
    assert result[5]["verdict"] == "PHISHING"
    assert result[6]["brands"] == []
    assert result[7]["reason"] == "Empty content payload context."


def test_only_valid_octets_make_an_ip_url(result):
    matched = [s["matched_text"] for s in result[8]["signals"] if s["signal"] == "ip_url"]
    assert matched == ["http://10.0.0.1/x"]


def test_filter_on_the_verdict_stays_plannable(spark):
    messages = spark.createDataFrame(ROWS, SCHEMA)
    out = R.rule_layer(messages, P.RuleLists(brands=BRANDS)).where("verdict = 'PHISHING'")
    assert {r["msg_id"] for r in out.select("msg_id").collect()} == {1, 3, 9}


def test_feed_of_urls_finds_the_sixth_link(spark):
    """Every link is looked up, feed entries are URLs, equal ids and rows without targets stay."""
    body = " ".join(f"http://site{k}.org/p" for k in range(6))
    rows = [(1, "email", "a@b.com", "", body, None), (1, "email", "a@b.com", "", "plain", None),
            (None, "email", "a@b.com", "", "see http://x.site5.org", None), (2, "sms", "", "", "", None), (2, "sms", "", "", "", None)]
    feed = spark.createDataFrame([("http://www.site5.org/login?a=1",), ("hxxp://other[.]top",), ("",), (None,)], "domain string")
    messages = spark.createDataFrame(rows, SCHEMA)
    out = R.rule_layer(messages, P.RuleLists(), feed).collect()
    hits = sorted((r["msg_id"] or 0, [s["matched_text"] for s in r["signals"] if s["signal"] == "blacklist_hit"]) for r in out)
    assert hits == [(0, ["site5.org"]), (1, []), (1, ["site5.org"]), (2, []), (2, [])]
    first = R.rule_layer(messages, P.RuleLists(feed_links=5), feed).where("msg_id = 1").collect()
    assert not any(s["signal"] == "blacklist_hit" for r in first for s in r["signals"])


ODD_TEXTS = [
    "", " ", "plain words", "  a b　\n", "end \x85", "\xa0 x\ty \r\n\r\r\n\n z  w ",
    "see http://a.com/x, (www.b.vn) or mail me@c.net now", "hxxps://d[.]top/q a.b@e.com.vn f.xyz", "g.com\nh.com i.com,j.com",
    "[LINK_3] <URL> [[URL]] [FORM_REGISTRATION_LINK_2] <|URL|> k.org.", "http://localhost/ x@y.top www.z.com@", "﷐ l.com m.com",
]


def test_texts_are_searched_by_pieces_as_a_whole(spark):
    """Links, gaps, ends and blanks by the quick forms equal those of one pattern over the whole text."""
    from pyspark.sql import functions as F

    from lurelake.functions import text as T, urls as U

    df = spark.createDataFrame([(i, t) for i, t in enumerate(ODD_TEXTS)], "id long, t string")
    whole, t = U.defang_undo(F.col("t")), F.col("t")
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(t, "\r\n?", "\n"), "[ \t]+", " "), "\n{3,}", "\n\n")
    ends = r"^[\s\p{Z}]+|[\s\p{Z}]+$"
    for quick, slow in (
        (T.stripped(t), F.regexp_replace(t, ends, "")),
        (T.collapse_whitespace(t), F.regexp_replace(plain, ends, "")),
        (T.link_tokens(t), F.regexp_extract_all(t, F.lit(T.LINK_TOKEN), F.lit(0))),
        (T.link_gaps(t), F.split(t, T.LINK_TOKEN)),
        (T.compact(t), F.regexp_replace(F.lower(t), "[^a-z0-9]", "")),
        (F.regexp_extract_all(U.defang_undo(T.pieces_with(t, ".", "://")), F.lit(T.EXPLICIT_URL), F.lit(0)),
         F.regexp_extract_all(whole, F.lit(T.EXPLICIT_URL), F.lit(0))),
        (F.regexp_extract_all(F.regexp_replace(U.defang_undo(T.pieces_with(t, ".", "://")), T.EMAIL, " "), F.lit(T.BARE_DOMAIN), F.lit(0)),
         F.regexp_extract_all(F.regexp_replace(whole, T.EMAIL, " "), F.lit(T.BARE_DOMAIN), F.lit(0))),
    ):
        for row in df.select("t", quick.alias("a"), slow.alias("b")).collect():
            assert row.a == row.b, row


def test_keywords_and_bounded_brands(spark):
    from pyspark.sql import functions as F

    from lurelake.functions import brands as B
    from lurelake.functions.arrays import contained_words

    rows = [("verify the account",), ("mã otp của bạn",), ("mb",), ("lamb mb.",), ("amb mbx", ), (None,)]
    df = spark.createDataFrame(rows, "t string")
    got = df.select(contained_words(F.col("t"), ("account", "mã otp", "otp", "otp")).alias("w"),
                    F.regexp_like("t", B.bounded(F.lit("mb"))).alias("b")).collect()
    assert [r.w for r in got] == [["account"], ["mã otp", "otp"], [], [], [], []]
    assert [r.b for r in got] == [False, False, True, True, False, None]
