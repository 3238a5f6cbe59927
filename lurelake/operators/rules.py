"""The rule layer: messages -> signals -> score and verdict.

All signals of a message are built as one array inside its row.  The layer is a map-only
job over the message table; only a threat-feed table (``blacklist``) adds a join, and that
join carries the narrow signal rows, never the message bodies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lurelake import params as P
from lurelake.functions import brands as B, text as T, urls as U
from lurelake.functions.arrays import (
    any_contained, contained_words, exploded, first_by_key, in_list, let, literal_array,
    weighted_lookup,
)

SIGNAL_TYPE = (
    "array<struct<signal:string,severity:string,title:string,matched_text:string,"
    "confidence:double,domain:string,entity:string>>"
)
AUTH = ("spf_fail", "auth_soft_fail", "dkim_fail", "dmarc_fail", "header_from_mismatch",
        "reply_to_mismatch", "message_id_mismatch")
LINK = ("many_urls", "ip_url", "punycode_domain", "homograph", "url_shortener", "risky_tld",
        "no_https_url", "sensitive_url_keyword", "foreign_domain")
ENTITY = ("trusted_sender", "entity_impersonation", "cybersquatting", "official_link",
          "brand_link_mismatch", "unknown_entity_mentioned")
CONTENT = ("sensitive_content_keyword", "urgency_keyword", "hidden_text_detected")


def _signal(name: str, matched: Column | None = None, domain: Column | None = None,
            title: Column | None = None) -> Column:
    severity, default_title = P.SIGNAL_INFO[name]
    return F.struct(
        F.lit(name).alias("signal"),
        F.lit(severity).alias("severity"),
        (F.lit(default_title) if title is None else title).alias("title"),
        (F.lit(None).cast("string") if matched is None else matched).alias("matched_text"),
        F.lit(1.0).alias("confidence"),
        (F.lit("") if domain is None else domain).alias("domain"),
        F.lit("").alias("entity"),
    )


def _none() -> Column:
    return F.array().cast(SIGNAL_TYPE)


def _present(*signals: Column) -> Column:
    return F.array_compact(F.array(*signals))


def message_context(messages: DataFrame, lists: P.RuleLists, id_col: str = "msg_id") -> DataFrame:
    """Cleaned fields, sender domain and analysed links of every message."""
    low = F.lower
    out = (
        messages.withColumn("_sender", T.strip_zero_width(F.col("sender")))
        .withColumn("_body", T.strip_zero_width(F.col("body")))
        .withColumn("_subject", T.strip_zero_width(F.col("subject")))
        .withColumn("_full", F.concat_ws("\n", "_subject", "_body"))
        .withColumn("_shost", U.address_host(F.col("_sender")))
        .withColumn("sender_domain", U.registered_of_host(F.col("_shost"), lists.suffixes))
    )
    found = T.extract_links(F.col("_full"))
    if "urls" in messages.columns:
        found = F.when(F.col("urls").isNotNull(), T.provided_links(F.col("urls"))).otherwise(found)
    out = out.withColumn("_links", found)
    out = out.withColumn("_links", F.transform("_links", lambda s: F.struct(
        s["norm"].alias("norm"), s["raw"].alias("raw"), low(s["norm"]).alias("low"),
        U.is_ipv4(U.host(s["norm"])).alias("is_ip"), U.address_host(s["norm"]).alias("host"))))
    return out.withColumn("_links", F.transform("_links", lambda s: F.struct(
        s["norm"].alias("norm"), s["raw"].alias("raw"), s["low"].alias("low"),
        s["is_ip"].alias("is_ip"),
        F.when(s["is_ip"], F.lit("")).otherwise(
            U.registered_of_host(s["host"], lists.suffixes)).alias("domain"))))


def _auth_signals(suffixes) -> Column:
    h = F.col("headers")
    facts = F.struct(
        *[T.auth_status(h, k).alias(k) for k in ("spf", "dkim", "dmarc")],
        *[T.header_domain(h, k, suffixes).alias(a) for k, a in (
            ("Return-Path", "ret"), ("From", "sent"), ("Reply-To", "reply"),
            ("Message-ID", "mid"))],
    )

    def signals(f):
        def differs(name):
            return (f[name] != "") & (f["sent"] != "") & (f[name] != f["sent"])

        return _present(
            F.when(f["spf"] == "fail", _signal("spf_fail")),
            F.when(f["spf"].isin("softfail", "neutral"), _signal("auth_soft_fail")),
            F.when(f["dkim"] == "fail", _signal("dkim_fail")),
            F.when(f["dmarc"] == "fail", _signal("dmarc_fail")),
            F.when(differs("ret"), _signal("header_from_mismatch")),
            F.when(differs("reply"), _signal("reply_to_mismatch")),
            F.when(differs("mid"), _signal("message_id_mismatch")),
        )

    usable = (F.col("message_type") == "email") & (F.coalesce(h, F.lit("")) != "")
    return F.when(usable, let(facts, signals)).otherwise(_none())


def _link_signals(lists: P.RuleLists) -> Column:
    links = F.col("_links")
    short = list(lists.shorteners)

    def of_link(s):
        d, u = s["domain"], s["norm"]
        named = ~s["is_ip"] & (d != "")
        tld = U.suffix_of(d, lists.suffixes)
        return F.array_compact(F.array(
            F.when(s["is_ip"], _signal("ip_url", u)),
            F.when(named & d.contains("xn--"), _signal("punycode_domain", d)),
            F.when(named & ~d.contains("xn--") & d.rlike(r"[^\x00-\x7F]"), _signal("homograph", d)),
            F.when(named & in_list(d, short), _signal("url_shortener", u)),
            F.when(named & in_list(tld, lists.risky_tlds), _signal("risky_tld", d)),
            F.when(named & s["raw"].startswith("http://"), _signal("no_https_url", u)),
            F.when(named & any_contained(s["low"], lists.sensitive_keywords),
                   _signal("sensitive_url_keyword", u)),
        ))

    domains = F.array_sort(F.array_distinct(F.transform(
        F.filter(links, lambda s: (s["domain"] != "") & (s["domain"] != F.col("sender_domain"))
                 & ~in_list(s["domain"], short)), lambda s: s["domain"])))
    return F.concat(
        _present(F.when(F.size(links) >= 5, _signal("many_urls"))),
        F.flatten(F.transform(links, of_link)),
        F.transform(domains, lambda d: _signal("foreign_domain", d)),
    )


def brand_hits(context: DataFrame, lists: P.RuleLists) -> DataFrame:
    """Add ``_hits``: detected brands with the flags in_text, in_sender and claimed."""
    out = (
        context.withColumn("_low", F.lower("_full"))
        .withColumn("_low_sender", F.lower("_sender"))
        .withColumn("_early", F.lower(F.concat_ws(
            "\n", F.col("_subject"), F.left(F.col("_body"), F.lit(600)))))
        .withColumn("_c_full", T.compact(F.col("_low")))
        .withColumn("_c_sender", T.compact(F.col("_low_sender")))
        .withColumn("_c_early", T.compact(F.col("_early")))
    )
    if not lists.brands:
        empty = ("array<struct<brand:string,compact:string,words:array<string>,"
                 "official:array<string>,first_official:string,in_text:boolean,"
                 "in_sender:boolean,claimed:boolean>>")
        return out.withColumn("_hits", F.array().cast(empty))
    entities = F.col("entities") if "entities" in context.columns else None

    def flags(b):
        seen = B.mentioned(b["brand"], b["compact"], F.col("_low"), F.col("_c_full"))
        if entities is not None:
            seen = seen | F.coalesce(
                B.named_entity(b["brand"], b["words"], entities), F.lit(False))
        sender = B.mentioned(b["brand"], b["compact"], F.col("_low_sender"), F.col("_c_sender"))
        early = B.mentioned(b["brand"], b["compact"], F.col("_early"), F.col("_c_early"))
        return F.struct(
            b["brand"].alias("brand"), b["compact"].alias("compact"), b["words"].alias("words"),
            b["official"].alias("official"), b["first_official"].alias("first_official"),
            seen.alias("in_text"), sender.alias("in_sender"), (sender | early).alias("claimed"))

    out = out.withColumn("_hits", F.transform(
        B.brand_table(lists.brands, lists.suffixes), flags))
    out = out.withColumn("_hits", F.filter("_hits", lambda b: b["in_text"] | b["in_sender"]))
    footer = [b for b in P.FOOTER_SAFE_BRANDS if b in {k.lower().strip() for k in lists.brands}]
    for brand in footer:
        suppressed = B.footer_context(brand, F.col("_low"))
        out = out.withColumn("_hits", F.filter("_hits", lambda b: ~(
            (b["brand"] == brand) & b["in_text"] & suppressed)))
    return out


def _entity_signals(lists: P.RuleLists, has_entities: bool) -> Column:
    sender, domain, links = F.col("_sender"), F.col("sender_domain"), F.col("_links")
    is_sms = F.col("message_type") == "sms"
    is_email = F.col("message_type") == "email"
    short = list(lists.shorteners)

    def of_brand(b):
        official = (domain != "") & F.array_contains(b["official"], domain)
        valid_sms = B.sms_sender_valid(sender, b["compact"])
        squat = U.squatting(domain, b["first_official"])
        own = F.array_compact(F.array(
            F.when(b["claimed"] & is_email & official, _signal("trusted_sender", domain)),
            F.when(b["claimed"] & is_email & ~official, _signal("entity_impersonation", sender)),
            F.when(b["claimed"] & is_email & ~official & squat, _signal("cybersquatting", domain)),
            F.when(b["claimed"] & is_sms & valid_sms, _signal(
                "trusted_sender", sender, title=F.lit(P.SMS_TITLES["trusted_sender"]))),
            F.when(b["claimed"] & is_sms & ~valid_sms, _signal(
                "entity_impersonation", sender,
                title=F.lit(P.SMS_TITLES["entity_impersonation"]))),
        ))
        usable = F.filter(links, lambda s: (s["domain"] != "") & ~in_list(s["domain"], short))
        of_links = F.transform(usable, lambda s: F.when(
            F.array_contains(b["official"], s["domain"]), _signal("official_link", s["norm"])
        ).when(b["claimed"] & any_contained(s["low"], lists.sensitive_keywords),
               _signal("brand_link_mismatch", s["norm"])))
        return F.concat(own, F.array_compact(of_links))

    out = F.flatten(F.transform("_hits", of_brand))
    if has_entities:
        names = [b.lower() for b in lists.brands]

        def unknown(e):
            low = F.lower(F.trim(e))
            comp = T.compact(low)
            near = B.mentioned(low, comp, F.col("_early"), F.col("_c_early")) | B.mentioned(
                low, comp, F.col("_low_sender"), F.col("_c_sender"))
            known = in_list(low, names) if names else F.lit(False)
            return F.when(~known & (F.length(low) > 3) & B.org_like(low) & near,
                          _signal("unknown_entity_mentioned", e))

        out = F.concat(out, F.array_compact(F.transform(
            F.coalesce(F.col("entities"), F.array().cast("array<string>")), unknown)))
    return out


def _content_signals(lists: P.RuleLists) -> Column:
    raw = F.col("body")

    def shown(name, words, limit):
        return let(words, lambda w: F.when(F.size(w) > 0, _signal(
            name, F.array_join(F.slice(w, 1, limit), ", "))))

    keywords = _present(shown("sensitive_content_keyword", F.col("_sensitive"), 12),
                        shown("urgency_keyword", F.col("_urgency"), 10))
    return F.concat(keywords, _present(F.when(
        raw.contains(T.ZERO_WIDTH[0]) | raw.contains(T.ZERO_WIDTH[1]),
        _signal("hidden_text_detected"))))


def blacklist_targets(lists: P.RuleLists) -> Column:
    """Sender domain and the domains of the links, without trusted domains."""
    links = F.col("_links") if lists.feed_links is None else F.slice("_links", 1, lists.feed_links)
    first = F.transform(links, lambda s: s["domain"])
    official = {U.registered_name(d, lists.suffixes)
                for v in lists.brands.values() for d in B.official_names(v)}
    skip = set(lists.skip_domains) | set(lists.free_domains) | official
    every = F.array_sort(F.array_distinct(F.concat(F.array("sender_domain"), first)))
    return F.array_except(F.filter(every, lambda d: d != ""), literal_array(sorted(skip)))


def rule_signals(messages: DataFrame, lists: P.RuleLists | None = None,
                 blacklist: DataFrame | None = None, only=None,
                 id_col: str = "msg_id") -> DataFrame:
    """(id, message_type, sender, sender_domain, links..., signals) per message.

    ``blacklist`` is a table with a ``domain`` column of domains, hosts, addresses or URLs.  ``only`` limits the work to the
    named signals.  Signals are deduplicated and stand in collector order.
    """
    lists = lists or P.RuleLists()

    def wanted(names):
        return only is None or bool(set(names) & set(only))

    ctx = message_context(messages, lists, id_col)
    has_entities = "entities" in messages.columns
    if wanted(ENTITY):
        ctx = brand_hits(ctx, lists)
    if wanted(CONTENT):
        low = F.lower(F.concat_ws("\n", "_subject", "_body"))
        ctx = ctx.withColumns({"_sensitive": contained_words(low, lists.sensitive_keywords),
                               "_urgency": contained_words(low, lists.urgency_keywords)})
    head = F.concat(
        _auth_signals(lists.suffixes) if wanted(AUTH) else _none(),
        _link_signals(lists) if wanted(LINK) else _none(),
    )
    tail = F.concat(
        _entity_signals(lists, has_entities) if wanted(ENTITY) else _none(),
        _content_signals(lists) if wanted(CONTENT) else _none(),
    )
    hits = (F.transform("_hits", lambda b: F.struct(b["brand"], b["claimed"]))
            if wanted(ENTITY) else F.array().cast("array<struct<brand:string,claimed:boolean>>"))
    out = ctx.select(
        id_col, "message_type", F.col("_sender").alias("sender"), "sender_domain",
        F.transform("_links", lambda s: s["norm"]).alias("urls"),
        F.array_sort(F.array_distinct(F.filter(
            F.transform("_links", lambda s: s["domain"]), lambda d: d != ""))).alias("url_domains"),
        F.transform(F.filter("_links", lambda s: in_list(s["domain"], lists.shorteners)),
                    lambda s: s["norm"]).alias("shortener_urls"),
        hits.alias("brands"),
        ((F.col("_sender") == "") & (F.col("_body") == "")).alias("is_empty"),
        blacklist_targets(lists).alias("_targets"), head.alias("_head"), tail.alias("_tail"),
    )
    if blacklist is not None and wanted(("blacklist_hit",)):
        out = _with_blacklist(out, blacklist, lists.suffixes)
    else:
        out = out.withColumn("_black", _none())
    everything = F.concat("_head", "_black", "_tail")
    if only is not None:
        everything = F.filter(everything, lambda s: s["signal"].isin(list(only)))
    unique = first_by_key(everything, lambda s: F.concat_ws(
        "\x01", s["signal"], F.lower(F.coalesce(s["matched_text"], F.lit(""))),
        F.lower(s["domain"]), F.lower(s["entity"])))
    signals = F.when(F.col("is_empty"), _none()).otherwise(unique)
    return out.withColumn("signals", signals).drop("_targets", "_head", "_tail", "_black")


def _with_blacklist(rows: DataFrame, blacklist: DataFrame, suffixes) -> DataFrame:
    """Join of the targets to the feed, in one pass over the messages.

    Each row is numbered where it is read and repeated for its targets; what is not in the feed goes at once, but
    for one row a message, and the rows of a message come together again, most of them before anything moves.
    Feed entries may be URLs, addresses or hosts.  No broadcast is forced: a small feed is broadcast by its size,
    a large one is a shuffle join whose hot domains adaptive execution splits.
    """
    feed = blacklist.select(U.registered_domain(F.col("domain"), suffixes).alias("_t")).where("_t <> ''").distinct()
    feed = feed.withColumn("_listed", F.lit(True))
    kept = [c for c in rows.columns if c != "_targets"]
    each = rows.withColumn("_row", F.monotonically_increasing_id()).select(
        "_row", *kept, F.posexplode_outer("_targets").alias("_at", "_t"))
    met = each.join(feed, "_t", "left").where("_listed OR coalesce(_at, 0) = 0")
    hit = F.when(F.col("_listed"), F.col("_t"))
    back = met.groupBy("_row").agg(F.first(F.struct(*kept)).alias("_of"), F.array_sort(F.collect_set(hit)).alias("_found"))
    return back.select("_of.*", F.transform("_found", lambda d: _signal("blacklist_hit", d, domain=d)).alias("_black"))


def signal_table(rules: DataFrame, id_col: str = "msg_id") -> DataFrame:
    """Long table (id, pos, signal, severity, title, matched_text, confidence, ...)."""
    return exploded(rules, id_col, "signals").select(id_col, "pos", "item.*")


def severity_rank(col: Column) -> Column:
    return (F.when(col == "critical", 4).when(col == "high", 3).when(col == "medium", 2)
            .otherwise(1))


def signal_order(rules: DataFrame) -> DataFrame:
    """Signals by severity then confidence, ties in collector order."""
    keyed = F.transform("signals", lambda s, i: F.struct(
        (-severity_rank(s["severity"])).alias("a"), (-s["confidence"]).alias("b"),
        i.alias("i"), s.alias("s")))
    return rules.withColumn("signals", F.transform(F.array_sort(keyed), lambda k: k["s"]))


def rule_score(rules: DataFrame) -> DataFrame:
    """Strongest core weight plus capped context minus trust, clamped to 0..1."""
    def value(s):
        return weighted_lookup(
            s["signal"], P.SIGNAL_WEIGHTS, P.DEFAULT_SIGNAL_WEIGHT) * s["confidence"]

    def core(s):
        return in_list(s["signal"], P.CORE_SIGNALS)

    facts = let(F.col("signals"), lambda found: F.struct(
        F.coalesce(F.array_max(F.transform(F.filter(found, core), value)), F.lit(0.0)).alias("core"),
        F.transform(F.filter(found, lambda s: ~core(s)), value).alias("other")))

    def total(f):
        zero = F.lit(0.0)
        context = F.aggregate(f["other"], zero, lambda a, v: a + F.greatest(v, zero))
        trust = F.aggregate(f["other"], zero, lambda a, v: a - F.least(v, zero))
        cap = F.when(f["core"] > 0, 0.20).otherwise(0.15)
        return F.greatest(f["core"], zero) + F.least(cap, context) - trust

    clamped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), let(facts, total)))
    return rules.withColumn("score", clamped)


def rule_verdict(scored: DataFrame) -> DataFrame:
    """Ordered hard rules, then the score threshold; expects ordered signals and a score."""
    facts = F.struct(F.col("signals").alias("s"), F.transform(
        "signals", lambda s: s["signal"]).alias("names"), F.col("score").alias("score"))

    def decide(f):
        suspicious = f["score"] >= 0.50
        titles = F.array_join(F.transform(F.slice(f["s"], 1, 3), lambda s: s["title"]), ", ")
        verdict = F.when(suspicious, F.lit("SUSPICIOUS")).otherwise(F.lit("UNKNOWN"))
        reason = F.when(suspicious, F.concat(F.lit(P.SUSPICIOUS_REASON), titles)).otherwise(
            F.lit(P.UNKNOWN_REASON))
        for needed, text in reversed(P.VERDICT_RULES):
            test = F.lit(True)
            for n in needed:
                test = test & F.array_contains(f["names"], n)
            verdict = F.when(test, F.lit("PHISHING")).otherwise(verdict)
            reason = F.when(test, F.lit(text)).otherwise(reason)
        return F.struct(verdict.alias("verdict"), reason.alias("reason"))

    out = scored.withColumn("_v", let(facts, decide))
    empty = F.lit("Empty content payload context.")
    return out.withColumns({
        "verdict": F.col("_v.verdict"),
        "reason": F.when(F.col("is_empty"), empty).otherwise(F.col("_v.reason")),
    }).drop("_v")


def rule_details(rules: DataFrame) -> DataFrame:
    return rules.withColumns({
        "url_count": F.size("urls"),
        "signal_count": F.size("signals"),
        "signal_names": F.transform("signals", lambda s: s["signal"]),
        "detected_entities": F.array_sort(F.array_distinct(
            F.transform("brands", lambda b: b["brand"]))),
        "claimed_entities": F.array_sort(F.array_distinct(F.transform(
            F.filter("brands", lambda b: b["claimed"]), lambda b: b["brand"]))),
    })


def rule_layer(messages: DataFrame, lists: P.RuleLists | None = None,
               blacklist: DataFrame | None = None, id_col: str = "msg_id") -> DataFrame:
    """Signals, score, verdict and reason of every message."""
    return rule_verdict(rule_score(signal_order(
        rule_signals(messages, lists, blacklist, id_col=id_col))))
