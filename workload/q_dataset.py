"""Sources, sinks, joins, dataset building, profiling and evaluation queries."""

from __future__ import annotations

from pyspark.sql import Observation, functions as F

from lurelake import params as P
from lurelake.functions import urls as U
from lurelake.operators import answers as OA, dataset as DS, evaluate as EV, fusion as OF, joins as OJ
from lurelake.operators import pages as OP, profile as PR, rules as OR, urls as OU
from lurelake.sources import readers as R, sinks as S
from workload import duck as D
from workload.bridge import BRANDS, cte, view
from workload.q_answers import ANS, URLS
from workload.q_messages import RULES
from workload.q_urls import GROUP, HOSTS, USABLE
from workload.registry import query, table

CORPUS, FEED = cte("corpus"), cte("feed")
H = "md5('42:' || {})"


def joined(col):
    return F.array_join(col, " | ")


# ---- sources ----

@query("read_url_corpus", f"""WITH {HOSTS} SELECT url, CASE WHEN page_id % 4 = 1 THEN 1 ELSE 0 END AS label FROM hosts WHERE page_id % 5 <> 2""")
def read_url_corpus(spark, sf):
    path = S.scratch_path(spark, "urls")
    view(spark, sf, "hosts").selectExpr(
        "url", "CASE WHEN page_id % 5 = 2 THEN NULL WHEN page_id % 4 = 1 THEN '1' ELSE '0' END AS label",
        "page_id").write.options(header=True, quote='"', escape='"').csv(path)
    return R.read_url_corpus(spark, path)


@query("read_message_corpora", """SELECT doc_id AS id, regexp_replace(text, '\\r\\n?', chr(10), 'g') AS body,
 CASE WHEN lang = 'en' THEN 'email_en' ELSE 'email_vie' END AS source, CASE WHEN lang = 'en' THEN '' ELSE lang END AS lang FROM documents""")
def read_message_corpora(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id"), F.regexp_replace(
        "text", "\r\n?", "\n").alias("body"), "lang")
    opts = {"header": True, "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    a, b = S.scratch_path(spark, "en"), S.scratch_path(spark, "vie")
    docs.where("lang = 'en'").drop("lang").write.options(**opts).csv(a)
    docs.where("lang <> 'en'").write.options(**opts).csv(b)
    return R.read_message_corpora(spark, {"email_en": a, "email_vie": b}).select(
        "id", "body", "source", F.coalesce("lang", F.lit("")).alias("lang"))


CHAT = f"""{CORPUS}, ev AS (SELECT id, text, source, label, n_evidence, CASE WHEN label = 1 AND n_evidence > 0 THEN 'urgency' ELSE '' END AS sig FROM corpus WHERE label = 0 OR n_evidence > 0)"""


def chat_input(spark, sf):
    """Corpus with evidence lists as the preprocessing step leaves them."""
    df = view(spark, sf, "corpus").where("label = 0 OR n_evidence > 0")
    item = F.struct(F.lit("urgency").alias("signal"), F.left("text", F.lit(20)).alias("exact_span"),
                    F.lit("high").alias("severity"))
    ev = F.when(F.col("label") == 1, F.array(item)).otherwise(F.slice(F.array(item), 1, 0))
    return df.withColumn("evidence", ev).withColumn("signals", F.transform("evidence", lambda e: e["signal"]))


PROMPT = "Answer with JSON only."


@query("read_chat_jsonl", f"""WITH {CHAT} SELECT '{PROMPT}' AS system_prompt, text AS user_prompt, CASE WHEN label = 1 THEN 'phishing' ELSE 'legit' END AS gold_label, sig AS gold_signals FROM ev""")
def read_chat_jsonl(spark, sf):
    path = S.scratch_path(spark, "chat")
    S.write_chat_jsonl(DS.chat_record(chat_input(spark, sf), PROMPT), path)
    return R.read_chat_jsonl(spark, path).select(
        "system_prompt", "user_prompt", "gold_label", joined(F.col("gold_signals")).alias("gold_signals"))


@query("write_chat_jsonl", f"""WITH {CHAT} SELECT sum(length(text)) AS user_chars, count(*) AS records FROM ev""")
def write_chat_jsonl(spark, sf):
    path = S.scratch_path(spark, "chat")
    S.write_chat_jsonl(DS.chat_record(chat_input(spark, sf), PROMPT), path)
    back = spark.read.schema("messages array<struct<role:string,content:string>>").json(path)
    return back.agg(F.sum(F.length(F.col("messages")[1]["content"])).alias("user_chars"), F.count(F.lit(1)).alias("records"))


@query("write_debug_table", f"""WITH {CHAT} SELECT CAST(id AS VARCHAR) AS id, source, CAST(label AS VARCHAR) AS label, CASE WHEN sig = '' THEN '[]' ELSE '["urgency"]' END AS signals,
 CASE WHEN sig = '' THEN '[]' ELSE '[' || json_object('signal', 'urgency', 'exact_span', left(text, 20), 'severity', 'high')::VARCHAR || ']' END AS evidence FROM ev""")
def write_debug_table(spark, sf):
    path = S.scratch_path(spark, "debug")
    S.write_debug_table(chat_input(spark, sf).select("id", "source", "label", "signals", "evidence"), path)
    return spark.read.options(header=True, quote='"', escape='"').csv(path)


@query("read_term_list", """SELECT DISTINCT lower(trim(t)) AS term FROM (SELECT CASE doc_id % 4 WHEN 0 THEN '# ' || source WHEN 1 THEN '  ' || upper(source) ELSE lang END AS t FROM documents) WHERE trim(t) <> '' AND NOT starts_with(trim(t), '#')""")
def read_term_list(spark, sf):
    path = S.scratch_path(spark, "terms")
    table(spark, sf, "documents").selectExpr("CASE doc_id % 4 WHEN 0 THEN '# ' || source WHEN 1 THEN '  ' || upper(source) ELSE lang END AS value").write.text(path)
    return R.read_term_list(spark, path)


@query("read_brand_whitelist", """SELECT 'segment_' || lower(c_mktsegment) AS brand, 'www.n' || c_nationkey || '.' || lower(c_mktsegment) || '.com.vn' AS domain,
 lower(c_mktsegment) || '.com.vn' AS registered_domain FROM (SELECT DISTINCT c_mktsegment, c_nationkey FROM customer)""")
def read_brand_whitelist(spark, sf):
    c = table(spark, sf, "customer").select("c_mktsegment", "c_nationkey").distinct()
    brands = c.groupBy(F.concat(F.lit("segment_"), F.lower("c_mktsegment")).alias("b")).agg(F.collect_list(
        F.concat(F.lit("www.n"), F.col("c_nationkey").cast("string"), F.lit("."), F.lower("c_mktsegment"), F.lit(".com.vn"))).alias("d"))
    merged = brands.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("b", "d")))).alias("value"))
    path = S.scratch_path(spark, "brands")
    merged.coalesce(1).write.text(path)
    return R.read_brand_whitelist(spark, path)


RANKED = "SELECT page_id + 1 AS rank, lower(regexp_extract(url, '//([^/]*)', 1)) AS domain FROM "


@query("read_ranked_domains", f"""WITH p AS (SELECT i - 1 AS ord, d AS domain FROM (SELECT unnest({D.lst(P.PRIORITY_DOMAINS)}) AS d, unnest(range(1, {len(P.PRIORITY_DOMAINS) + 1})) AS i)),
r AS (SELECT min(rank) + {len(P.PRIORITY_DOMAINS)} AS ord, domain FROM ({RANKED} pages) WHERE rank BETWEEN 1 AND 200 AND domain NOT IN (SELECT domain FROM p) GROUP BY domain) SELECT * FROM p UNION ALL SELECT * FROM r""")
def read_ranked_domains(spark, sf):
    return R.read_ranked_domains(spark.sql(RANKED + "{p}", p=table(spark, sf, "pages")), 1, 200)


# three levels: an entry index, one index for each 400 pages, one list for each 40; the lists of the index before
# lead back to the entry, so the documents hold cycles
SITEMAPS = """
WITH h AS (SELECT page_id, url, regexp_extract(url, '//([^/]*)', 1) AS host FROM {pages}),
d AS (SELECT page_id, url, regexp_extract(host, '[^.]+[.][^.]+$', 0) AS domain FROM h),
leaf AS (SELECT domain, page_id div 400 AS m, 'https://' || domain || '/l' || CAST(page_id div 40 AS STRING) || '.xml' AS url, array_join(sort_array(collect_list('<url><loc> ' || url || ' </loc></url><loc>https://' || domain || '/</loc><loc>https://other.test/x.html</loc>')), '') AS xml FROM d GROUP BY domain, page_id div 40, page_id div 400),
mid AS (SELECT domain, 'https://' || domain || '/m' || CAST(m AS STRING) || '.xml' AS url, '<sitemapindex><sitemap><loc>https://' || domain || '/sitemap.xml</loc></sitemap>' || array_join(sort_array(collect_list('<sitemap><loc>' || url || '</loc></sitemap>')), '') || '</sitemapindex>' AS xml FROM leaf GROUP BY domain, m)
SELECT domain, url, xml, false AS is_entry FROM leaf UNION ALL SELECT domain, url, xml, false FROM mid
UNION ALL SELECT domain, 'https://' || domain || '/sitemap.xml', '<sitemapindex>' || array_join(sort_array(collect_list('<sitemap><loc>' || url || '</loc></sitemap>')), '') || '</sitemapindex>', true FROM mid GROUP BY domain
"""


@query("extract_sitemap_locs", """WITH d AS (SELECT url, regexp_extract(regexp_extract(url, '//([^/]*)', 1), '[^.]+[.][^.]+$') AS domain FROM pages)
SELECT DISTINCT domain, url AS loc FROM d WHERE NOT regexp_matches(url, '^https?://[^/]*/?([?#].*)?$')""")
def extract_sitemap_locs(spark, sf):
    return R.extract_sitemap_locs(spark.sql(SITEMAPS, pages=table(spark, sf, "pages")))


@query("feed_incremental_load", f"""WITH {FEED} SELECT id, url, date, 0 AS label FROM (SELECT * FROM feed WHERE id < (SELECT max(id) * 9 // 10 FROM feed)
 QUALIFY row_number() OVER (PARTITION BY url ORDER BY id DESC) = 1)""")
def feed_incremental_load(spark, sf):
    feed = view(spark, sf, "feed")
    return R.feed_incremental_load(feed, feed.agg(F.max("id")).first()[0] * 9 // 10)


@query("feed_profile", f"WITH {FEED} SELECT max(date) AS newest, min(date) AS oldest, CAST(floor((epoch_us(max(date)) - epoch_us(min(date))) / 86400000000) AS BIGINT) AS span_days FROM feed")
def feed_profile(spark, sf):
    return PR.feed_profile(view(spark, sf, "feed"))


@query("resume_pending", "SELECT page_id, url FROM pages WHERE url NOT IN (SELECT url FROM pages WHERE length(url) % 3 = 0)")
def resume_pending(spark, sf):
    p = table(spark, sf, "pages").select("page_id", "url")
    return OU.resume_pending(p, p.where(F.length("url") % 3 == 0)).select("page_id", "url")


@query("append_feature_sink", "SELECT url, page_id, length(url) AS n FROM pages")
def append_feature_sink(spark, sf):
    path = S.scratch_path(spark, "features")
    p = table(spark, sf, "pages").select("page_id", F.length("url").alias("n"), "url")
    S.append_feature_sink(p.where(F.length("url") % 3 == 0), path, ["url", "page_id", "n"])
    S.append_feature_sink(p, path, ["url", "page_id", "n"])
    return spark.read.parquet(path)


@query("split_by_status_sink", f"WITH {USABLE} SELECT status, count(*) AS n FROM status GROUP BY status")
def split_by_status_sink(spark, sf):
    path = S.scratch_path(spark, "status")
    S.split_by_status_sink(OP.page_usability(view(spark, sf, "pages_rich")).select("page_id", "url", "status"), path)
    return spark.read.parquet(path).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("convert_label_jsonl", """SELECT conv_id, turn, role, CASE WHEN role = 'assistant' THEN '{"label": "' || CASE WHEN conv_id % 2 = 0 THEN 'legit' ELSE 'phishing' END || '", "n": ' || turn || '}' ELSE text END AS content FROM conversations""")
def convert_label_jsonl(spark, sf):
    c = table(spark, sf, "conversations").withColumn("content", F.when(F.col("role") == "assistant", F.concat(
        F.lit('{"label": '), (F.col("conv_id") % 2).cast("string"), F.lit(', "n": '), F.col("turn").cast("string"), F.lit("}"))).otherwise(F.col("text")))
    out = c.withColumn("m", DS.convert_labels(F.array(F.struct("role", "content"))).getItem(0))
    return out.select("conv_id", "turn", "role", F.col("m.content").alias("content"))


# ---- joins ----

@query("join_semi_lists", f"WITH {URLS} SELECT page_id FROM us WHERE regexp_extract(url, '//[^/]*?([^./]+[.][^./]+)/', 1) IN ('example.com', 'example.org')")
def join_semi_lists(spark, sf):
    df = OU.registered_domain(table(spark, sf, "pages"))
    names = spark.createDataFrame([("example.com",), ("example.org",)], "d string")
    return OJ.semi_list(df, names, "registered_domain", "d").select("page_id")


@query("join_anti_resume", "SELECT page_id FROM pages WHERE NOT regexp_matches(url, '//[^/]*example[.](com|org)/')")
def join_anti_resume(spark, sf):
    df = OU.registered_domain(table(spark, sf, "pages"))
    names = spark.createDataFrame([("example.com",), ("example.org",)], "d string")
    return OJ.anti_list(df, names, "registered_domain", "d").select("page_id")


@query("join_status_attach", f"WITH {USABLE} SELECT p.page_id, coalesce(s.status, 'dead') AS status FROM pages p LEFT JOIN (SELECT page_id, status FROM status WHERE status <> 'no_html') s USING (page_id)")
def join_status_attach(spark, sf):
    res = OP.page_usability(view(spark, sf, "pages_rich")).where("status <> 'no_html'").select("page_id", "status")
    return OJ.status_attach(table(spark, sf, "pages").select("page_id"), res, "page_id", {"status": "dead"})


@query("join_brand_text", """SELECT d.doc_id AS msg_id, b.brand FROM documents d, (SELECT DISTINCT lower(r_name) AS brand FROM region UNION SELECT DISTINCT lower(n_name) FROM nation UNION SELECT 'the' UNION SELECT 'on') b
WHERE CASE WHEN length(regexp_replace(brand, '[^a-z0-9]', '', 'g')) >= 4 THEN contains(regexp_replace(lower(text), '[^a-z0-9]', '', 'g'), regexp_replace(brand, '[^a-z0-9]', '', 'g'))
 ELSE regexp_matches(lower(text), '(?:^|[^\\p{L}\\p{N}_])' || brand || '(?:[^\\p{L}\\p{N}_]|$)') END""")
def join_brand_text(spark, sf):
    names = table(spark, sf, "region").select(F.col("r_name").alias("brand")).union(table(spark, sf, "nation").select("n_name"))
    brands = names.union(spark.createDataFrame([("the",), ("on",)], "brand string"))
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("msg_id"), "text")
    return OJ.brand_mentions(docs, brands)


BRAND_PAIRS = [(b, d) for b, ds in BRANDS.items() for d in ds]


@query("join_official_domain", f"""WITH {RULES} SELECT l.msg_id, b.brand FROM (SELECT DISTINCT msg_id, domain FROM lnk) l JOIN (SELECT brand, unnest(official) AS d FROM brands) b ON b.d = l.domain""")
def join_official_domain(spark, sf):
    from lurelake.operators.messages import extract_urls

    m = view(spark, sf, "messages").select("msg_id", F.concat_ws("\n", "subject", "body").alias("text"))
    links = OU.registered_domain(extract_urls(m), "url").where("registered_domain <> ''").select(
        "msg_id", F.col("registered_domain").alias("domain")).distinct()
    return OJ.official_domain_join(links, spark.createDataFrame(BRAND_PAIRS, "brand string, domain string"), "domain").select("msg_id", "brand")


SQ_D, SQ_O = "regexp_replace(domain, '[.][^.]*$', '')", "regexp_replace(official, '[.][^.]*$', '')"
SQ = f"""WITH dd AS (SELECT DISTINCT CASE page_id % 4 WHEN 0 THEN h WHEN 1 THEN replace(h, 'th', 'ht') WHEN 2 THEN split_part(h, '.', 1) || '-login.' || 'com' ELSE 'x' || h END AS domain
 FROM (SELECT page_id, lower(regexp_extract(url, '//([^/]*)', 1)) AS h FROM pages)), oo AS (SELECT DISTINCT lower(regexp_extract(url, '//([^/]*)', 1)) AS official FROM pages)
SELECT domain, official FROM dd, oo WHERE {SQ_D} <> {SQ_O} AND (({D.any_of(SQ_D, P.SQUAT_AFFIXES)} AND contains({SQ_D}, {SQ_O})) OR (abs(length({SQ_D}) - length({SQ_O})) <= 3 AND length({SQ_D}) > 3 AND length({SQ_O}) > 3
 AND len(list_intersect(string_split({SQ_D}, ''), string_split({SQ_O}, ''))) >= least(length({SQ_D}), length({SQ_O})) / 2 AND levenshtein({SQ_D}, {SQ_O}) <= 2))"""


@query("squatting_match", SQ)
def squatting_match(spark, sf):
    h = table(spark, sf, "pages").select("page_id", F.lower(F.regexp_extract("url", "//([^/]*)", 1)).alias("h"))
    d = h.selectExpr("CASE page_id % 4 WHEN 0 THEN h WHEN 1 THEN replace(h, 'th', 'ht') WHEN 2 THEN split_part(h, '.', 1) || '-login.com' ELSE 'x' || h END AS domain")
    return OJ.squatting_match(d, h.select(F.col("h").alias("official_domain")))


@query("join_gold_pred", "SELECT d.doc_id AS \"index\", coalesce(l.toxic, -1) AS pred, CAST(l.doc_id IS NOT NULL AS INT) AS is_done FROM documents d LEFT JOIN labels l USING (doc_id)")
def join_gold_pred(spark, sf):
    s = table(spark, sf, "documents").select(F.col("doc_id").alias("index"))
    done = table(spark, sf, "labels").select(F.col("doc_id").alias("index"), F.col("toxic").alias("pred"))
    return OJ.gold_predictions(s, done).select("index", F.coalesce("pred", F.lit(-1)).alias("pred"), F.col("is_done").cast("int").alias("is_done"))


# ---- dataset building ----

MIXED = "CASE id % 8 WHEN 0 THEN ' Phishing ' WHEN 1 THEN '1.0' WHEN 2 THEN 'ham' WHEN 3 THEN '0' WHEN 4 THEN '1.7' WHEN 5 THEN 'other' WHEN 6 THEN 'spam' ELSE NULL END"


@query("label_normalize", f"""WITH {CORPUS} SELECT id, CASE WHEN id % 8 IN (0, 1, 4, 6) THEN 1 ELSE 0 END AS label FROM corpus""")
def label_normalize(spark, sf):
    return view(spark, sf, "corpus").withColumn("raw", F.expr(MIXED)).select("id", DS.label_normalize(F.col("raw")).alias("label"))


LISTED = """CASE id % 4 WHEN 0 THEN '[{"signal": "Urgency", "exact_span": "a' || id || '", "severity": "low"}, {"signal": "urgency", "exact_span": "A' || id || ' ", "severity": "high"}, {"signal": "threat", "exact_span": "b", "severity": "x"}, {"signal": "bad", "exact_span": "c"}]'
 WHEN 1 THEN '[{''signal'': ''extortion'', ''exact_span'': ''pay'', ''verified'': False}, {''signal'': ''otp_or_code'', ''exact_span'': ''otp'', ''verified'': True, ''severity'': None}]' WHEN 2 THEN 'nan' ELSE '{"a": 1}' END"""


def listed(spark, sf):
    return view(spark, sf, "corpus").withColumn("raw", F.expr(LISTED.replace("id ||", "CAST(id AS STRING) ||")))


@query("parse_list_column", f"WITH {CORPUS} SELECT id, CASE id % 4 WHEN 0 THEN 'Urgency | urgency | threat | bad' WHEN 1 THEN 'extortion | otp_or_code' ELSE '' END AS signals FROM corpus")
def parse_list_column(spark, sf):
    return listed(spark, sf).select("id", joined(F.transform(DS.parse_list_column(F.col("raw")), lambda e: e["signal"])).alias("signals"))


@query("evidence_simplify", f"WITH {CORPUS} SELECT id, CASE id % 4 WHEN 0 THEN 'urgency:A' || id || ':high | threat:b:medium' WHEN 1 THEN 'otp_or_code:otp:medium' ELSE '' END AS evidence FROM corpus")
def evidence_simplify(spark, sf):
    ev = DS.evidence_simplify(DS.parse_list_column(F.col("raw")))
    return listed(spark, sf).select("id", joined(F.transform(ev, lambda e: F.concat_ws(":", e["signal"], e["exact_span"], e["severity"]))).alias("evidence"))


@query("message_preprocess", f"""WITH {CORPUS} SELECT id, label, CASE WHEN label = 0 THEN '' WHEN id % 4 = 0 THEN 'threat | urgency' ELSE 'otp_or_code' END AS signals
FROM corpus WHERE length(trim(text)) >= 5 AND (label = 0 OR id % 4 < 2)""")
def message_preprocess(spark, sf):
    df = listed(spark, sf).select("id", "text", "label", "source", F.col("raw").alias("evidence"))
    return DS.message_preprocess(df).select("id", "label", joined(F.col("signals")).alias("signals"))


@query("message_preprocess_counts", f"""WITH {CORPUS}, f AS (SELECT label, length(trim(text)) >= 5 AS long, label = 0 OR id % 4 < 2 AS grounded FROM corpus)
SELECT count(*) AS rows, count(*) FILTER (NOT long) AS removed_short, count(*) FILTER (long AND NOT grounded) AS removed_no_evidence, count(*) FILTER (long AND grounded) AS kept,
 count(*) FILTER (long AND grounded AND label = 1) AS kept_phishing, count(*) FILTER (long AND grounded AND label = 0) AS kept_legit FROM f""")
def message_preprocess_counts(spark, sf):
    """Counted in the pass that writes the rows."""
    seen = Observation("preprocess")
    df = listed(spark, sf).select("id", "text", "label", "source", F.col("raw").alias("evidence"))
    DS.message_preprocess(df, observed=seen).write.parquet(S.scratch_path(spark, "preprocessed"))
    names = ["rows", "removed_short", "removed_no_evidence", "kept", "kept_phishing", "kept_legit"]
    return spark.createDataFrame([tuple(seen.get[n] for n in names)], ", ".join(f"{n} long" for n in names))


@query("dedupe_rows", "SELECT DISTINCT event_type, user_id FROM events")
def dedupe_rows(spark, sf):
    return DS.dedupe_rows(table(spark, sf, "events").select("event_type", "user_id"))


@query("dedupe_url", f"WITH {FEED} SELECT id, url, date FROM feed QUALIFY row_number() OVER (PARTITION BY url ORDER BY id) = 1")
def dedupe_url(spark, sf):
    return DS.dedupe_url(view(spark, sf, "feed")).select("id", "url", "date")


@query("corpus_union", f"WITH {USABLE} SELECT page_id, label, status FROM status WHERE (label = 0 AND status = 'valid') OR (label <> 0 AND status <> 'dead')")
def corpus_union(spark, sf):
    s = OP.page_usability(view(spark, sf, "pages_rich")).select("page_id", "url", "label", "status")
    return DS.corpus_union(s.where("label = 0 AND status = 'valid'"), s.where("label <> 0 AND status <> 'dead'")).select("page_id", "label", "status")


FEED_DOM = f"""{FEED}, fd AS (SELECT id, url, lower({D.netloc('url')}) AS domain FROM feed)"""


def feed_domains(spark, sf):
    return view(spark, sf, "feed").withColumn("domain", F.lower(U.netloc(F.col("url"))))


@query("cap_per_domain", f"WITH {FEED_DOM} SELECT id, domain FROM fd QUALIFY row_number() OVER (PARTITION BY domain ORDER BY id) <= 50")
def cap_per_domain(spark, sf):
    return DS.cap_per_domain(feed_domains(spark, sf), "domain", "id", 50).select("id", "domain")


@query("sample_per_domain", f"WITH {FEED_DOM} SELECT id, domain FROM (SELECT * FROM fd QUALIFY row_number() OVER (PARTITION BY domain ORDER BY {H.format('id')}, id) <= 3) ORDER BY {H.format('id')}, id LIMIT 400")
def sample_per_domain(spark, sf):
    return DS.sample_per_domain(feed_domains(spark, sf), "domain", "id", 3, 400).select("id", "domain")


@query("shuffle_rows", "SELECT doc_id, source FROM documents")
def shuffle_rows(spark, sf):
    return DS.shuffle_rows(table(spark, sf, "documents").select("doc_id", "source"), "doc_id")


EDGES = "list_distinct(quantile_cont(length(text), [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]))"


def buckets(source, keys):
    on = " AND ".join(f"e.{k} = c.{k}" for k in keys) or "true"
    group = f"GROUP BY {', '.join(keys)}" if keys else ""
    cols = "".join(f"{k}, " for k in keys)
    return f"""edges AS (SELECT {cols}list_sort({EDGES})[2:-2] AS es FROM {source} {group}),
bucketed AS (SELECT c.*, len(list_filter(es, lambda e: length(text) > e)) AS len_bucket FROM {source} c JOIN edges e ON {on})"""


@query("length_buckets", f"WITH {CORPUS}, {buckets('corpus', [])} SELECT id, length(text) AS text_len, len_bucket FROM bucketed")
def length_buckets(spark, sf):
    return DS.length_buckets(view(spark, sf, "corpus")).select("id", "text_len", "len_bucket")


DOWN = """cnt AS (SELECT source, len_bucket, count(*) AS c FROM bucketed GROUP BY ALL),
q0 AS (SELECT cnt.*, t.target, sum(c) OVER (PARTITION BY cnt.source) AS tot, max(len_bucket) OVER (PARTITION BY cnt.source) AS last FROM cnt JOIN targets t ON t.source = cnt.source),
q1 AS (SELECT *, CASE WHEN len_bucket = last THEN 0 ELSE least(CAST(round_even(target * c / tot, 0) AS BIGINT), c) END AS q FROM q0),
quota AS (SELECT source, len_bucket, CASE WHEN target >= tot THEN c WHEN len_bucket = last THEN least(target - sum(q) OVER (PARTITION BY source), c) ELSE q END AS quota FROM q1),
down AS (SELECT b.* FROM (SELECT *, row_number() OVER (PARTITION BY source, len_bucket ORDER BY md5('42:' || id), id) AS rn FROM bucketed) b JOIN quota USING (source, len_bucket) WHERE rn <= quota)"""


@query("stratified_downsample", f"WITH {CORPUS}, targets AS (SELECT source, 37 AS target FROM corpus GROUP BY source), {buckets('corpus', ['source'])}, {DOWN} SELECT id, source FROM down")
def stratified_downsample(spark, sf):
    df = view(spark, sf, "corpus")
    targets = df.select("source").distinct().withColumn("target", F.lit(37).cast("long"))
    return DS.stratified_downsample(df, targets, ["source"], "id").select("id", "source")


BALANCE = f"""{CORPUS}, legit AS (SELECT * FROM corpus WHERE label = 0), targets AS (SELECT source, least(count(*) FILTER (label = 0), count(*) FILTER (label = 1)) AS target FROM corpus GROUP BY source),
{buckets('legit', ['source'])}, {DOWN}, balanced AS (SELECT id, source, label FROM corpus WHERE label = 1 UNION ALL SELECT id, source, label FROM down)"""


@query("balance_by_source", f"WITH {BALANCE} SELECT id, source, label FROM balanced")
def balance_by_source(spark, sf):
    return DS.balance_by_source(view(spark, sf, "corpus"), "id").select("id", "source", "label")


EN, VIE = ("email_en", "sms_en"), ("email_vie", "sms_vie")


@query("language_partition", f"WITH {CORPUS} SELECT id, source FROM corpus WHERE source IN ({D.quoted(EN)})")
def language_partition(spark, sf):
    return DS.language_partition(view(spark, sf, "corpus"), EN).select("id", "source")


def mix_sql(keep, sample, quota):
    return f"""mix AS (SELECT id, source, label FROM corpus WHERE source IN ({D.quoted(keep)}) UNION ALL SELECT id, source, label FROM (
 SELECT *, row_number() OVER (ORDER BY md5('42:' || id), id) AS rn FROM corpus WHERE source IN ({D.quoted(sample)})) WHERE rn <= {quota})"""


N_KEEP = f"(SELECT round_even(count(*) * 0.5, 0) FROM corpus WHERE source IN ({D.quoted(VIE)}))"


@query("language_mix", f"WITH {CORPUS}, {mix_sql(VIE, EN, N_KEEP)} SELECT id, source FROM mix")
def language_mix(spark, sf):
    c = view(spark, sf, "corpus").select("id", "source", "label")
    return DS.language_mix(DS.language_partition(c, VIE), DS.language_partition(c, EN), 0.5, "id").select("id", "source")


@query("replay_mix", f"WITH {CORPUS}, {mix_sql(VIE, EN, f'(SELECT round_even(count(*) * 0.2, 0) FROM corpus WHERE source IN ({D.quoted(EN)}))')} SELECT id, source FROM mix")
def replay_mix(spark, sf):
    c = view(spark, sf, "corpus").select("id", "source", "label")
    return DS.replay_mix(DS.language_partition(c, VIE), DS.language_partition(c, EN), "id").select("id", "source")


STRATA = f"""{CORPUS}, s0 AS (SELECT id, source || '_' || label || '_' || CASE WHEN n_evidence = 0 THEN '0' WHEN n_evidence <= 2 THEN '1_2' ELSE '3plus' END AS fine, source || '_' || label AS coarse FROM corpus),
strata AS (SELECT id, CASE WHEN (SELECT min(n) FROM (SELECT count(*) AS n FROM s0 GROUP BY fine)) < 2 THEN coarse ELSE fine END AS split_strata FROM s0)"""


@query("split_strata", f"WITH {STRATA} SELECT id, split_strata FROM strata")
def split_strata(spark, sf):
    return DS.split_strata(view(spark, sf, "corpus")).select("id", "split_strata")


@query("stratified_split", f"""WITH {STRATA} SELECT id, CASE WHEN row_number() OVER (PARTITION BY split_strata ORDER BY md5('42:' || id), id) <= round_even(count(*) OVER (PARTITION BY split_strata) * 0.15, 0) THEN 'eval' ELSE 'train' END AS split FROM strata""")
def stratified_split(spark, sf):
    return DS.stratified_split(DS.split_strata(view(spark, sf, "corpus")), "id").select("id", "split")


GSPLIT = f"""{HOSTS}, {D.SUFFIXES}, {GROUP}, gs AS (SELECT group_key, row_number() OVER (ORDER BY md5('42:' || group_key)) AS rn, count(*) OVER () AS g FROM (SELECT DISTINCT group_key FROM keyed)),
gsplit AS (SELECT page_id, label, k.group_key, CASE WHEN rn <= ceil(g * 0.2::DOUBLE) THEN 'test' ELSE 'train' END AS split FROM keyed k JOIN gs USING (group_key))"""


def grouped(spark, sf):
    return DS.group_split(OU.group_key(view(spark, sf, "hosts").select("page_id", "url", "label")), "group_key")


@query("group_split", f"WITH {GSPLIT} SELECT page_id, group_key, split FROM gsplit")
def group_split(spark, sf):
    return grouped(spark, sf).select("page_id", "group_key", "split")


@query("set_leak", f"WITH {GSPLIT} SELECT group_key FROM gsplit WHERE split = 'train' INTERSECT SELECT group_key FROM gsplit WHERE split = 'test'")
def set_leak(spark, sf):
    g = grouped(spark, sf)
    return DS.set_leak(g.where("split = 'train'"), g.where("split = 'test'"), "group_key")


IMP = "SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'test' ELSE 'train' END AS split, html_score AS a, CASE WHEN page_id % 7 = 3 THEN NULL ELSE lexical_score END AS b FROM "


@query("median_impute", f"WITH {cte('scored')}, f AS ({IMP} scored) SELECT page_id, coalesce(a, (SELECT quantile_cont(a, 0.5) FROM f WHERE split = 'train')) AS a, coalesce(b, (SELECT quantile_cont(b, 0.5) FROM f WHERE split = 'train')) AS b FROM f")
def median_impute(spark, sf):
    f = spark.sql(IMP + "{s}", s=view(spark, sf, "scored"))
    return DS.median_impute(f, ["a", "b"]).select("page_id", "a", "b")


@query("class_weights", f"WITH {CORPUS} SELECT label, count(*) AS n, round_even(sum(count(*)) OVER () / (2 * count(*)), 6) AS weight FROM corpus GROUP BY label")
def class_weights(spark, sf):
    return DS.class_weights(view(spark, sf, "corpus"))


@query("chat_record", f"""WITH {CHAT} SELECT id, text AS user_text, CASE WHEN label = 0 THEN 'legit//' ELSE 'phishing/urgency/' || left(text, 20) END AS answer FROM ev""")
def chat_record(spark, sf):
    df = DS.chat_record(chat_input(spark, sf), PROMPT)
    a = F.from_json(F.col("messages")[2]["content"], "label string, signals array<string>, evidence array<struct<exact_span:string>>")
    return df.withColumn("a", a).select("id", F.col("messages")[1]["content"].alias("user_text"), F.concat_ws(
        "/", "a.label", joined(F.col("a.signals")), joined(F.transform("a.evidence", lambda e: e["exact_span"]))).alias("answer"))


@query("chat_validate", f"WITH {CHAT} SELECT count(*) AS checked, count(*) FILTER (id % 10 = 4) AS bad FROM ev")
def chat_validate(spark, sf):
    df = DS.chat_record(chat_input(spark, sf), PROMPT)
    m = F.col("messages")
    return DS.chat_validate(df.withColumn("messages", F.when(F.col("id") % 10 == 4, F.slice(m, 1, 2)).otherwise(m)))


@query("token_budget_check", "SELECT count(*) AS rows, max(n) AS max_tokens, count(*) FILTER (n > 1000) AS over_limit FROM (SELECT len(regexp_extract_all(text, '[^ \\t\\n\\r\\f\\v]+')) AS n FROM documents)")
def token_budget_check(spark, sf):
    return DS.token_budget_check(table(spark, sf, "documents"), "text", 1000)


# ---- profiling ----

@query("label_distribution", "SELECT toxic AS label, count(*) AS n, round_even(count(*) / sum(count(*)) OVER (), 6) AS share FROM labels GROUP BY toxic")
def label_distribution(spark, sf):
    return PR.label_distribution(table(spark, sf, "labels").select(F.col("toxic").alias("label")))


@query("source_label_crosstab", f'WITH {CORPUS} SELECT source, count(*) FILTER (label = 0) AS "0", count(*) FILTER (label = 1) AS "1" FROM corpus GROUP BY source')
def source_label_crosstab(spark, sf):
    return PR.source_label_crosstab(view(spark, sf, "corpus"), [0, 1])


@query("missing_ratio", f"WITH {cte('scored')} SELECT 'html_score' AS \"column\", round_even(count(*) FILTER (html_score IS NULL) / count(*), 6) AS ratio FROM scored UNION ALL SELECT 'url', 0.0")
def missing_ratio(spark, sf):
    return PR.missing_ratio(view(spark, sf, "scored"), ["html_score", "url"])


@query("top_domains", f"WITH {FEED_DOM} SELECT domain, count(*) AS n FROM fd GROUP BY domain ORDER BY n DESC, domain LIMIT 20")
def top_domains(spark, sf):
    return PR.top_domains(feed_domains(spark, sf), "domain")


@query("mix_summary", f"WITH {CORPUS} SELECT count(*) AS rows, count(*) FILTER (source IN ({D.quoted(EN)})) AS en, count(*) FILTER (source IN ({D.quoted(VIE)})) AS vie, round(count(*) FILTER (source IN ({D.quoted(EN)})) / count(*) FILTER (source IN ({D.quoted(VIE)})), 3) AS en_vie_ratio FROM corpus")
def mix_summary(spark, sf):
    return PR.mix_summary(view(spark, sf, "corpus"), EN, VIE)


@query("null_by_label", f"WITH {cte('scored')} SELECT label, count(*) FILTER (html_score IS NULL) AS html_score FROM scored GROUP BY label")
def null_by_label(spark, sf):
    return PR.null_by_label(view(spark, sf, "scored"), ["html_score"])


@query("set_union_lists", f"WITH {RULES} SELECT sender_domain AS domain FROM ctx WHERE sender_domain <> '' UNION SELECT domain FROM lnk WHERE domain <> '' UNION SELECT unnest({D.lst(P.FREE_DOMAINS)})")
def set_union_lists(spark, sf):
    r = OR.rule_signals(view(spark, sf, "messages"), only=())
    free = spark.createDataFrame([(d,) for d in P.FREE_DOMAINS], "domain string")
    links = r.select(F.explode_outer("url_domains").alias("domain")).where("domain IS NOT NULL")
    return PR.set_union_lists(r.select(F.col("sender_domain").alias("domain")).where("domain <> ''"), links, free)


# ---- evaluation ----

PREDS = f"""{ANS}, pr AS (SELECT l.msg_id, l.gold_label, CASE WHEN l.ok THEN l.label0 ELSE 'unknown' END AS pred_label, l.ok,
 CASE WHEN gold_label = 'phishing' THEN ['threat', 'urgency'] WHEN msg_id % 3 = 0 THEN ['urgency'] ELSE [] END AS gold_signals,
 CASE WHEN l.ok THEN ['urgency'] ELSE [] END AS pred_signals FROM al l)"""


def predictions(spark, sf):
    a = OA.normalize(OA.parse_json(view(spark, sf, "answers")))
    gold = F.when(F.col("gold_label") == "phishing", F.array(F.lit("threat"), F.lit("urgency"))).when(
        F.col("msg_id") % 3 == 0, F.array(F.lit("urgency"))).otherwise(F.array().cast("array<string>"))
    return a.select("msg_id", "gold_label", F.col("answer_label").alias("pred_label"), "json_parsed", "pred_signals", "items",
                    "body", gold.alias("gold_signals"))


def report_sql(source, group=""):
    g = f"{group}, " if group else ""

    def c(t):
        return f"count(*) FILTER ({t})"

    def r(a, b):
        return f"CASE WHEN {b} > 0 THEN round_even({a} / ({b}), 6) ELSE 0.0 END"

    cols = [f"{g}count(*) AS total_samples", f"{r(c('gold_label = pred_label'), 'count(*)')} AS accuracy"]
    for k in ("phishing", "legit"):
        tp, fp, fn = (c(f"gold_label {a} '{k}' AND pred_label {b} '{k}'") for a, b in (("=", "="), ("<>", "="), ("=", "<>")))
        cols += [f"{r(tp, f'({tp} + {fp})')} AS {k}_precision", f"{r(tp, f'({tp} + {fn})')} AS {k}_recall",
                 f"{r(f'2 * {tp}', f'(2 * {tp} + {fp} + {fn})')} AS {k}_f1", f"{tp} + {fn} AS {k}_support"]
        if k == "phishing":
            cols += [f"{fn} AS phishing_fn", f"{r(fn, f'({tp} + {fn})')} AS phishing_fnr"]
    return f"SELECT {', '.join(cols)} FROM {source}" + (f" GROUP BY {group}" if group else "")


@query("binary_report", f"WITH {PREDS} {report_sql('pr')}")
def binary_report(spark, sf):
    return EV.binary_report(predictions(spark, sf))


@query("confusion_matrix", f"WITH {PREDS} SELECT gold_label, pred_label, count(*) AS n FROM pr GROUP BY ALL")
def confusion_matrix(spark, sf):
    return EV.confusion_matrix(predictions(spark, sf))


@query("phishing_fnr", f"WITH {PREDS} SELECT phishing_fn, phishing_fnr FROM ({report_sql('pr')})")
def phishing_fnr(spark, sf):
    return EV.binary_report(predictions(spark, sf)).select("phishing_fn", "phishing_fnr")


@query("parse_rate", f"WITH {PREDS} SELECT count(*) AS total, count(*) FILTER (ok) AS parsed, round_even(count(*) FILTER (ok) / count(*), 6) AS parse_rate FROM pr")
def parse_rate(spark, sf):
    return EV.parse_rate(predictions(spark, sf))


@query("roc_auc", f"""WITH {URLS} SELECT count(*) FILTER (label = 0) AS positives, count(*) FILTER (label <> 0) AS negatives, (SELECT round(sum(CASE WHEN a.p > b.p THEN 1.0::DOUBLE WHEN a.p = b.p THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END) / count(*), 6)
 FROM us a, us b WHERE a.label = 0 AND b.label <> 0) AS auc FROM us""")
def roc_auc(spark, sf):
    return EV.roc_auc(OF.url_model_score(view(spark, sf, "scored")), "phishing_score", F.col("label") == 0)


@query("threshold_sweep", f"""WITH {URLS}, t AS (SELECT unnest([0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8])::DOUBLE AS threshold),
c AS (SELECT threshold, count(*) FILTER (p >= threshold AND label = 0) AS tp, count(*) FILTER (p >= threshold AND label <> 0) AS fp, count(*) FILTER (p < threshold AND label = 0) AS fn FROM us, t GROUP BY threshold)
SELECT threshold, CASE WHEN tp + fp > 0 THEN round_even(tp / (tp + fp), 6) ELSE 0.0 END AS "precision", CASE WHEN tp + fn > 0 THEN round_even(tp / (tp + fn), 6) ELSE 0.0 END AS recall,
 CASE WHEN 2 * tp + fp + fn > 0 THEN round_even(2 * tp / (2 * tp + fp + fn), 6) ELSE 0.0 END AS f1 FROM c""")
def threshold_sweep(spark, sf):
    return EV.threshold_sweep(OF.url_model_score(view(spark, sf, "scored")), "phishing_score", F.col("label") == 0)


SPANS = f"""{ANS}, sv0 AS (SELECT msg_id, span, cs, ce, a.body AS txt FROM ae e JOIN answers a USING (msg_id)),
sv AS (SELECT *, CASE WHEN span = '' THEN 0 WHEN strpos(lower(txt), lower(span)) > 0 THEN strpos(lower(txt), lower(span)) WHEN regexp_matches(span, '\\s') AND regexp_matches(txt, '(?is)' || regexp_replace(span, '\\s+', '\\\\s+', 'g'))
  THEN strpos(txt, regexp_extract(txt, '(?is)' || regexp_replace(span, '\\s+', '\\\\s+', 'g'))) ELSE 0 END AS p FROM sv0)"""


@query("span_verification", f"""WITH {SPANS} SELECT count(*) AS total, count(*) FILTER (p > 0) AS found, count(*) FILTER (p = 0) AS not_found, count(*) FILTER (p > 0 AND cs >= 0 AND ce >= 0 AND cs = p - 1 AND ce = p - 1 + length(span)) AS char_correct,
 count(*) FILTER (p > 0 AND cs >= 0 AND ce >= 0 AND NOT (cs = p - 1 AND ce = p - 1 + length(span))) AS char_incorrect, round_even(count(*) FILTER (p = 0) / count(*), 6) AS hallucination_rate FROM sv""")
def span_verification(spark, sf):
    return EV.span_verification(predictions(spark, sf), "items", "body")


@query("signal_set_diff", f"WITH {PREDS} SELECT msg_id, array_to_string(list_sort(list_intersect(gold_signals, pred_signals)), ',') AS tp, array_to_string(list_filter(pred_signals, lambda s: NOT list_contains(gold_signals, s)), ',') AS fp, array_to_string(list_filter(gold_signals, lambda s: NOT list_contains(pred_signals, s)), ',') AS fn FROM pr")
def signal_set_diff(spark, sf):
    return PR.signal_set_diff(predictions(spark, sf)).select("msg_id", *[F.array_join(c, ",").alias(c) for c in ("tp", "fp", "fn")])


@query("signal_micro", f"""WITH {PREDS}, x AS (SELECT s AS signal, count(*) FILTER (g AND p) AS tp, count(*) FILTER (p AND NOT g) AS fp, count(*) FILTER (g AND NOT p) AS fn FROM (
 SELECT s, list_contains(gold_signals, s) AS g, list_contains(pred_signals, s) AS p FROM pr, (SELECT unnest({D.lst(P.ANSWER_SIGNALS)}) AS s)) WHERE g OR p GROUP BY s),
y AS (SELECT * FROM x UNION ALL SELECT '*', sum(tp)::BIGINT, sum(fp)::BIGINT, sum(fn)::BIGINT FROM x)
SELECT signal, tp, fp, fn, CASE WHEN tp + fp > 0 THEN round_even(tp / (tp + fp), 6) ELSE 0.0 END AS "precision", CASE WHEN tp + fn > 0 THEN round_even(tp / (tp + fn), 6) ELSE 0.0 END AS recall, round_even(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM y""")
def signal_micro(spark, sf):
    return EV.signal_micro(predictions(spark, sf))


@query("compare_runs", f"""WITH {PREDS}, runs AS (SELECT 'ft' AS run, gold_label, pred_label FROM pr UNION ALL SELECT 'base', gold_label, CASE WHEN msg_id % 2 = 0 THEN 'phishing' ELSE 'legit' END FROM pr) {report_sql('runs', 'run')}""")
def compare_runs(spark, sf):
    p = predictions(spark, sf)
    base = p.withColumn("pred_label", F.when(F.col("msg_id") % 2 == 0, "phishing").otherwise("legit"))
    both = p.select(F.lit("ft").alias("run"), "gold_label", "pred_label").unionByName(
        base.select(F.lit("base").alias("run"), "gold_label", "pred_label"))
    return EV.compare_runs(both)

