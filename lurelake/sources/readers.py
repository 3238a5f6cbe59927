"""Readers for URL and message corpora, term lists, brand lists, feeds and sitemaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lurelake import params as P
from lurelake.functions import answers as A, urls as U
from lurelake.operators.urls import latest_per_key
from lurelake.sources.sinks import scratch_path

CSV = {"header": True, "quote": '"', "escape": '"'}


def read_url_corpus(spark: SparkSession, path: str) -> DataFrame:
    """CSV with url and label; rows without either are dropped, other columns never read."""
    raw = spark.read.options(**CSV).csv(path)
    missing = {"url", "label"} - set(raw.columns)
    if missing:
        raise ValueError(f"input lacks the columns {sorted(missing)}")
    return raw.select(F.col("url").cast("string"), F.expr("try_cast(label AS INT)").alias("label")
                      ).dropna(subset=["url", "label"])


def read_message_corpora(spark: SparkSession, paths: dict[str, str],
                         multiline: bool = True) -> DataFrame:
    """Several CSV corpora tagged with their source name, columns aligned by name.

    ``multiline`` is needed for texts with line breaks and makes each file one split;
    write the corpora as many files, or turn it off where records are single lines.
    """
    out = None
    for source, path in paths.items():
        part = spark.read.options(**CSV, multiLine=multiline).csv(path).withColumn(
            "source", F.lit(source))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def read_chat_jsonl(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """JSONL chat records -> prompts and gold answer; unparsable answers are skipped."""
    raw = spark.read.schema("messages array<struct<role:string,content:string>>").json(path)

    def first(role):
        return F.coalesce(F.get(F.filter("messages", lambda m: m["role"] == role), F.lit(0))[
            "content"], F.lit(""))

    out = raw.select(first("system").alias("system_prompt"), first("user").alias("user_prompt"),
                     first("assistant").alias("_a"))
    out = out.where(F.try_parse_json("_a").isNotNull()).withColumn(
        "_g", F.from_json("_a", A.ANSWER_SCHEMA))
    out = out.select(
        "system_prompt", "user_prompt",
        F.coalesce("_g.label", F.lit("unknown")).alias("gold_label"),
        F.array_distinct(F.coalesce("_g.signals", F.array().cast("array<string>"))).alias(
            "gold_signals"), F.col("_g.evidence").alias("gold_evidence"))
    return out if limit is None else out.limit(limit)


def read_term_list(spark: SparkSession, path: str) -> DataFrame:
    """One term per line; blanks and comment lines dropped, trimmed, lower, distinct."""
    t = F.trim("value")
    return spark.read.text(path).where((t != "") & ~t.startswith("#")).select(
        F.lower(t).alias("term")).distinct()


def read_brand_whitelist(spark: SparkSession, path: str, suffixes=P.PUBLIC_SUFFIXES) -> DataFrame:
    """JSON object brand -> domain or list of domains, as (brand, domain, registered_domain)."""
    raw = spark.read.option("wholetext", True).text(path)
    pairs = raw.select(F.explode(F.from_json("value", "map<string,string>")).alias("brand", "v"))
    listed = F.when(F.ltrim("v").startswith("["), F.from_json("v", "array<string>")).otherwise(
        F.array("v"))
    return pairs.select("brand", F.explode(listed).alias("domain")).withColumn(
        "registered_domain", U.registered_domain(F.col("domain"), suffixes))


def read_ranked_domains(ranked: DataFrame, start: int, end: int,
                        priority=P.PRIORITY_DOMAINS) -> DataFrame:
    """(ord, domain): priority domains first, then ranks start..end (both included).

    ``ord`` is an ordering key made from the rank, so nothing is numbered globally.
    """
    spark = ranked.sparkSession
    first = spark.createDataFrame(list(enumerate(priority)), "ord long, domain string")
    rest = ranked.where(F.col("rank").between(start, end)).select(
        (F.col("rank") + len(priority)).cast("long").alias("ord"),
        F.lower(F.trim("domain")).alias("domain"))
    rest = rest.where(~F.col("domain").isin(list(priority)))
    return first.unionByName(rest.groupBy("domain").agg(F.min("ord").alias("ord")).select(
        "ord", "domain"))


LOC = r"<loc>\s*(https?://[^<\s]+)\s*</loc>"


def sitemap_documents(docs: DataFrame, max_children: int | None = None) -> DataFrame:
    """(domain, url, xml) of the page lists that a domain's entry documents lead to, over index documents of any
    depth.

    Breadth first over the table: each round joins the children of the index documents just reached with the
    documents, and goes on from those not met before, so cycles and shared children end.  A round's documents are
    written under the checkpoint folder; only their number reaches the driver.
    """
    spark = docs.sparkSession
    is_index = F.col("xml").contains("<sitemapindex")
    found = F.regexp_extract_all("xml", F.lit(r"(?s)<sitemap>.*?" + LOC), F.lit(1))
    children = F.array_distinct(found if max_children is None else F.slice(found, 1, max_children))
    pages = docs.select("url", "xml").where("xml IS NOT NULL").dropDuplicates(["url"])

    def written(df: DataFrame, name: str) -> DataFrame:
        path = scratch_path(spark, name)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    frontier = written(docs.where("is_entry AND xml IS NOT NULL").select("domain", "url", "xml").dropDuplicates(
        ["domain", "url"]), "sitemap-0")
    reached, depth = frontier, 0
    while frontier.limit(1).count():
        depth += 1
        asked = frontier.where(is_index).select("domain", F.explode_outer(children).alias("url")).where(
            "url IS NOT NULL").distinct()
        asked = asked.join(reached.select("domain", "url"), ["domain", "url"], "left_anti")
        frontier = written(asked.join(pages, "url").select("domain", "url", "xml"), f"sitemap-{depth}")
        reached = reached.unionByName(frontier)
    return reached.where(~is_index)


def extract_sitemap_locs(docs: DataFrame, max_children: int | None = None) -> DataFrame:
    """Fetched sitemap documents (domain, url, xml, is_entry) -> page URLs (domain, loc) of the same domain.

    All page lists that the entries lead to count, see ``sitemap_documents``; ``max_children`` bounds the
    children of an index where a crawl is to be short.
    """
    leaves = sitemap_documents(docs, max_children)
    urls = leaves.select("domain", F.explode_outer(F.regexp_extract_all(
        "xml", F.lit(LOC), F.lit(1))).alias("loc")).where("loc IS NOT NULL")
    net = F.lower(U.netloc(F.col("loc")))
    same = (net == F.col("domain")) | F.endswith(net, F.concat(F.lit("."), F.col("domain")))
    return urls.where(same & U.content_url(F.col("loc"))).distinct()


def feed_incremental_load(feed: DataFrame, before_id: int | None = None,
                          cap: int | None = None) -> DataFrame:
    """Feed rows below the id cursor, one per URL (largest id), newest first, label 0."""
    page = feed if before_id is None else feed.where(F.col("id") < before_id)
    latest = latest_per_key(page.select("id", "url", "date"), "url", "id").withColumn(
        "label", F.lit(0))
    return latest if cap is None else latest.orderBy(F.desc("id")).limit(cap)
