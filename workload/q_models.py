"""Model training and streaming queries."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from lurelake import params as P
from lurelake.operators import dataset as DS, pages as OP, train as TR, trees as TREES, urls as OU
from lurelake.sources.sinks import scratch_path
from lurelake.streaming import jobs as J
from workload.bridge import cte, view
from workload.q_messages import LISTS, RULES, blacklist, rule_input
from workload.registry import query, table

ALL = P.URL_MODEL_FEATURES + P.HTML_MODEL_FEATURES
#: The tree counts of the models stay their limits; larger steps and short rounds make the early stop come soon.
QUICK = {"rate": 0.3, "depth": 3, "every": 4, "patience": 8}
RISK = "CASE WHEN (page_id % 8 IN (1, 2, 3, 5, 7)) <> (page_id % 11 = 0) THEN 0 ELSE 1 END"


def features(spark, sf):
    """Lexical and page features of every page with a label that follows the kind of host, noise in between;
    split by label, written once and read back."""
    path = scratch_path(spark, "url-features")
    lex = OU.url_lexical_features(view(spark, sf, "hosts")).select("page_id", *P.URL_MODEL_FEATURES)
    page = OP.html_features(view(spark, sf, "pages_rich")).select("page_id", *P.HTML_MODEL_FEATURES)
    both = lex.join(page, "page_id").withColumn("label", F.expr(RISK))
    both.write.parquet(path)
    return spark.read.parquet(path)


def parts(df):
    """(train, validation): the same exact share of every label is held out."""
    split = DS.stratified_split(df, "page_id", 0.2, "label")
    return split.where("split = 'train'"), split.where("split = 'eval'")


def fitted(spark, sf, kind, rows=None, **options):
    df = features(spark, sf)
    df = df if kind == "lexical" else OU.complete_rows(df)
    df = rows(df) if rows else df
    train, valid = parts(df)
    setting = replace({"lexical": TR.LEXICAL, "html": TR.HTML}.get(kind, TR.FULL), **QUICK)
    if kind == "all":
        return df, TR.train_url_all(train, valid, ("page_id", "label", "split"), setting, **options)
    make = {"lexical": TR.train_url_lexical, "html": TR.train_url_html, "full": TR.train_url_full}[kind]
    return df, make(train, valid, setting, **options)


def trained_sql(floor, complete):
    """Rows of each label and part, and that the validation AUC is above the floor."""
    return f"""WITH f AS (SELECT {RISK} AS label, count(*) AS n FROM pages {"WHERE page_id % 25 <> 24" if complete else ""} GROUP BY 1),
q AS (SELECT label, n, CAST(round_even(n * 0.2::DOUBLE, 0) AS BIGINT) AS e FROM f)
SELECT label, n - e AS train_rows, e AS eval_rows, true AS auc_above_{floor}, true AS stopped_early FROM q"""


def trained_rows(df, result, floor):
    train, valid = parts(df)
    counts = train.groupBy("label").agg(F.count(F.lit(1)).alias("train_rows")).join(
        valid.groupBy("label").agg(F.count(F.lit(1)).alias("eval_rows")), "label")
    return counts.withColumns({f"auc_above_{floor}": F.lit(result.auc * 100 > floor),
                               "stopped_early": F.lit(len(result.model.trees) < 200)})


@query("train_url_lexical", trained_sql(80, False))
def train_url_lexical(spark, sf):
    df, result = fitted(spark, sf, "lexical")
    return trained_rows(df, result, 80)


def weighted(df):
    weights = DS.class_weights(parts(df)[0]).select("label", "weight")
    return df.join(weights, "label")


@query("train_url_html", trained_sql(60, True))
def train_url_html(spark, sf):
    df, result = fitted(spark, sf, "html", weighted, weight_col="weight")
    return trained_rows(df, result, 60)


@query("train_url_full", trained_sql(80, True))
def train_url_full(spark, sf):
    df, result = fitted(spark, sf, "full")
    return trained_rows(df, result, 80)


@query("train_url_all", trained_sql(80, True))
def train_url_all(spark, sf):
    """Over every numeric column, an encoded category included."""
    def encoded(df):
        pages = table(spark, sf, "pages").select("page_id", F.regexp_extract("url", "//([^/.]*)", 1).alias("first_label"))
        return TR.encode_categoricals(df.join(pages, "page_id"), ["first_label"], "label", "page_id").drop("first_label")

    df, result = fitted(spark, sf, "all", encoded)
    return trained_rows(df, result, 80)


@query("url_batch_score", """SELECT page_id, true AS lexical_in_range, page_id % 25 <> 24 AS html_scored,
 CASE WHEN page_id % 25 <> 24 THEN true END AS html_in_range FROM pages""")
def url_batch_score(spark, sf):
    df, lexical = fitted(spark, sf, "lexical")
    _, html = fitted(spark, sf, "html")
    scored = TR.url_batch_score(lexical.model, html.model, df)
    return scored.select("page_id", F.col("lexical_score").between(0, 1).alias("lexical_in_range"),
                         F.col("html_score").isNotNull().alias("html_scored"), F.col("html_score").between(0, 1).alias("html_in_range"))


ENCODED = "(coalesce(sum(label) OVER {0}, 0) + 0.5::DOUBLE) / (count(label) OVER {0} + 1.0::DOUBLE) AS {0}_enc"


@query("encode_categoricals", f"""WITH {cte('corpus')} SELECT id, {ENCODED.format("source")}, {ENCODED.format("lang")} FROM corpus
WINDOW source AS (PARTITION BY source ORDER BY md5('42:' || id), id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
 lang AS (PARTITION BY lang ORDER BY md5('42:' || id), id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def encode_categoricals(spark, sf):
    rows = view(spark, sf, "corpus").select("id", "source", "lang", "label")
    return TR.encode_categoricals(rows, ["source", "lang"], "label", "id").select("id", "source_enc", "lang_enc")


@query("feature_importance", f"""SELECT unnest({list(ALL)}) AS feature, true AS in_range, true AS sums_to_one""")
def feature_importance(spark, sf):
    _, result = fitted(spark, sf, "full")
    found = TR.feature_importance(result.model, spark)
    total = found.agg(F.abs(F.sum("importance") - 1) < 1e-9).first()[0]
    return found.select("feature", F.col("importance").between(0, 1).alias("in_range"), F.lit(total).alias("sums_to_one"))


@query("shap_mean_abs", f"""SELECT unnest({list(ALL)}) AS feature, (SELECT count(*) FROM pages WHERE page_id % 25 <> 24) AS rows_explained,
 true AS adds_up, true AS in_range""")
def shap_mean_abs(spark, sf):
    df, result = fitted(spark, sf, "full")
    rows = TREES.score(result.model, TREES.shap_values(result.model, df), "margin", margin=True)
    gap = F.abs(F.aggregate("phi", F.col("base"), lambda a, x: a + x) - F.col("margin"))
    exact = rows.agg(F.count(F.lit(1)).alias("rows_explained"), (F.max(gap) < 1e-9).alias("adds_up")).first()
    return TREES.shap_mean_abs(result.model, df).select(
        "feature", F.lit(exact["rows_explained"]).alias("rows_explained"), F.lit(exact["adds_up"]).alias("adds_up"),
        (F.col("mean_abs") >= 0).alias("in_range"))


@query("stream_score_messages", f"WITH {RULES} SELECT msg_id, round(score, 6) AS score, verdict, reason FROM rules")
def stream_score_messages(spark, sf):
    src, out, check = (scratch_path(spark, n) for n in ("messages", "scored", "check"))
    m = rule_input(spark, sf)
    files = spark.sparkContext.defaultParallelism  # of each of four batches
    m.repartition(4 * files).write.parquet(src)
    stream = J.read_stream(spark, src, m.schema, files)
    J.stream_score_messages(stream, out, check, LISTS, blacklist=blacklist(spark)).awaitTermination()
    return spark.read.parquet(out).select("msg_id", F.round("score", 6).alias("score"), "verdict", "reason")


@query("stream_feed_dedupe", f"WITH {cte('feed')} SELECT id, url FROM feed QUALIFY row_number() OVER (PARTITION BY url ORDER BY id DESC) = 1")
def stream_feed_dedupe(spark, sf):
    src, out, check = (scratch_path(spark, n) for n in ("feed", "latest", "check"))
    f = J.with_timestamp(view(spark, sf, "feed"))
    f.repartition(3).write.parquet(src)
    J.stream_feed_dedupe(J.read_stream(spark, src, f.schema, 10), out, check).awaitTermination()
    return J.feed_latest(spark, out, f.schema).select("id", "url")
