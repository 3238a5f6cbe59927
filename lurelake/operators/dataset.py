"""Training-set operators: labels, evidence, sampling with exact quotas, splits, chat records.

Samples are taken by a stable hash of the row id, so they do not depend on partitioning.
Exact quotas never sort a whole stratum in one task: a histogram over hash prefixes finds
the one prefix where the quota ends, only that sliver is ranked, and rows below the resulting
threshold are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window as W, functions as F

from lurelake import params as P
from lurelake.functions import answers as A, text as T
from lurelake.functions.arrays import first_by_key, in_list, py_round, round6
from lurelake.operators.messages import build_text

EVIDENCE = ("array<struct<signal:string,exact_span:string,severity:string,verified:boolean>>")
#: Hex digits of the hash prefixes that rows are counted by; 1.5 million of 10^11 rows share one.
PREFIX = 4
#: Above every hash.
ABOVE = "g"
#: The stratum of tables that have one only.
ONE = "_one"


def label_normalize(value: Column) -> Column:
    """1 for phishing words or a number that truncates to one, else 0."""
    v = F.lower(F.trim(value.cast("string")))
    number = v.try_cast("double")
    return (F.when(v.isin("1", "1.0", "phish", "phishing", "malicious", "spam"), 1)
            .when(v.isin("0", "0.0", "legit", "legitimate", "ham", "benign"), 0)
            .when((number >= 1) & (number < 2), 1).otherwise(0))


def parse_list_column(value: Column, schema: str = EVIDENCE) -> Column:
    """JSON list or Python list text -> array, anything else -> empty array."""
    s = F.trim(value)
    python = s
    for word, json_word in (("True", "true"), ("False", "false"), ("None", "null")):
        python = F.regexp_replace(python, rf"(?<=[:,\[]\s?){word}(?=\s*[,\]}}])", json_word)
    listed = F.when(s.startswith("["), F.coalesce(
        F.from_json(s, schema), F.from_json(python, schema)))
    return F.coalesce(listed, F.from_json(F.lit("[]"), schema))


def evidence_simplify(evidence: Column, max_items: int = 6, taxonomy=P.TRAIN_SIGNALS) -> Column:
    """Valid evidence, strongest severity per (signal, span), strongest first."""
    clean = F.filter(F.transform(evidence, lambda e: F.struct(
        F.lower(F.trim(F.coalesce(e["signal"], F.lit("")))).alias("signal"),
        F.trim(F.coalesce(e["exact_span"], F.lit(""))).alias("exact_span"),
        A.severity_of(e["severity"]).alias("severity"), e["verified"].alias("verified"))),
        lambda e: in_list(e["signal"], taxonomy) & (e["exact_span"] != "")
        & ~F.coalesce(~e["verified"], F.lit(False)))

    def rank(e):
        return F.when(e["severity"] == "high", 3).when(e["severity"] == "medium", 2).otherwise(1)

    def key(e):
        return F.concat_ws("\x01", e["signal"], F.lower(e["exact_span"]))

    def strongest(items):
        keys = F.transform(items, key)
        tagged = F.array_sort(F.transform(items, lambda e, i: F.struct(
            (-rank(e)).alias("r"), F.array_position(keys, key(e)).alias("first"), i.alias("i"),
            F.struct(e["signal"], e["exact_span"], e["severity"]).alias("e"))))
        best = first_by_key(tagged, lambda t: t["first"].cast("string"))
        return F.slice(F.transform(best, lambda t: t["e"]), 1, max_items)

    return F.transform(F.array(clean), strongest).getItem(0)


def message_preprocess(df: DataFrame, source: str | None = None, observed: Observation | None = None) -> DataFrame:
    """(…, text, label, signals, evidence, source) with unusable rows dropped.

    ``observed`` counts, in the pass that the caller's action makes anyway: rows, removed_short (fewer than
    five characters), removed_no_evidence (phishing without evidence, of the rest), kept, kept_phishing and
    kept_legit.
    """
    out = build_text(df).withColumn("label", label_normalize(F.col("label")))
    out = out.withColumn("evidence", evidence_simplify(parse_list_column(F.col("evidence"))))
    out = out.withColumn("evidence", F.when(F.col("label") == 1, F.col("evidence")).otherwise(
        F.slice("evidence", 1, 0)))
    if source is not None:
        out = out.withColumn("source", F.lit(source))
    signals = F.array_sort(F.array_distinct(F.transform("evidence", lambda e: e["signal"])))
    out = out.withColumn("text", F.trim("built_text")).drop("built_text").withColumn(
        "signals", signals)
    long_enough = F.coalesce(F.length("text") >= 5, F.lit(False))
    grounded = F.coalesce((F.col("label") == 0) | (F.size("evidence") > 0), F.lit(False))
    if observed is None:
        return out.where(long_enough & grounded)
    marked = out.withColumns({"_long": long_enough, "_grounded": grounded})
    kept = F.col("_long") & F.col("_grounded")
    return marked.observe(
        observed, F.count(F.lit(1)).alias("rows"), F.count_if(~F.col("_long")).alias("removed_short"),
        F.count_if(F.col("_long") & ~F.col("_grounded")).alias("removed_no_evidence"), F.count_if(kept).alias("kept"),
        F.count_if(kept & (F.col("label") == 1)).alias("kept_phishing"),
        F.count_if(kept & (F.col("label") == 0)).alias("kept_legit")).where(kept).drop("_long", "_grounded")


def dedupe_rows(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def dedupe_url(df: DataFrame, key: str = "url", order: str = "id") -> DataFrame:
    """First row by order for each key, as a partial aggregate (a hot key shrinks early)."""
    first = F.min_by(F.struct(*df.columns), F.col(order)).alias("row")
    return df.groupBy(key).agg(first).select("row.*")


def corpus_union(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.dropna(how="any", subset=["url", "label"])


# ---- sampling by stable hash ----

def _hashed(df: DataFrame, id_col: str, seed: int) -> DataFrame:
    return df.withColumn("_h", T.stable_hash(F.col(id_col), seed))


def _same(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on the keys in which nulls are equal; the left's keys stay."""
    renamed = right.select(*[F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in right.columns])
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return left.join(renamed, same, how).drop(*[f"_r_{k}" for k in keys])


def quota_rule(keyed: DataFrame, quotas: DataFrame, strata: list[str], id_col: str) -> DataFrame:
    """(strata, _th, _tid): the hash and id of the last of the ``quota`` rows of each stratum with the smallest
    hashes ``_h``; a hash above all where the stratum has no more rows.  Strata that take nothing have no row.

    A radix selection in one lazy plan.  Rows are counted per (stratum, hash prefix); the cumulative counts
    give the prefix in which the quota is filled, and only that prefix's rows are ranked: a window sorts
    1 / 16^PREFIX of a stratum, and no more than 16^PREFIX counts.
    """
    narrow = keyed.select(*strata, F.left("_h", F.lit(PREFIX)).alias("_b"), "_h", F.col(id_col).alias("_id"))
    stratum = W.partitionBy(*strata)
    before = stratum.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    histogram = narrow.groupBy(*strata, "_b").agg(F.count(F.lit(1)).alias("_n")).withColumns({
        "_before": F.coalesce(F.sum("_n").over(before), F.lit(0)), "_total": F.sum("_n").over(stratum)})
    bounded = _same(histogram, quotas.select(*strata, "quota"), strata)
    whole = bounded.where("quota >= _total AND _before + _n = _total").select(
        *strata, F.lit(ABOVE).alias("_th"), F.lit(None).cast(narrow.schema["_id"].dataType).alias("_tid"))
    edge = bounded.where("quota < _total AND _before < quota AND quota <= _before + _n").select(
        *strata, "_b", (F.col("quota") - F.col("_before")).alias("_need"))
    rank = F.row_number().over(W.partitionBy(*strata, "_b").orderBy("_h", "_id"))
    last = _same(narrow, edge, [*strata, "_b"]).withColumn("_rn", rank).where("_rn = _need").select(
        *strata, F.col("_h").alias("_th"), F.col("_id").alias("_tid"))
    return whole.unionByName(last)


def flag_quota(df: DataFrame, quotas: DataFrame, strata: list[str], id_col: str, seed: int = 42,
               out: str = "taken") -> DataFrame:
    """All rows, ``out`` true for the ``quota`` rows per stratum with the smallest hashes (exact).

    ``quotas`` has the strata columns and ``quota``; strata without one take nothing.  Nothing runs before the
    caller's action.
    """
    keyed = _hashed(df, id_col, seed)
    rule = quota_rule(keyed, quotas, strata, id_col)
    if strata == [ONE]:
        rule = F.broadcast(rule)  # one row
    h, th = F.col("_h"), F.col("_th")
    below = (h < th) | ((h == th) & (F.col(id_col) <= F.col("_tid")))
    return _same(keyed, rule, strata, "left").withColumn(
        out, F.coalesce(below, F.lit(False))).select(*df.columns, out)


def take_quota(df: DataFrame, quotas: DataFrame, strata: list[str], id_col: str,
               seed: int = 42) -> DataFrame:
    """Keep, per stratum, the ``quota`` rows with the smallest hashes (exact); see ``flag_quota``."""
    return flag_quota(df, quotas, strata, id_col, seed, "_taken").where("_taken").select(*df.columns)


def share_quotas(df: DataFrame, share: float, strata: list[str]) -> DataFrame:
    """(strata, quota): the rounded share of each stratum's rows."""
    return df.groupBy(*strata).agg(py_round(F.count(F.lit(1)) * share, 0).cast("long").alias("quota"))


def take_share(df: DataFrame, share: float, id_col: str, seed: int = 42,
               strata: list[str] | None = None) -> DataFrame:
    """Exact rounded share of the rows, per stratum when strata are given."""
    base = df if strata else df.withColumn(ONE, F.lit(1))
    keys = strata or [ONE]
    return take_quota(base, share_quotas(base, share, keys), keys, id_col, seed).select(*df.columns)


def cap_per_domain(df: DataFrame, domain_col: str, order: str, cap: int = 50) -> DataFrame:
    """First ``cap`` rows per domain; the rank limit runs before the shuffle as well."""
    rank = F.row_number().over(W.partitionBy(domain_col).orderBy(order))
    return df.withColumn("_rn", rank).where(F.col("_rn") <= cap).drop("_rn")


def sample_per_domain(df: DataFrame, domain_col: str, id_col: str, cap: int = 50,
                      target: int | None = None, seed: int = 42) -> DataFrame:
    """At most ``cap`` random rows per domain and ``target`` rows overall."""
    hashed = _hashed(df, id_col, seed)
    rank = F.row_number().over(W.partitionBy(domain_col).orderBy("_h", id_col))
    kept = hashed.withColumn("_rn", rank).where(F.col("_rn") <= cap)
    if target is not None:
        kept = kept.orderBy("_h", id_col).limit(target)
    return kept.drop("_h", "_rn")


def shuffle_rows(df: DataFrame, id_col: str, seed: int = 42) -> DataFrame:
    return _hashed(df, id_col, seed).orderBy("_h", id_col).drop("_h")


def length_counts(df: DataFrame, group_cols: list[str], text_col: str = "text") -> DataFrame:
    """(group, _len, _n): how many texts of a group have a length."""
    return df.groupBy(*group_cols, F.length(text_col).alias("_len")).agg(F.count(F.lit(1)).alias("_n"))


def length_edges(lengths: DataFrame, group_cols: list[str], q: int = 5) -> DataFrame:
    """Interior quantile edges of the text length per group, duplicate edges dropped.

    The percentile sees one row per distinct length.
    """
    shares = F.array(*[F.lit(i / q) for i in range(q + 1)])
    edges = F.array_distinct(F.percentile("_len", shares, F.col("_n")))
    return lengths.groupBy(*group_cols).agg(edges.alias("_e")).withColumn(
        "_edges", F.slice("_e", 2, F.greatest(F.size("_e") - 2, F.lit(0)))).drop("_e")


def _length_bucket(length: Column) -> Column:
    return F.coalesce(F.size(F.filter("_edges", lambda e: length > e)), F.lit(0))


def length_buckets(df: DataFrame, group_cols: list[str] | None = None, text_col: str = "text",
                   q: int = 5) -> DataFrame:
    """Add ``text_len`` and ``len_bucket`` (quantile bucket within the group)."""
    base = df if group_cols else df.withColumn(ONE, F.lit(1))
    keys = group_cols or [ONE]
    edges = length_edges(length_counts(base, keys, text_col), keys, q)
    if not group_cols:
        edges = F.broadcast(edges)  # one row
    # the length goes through the join, so a caller that keeps no text moves none
    out = _same(base.withColumn("text_len", F.length(text_col)), edges, keys, "left").withColumn(
        "len_bucket", _length_bucket(F.col("text_len")))
    return out.select(*df.columns, "text_len", "len_bucket")


def stratified_downsample(df: DataFrame, targets: DataFrame, group_cols: list[str], id_col: str,
                          text_col: str = "text", seed: int = 42) -> DataFrame:
    """Per group keep ``target`` rows, spread over its length buckets in proportion.

    The last bucket takes the remainder of the rounding.  A bucket's rows are counted by their lengths' counts.
    """
    bucketed = length_buckets(df, group_cols, text_col)
    lengths = length_counts(df, group_cols, text_col)
    counts = _same(lengths, length_edges(lengths, group_cols), group_cols).withColumn(
        "len_bucket", _length_bucket(F.col("_len"))).groupBy(*group_cols, "len_bucket").agg(F.sum("_n").alias("_c"))
    per_group = W.partitionBy(*group_cols)
    counts = _same(counts, targets, group_cols).withColumns({
        "_total": F.sum("_c").over(per_group),
        "_last": F.max("len_bucket").over(per_group) == F.col("len_bucket"),
    })
    share = F.least(py_round(F.col("target") * F.col("_c") / F.col("_total"), 0), F.col("_c"))
    counts = counts.withColumn("_q", F.when(F.col("_last"), F.lit(0)).otherwise(share.cast("long")))
    counts = counts.withColumn("quota", F.when(
        F.col("target") >= F.col("_total"), F.col("_c")).when(
            F.col("_last"), F.least(F.col("target") - F.sum("_q").over(per_group), F.col("_c")))
        .otherwise(F.col("_q")))
    quotas = counts.select(*group_cols, "len_bucket", F.col("quota").cast("long").alias("quota"))
    return take_quota(bucketed, quotas, [*group_cols, "len_bucket"], id_col, seed).select(
        *df.columns)


def balance_by_source(df: DataFrame, id_col: str, ratio: float = 1.0, seed: int = 42) -> DataFrame:
    """Per source all phishing rows and legit rows sampled to ``ratio`` by text length."""
    legit = df.where(F.col("label") == 0)
    targets = df.groupBy("source").agg(F.least(
        F.count_if(F.col("label") == 0),
        py_round(F.count_if(F.col("label") == 1) * ratio, 0).cast("long")).alias("target"))
    sampled = stratified_downsample(legit, targets, ["source"], id_col, seed=seed)
    return df.where(F.col("label") == 1).unionByName(sampled)


def language_partition(df: DataFrame, sources) -> DataFrame:
    return df.where(F.col("source").isin(list(sources)))


def language_mix(kept: DataFrame, sampled: DataFrame, ratio: float, id_col: str,
                 seed: int = 42) -> DataFrame:
    """All rows of ``kept`` and ratio * |kept| rows of ``sampled`` (at most all of them)."""
    quotas = kept.agg(py_round(F.count(F.lit(1)) * ratio, 0).cast("long").alias("quota")).select(
        F.lit(1).alias(ONE), "quota")
    part = take_quota(sampled.withColumn(ONE, F.lit(1)), quotas, [ONE], id_col, seed)
    return kept.unionByName(part.drop(ONE))


def replay_mix(target: DataFrame, other: DataFrame, id_col: str, share: float = 0.2,
               seed: int = 42) -> DataFrame:
    """Target-language rows and a share of the other language to replay."""
    return target.unionByName(take_share(other, share, id_col, seed))


def split_strata(df: DataFrame, evidence_count: str = "n_evidence") -> DataFrame:
    """Add ``split_strata``: source_label_bucket, or source_label if a stratum has one row."""
    n = F.col(evidence_count)
    bucket = F.when(n == 0, "0").when(n <= 2, "1_2").otherwise("3plus")
    fine = F.concat_ws("_", "source", F.col("label").cast("string"), bucket)
    coarse = F.concat_ws("_", "source", F.col("label").cast("string"))
    smallest = df.groupBy(fine.alias("s")).count().agg(F.min("count").alias("m")).first()["m"]
    return df.withColumn("split_strata", coarse if smallest is not None and smallest < 2 else fine)


def stratified_split(df: DataFrame, id_col: str, eval_share: float = 0.15,
                     strata_col: str = "split_strata", seed: int = 42) -> DataFrame:
    """Add ``split`` train/eval with the share taken exactly in every stratum."""
    flagged = flag_quota(df, share_quotas(df, eval_share, [strata_col]), [strata_col], id_col, seed, "_eval")
    return flagged.withColumn("split", F.when(F.col("_eval"), F.lit("eval")).otherwise(F.lit("train"))).drop("_eval")


def group_split(df: DataFrame, group_col: str, test_share: float = 0.2, seed: int = 42) -> DataFrame:
    """Add ``split``: the share of groups (not rows) with the smallest hashes is test.

    The test groups form a hash range, so rows are assigned by comparing their group's hash
    with one threshold: no join on the group and no cost for a hot group.
    """
    groups = df.select(F.lit(1).alias(ONE), F.col(group_col).alias("g")).distinct().withColumn(
        "_h", T.stable_hash(F.col("g"), seed))
    quotas = groups.groupBy(ONE).agg(F.ceil(F.count(F.lit(1)) * test_share).alias("quota"))
    rule = F.broadcast(quota_rule(groups, quotas, [ONE], "g").drop("_tid"))  # one row
    test = F.coalesce(T.stable_hash(F.col(group_col), seed) <= F.col("_th"), F.lit(False))
    ruled = _same(df.withColumn(ONE, F.lit(1)), rule, [ONE], "left")
    return ruled.withColumn("split", F.when(test, F.lit("test")).otherwise(F.lit("train"))).select(*df.columns, "split")


def set_leak(train: DataFrame, test: DataFrame, key: str) -> DataFrame:
    """Keys present on both sides (should be empty)."""
    return train.select(key).intersect(test.select(key))


def median_impute(df: DataFrame, features, split_col: str = "split") -> DataFrame:
    """Fill NULL features with train medians, then 0.

    Values are counted per feature before the percentile, in one pass over the train rows.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).cast("double").alias("v"))
                                for f in features])).alias("p")
    counted = (
        df.where(F.col(split_col) == "train").select(pairs).select("p.f", "p.v")
        .where(F.col("v").isNotNull()).groupBy("f", "v").agg(F.count(F.lit(1)).alias("n"))
    )
    medians = {r["f"]: r["m"] for r in counted.groupBy("f").agg(
        F.percentile("v", F.lit(0.5), F.col("n")).alias("m")).collect()}
    return df.withColumns({f: F.coalesce(
        F.col(f).cast("double"), F.lit(float(medians.get(f, 0.0)))) for f in features})


def class_weights(df: DataFrame, label_col: str = "label") -> DataFrame:
    """(label, n, weight) with weight = total / (classes used * n), two classes."""
    counts = df.groupBy(label_col).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(W.partitionBy())
    return counts.withColumn("weight", round6(total / (2 * F.col("n"))))


# ---- chat records ----

def assistant_json(label: Column, evidence: Column, signals: Column) -> Column:
    """Compact JSON answer; legit rows carry empty lists."""
    legit = label == 0
    return F.to_json(F.struct(
        F.when(legit, F.lit("legit")).otherwise(F.lit("phishing")).alias("label"),
        F.when(legit, F.slice(signals, 1, 0)).otherwise(signals).alias("signals"),
        F.when(legit, F.slice(evidence, 1, 0)).otherwise(evidence).alias("evidence")))


def chat_record(df: DataFrame, system_prompt: str) -> DataFrame:
    """Add ``messages``: system, user and assistant turns."""
    def turn(role, content):
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    answer = assistant_json(F.col("label"), F.col("evidence"), F.col("signals"))
    return df.withColumn("messages", F.array(
        turn("system", F.lit(system_prompt)), turn("user", F.col("text")),
        turn("assistant", answer)))


def chat_valid(messages: Column) -> Column:
    """True for a record that meets the answer contract."""
    content = F.try_element_at(messages, F.lit(3))["content"]
    parsed = F.from_json(content, "label string, signals array<string>, evidence array<string>")
    shape = (F.size(messages) == 3) & (
        F.array_join(F.transform(messages, lambda m: m["role"]), ",") == "system,user,assistant")
    signals, evidence = F.size(parsed["signals"]), F.size(parsed["evidence"])
    lists = parsed["signals"].isNotNull() & parsed["evidence"].isNotNull()
    legit_ok = (parsed["label"] == "legit") & (signals == 0) & (evidence == 0)
    phish_ok = (parsed["label"] == "phishing") & (evidence > 0)
    return F.coalesce(shape & lists & (legit_ok | phish_ok), F.lit(False))


def chat_validate(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("checked"),
                  F.count_if(~chat_valid(F.col("messages"))).alias("bad"))


def token_budget_check(df: DataFrame, text_col: str, limit: int) -> DataFrame:
    """Longest text in white-space tokens and the rows over the limit."""
    n = F.size(F.regexp_extract_all(text_col, F.lit(r"\S+"), F.lit(0)))
    return df.agg(F.count(F.lit(1)).alias("rows"), F.max(n).alias("max_tokens"),
                  F.count_if(n > limit).alias("over_limit"))


def convert_labels(messages: Column) -> Column:
    """Rewrite a 0/1 label inside the assistant's JSON answer to legit/phishing."""
    def turn(m):
        label = F.get_json_object(m["content"], "$.label")
        word = F.when(label == "0", F.lit('"legit"')).when(label == "1", F.lit('"phishing"'))
        swapped = F.regexp_replace(
            m["content"], r'("label"\s*:\s*)[01](?=\s*[,}])', F.concat(F.lit("$1"), word))
        return F.struct(m["role"].alias("role"), F.when(
            (m["role"] == "assistant") & word.isNotNull(), swapped).otherwise(m["content"])
            .alias("content"))

    return F.transform(messages, turn)
