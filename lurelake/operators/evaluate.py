"""Evaluation reports: each is one partial aggregate over the predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lurelake.functions import answers as A
from lurelake.functions.arrays import exploded, round6


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / F.nullif(b, F.lit(0))).otherwise(F.lit(0.0))


def _f1(tp: Column, fp: Column, fn: Column) -> Column:
    return _ratio(2 * tp, 2 * tp + fp + fn)


def binary_report(df: DataFrame, gold: str = "gold_label", pred: str = "pred_label",
                  by=()) -> DataFrame:
    """Accuracy, per-class precision/recall/F1/support and phishing FNR (per ``by`` group)."""
    counts = df.groupBy(*by, gold, pred).agg(F.count(F.lit(1)).alias("_n"))
    g, p = F.col(gold), F.col(pred)

    def total(test):
        return F.coalesce(F.sum(F.when(test, F.col("_n"))), F.lit(0))

    n = F.sum("_n")
    out = {"total_samples": n, "accuracy": round6(_ratio(total(g == p), n))}
    for c in ("phishing", "legit"):
        tp, fp = total((g == c) & (p == c)), total((g != c) & (p == c))
        fn = total((g == c) & (p != c))
        out |= {f"{c}_precision": round6(_ratio(tp, tp + fp)),
                f"{c}_recall": round6(_ratio(tp, tp + fn)),
                f"{c}_f1": round6(_f1(tp, fp, fn)), f"{c}_support": tp + fn}
        if c == "phishing":
            out |= {"phishing_fn": fn, "phishing_fnr": round6(_ratio(fn, tp + fn))}
    return counts.groupBy(*by).agg(*[v.alias(k) for k, v in out.items()])


def confusion_matrix(df: DataFrame, gold: str = "gold_label", pred: str = "pred_label") -> DataFrame:
    return df.groupBy(gold, pred).agg(F.count(F.lit(1)).alias("n"))


def roc_auc(df: DataFrame, score: str, positive: Column, buckets: int = 256) -> DataFrame:
    """Exact AUC with ties counted half.

    Equal scores collapse first.  Distinct scores are then cut into ranges, negatives below
    each range come from the small per-range totals, and the running count inside a range
    is a window over that range only, so no task sorts all scores.
    """
    tallied = df.where(F.col(score).isNotNull()).groupBy(F.col(score).alias("s")).agg(
        F.count_if(positive).alias("pos"), F.count_if(~positive).alias("neg"))
    shares = F.array(*[F.lit(i / buckets) for i in range(1, buckets)])
    edges = tallied.agg(F.percentile_approx("s", shares, 10_000)).first()[0] or []
    cuts = F.array(*[F.lit(float(e)) for e in sorted(set(edges))]) if edges else F.array(F.lit(0.0))
    ranged = tallied.withColumn("r", F.size(F.filter(cuts, lambda e: e < F.col("s"))))
    totals = ranged.groupBy("r").agg(F.sum("pos").alias("rp"), F.sum("neg").alias("rn"))
    below = F.coalesce(F.sum("rn").over(
        W.orderBy("r").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    inner = F.coalesce(F.sum("neg").over(
        W.partitionBy("r").orderBy("s").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    wins = ranged.withColumn("inner", inner).groupBy("r").agg(
        F.sum(F.col("pos") * (F.col("inner") + F.col("neg") / 2)).alias("w"))
    joined = totals.withColumn("below", below).join(wins, "r")
    p, n = F.sum("rp"), F.sum("rn")
    auc = F.sum(F.col("w") + F.col("rp") * F.col("below")) / F.nullif(p * n, F.lit(0))
    return joined.agg(p.alias("positives"), n.alias("negatives"), F.round(auc, 6).alias("auc"))


def threshold_sweep(df: DataFrame, score: str, positive: Column,
                    thresholds=(0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8)) -> DataFrame:
    """Precision, recall and F1 per threshold from one aggregate, unpivoted afterwards."""
    aggs = [F.count_if(positive).alias("p")]
    for i, t in enumerate(thresholds):
        above = F.col(score) >= t
        aggs += [F.count_if(above & positive).alias(f"tp{i}"),
                 F.count_if(above & ~positive).alias(f"fp{i}")]
    one = df.agg(*aggs)
    rows = F.explode(F.array(*[F.struct(
        F.lit(float(t)).alias("threshold"), F.col(f"tp{i}").alias("tp"),
        F.col(f"fp{i}").alias("fp"), (F.col("p") - F.col(f"tp{i}")).alias("fn"))
        for i, t in enumerate(thresholds)])).alias("x")
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return one.select(rows).select("x.*").select(
        "threshold", round6(_ratio(tp, tp + fp)).alias("precision"),
        round6(_ratio(tp, tp + fn)).alias("recall"), round6(_f1(tp, fp, fn)).alias("f1"))


def parse_rate(df: DataFrame, col: str = "json_parsed") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total"), F.count_if(col).alias("parsed"),
                  round6(_ratio(F.count_if(col), F.count(F.lit(1)))).alias("parse_rate"))


def span_checks(df: DataFrame, items_col: str, text_col: str) -> DataFrame:
    """Per-row counts: total, found, not_found, char_correct, char_incorrect."""
    def check(e):
        at = A.find_span(e["exact_span"], F.col(text_col))
        return F.struct(at.alias("at"), F.coalesce(e["char_start"], F.lit(-1)).alias("s"),
                        F.coalesce(e["char_end"], F.lit(-1)).alias("e"))

    def stated(c):
        return c["at"].isNotNull() & (c["s"] >= 0) & (c["e"] >= 0)

    def right(c):
        return (c["s"] == c["at"]["s"]) & (c["e"] == c["at"]["e"])

    out = df.withColumn("_c", F.transform(items_col, check))
    return out.withColumns({
        "total": F.size("_c"),
        "found": F.size(F.filter("_c", lambda c: c["at"].isNotNull())),
        "char_correct": F.size(F.filter("_c", lambda c: stated(c) & right(c))),
        "char_incorrect": F.size(F.filter("_c", lambda c: stated(c) & ~right(c))),
    }).withColumn("not_found", F.col("total") - F.col("found")).drop("_c")


def span_verification(df: DataFrame, items_col: str, text_col: str, by=()) -> DataFrame:
    checked = span_checks(df, items_col, text_col)
    names = ("total", "found", "not_found", "char_correct", "char_incorrect")
    sums = [F.sum(c).alias(c) for c in names]
    return checked.groupBy(*by).agg(*sums, round6(_ratio(
        F.sum("not_found"), F.sum("total"))).alias("hallucination_rate"))


def signal_micro(df: DataFrame, gold: str = "gold_signals", pred: str = "pred_signals") -> DataFrame:
    """TP/FP/FN and precision/recall/F1 per signal and overall (signal = '*').

    Sets are compared inside the row, so samples are never joined to themselves.
    """
    tagged = F.concat(
        F.transform(F.array_intersect(gold, pred), lambda s: F.struct(
            s.alias("signal"), F.lit("tp").alias("kind"))),
        F.transform(F.array_except(pred, gold), lambda s: F.struct(
            s.alias("signal"), F.lit("fp").alias("kind"))),
        F.transform(F.array_except(gold, pred), lambda s: F.struct(
            s.alias("signal"), F.lit("fn").alias("kind"))))
    rows = exploded(df.select(tagged.alias("_t")), [], "_t").select("item.*")
    kinds = [F.count_if(F.col("kind") == k).alias(k) for k in ("tp", "fp", "fn")]
    per = rows.groupBy("signal").agg(*kinds)
    overall = per.agg(*[F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in ("tp", "fp", "fn")]).select(
        F.lit("*").alias("signal"), "tp", "fp", "fn")
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return per.unionByName(overall).select(
        "signal", "tp", "fp", "fn", round6(_ratio(tp, tp + fp)).alias("precision"),
        round6(_ratio(tp, tp + fn)).alias("recall"), round6(_f1(tp, fp, fn)).alias("f1"))


def compare_runs(df: DataFrame, run_col: str = "run") -> DataFrame:
    """Binary reports of several runs over one gold set."""
    return binary_report(df, by=(run_col,))
