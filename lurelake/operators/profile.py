"""Counts, shares and set comparisons of data sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from lurelake.functions.arrays import round6


def label_distribution(df: DataFrame, col: str = "label") -> DataFrame:
    """Counts and shares with NULLs; the window runs over the few distinct labels."""
    counts = df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", round6(F.col("n") / F.sum("n").over(W.partitionBy())))


def source_label_crosstab(df: DataFrame, labels, row: str = "source", col: str = "label") -> DataFrame:
    """Contingency table; the label values are given, so no extra job lists them."""
    return df.groupBy(row).pivot(col, list(labels)).agg(F.count(F.lit(1))).na.fill(0)


def missing_ratio(df: DataFrame, columns) -> DataFrame:
    """(column, ratio) of NULLs, one aggregate then an unpivot of one row."""
    one = df.agg(*[round6(F.avg(F.col(c).isNull().cast("int"))).alias(c) for c in columns])
    return one.unpivot([], list(columns), "column", "ratio")


def top_domains(df: DataFrame, domain_col: str, n: int = 20) -> DataFrame:
    counts = df.groupBy(domain_col).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), F.asc(domain_col)).limit(n)


def mix_summary(df: DataFrame, en_sources, vie_sources) -> DataFrame:
    en = F.count_if(F.col("source").isin(list(en_sources)))
    vie = F.count_if(F.col("source").isin(list(vie_sources)))
    return df.agg(F.count(F.lit(1)).alias("rows"), en.alias("en"), vie.alias("vie"),
                  F.when(vie > 0, F.round(en / F.nullif(vie, F.lit(0)), 3)).alias("en_vie_ratio"))


def null_by_label(df: DataFrame, columns, label_col: str = "label") -> DataFrame:
    return df.groupBy(label_col).agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])


def feed_profile(df: DataFrame, date_col: str = "date") -> DataFrame:
    first, last = F.min(date_col), F.max(date_col)
    span = F.unix_micros(last.cast("timestamp")) - F.unix_micros(first.cast("timestamp"))
    days = F.floor(span / F.lit(86_400_000_000))
    return df.agg(last.alias("newest"), first.alias("oldest"), days.alias("span_days"))


def set_union_lists(*lists: DataFrame) -> DataFrame:
    out = lists[0]
    for other in lists[1:]:
        out = out.union(other)
    return out.distinct()


def signal_set_diff(df: DataFrame, gold: str = "gold_signals", pred: str = "pred_signals") -> DataFrame:
    return df.withColumns({
        "tp": F.array_sort(F.array_intersect(gold, pred)),
        "fp": F.array_sort(F.array_except(pred, gold)),
        "fn": F.array_sort(F.array_except(gold, pred)),
    })
