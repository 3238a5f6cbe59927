"""URL models: boosted trees in rounds with an early stop on validation AUC, batch scoring, encodings."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import DataFrame, Window as W, functions as F

from lurelake import params as P
from lurelake.functions import text as T
from lurelake.operators import trees as TR
from lurelake.operators.evaluate import roc_auc
from lurelake.operators.trees import Ensemble, score as _score
from lurelake.sources.sinks import scratch_path


# ---- categories ---------------------------------------------------------------------------------

#: Hex digits of the hash prefix that cuts a category's rows into blocks.
BLOCK_DIGITS = 3
MISSING = "\u0000"


def encode_categoricals(df: DataFrame, columns, target: str, id_col: str, prior: float = 0.5, strength: float = 1.0,
                        seed: int = 42, block_digits: int = BLOCK_DIGITS) -> DataFrame:
    """The rows with ``<column>_enc``: ordered target statistics of each categorical column.

    Rows are put into a random order by the hash of their id; a row's value is the mean target of the earlier rows
    of its category, smoothed with ``strength`` rows of ``prior``, so no row sees its own target.  Prefix sums run in
    two levels: whole blocks of the hash order are added up first, then a window runs inside each block alone, so no
    category is ever in one task.  Missing values are a category; missing targets count as no row, and every row gets a
    value.
    """
    out = df.withColumn("_h", T.stable_hash(F.col(id_col), seed)).withColumn("_block", F.left("_h", F.lit(block_digits)))
    y, one = F.coalesce(F.col(target).cast("double"), F.lit(0.0)), F.col(target).isNotNull().cast("long")
    for c in columns:
        out = out.withColumn("_c", F.coalesce(F.col(c).cast("string"), F.lit(MISSING)))
        earlier = W.partitionBy("_c").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
        blocks = out.groupBy("_c", "_block").agg(F.sum(y).alias("_y"), F.sum(one).alias("_n")).select(
            "_c", "_block", F.coalesce(F.sum("_y").over(earlier), F.lit(0.0)).alias("_y0"),
            F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_n0"))
        inside = W.partitionBy("_c", "_block").orderBy("_h", id_col).rowsBetween(W.unboundedPreceding, -1)
        before_y = F.col("_y0") + F.coalesce(F.sum(y).over(inside), F.lit(0.0))
        before_n = F.col("_n0") + F.coalesce(F.sum(one).over(inside), F.lit(0))
        out = out.join(blocks, ["_c", "_block"]).withColumn(
            f"{c}_enc", (before_y + prior * strength) / (before_n + strength)).drop("_y0", "_n0")
    return out.select(*df.columns, *[f"{c}_enc" for c in columns])


#: Stands for a missing value while a tree is fitted; it lies right of every split, as missing values do in scoring.
BEYOND = 1e300


# ---- boosting -----------------------------------------------------------------------------------

@dataclass(frozen=True)
class Boosting:
    """How an ensemble grows: at most ``trees`` trees, ``every`` of them a round; it stops when the validation
    AUC has not risen for ``patience`` trees."""

    trees: int = 5000
    rate: float = 0.01
    depth: int = 5
    every: int = 10
    patience: int = 100
    seed: int = 42


@dataclass(frozen=True)
class Trained:
    """The ensemble cut at its best round, and (trees, AUC) of every round."""

    model: Ensemble
    history: tuple[tuple[int, float], ...]

    @property
    def auc(self) -> float:
        return max((auc for _, auc in self.history), default=math.nan)


def boost(train: DataFrame, valid: DataFrame, features, setting: Boosting, label_col: str = "label",
          weight_col: str | None = None, start: Ensemble | None = None) -> Trained:
    """Logistic boosting for label 0 = phishing, with an early stop on the AUC over ``valid``.

    A tree is fitted by Spark ML to the residuals of the margins so far.  After each round the margins of both tables
    are written to the checkpoint folder, which cuts the lineage: a lost executor costs a round at most.  ``start``
    goes on from a saved ensemble with the same features and rate.
    """
    spark = train.sparkSession
    names = tuple(features)
    if start is not None and (start.features != names or start.rate != setting.rate):
        raise ValueError("the ensemble to go on from has other features or another rate")
    y = F.when(F.col(label_col) == 0, 1.0).otherwise(-1.0)
    weight = F.col(weight_col).cast("double") if weight_col else F.lit(1.0)
    assembled = VectorAssembler(inputCols=list(names), outputCol="x")

    def prepared(df: DataFrame, model: Ensemble) -> DataFrame:
        values = [F.col(f).cast("double").alias(f) for f in names]
        rows = _score(model, df.select(*values, y.alias("y"), weight.alias("w")), "margin", margin=True)
        rows = rows.withColumns({f: F.when(F.isnan(f), None).otherwise(F.col(f)) for f in names}).na.fill(BEYOND, list(names))
        return assembled.transform(rows).select("x", "y", "w", "margin")

    def written(df: DataFrame, name: str) -> DataFrame:
        path = scratch_path(spark, name)
        df.write.parquet(path)
        return spark.read.parquet(path)

    def valid_auc(df: DataFrame) -> float:
        auc = roc_auc(df, "margin", F.col("y") > 0).first()["auc"]
        return float("nan") if auc is None else float(auc)

    if start is None:
        positive, whole = train.agg(F.sum(F.when(y > 0, weight).otherwise(0.0)), F.sum(weight)).first()
        share = min(max((positive or 0.0) / (whole or 1.0), 1e-6), 1 - 1e-6)
        start = Ensemble(names, setting.rate, 0.5 * math.log(share / (1 - share)))
    model, own, held = start, written(prepared(train, start), "boost-train"), written(prepared(valid, start), "boost-valid")
    history = [(len(model.trees), valid_auc(held))]
    best = model
    while len(model.trees) < setting.trees:
        for _ in range(min(setting.every, setting.trees - len(model.trees))):
            residual = 4 * F.col("y") / (1 + F.exp(2 * F.col("y") * F.col("margin")))
            fitted = DecisionTreeRegressor(featuresCol="x", labelCol="residual", weightCol="w", maxDepth=setting.depth,
                                           seed=setting.seed, predictionCol="tree").fit(own.withColumn("residual", residual))
            step = F.col("margin") + setting.rate * F.col("tree")
            own = fitted.transform(own).withColumn("margin", step).drop("tree")
            held = fitted.transform(held).withColumn("margin", step).drop("tree")
            model = replace(model, trees=(*model.trees, TR.tree_of(fitted)))
        own, held = written(own, "boost-train"), written(held, "boost-valid")
        auc, before = valid_auc(held), max((a for _, a in history if not math.isnan(a)), default=-1.0)
        history.append((len(model.trees), auc))
        if auc > before:
            best = model
        if len(model.trees) - len(best.trees) >= setting.patience:
            break
    return Trained(best, tuple(history))


#: Limits of the three models; the early stop ends far below them.
LEXICAL = Boosting(5000, 0.01, 5)
HTML = Boosting(3000, 0.02, 5)
FULL = Boosting(2000, 0.01, 6)


def train_url_lexical(train: DataFrame, valid: DataFrame, setting: Boosting = LEXICAL, **options) -> Trained:
    return boost(train, valid, P.URL_MODEL_FEATURES, setting, **options)


def train_url_html(train: DataFrame, valid: DataFrame, setting: Boosting = HTML, **options) -> Trained:
    return boost(train, valid, P.HTML_MODEL_FEATURES, setting, **options)


def train_url_full(train: DataFrame, valid: DataFrame, setting: Boosting = FULL,
                   features=P.URL_MODEL_FEATURES + P.HTML_MODEL_FEATURES, **options) -> Trained:
    return boost(train, valid, features, setting, **options)


def numeric_features(df: DataFrame, besides=("label", "split", "group_key")) -> tuple[str, ...]:
    """All columns that a model over every feature takes: numbers, without the label and keys."""
    return tuple(f.name for f in df.schema.fields if f.name not in besides
                 and f.dataType.typeName() in ("integer", "long", "double", "float", "short", "byte", "boolean"))


def train_url_all(train: DataFrame, valid: DataFrame, besides, setting: Boosting = FULL, **options) -> Trained:
    """The full model over every numeric column there is, encoded categories included."""
    return boost(train, valid, numeric_features(train, besides), setting, **options)


def score(model: Ensemble, df: DataFrame, out_col: str = "phishing_score") -> DataFrame:
    """Phishing probability per row."""
    return _score(model, df, out_col)


def url_batch_score(lexical: Ensemble, html: Ensemble, df: DataFrame) -> DataFrame:
    """lexical_score for all rows, html_score where every page feature is present."""
    complete = F.lit(True)
    for f in P.HTML_MODEL_FEATURES:
        complete = complete & F.col(f).isNotNull()
    scored = score(html, score(lexical, df, "lexical_score"), "html_score")
    return scored.withColumn("html_score", F.when(complete, F.col("html_score")))


def feature_importance(model: Ensemble, spark) -> DataFrame:
    """(feature, importance) of the splits, greatest first."""
    return spark.createDataFrame(TR.split_gains(model), "feature string, importance double").orderBy(
        F.desc("importance"), "feature")
