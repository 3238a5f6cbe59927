"""Ensembles of regression trees as plain node tables: scoring and exact Shapley values."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import product
from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from lurelake.session import shipped


@dataclass(frozen=True)
class Tree:
    """Nodes by number, the root first.  ``feature`` is -1 for a leaf; rows with a value of at most ``threshold``
    go left, missing values right.  ``cover`` is the weight of the training rows in a node."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    cover: np.ndarray


@dataclass(frozen=True)
class Ensemble:
    """margin = start + rate * sum of the trees; the score is 1 / (1 + exp(-2 margin))."""

    features: tuple[str, ...]
    rate: float
    start: float
    trees: tuple[Tree, ...] = field(default=())

    def margins(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        for tree in self.trees:
            out += self.rate * tree.value[landed(tree, x)]
        return out


def tree_of(model) -> Tree:
    """The nodes of a fitted regression tree of Spark ML with continuous features."""
    rows: list[list] = []

    def walk(node) -> int:
        at = len(rows)
        rows.append([-1, 0.0, -1, -1, node.prediction(), float(node.impurityStats().stats()[0])])
        if node.subtreeDepth() > 0:
            split = node.split()
            rows[at][:2] = [split.featureIndex(), split.threshold()]
            rows[at][2] = walk(node.leftChild())
            rows[at][3] = walk(node.rightChild())
        return at

    walk(model._call_java("rootNode"))
    columns = list(zip(*rows))
    return Tree(*[np.array(c, kind) for c, kind in zip(columns, (int, float, int, int, float, float))])


def landed(tree: Tree, x: np.ndarray) -> np.ndarray:
    """The leaf of each row."""
    at = np.zeros(len(x), int)
    while (inner := tree.feature[at] >= 0).any():
        f = np.where(inner, tree.feature[at], 0)
        with np.errstate(invalid="ignore"):
            low = x[np.arange(len(x)), f] <= tree.threshold[at]
        at = np.where(inner, np.where(low, tree.left[at], tree.right[at]), at)
    return at


def save(model: Ensemble, spark: SparkSession, path: str) -> None:
    rows = [(t, n, int(tree.feature[n]), float(tree.threshold[n]), int(tree.left[n]), int(tree.right[n]),
             float(tree.value[n]), float(tree.cover[n]))
            for t, tree in enumerate(model.trees) for n in range(len(tree.feature))]
    spark.createDataFrame(rows, NODES).coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")
    spark.createDataFrame([(list(model.features), model.rate, model.start)], HEAD).write.mode("overwrite").parquet(f"{path}/head")


NODES = "tree int, node int, feature int, threshold double, left int, right int, value double, cover double"
HEAD = "features array<string>, rate double, start double"


def load(spark: SparkSession, path: str) -> Ensemble:
    head = spark.read.schema(HEAD).parquet(f"{path}/head").first()
    nodes = spark.read.schema(NODES).parquet(f"{path}/nodes").toPandas().sort_values(["tree", "node"])
    trees = tuple(Tree(*[own[c].to_numpy() for c in ("feature", "threshold", "left", "right", "value", "cover")])
                  for _, own in nodes.groupby("tree"))
    return Ensemble(tuple(head["features"]), head["rate"], head["start"], trees)


def score(model: Ensemble, df: DataFrame, out_col: str = "score", margin: bool = False) -> DataFrame:
    """The rows with their probability, or margin; the trees travel once to each executor."""
    shared = shipped(df.sparkSession).sparkContext.broadcast(model)

    def run(*columns: pd.Series) -> pd.Series:
        x = np.column_stack([c.to_numpy(float) for c in columns])
        m = shared.value.margins(x)
        return pd.Series(m if margin else 1 / (1 + np.exp(-2 * m)))

    udf = F.pandas_udf(run, "double")
    return df.withColumn(out_col, udf(*[F.col(f).cast("double") for f in model.features]))


# ---- Shapley values -----------------------------------------------------------------------------

@dataclass(frozen=True)
class Path:
    """A leaf: its distinct features with the open and closed ends that the splits leave, whether a missing value
    passes, and the contribution of each feature for every pattern of passed features."""

    features: np.ndarray
    low: np.ndarray
    high: np.ndarray
    missing: np.ndarray
    table: np.ndarray  # 2^m x m


def paths_of(tree: Tree) -> Iterator[tuple[list[int], dict]]:
    """(leaf, {feature: [low, high, missing passes, share of the cover that goes on]}) of every leaf."""
    def walk(node: int, bounds: dict):
        f = int(tree.feature[node])
        if f < 0:
            yield node, bounds
            return
        for child, goes_left in ((int(tree.left[node]), True), (int(tree.right[node]), False)):
            low, high, missing, share = bounds.get(f, (-np.inf, np.inf, True, 1.0))
            share *= tree.cover[child] / tree.cover[node]
            if goes_left:
                own = (low, min(high, tree.threshold[node]), False, share)
            else:
                own = (max(low, tree.threshold[node]), high, missing, share)
            yield from walk(child, bounds | {f: own})

    yield from walk(0, {})


def contributions(value: float, shares: np.ndarray) -> np.ndarray:
    """Shapley values of one leaf for every pattern of passed features (bit k: feature k passes).

    The leaf's game gives a set S of known features value * product over k in S of [k passes] * product over the
    others of their shares.
    """
    m = len(shares)
    weight = [factorial(s) * factorial(m - s - 1) / factorial(m) for s in range(m)]
    table = np.zeros((1 << m, m))
    for pattern in range(1 << m):
        passed = np.array([(pattern >> k) & 1 for k in range(m)], float)
        for i in range(m):
            sums = np.zeros(m)  # by the size of S, the features other than i known
            sums[0] = 1.0
            for k in range(m):
                if k != i:
                    sums[1:] = sums[1:] * shares[k] + sums[:-1] * passed[k]
                    sums[0] *= shares[k]
            table[pattern, i] = value * (passed[i] - shares[i]) * float(np.dot(weight, sums))
    return table


def explained(model: Ensemble) -> tuple[float, list[Path]]:
    """(base, paths): the margin expected without any feature, and the leaves' tables."""
    base, paths = model.start, []
    for tree in model.trees:
        for leaf, bounds in paths_of(tree):
            value = model.rate * float(tree.value[leaf])
            shares = np.array([b[3] for b in bounds.values()])
            base += value * float(np.prod(shares))
            if bounds:
                low, high, missing = (np.array([b[k] for b in bounds.values()]) for k in range(3))
                paths.append(Path(np.array(list(bounds)), low, high, missing, contributions(value, shares)))
    return base, paths


def shapley(paths: list[Path], x: np.ndarray) -> np.ndarray:
    """phi, rows x features: a row's pattern on each path picks the contributions from its table."""
    phi = np.zeros(x.shape)
    for path in paths:
        own = x[:, path.features]
        gone = np.isnan(own)
        with np.errstate(invalid="ignore"):
            passed = np.where(gone, path.missing, (own > path.low) & (own <= path.high))
        pattern = passed @ (1 << np.arange(len(path.features)))
        phi[:, path.features] += path.table[pattern]
    return phi


def shap_values(model: Ensemble, df: DataFrame, out_col: str = "phi") -> DataFrame:
    """The rows with ``phi``, the exact path-dependent Shapley value of each feature, and ``base``; the values of
    a row and the base add up to its margin.

    Whole ensembles are explained, row by row in vectorised batches, whatever the number of rows; the tables of
    the paths travel once to each executor and grow with the trees, not the data.
    """
    base, paths = explained(model)
    shared = shipped(df.sparkSession).sparkContext.broadcast(paths)

    def run(*columns: pd.Series) -> pd.Series:
        x = np.column_stack([c.to_numpy(float) for c in columns])
        return pd.Series(list(shapley(shared.value, x)))

    udf = F.pandas_udf(run, "array<double>")
    return df.withColumn(out_col, udf(*[F.col(f).cast("double") for f in model.features])).withColumn("base", F.lit(base))


def shap_mean_abs(model: Ensemble, df: DataFrame) -> DataFrame:
    """(feature, mean_abs): the mean of |phi| over all rows, greatest first."""
    phi = shap_values(model, df).select(F.posexplode("phi").alias("at", "phi"))
    names = F.array(*[F.lit(f) for f in model.features])
    return phi.groupBy("at").agg(F.avg(F.abs("phi")).alias("mean_abs")).select(
        names[F.col("at")].alias("feature"), "mean_abs").orderBy(F.desc("mean_abs"), "feature")


def split_gains(model: Ensemble) -> list[tuple[str, float]]:
    """(feature, importance): the weighted fall in squared error of each feature's splits, adding up to 1."""
    gains = np.zeros(len(model.features))
    for tree in model.trees:
        for n in np.flatnonzero(tree.feature >= 0):
            l, r = tree.left[n], tree.right[n]
            means = _subtree_mean(tree, l), _subtree_mean(tree, r)
            gains[tree.feature[n]] += tree.cover[l] * tree.cover[r] / tree.cover[n] * (means[0] - means[1]) ** 2
    total = gains.sum()
    return [(f, float(g / total) if total else 0.0) for f, g in zip(model.features, gains)]


def _subtree_mean(tree: Tree, node: int) -> float:
    """The mean prediction of the training rows below a node."""
    if tree.feature[node] < 0:
        return float(tree.value[node])
    l, r = tree.left[node], tree.right[node]
    whole = tree.cover[l] + tree.cover[r]
    return (tree.cover[l] * _subtree_mean(tree, l) + tree.cover[r] * _subtree_mean(tree, r)) / whole


def brute_force_shapley(model: Ensemble, row: np.ndarray) -> np.ndarray:
    """Shapley values over all subsets, for small numbers of features; a check, not a way to explain tables."""
    n = len(row)

    def game(known) -> float:
        def expect(tree: Tree, node: int) -> float:
            f = int(tree.feature[node])
            if f < 0:
                return float(tree.value[node])
            l, r = int(tree.left[node]), int(tree.right[node])
            if known[f]:
                return expect(tree, l if row[f] <= tree.threshold[node] else r)
            return (tree.cover[l] * expect(tree, l) + tree.cover[r] * expect(tree, r)) / tree.cover[node]

        return model.start + model.rate * sum(expect(t, 0) for t in model.trees)

    phi = np.zeros(n)
    for known in product([False, True], repeat=n):
        size = sum(known)
        for i in range(n):
            if not known[i]:
                with_i = [k or j == i for j, k in enumerate(known)]
                phi[i] += factorial(size) * factorial(n - size - 1) / factorial(n) * (game(with_i) - game(known))
    return phi
