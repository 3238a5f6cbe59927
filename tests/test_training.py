"""Boosting, Shapley values and ordered target statistics against brute force."""

import math
import random
from hashlib import md5

import numpy as np
import pytest
from pyspark.sql import functions as F

from lurelake.operators import train as TR, trees as TREES
from lurelake.sources.sinks import scratch_path

FEATURES = ("a", "b", "c", "d")


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(5)

    def rows(n):
        out = []
        for _ in range(n):
            a, b, c, d = (rng.random() for _ in range(4))
            phishing = (a > 0.5) ^ (b > 0.7 and c < 0.4) if rng.random() < 0.9 else rng.random() < 0.5
            out.append((a, None if rng.random() < 0.05 else b, c, round(d, 1), 0 if phishing else 1, 2.0 if phishing else 1.0))
        return out

    schema = "a double, b double, c double, d double, label int, w double"
    return spark.createDataFrame(rows(500), schema).cache(), spark.createDataFrame(rows(200), schema).cache()


@pytest.fixture(scope="module")
def trained(tables):
    setting = TR.Boosting(trees=40, rate=0.3, depth=3, every=3, patience=6)
    return setting, TR.boost(*tables, FEATURES, setting, weight_col="w")


def auc(pairs):
    wins = sum((s > t) + (s == t) / 2 for s, p in pairs if p for t, q in pairs if not q)
    return wins / (sum(p for _, p in pairs) * sum(not p for _, p in pairs))


def test_boosting_stops_at_the_best_round(tables, trained):
    setting, result = trained
    best = max(a for _, a in result.history)
    assert best > 0.85 and len(result.model.trees) == next(n for n, a in result.history if a == best)
    last = result.history[-1][0]
    assert last == setting.trees or last - len(result.model.trees) >= setting.patience
    assert last - len(result.model.trees) < setting.patience + setting.every
    valid = TR.score(result.model, tables[1], "s").collect()
    assert auc([(r["s"], r["label"] == 0) for r in valid]) == pytest.approx(best, abs=1e-5)


def test_boosting_goes_on_from_a_saved_model(spark, tables, trained):
    whole = trained[1]
    first = TR.boost(*tables, FEATURES, TR.Boosting(trees=3, rate=0.3, depth=3, every=3), weight_col="w")
    path = scratch_path(spark, "model")
    TREES.save(first.model, spark, path)
    again = TREES.load(spark, path)
    assert again.features == FEATURES and again.start == first.model.start
    on = TR.boost(*tables, FEATURES, TR.Boosting(trees=6, rate=0.3, depth=3, every=3), weight_col="w", start=again)
    assert on.history[-1] == (6, dict(whole.history)[6])  # as if never stopped
    with pytest.raises(ValueError):
        TR.boost(*tables, FEATURES, TR.Boosting(rate=0.1), start=again)


def test_shapley_values_equal_all_subsets_and_add_up(tables, trained):
    model = trained[1].model
    rows = TREES.score(model, TREES.shap_values(model, tables[1]), "margin", margin=True).collect()
    for k, r in enumerate(rows):
        assert sum(r["phi"]) + r["base"] == pytest.approx(r["margin"], abs=1e-9)
        if k < 12:
            x = np.array([np.nan if r[f] is None else r[f] for f in FEATURES])
            assert r["phi"] == pytest.approx(TREES.brute_force_shapley(model, x), abs=1e-9)
    mean = {r["feature"]: r["mean_abs"] for r in TREES.shap_mean_abs(model, tables[1]).collect()}
    for i, f in enumerate(FEATURES):
        assert mean[f] == pytest.approx(np.mean([abs(r["phi"][i]) for r in rows]), abs=1e-9)
    assert max(mean, key=mean.get) == "a"


def test_importances_add_up(spark, trained):
    found = {r["feature"]: r["importance"] for r in TR.feature_importance(trained[1].model, spark).collect()}
    assert sum(found.values()) == pytest.approx(1) and max(found, key=found.get) == "a" and min(found.values()) >= 0


def test_one_class_and_no_validation_rows(spark, tables):
    train, valid = tables
    result = TR.boost(train.where("label = 0"), valid.limit(0), FEATURES, TR.Boosting(trees=2, every=1, patience=1))
    assert len(result.model.trees) == 0 and math.isnan(result.history[0][1])


def test_ordered_target_statistics(spark):
    rng = random.Random(7)
    rows = [(i, "hot" if i % 3 else rng.choice(["x", "y", None]), rng.choice([0, 1, 1, None])) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, kind string, y int").withColumn("_c", F.lit("clash"))
    got = {r["id"]: r["kind_enc"] for r in TR.encode_categoricals(df.drop("_c"), ["kind"], "y", "id", block_digits=1).collect()}
    order = sorted(rows, key=lambda r: (md5(f"42:{r[0]}".encode()).hexdigest(), r[0]))
    sums = {}
    for i, kind, y in order:
        s, n = sums.get(kind, (0, 0))
        assert got[i] == pytest.approx((s + 0.5) / (n + 1))
        if y is not None:
            sums[kind] = (s + y, n + 1)
    assert len(got) == 400
