"""Histogram boosting against a direct leaf-wise booster over raw rows."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegate.operators import boosting as B
from pulsegate.operators import scoring


def cuts_of(x: np.ndarray, bins: int) -> list[float]:
    values = np.unique(x)
    if len(values) <= bins:
        return ((values[1:] + values[:-1]) / 2).tolist()
    s, m = np.sort(x), len(x) - 1
    return sorted({(s[k * m // bins] + s[-(-k * m // bins)]) / 2 for k in range(1, bins)})


def direct(X, y, w, growth, bins):
    """Raw scores of the training rows, one node at a time over rows, not histograms."""
    cuts = [cuts_of(X[:, i], bins) for i in range(X.shape[1])]
    raw = np.full(len(y), math.log((w * y).sum() / (w * (1 - y)).sum()))
    for _ in range(growth.max_iter):
        p = 1 / (1 + np.exp(-raw))
        g, h = np.rint(w * (p - y) * B.SCALE) / B.SCALE, np.rint(w * p * (1 - p) * B.SCALE) / B.SCALE

        def split(rows):
            best = None
            for f, own in enumerate(cuts):
                for k, cut in enumerate(own):
                    left, right = rows[X[rows, f] <= cut], rows[X[rows, f] > cut]
                    if min(len(left), len(right)) < growth.min_samples_leaf or min(h[left].sum(), h[right].sum()) < 1e-3:
                        continue
                    power = lambda r: g[r].sum() ** 2 / (h[r].sum() + growth.l2)
                    gain = power(left) + power(right) - power(rows)
                    if gain > 0 and (best is None or gain > best[0] + 1e-12):
                        best = (gain, left, right)
            return best

        leaves = [(np.arange(len(y)), 0)]
        while len(leaves) < growth.max_leaf_nodes:
            options = [(split(r), i) for i, (r, d) in enumerate(leaves) if d < growth.max_depth]
            options = [(s, i) for s, i in options if s]
            if not options:
                break
            (_, left, right), i = max(options, key=lambda o: o[0][0])
            depth = leaves[i][1] + 1
            leaves[i : i + 1] = [(left, depth), (right, depth)]
        for rows, _ in leaves:
            raw[rows] -= growth.learning_rate * g[rows].sum() / (h[rows].sum() + growth.l2)
    return raw


@pytest.fixture(scope="module")
def sample():
    rng = np.random.default_rng(3)
    X = np.round(rng.normal(size=(400, 3)), 2)
    X[:, 2] = rng.integers(0, 5, 400)
    y = (X[:, 0] * X[:, 2] + rng.normal(size=400) > 0.5).astype(float)
    return X, y, rng.uniform(0.2, 3.0, 400)


def frame(spark, X, y, w):
    rows = [(*map(float, x), float(t), float(v)) for x, t, v in zip(X, y, w)]
    return spark.createDataFrame(rows, "a double, b double, c double, y double, w double")


def columns():
    return [F.col(c) for c in "abc"]


@pytest.mark.parametrize("bins", [4, 16, 255])
def test_thresholds(spark, sample, bins):
    X, y, w = sample
    got = B.bin_thresholds(frame(spark, X, y, w).repartition(5), columns(), bins)
    for i, own in enumerate(got):
        assert own == pytest.approx(cuts_of(X[:, i], bins), abs=1e-12)


def test_boosting_matches_rows(spark, sample):
    X, y, w = sample
    growth = B.Growth(max_iter=12, learning_rate=0.3, max_leaf_nodes=5, min_samples_leaf=10)
    df = frame(spark, X, y, w)
    one = B.fit_boosted(df.repartition(7), columns(), "y", "w", growth, 32)
    two = B.fit_boosted(df.coalesce(1), columns(), "y", "w", growth, 32)
    assert one.trees == two.trees
    assert one.raw(one.bins(X)) == pytest.approx(direct(X, y, w, growth, 32), abs=1e-6)
    scored = B.score_boosted(df, columns(), one, "y").collect()
    assert [r["y"] for r in scored] == pytest.approx(one.raw(one.bins(X)).tolist())
    assert all(len([n for n in t if n[0] >= 0]) <= 4 for t in one.trees)


def test_split_table_agrees_with_best_split(spark, sample):
    X, y, w = sample
    df = frame(spark, X, y, w)
    first = B.Boosted(B.bin_thresholds(df, columns(), 32), 0.1)
    rows = B.binned(df, columns(), first, F.col("y"), F.col("w"))
    hist = B.histogram(rows, (), ((-1, 0, 0, 0.0),), [0], 3)
    n, g, h = B._collected(hist, [0], 3)[0]
    gain, feature, cut = B.Growth().best_split(n, g, h)
    top = B.split_gains(hist).orderBy(F.desc("gain"), "feature", "bin").first()
    assert (top["feature"], top["bin"]) == (feature, cut) and top["gain"] == pytest.approx(gain)


def test_limits(spark, sample):
    X, y, w = sample
    df = frame(spark, X, y, w)
    with pytest.raises(ValueError):
        B.fit_boosted(df.where("y = 1"), columns(), "y", "w")
    with pytest.raises(ValueError):
        B.Growth(max_depth=4)
    constant = B.fit_boosted(df.withColumns({"a": F.lit(1.0), "b": F.lit(1.0), "c": F.lit(1.0)}), columns(), "y", "w", B.Growth(max_iter=1))
    assert constant.thresholds == ((), (), ()) and len(constant.trees[0]) == 1


def test_held_out_and_saved(spark, tmp_path):
    rng = np.random.default_rng(5)
    X = rng.normal(size=(3000, 3))
    y = (X[:, 0] * X[:, 1] > 0).astype(float)
    rows = [(*map(float, x), float(t), 1.0, "train" if i < 2000 else "test") for i, (x, t) in enumerate(zip(X, y))]
    df = spark.createDataFrame(rows, "a double, b double, c double, is_attack_epoch double, w double, split string")
    model = scoring.fit_risk_model(df, ("a", "b", "c"), "train", ("a", "b", "c"), "hist_gradient_boosting", max_iter=25, learning_rate=0.3)
    scored = model.raw_score(df.where("split = 'test'"), "raw").select("raw", "is_attack_epoch").collect()
    right = np.mean([(r["raw"] > 0) == (r["is_attack_epoch"] > 0) for r in scored])
    assert right > 0.93  # a linear model stays near 0.5
    scoring.save_model(model, f"{tmp_path}/m.json")
    assert scoring.load_model(spark, f"{tmp_path}/m.json", ("a", "b", "c")).boosted == model.boosted


def test_equal_rows_are_binned_to_one(spark):
    rows = spark.range(60_000).selectExpr("CAST(id % 3 AS double) AS a", "CAST(id % 2 AS double) AS y", "1.0D AS w").repartition(7)
    start = B.Boosted(((0.5, 1.5),), 0.0)
    table = B.binned(rows, [F.col("a")], start, F.col("y"), F.col("w"))
    assert [r["n"] for r in table.collect()] == [10_000] * 6
    found = {r["bin"]: (r["n"], int(r["g"]), int(r["h"])) for r in B.histogram(table, (), ((-1, 0, 0, 0.0),), [0], 1).collect()}
    assert found == {k: (20_000, 0, 20_000 * B.SCALE // 4) for k in range(3)}


def test_tree_ensembles_train_on_partitions_of_bounded_rows(spark, monkeypatch):
    seen = []

    class Fitted(Exception):
        pass

    def fit(self, training):
        seen.append((training.rdd.getNumPartitions(), training.count()))
        raise Fitted

    monkeypatch.setattr(scoring.GBTClassifier, "fit", fit)
    rows = spark.range(900).selectExpr("CAST(id % 7 AS double) AS a", "id % 2 = 0 AS is_attack_epoch").repartition(60)
    for size, parts in ((1000, 1), (300, 3)):
        monkeypatch.setattr(scoring, "TREE_ROWS", size)
        with pytest.raises(Fitted):
            scoring.fit_risk_model(rows, ["a"], "train", ["a"], "gradient_boosted_trees")
        assert seen.pop() == (parts, 900)
