"""Boosted trees against a booster of plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loamframe.operators import boosting
from loamframe.operators.boosting import Options


def brute(bins, label, n_classes, o):
    """Scores of a booster that looks at every split of every node row by row."""
    scores = np.zeros((len(bins), n_classes))

    def grow(rows, g, h, depth):
        total_g, total_h = g[rows].sum(), h[rows].sum()
        best = (o.least_gain, None)
        if depth < o.depth:
            for f in range(bins.shape[1]):
                for cut in range(bins[:, f].max() + 1):
                    left = rows[bins[rows, f] <= cut]
                    gl, hl = g[left].sum(), h[left].sum()
                    if hl < o.least_weight or total_h - hl < o.least_weight:
                        continue
                    gain = gl**2 / (hl + o.l2) + (total_g - gl) ** 2 / (total_h - hl + o.l2) - total_g**2 / (total_h + o.l2)
                    if gain > best[0] + 1e-12:
                        best = (gain, (f, cut))
        if best[1] is None:
            return {int(r): -total_g / (total_h + o.l2) for r in rows}
        f, cut = best[1]
        under = bins[rows, f] <= cut
        return grow(rows[under], g, h, depth + 1) | grow(rows[~under], g, h, depth + 1)

    for _ in range(o.rounds):
        p = np.exp(scores - scores.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        for k in range(n_classes):
            values = grow(np.arange(len(bins)), p[:, k] - (label == k), p[:, k] * (1 - p[:, k]), 0)
            scores[:, k] += o.rate * np.array([values[r] for r in range(len(bins))])
    return scores


@pytest.fixture(scope="module")
def rows(spark):
    random_ = np.random.default_rng(3)
    x = random_.normal(size=(240, 3))
    label = np.where(x[:, 0] + 0.3 * x[:, 1] > 0.4, 2, np.where(x[:, 2] * x[:, 0] > 0, 1, 0))
    data = [(*map(float, v), "kind" + str(k)) for v, k in zip(x, label)]
    return spark.createDataFrame(data, "a double, b double, c double, kind string").repartition(3).cache()


def test_scores_against_loops(rows):
    o = Options(rounds=3, depth=3, rate=0.4, l2=2.0)
    (model,), _ = boosting.fit(rows, ["a", "b", "c"], "kind", [o], bins=12)
    found = boosting.predicted(model, rows).toPandas()
    bins = model.binned([found[c].to_numpy() for c in "abc"])
    label = np.array([model.classes.index(k) for k in found["kind"]])
    wanted = brute(bins.astype(int), label, 3, o)
    assert np.allclose(model.scores(bins), wanted)
    p = np.exp(wanted) / np.exp(wanted).sum(axis=1, keepdims=True)
    assert np.allclose(np.stack(found["probabilities"]), p) and (found["predicted"] == [model.classes[k] for k in wanted.argmax(axis=1)]).all()
    assert (found["predicted"] == found["kind"]).mean() > 0.9
    assert set(model.gains()) <= {"a", "b", "c"} and model.gains()["a"] > model.gains()["b"]


def test_grid_and_folds(rows, spark, tmp_path):
    grid = [Options(rounds=2, depth=d, rate=r, l2=l) for d, r, l in ((1, 0.1, 50.0), (3, 0.5, 1.0))]
    fold = F.pmod(F.xxhash64("a"), F.lit(3))
    models, accuracy = boosting.fit(rows, ["a", "b", "c"], "kind", grid, folds=3, bins=12, fold_col=fold)
    assert accuracy[1] > accuracy[0] and accuracy[1] > 0.8 and len(models[0].trees) == 2
    # a model beside others is the model that grows alone, and the accuracy is that of models without the fold
    (alone,), _ = boosting.fit(rows, ["a", "b", "c"], "kind", grid[1:], bins=12)
    x = rows.toPandas()
    bins = alone.binned([x[c].to_numpy() for c in "abc"])
    assert np.allclose(alone.scores(bins), models[1].scores(bins))
    right = 0
    for k in range(3):
        marked = rows.withColumn("fold", fold)
        train, test = marked.where(F.col("fold") != k), marked.where(F.col("fold") == k)
        (own,), _ = boosting.fit(train, ["a", "b", "c"], "kind", grid[1:], bins=12)
        right += boosting.predicted(own, test).where("predicted = kind").count()
    assert abs(right / 240 - accuracy[1]) < 0.05  # edges of bins differ slightly without a fold
    boosting.save(models[1], spark, f"{tmp_path}/model")
    again = boosting.load(spark, f"{tmp_path}/model")
    assert np.array_equal(again.scores(bins), models[1].scores(bins)) and again.classes == models[1].classes


def test_missing_values_and_few_rows(spark):
    data = [(None, 1.0, 1), (float("nan"), 2.0, 1), (5.0, 3.0, 2), (6.0, None, 2), (7.0, 1.0, None)] * 3
    df = spark.createDataFrame(data, "a double, b double, kind int")
    (model,), _ = boosting.fit(df, ["a", "b"], "kind", [Options(rounds=2, depth=2, rate=0.5, l2=0.1)])
    found = boosting.predicted(model, df).collect()
    assert all(r.predicted == r.kind for r in found if r.kind is not None) and found[4].predicted == 2
    (one,), _ = boosting.fit(df.where("kind = 1"), ["a", "b"], "kind", [Options(rounds=1, depth=2)])
    assert {r.predicted for r in boosting.predicted(one, df).collect()} == {1}
