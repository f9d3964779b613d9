"""Boosting of several classes."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from facsimile.operators import classifiers, softmax


@pytest.fixture(scope="module")
def three(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 3))
    y = np.where(x[:, 0] > 0.5, 2, np.where(x[:, 1] > 0, 1, 0))
    rows = spark.createDataFrame([(float(a), v.tolist()) for a, v in zip(y, x)], "label double, x array<double>")
    return rows.select("label", array_to_vector("x").alias("features")).repartition(4)


def test_probabilities_add_to_one_and_the_loss_falls(three):
    model = classifiers.train(three, "GradientBoosting", 3, {"maxIter": 4, "maxDepth": 3})
    assert len(model.losses) == 5 and all(b < a for a, b in zip(model.losses, model.losses[1:]))
    assert model.losses[0] < np.log(3) + 1e-9 and abs(model.importances.sum() - 1) < 1e-9 and model.importances[2] < 0.1
    found = classifiers.predictions(model, three)
    rows = found.collect()
    assert len(rows) == 400 and all(abs(sum(r["scores"]) - 1) < 1e-12 and len(r["scores"]) == 3 for r in rows)
    assert all(r["prediction"] == np.argmax(r["scores"]) for r in rows)
    scores = classifiers.evaluate(found, 3)
    assert scores["accuracy"] > 0.95 and scores["roc_auc"] > 0.98
    assert [f for f, _ in classifiers.top_importances(model, ["a", "b", "c"])][:2] in (["a", "b"], ["b", "a"])


def test_one_round_is_the_newton_step_of_its_leaves(three):
    model = softmax.fit(three, 3, 1, 1, 42)
    rows = [(r["label"], r["features"].toArray()) for r in three.collect()]
    y, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    p = np.array([(y == k).mean() for k in range(3)])
    for k, tree in enumerate(model.rounds[0]):
        r = (y == k) - p[k]
        leaf = tree.leaf(x)
        for at in np.unique(leaf):
            rest = r[leaf == at]
            assert tree.value[at] == pytest.approx(2 / 3 * rest.sum() / (np.abs(rest) * (1 - np.abs(rest))).sum())


def test_a_class_without_rows(spark, three):
    model = softmax.fit(three.where("label < 2"), 3, 1, 2, 42)
    best = classifiers.predictions(model, three).agg(F.max(F.col("scores")[2])).first()[0]
    assert best < 1e-6
    with pytest.raises(ValueError):
        softmax.fit(three.limit(0), 3, 1, 2, 42)
