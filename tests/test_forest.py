"""Forests over any number of classes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from facsimile.operators import audit, forest


def table(spark, rows, classes, seed):
    rng = np.random.default_rng(seed)
    x, y = rng.normal(size=rows).round(3), rng.integers(0, 5, rows)
    kind = np.where(rng.random(rows) < 0.8, (x > 0.3) * 2 + (y > 2), rng.integers(0, classes, rows))
    return spark.createDataFrame([(f"c{k:04d}", float(a), float(b)) for k, a, b in zip(kind, x, y)], "kind string, x double, y double")


@pytest.mark.parametrize("levels", [900, 1200])
def test_the_attack_is_one_for_any_number_of_classes(spark, levels):
    # single levels give every name away, a tree of depth two cannot
    rows = spark.createDataFrame([(f"name{k}", k % 7, f"street{k}") for k in range(levels)], "name string, zone int, street string")
    row = audit.attribute_inference(rows, rows, ["name"], settings={"numTrees": 3, "maxDepth": 2}).first()
    assert row["n_classes"] == levels and row["error"] is None
    assert row["accuracy"] < 0.1 and not row["vulnerable"]


def test_guesses_equal_the_trees_by_hand(spark, monkeypatch):
    train, asked = table(spark, 3000, 300, 1), table(spark, 500, 400, 2)
    grown = lambda: forest.fit(train, "kind", ["x", "y"], 6, 3, 10)
    trees, packed = grown()
    told = sorted(tuple(r) for r in forest.guesses(trees, packed, asked, "kind", ["x", "y"]).groupBy("class", "guess").agg(F.sum("n")).collect())

    parts = [forest._unpacked(r.asDict(), 2) for r in packed.collect()]
    shares = {}
    for labels, cls, bins, n, h in parts:
        for t in range(trees.trees):
            for c, leaf, w in zip(cls, trees.node(bins, t), forest.copies(h, n, t, trees.seed)):
                shares[t, leaf, labels[c]] = shares.get((t, leaf, labels[c]), 0) + w
    for t in range(trees.trees):
        held = {}
        for (s, leaf, _), w in shares.items():
            if s == t:
                held[leaf] = held.get(leaf, 0) + w
        assert all(trees.rows[t, leaf] == w for leaf, w in held.items()) and min(held.values()) >= 10 and len(held) > 2
    names = sorted({k for _, _, k in shares})
    want = {}
    for r in asked.collect():
        leaves = [trees.node(trees.binned(np.array([[r["x"], r["y"]]])), t)[0] for t in range(trees.trees)]
        score = [sum(int(forest._ONE * shares.get((t, leaf, k), 0) / trees.rows[t, leaf]) for t, leaf in enumerate(leaves)) for k in names]
        key = (r["kind"], names[int(np.argmax(score))])
        want[key] = want.get(key, 0) + 1
    assert told == sorted((*k, n) for k, n in want.items())

    # classes of many rows, dealt over several parts, change nothing
    monkeypatch.setattr(forest, "PART_ROWS", 20)
    again, more = grown()
    assert more.where("hot").count() > 3 and more.where("NOT hot").count() > 3
    assert np.array_equal(again.feature, trees.feature) and np.array_equal(again.cut, trees.cut) and np.array_equal(again.rows, trees.rows)
    monkeypatch.setattr(forest, "ASKED_ROWS", 7)
    assert sorted(tuple(r) for r in forest.guesses(again, more, asked, "kind", ["x", "y"]).groupBy("class", "guess").agg(F.sum("n")).collect()) == told


def test_first_cut_is_the_best_by_gini(spark):
    rows = table(spark, 2000, 50, 3)
    trees, packed = forest.fit(rows, "kind", ["x"], 1, 1)
    labels, weights, bins = [], [], []
    for r in packed.collect():
        names, cls, b, n, h = forest._unpacked(r.asDict(), 1)
        labels += [names[c] for c in cls]
        weights += forest.copies(h, n, 0, trees.seed).tolist()
        bins += b[:, 0].tolist()
    labels, weights, bins = np.array(labels), np.array(weights), np.array(bins)

    def purity(at):
        part = np.array([weights[at & (labels == k)].sum() for k in np.unique(labels)])
        return (part**2).sum() / part.sum() if part.sum() else -np.inf

    gains = [purity(bins <= c) + purity(bins > c) for c in range(forest.BINS - 1)]
    assert trees.feature[0, 0] == 0 and trees.cut[0, 0] == int(np.argmax(gains))


def test_repeats_draw_as_many_copies_as_single_rows():
    h = np.arange(20_000, dtype=np.uint64)
    for n in (1, 9, 5000):
        got = forest.copies(h, np.full(len(h), n, np.int64), 3, 42)
        assert got.mean() == pytest.approx(n, rel=0.03) and got.var() == pytest.approx(n, rel=0.05)


def test_odd_tables(spark):
    rows = spark.createDataFrame([("a", None, 1.0), (None, 2, None), ("a", 3, 2.0), ("b", 3, 2.0)], "kind string, n int, x double")
    few = {"numTrees": 4, "maxDepth": 2}
    assert audit.attribute_inference(rows, rows, ["kind"], settings=few).first()["n_classes"] == 3
    assert audit.attribute_inference(rows, rows.limit(0), ["kind"], settings=few).first()["error"] is not None
    assert audit.attribute_inference(rows.limit(0), rows, ["kind"], settings=few).first()["accuracy"] is None
    # without other columns every guess is the most common class
    alone = audit.attribute_inference(rows.select("kind"), rows.select("kind"), ["kind"], settings={"numTrees": 30, "maxDepth": 2}).first()
    assert (alone["accuracy"], alone["baseline_accuracy"], alone["advantage"]) == (0.5, 0.5, 0.0)
