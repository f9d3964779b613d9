"""Gradient boosting for several classes: in each round one regression tree a class on the residuals all classes share.

A row's scores are one number a class, its probabilities their softmax, which adds to one.  The residual of a class is
its indicator less its probability; Spark ML fits the trees, and the value of a leaf is the Newton step of the
multinomial loss from the sums of its rows.  Only trees and sums of leaves reach the driver.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facsimile.session import cut_lineage

#: Fixed value: the published step of each tree.
RATE = 0.1
_LEAST = 1e-12


@dataclass
class Tree:
    """Flat nodes: feature (-1 at a leaf), threshold, children, and the value of a leaf."""

    feature: np.ndarray
    threshold: np.ndarray
    low: np.ndarray
    high: np.ndarray
    value: np.ndarray = field(default=None)

    def leaf(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        while True:
            inner = np.flatnonzero(self.feature[at] >= 0)
            if not len(inner):
                return at
            node = at[inner]
            at[inner] = np.where(x[inner, self.feature[node]] <= self.threshold[node], self.low[node], self.high[node])


def flat_tree(model) -> Tree:
    """The nodes of a Spark ML regression tree on continuous features."""
    nodes: list[list] = []

    def add(node) -> int:
        at = len(nodes)
        nodes.append([-1, 0.0, at, at])
        if node.getClass().getSimpleName() == "InternalNode":
            split = node.split()
            nodes[at][:2] = [int(split.featureIndex()), float(split.threshold())]
            nodes[at][2], nodes[at][3] = add(node.leftChild()), add(node.rightChild())
        return at

    add(model._java_obj.rootNode())
    feature, threshold, low, high = (np.array(c) for c in zip(*nodes))
    return Tree(feature.astype(np.int64), threshold.astype(float), low.astype(np.int64), high.astype(np.int64), np.zeros(len(nodes)))


def _softmax(raw: np.ndarray) -> np.ndarray:
    e = np.exp(raw - raw.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype="float64")


def _residuals(labels: np.ndarray, p: np.ndarray) -> np.ndarray:
    return (labels[:, None] == np.arange(p.shape[1])) - p


@dataclass
class SoftmaxModel:
    start: np.ndarray
    rounds: list[list[Tree]]
    losses: list[float]
    importances: np.ndarray

    @property
    def featureImportances(self):
        return self

    def toArray(self) -> np.ndarray:
        return self.importances

    def transform(self, df: DataFrame) -> DataFrame:
        """``(label, prediction, probability)``, the probabilities as an array; ties go to the first class."""
        start, rounds = self.start, self.rounds

        def score(batches):
            for batch in batches:
                x = _matrix(batch["x"])
                raw = np.tile(start, (len(x), 1))
                for trees in rounds:
                    for k, tree in enumerate(trees):
                        raw[:, k] += RATE * tree.value[tree.leaf(x)]
                p = _softmax(raw)
                yield pd.DataFrame({"label": batch["label"], "prediction": p.argmax(axis=1).astype(float), "probability": list(p)})

        rows = df.select(F.col("label").cast("double").alias("label"), vector_to_array("features").alias("x"))
        return rows.mapInPandas(score, "label double, prediction double, probability array<double>")


def fit(df: DataFrame, classes: int, maxIter: int, maxDepth: int, seed: int) -> SoftmaxModel:
    """Fit on ``(features, label)``, labels 0 to ``classes`` - 1; rows with another label take no part.

    A class without rows starts from a tiny share.  ``losses``: mean multinomial loss before each round and after the last.
    """
    known = df.where((F.col("label") >= 0) & (F.col("label") < classes)).select("features", F.col("label").cast("double").alias("label"))
    counts = {int(r["label"]): r["count"] for r in known.groupBy("label").count().collect()}
    total = sum(counts.values())
    if not total:
        raise ValueError("no rows to learn from")
    start = np.log(np.maximum([counts.get(k, 0) / total for k in range(classes)], _LEAST))
    state = cut_lineage(known.withColumn("x", vector_to_array("features")).withColumn("raw", F.array(*[F.lit(float(v)) for v in start])))
    width = len(state.first()["x"])
    rounds, losses, importances = [], [], np.zeros(width)

    def loss_of(state: DataFrame) -> float:
        e = F.transform("raw", lambda v: F.exp(v - F.array_max("raw")))
        share = F.get(e, F.col("label").cast("int")) / F.aggregate(e, F.lit(0.0), lambda a, v: a + v)
        return state.agg(F.avg(-F.log(F.greatest(share, F.lit(1e-300))))).first()[0]

    losses.append(loss_of(state))
    for n in range(maxIter):
        @F.pandas_udf("array<double>")
        def residual(label: pd.Series, raw: pd.Series) -> pd.Series:
            return pd.Series(list(_residuals(label.to_numpy(), _softmax(_matrix(raw)))))

        work = cut_lineage(state.withColumn("residual", residual("label", "raw")))
        trees = []
        for k in range(classes):
            tree = DecisionTreeRegressor(maxDepth=maxDepth, labelCol="target", seed=seed + n).fit(work.select("features", F.col("residual")[k].alias("target")))
            importances += tree.featureImportances.toArray()
            trees.append(flat_tree(tree))

        def sums(batches):
            for batch in batches:
                x, r = _matrix(batch["x"]), _matrix(batch["residual"])
                for k, tree in enumerate(trees):
                    leaf = tree.leaf(x)
                    up = np.bincount(leaf, r[:, k], len(tree.value))
                    down = np.bincount(leaf, np.abs(r[:, k]) * (1 - np.abs(r[:, k])), len(tree.value))
                    at = np.unique(leaf)
                    yield pd.DataFrame({"k": k, "leaf": at, "up": up[at], "down": down[at]})

        # a row for each leaf of this round's trees
        leaves = work.select("x", "residual").mapInPandas(sums, "k int, leaf int, up double, down double").groupBy("k", "leaf").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
        for r in leaves.collect():
            trees[r["k"]].value[r["leaf"]] = (classes - 1) / classes * r["up"] / r["down"] if r["down"] > _LEAST else 0.0

        @F.pandas_udf("array<double>")
        def moved(raw: pd.Series, x: pd.Series) -> pd.Series:
            values, rows = _matrix(raw), _matrix(x)
            for k, tree in enumerate(trees):
                values[:, k] += RATE * tree.value[tree.leaf(rows)]
            return pd.Series(list(values))

        state = cut_lineage(work.withColumn("raw", moved("raw", "x")).drop("residual"))
        rounds.append(trees)
        losses.append(loss_of(state))
    return SoftmaxModel(start, rounds, losses, importances / max(importances.sum(), _LEAST))
