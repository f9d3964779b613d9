"""Random forests over any number of classes, for attacks on columns that may have a class for each row.

The trees are the usual ones: cells in at most ``BINS`` bins, Poisson bootstrap, the square root of the features at each node,
Gini impurity.  A sum of squares over classes adds up class by class, so rows are dealt by class and every task sends, for each
tree, three numbers a possible cut, whatever the number of classes.  Rows of one class and equal bins are one row with a count; a
class with more than ``PART_ROWS`` such rows is dealt over several parts, which send its counts instead.  A class is guessed the
same way: each part names its best class for each combination of leaves, the best of all parts wins.

Draws hash the row, so the forest does not depend on the partitioning.  Only cuts and sums of nodes reach the driver.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facsimile.operators.quantiles import quantiles
from facsimile.session import cut_lineage

#: Bins of a feature, as in Spark ML; rows of a part; leaf combinations and classes compared at a time.
BINS = 32
PART_ROWS = 32_768
ASKED_ROWS = 2048
CLASSES = 4096
#: Shares of a leaf are whole numbers of this, so that their sums are exact in any order.
_ONE = float(1 << 40)
_PACKED = "labels array<string>, hot boolean, cls binary, bins binary, n binary, h binary"


def thresholds(df: DataFrame, features: list[str]) -> list[np.ndarray]:
    """Ascending cuts of each feature: between its values where they are at most ``BINS``, else its quantiles."""
    if not features:
        return []

    def few(batches):
        seen = [set() for _ in features]
        for batch in batches:
            for values, name in zip(seen, features):
                if len(values) <= BINS:
                    values.update(batch[name].unique().tolist())
        for k, values in enumerate(seen):
            yield pd.DataFrame({"k": k, "value": sorted(values)[: BINS + 1]}).astype({"k": "int32", "value": "float64"})

    # at most BINS + 1 values a feature and task
    listed = df.select(*features).mapInPandas(few, "k int, value double").distinct().groupBy("k").agg(F.array_sort(F.collect_set("value")).alias("values"))
    values = {r["k"]: r["values"] for r in listed.select("k", F.slice("values", 1, BINS + 1).alias("values")).collect()}
    wide = [name for k, name in enumerate(features) if len(values.get(k, [])) > BINS]
    cuts = {}
    if wide:
        names = {f"q{i}": i / BINS for i in range(1, BINS)}
        cuts = {r["column"]: np.unique([r[q] for q in names]) for r in quantiles(df, wide, names).collect()}
    between = lambda v: (v[1:] + v[:-1]) / 2
    return [cuts[name] if name in cuts else between(np.array(values.get(k, []), dtype="float64")) for k, name in enumerate(features)]


def _mixed(x: np.ndarray) -> np.ndarray:
    """64 well mixed bits of 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _uniform(h: np.ndarray, seed: int, tag: int) -> np.ndarray:
    salt = np.uint64((seed * 1_000_003 + tag + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    return ((_mixed(_mixed(h ^ salt) + salt) >> np.uint64(11)).astype("float64") + 0.5) / float(1 << 53)


@lru_cache(maxsize=4096)
def _poisson_steps(mean: int) -> np.ndarray:
    k = np.arange(int(mean + 12 * np.sqrt(mean) + 24))
    return np.exp(k * np.log(mean) - mean - np.concatenate([[0.0], np.cumsum(np.log(k[1:]))])).cumsum()


def copies(h: np.ndarray, n: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """Bootstrap weight of rows that stand for ``n`` equal ones: Poisson with mean ``n``, as many single draws add up to."""
    u, out = _uniform(h, seed, 2 * tree), np.zeros(len(n))
    many = n > 1024
    if many.any():  # the normal limit with its skewness
        z = np.sqrt(-2 * np.log(u[many])) * np.cos(2 * np.pi * _uniform(h[many], seed, 2 * tree + 1))
        out[many] = np.maximum(0, np.rint(n[many] + np.sqrt(n[many]) * z + (z * z - 1) / 6))
    for mean in np.unique(n[~many]):
        at = n == mean
        out[at] = np.searchsorted(_poisson_steps(int(mean)), u[at])
    return out


@dataclass
class Forest:
    """Trees as arrays (tree, node); node i has the children 2i + 1 and 2i + 2, ``feature`` is -1 at a leaf, ``rows`` are weights of nodes."""

    cuts: list[np.ndarray]
    depth: int
    seed: int
    feature: np.ndarray
    cut: np.ndarray
    rows: np.ndarray

    @property
    def trees(self) -> int:
        return len(self.feature)

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(c, x[:, k], side="left") for k, c in enumerate(self.cuts)]).astype(np.uint8) if self.cuts else np.zeros((len(x), 0), np.uint8)

    def node(self, bins: np.ndarray, tree: int, depth: int | None = None) -> np.ndarray:
        """The node of each row after so many steps, or where its way ends before."""
        at = np.zeros(len(bins), np.int64)
        for _ in range(self.depth if depth is None else depth):
            feature = self.feature[tree, at]
            inner = np.flatnonzero(feature >= 0)
            at[inner] = 2 * at[inner] + 1 + (bins[inner, feature[inner]] > self.cut[tree, at[inner]])
        return at

    def asked(self, tree: int, depth: int) -> np.ndarray:
        """(node of a level, feature): the features that a node may be divided by."""
        width, nodes = len(self.cuts), np.arange(2**depth - 1, 2 ** (depth + 1) - 1)
        if not width:
            return np.zeros((len(nodes), 0), bool)
        key = (nodes[:, None] * width + np.arange(width)[None]).astype(np.uint64) + np.uint64(tree << 32)
        place = _uniform(key, self.seed, 1 << 20).argsort(axis=1).argsort(axis=1)
        return place < int(np.ceil(np.sqrt(width)))


def _unpacked(row, width: int):
    n = np.frombuffer(row["n"], np.int64)
    return row["labels"], np.frombuffer(row["cls"], np.int32), np.frombuffer(row["bins"], np.uint8).reshape(len(n), width), n, np.frombuffer(row["h"], np.uint64)


def _packed_rows(batches):
    for batch in batches:
        yield from batch.to_dict("records")


def packed(forest: Forest, df: DataFrame, label: str, features: list[str]) -> DataFrame:
    """Rows of ``df`` by class, a part a row; parts of a class that fills several are ``hot`` and hold that class only."""
    def place(batches):
        for batch in batches:
            yield pd.DataFrame({"label": batch[label], "bins": [b.tobytes() for b in forest.binned(batch[features].to_numpy(dtype="float64").reshape(len(batch), -1))]})

    grouped = cut_lineage(df.select(label, *features).mapInPandas(place, "label string, bins binary").groupBy("label", "bins").agg(F.count(F.lit(1)).alias("n")))
    counts = grouped.groupBy("label").agg(F.count(F.lit(1)).alias("held"))
    hot = cut_lineage(counts.where(F.col("held") > PART_ROWS).select("label", F.ceil(F.col("held") / PART_ROWS).alias("shares")))
    parts = max(1, -(-grouped.count() // PART_ROWS))
    digest = F.xxhash64("label", "bins")
    # one row for each class of many rows: as many as parts at most
    dealt = grouped.join(F.broadcast(hot), "label", "left").select(
        "label", "bins", "n", digest.alias("h"), F.col("shares").isNotNull().alias("hot"),
        F.when(F.col("shares").isNull(), F.pmod(F.xxhash64("label", F.lit(1)), F.lit(parts))).otherwise(F.pmod(digest, "shares")).alias("part"),
        F.when(F.col("shares").isNotNull(), F.col("label")).alias("of"))

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["label", "bins"])
        labels, cls = np.unique(rows["label"].to_numpy(dtype=object), return_inverse=True)
        return pd.DataFrame([{
            "labels": labels.tolist(), "hot": bool(rows["hot"].iloc[0]), "cls": cls.astype(np.int32).tobytes(), "bins": b"".join(rows["bins"]),
            "n": rows["n"].to_numpy(np.int64).tobytes(), "h": rows["h"].to_numpy(np.int64).tobytes()}])

    return cut_lineage(dealt.groupBy("hot", "of", "part").applyInPandas(pack, _PACKED))


def _level_sums(forest: Forest, depth: int):
    """Of each tree what the cuts of a level's nodes give: by bin, the changes of both sides' sums of squares, and the rows."""
    nodes, width, first = 2**depth, len(forest.cuts), 2**depth - 1

    def sums(batches):
        cells = np.zeros((forest.trees, nodes, width, BINS, 3))
        whole = np.zeros((forest.trees, nodes, 2))
        held: dict[tuple[int, str], np.ndarray] = {}
        for row in _packed_rows(batches):
            labels, cls, bins, n, h = _unpacked(row, width)
            for tree in range(forest.trees):
                weight, node, asked = copies(h, n, tree, forest.seed), forest.node(bins, tree, depth) - first, forest.asked(tree, depth)
                on = np.flatnonzero((weight > 0) & (node >= 0))
                if not len(on):
                    continue
                w, at, c, b = weight[on], node[on], cls[on], bins[on]
                if row["hot"]:
                    seen = held.setdefault((tree, labels[0]), np.zeros((nodes, width + 1, BINS)))
                    seen[:, width, 0] += np.bincount(at, w, nodes)
                    for f in range(width):
                        here = asked[at, f]
                        seen[:, f] += np.bincount(at[here] * BINS + b[here, f], w[here], nodes * BINS).reshape(nodes, BINS)
                    continue
                keys, group = np.unique(c.astype(np.int64) * nodes + at, return_inverse=True)
                total, place = np.bincount(group, w), keys % nodes
                whole[tree, :, 0] += np.bincount(place, total, nodes)
                whole[tree, :, 1] += np.bincount(place, total**2, nodes)
                for f in range(width):
                    here = asked[at, f]
                    if not here.any():
                        continue
                    steps, step = np.unique(group[here] * BINS + b[here, f], return_inverse=True)
                    count = np.bincount(step, w[here])
                    of = steps // BINS
                    upto = count.cumsum()
                    start = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
                    upto -= np.repeat((upto - count)[start], np.diff(np.append(start, len(of))))
                    rest = total[of] - upto
                    cell = place[of] * BINS + steps % BINS
                    for k, values in enumerate((upto**2 - (upto - count) ** 2, rest**2 - (rest + count) ** 2, count)):
                        cells[tree, :, f, :, k] += np.bincount(cell, values, nodes * BINS).reshape(nodes, BINS)
        yield pd.DataFrame({
            "tree": np.arange(forest.trees, dtype=np.int32), "label": None, "sums": [np.concatenate([whole[t].ravel(), cells[t].ravel()]) for t in range(forest.trees)]})
        if held:
            yield pd.DataFrame({"tree": [t for t, _ in held], "label": [k for _, k in held], "sums": [v.ravel() for v in held.values()]}).astype({"tree": "int32"})
    return sums


def _best_cuts(forest: Forest, depth: int, least: int):
    nodes, width = 2**depth, len(forest.cuts)

    def best(rows: pd.DataFrame) -> pd.DataFrame:
        tree = int(rows["tree"].iloc[0])
        spread = rows["label"].notna().to_numpy()
        added = np.sum(rows["sums"][~spread].tolist(), axis=0)
        whole, cells = added[: nodes * 2].reshape(nodes, 2), added[nodes * 2 :].reshape(nodes, width, BINS, 3).cumsum(axis=2)
        total, square = whole[:, 0].copy(), whole[:, 1].copy()
        left, low, high = cells[..., 2].copy(), cells[..., 0].copy(), cells[..., 1] + square[:, None, None]
        for _, part in rows[spread].groupby("label"):
            seen = np.sum(part["sums"].tolist(), axis=0).reshape(nodes, width + 1, BINS)
            mine, upto = seen[:, width, 0], seen[:, :width].cumsum(axis=2)
            total, square = total + mine, square + mine**2
            left, low, high = left + upto, low + upto**2, high + (mine[:, None, None] - upto) ** 2
        right = total[:, None, None] - left
        found = []
        for at in np.flatnonzero(total > 0):
            with np.errstate(all="ignore"):
                gain = low[at] / left[at] + high[at] / right[at] - square[at] / total[at]
            gain[~((left[at] >= max(1, least)) & (right[at] >= max(1, least)) & forest.asked(tree, depth)[at][:, None])] = -np.inf
            place = int(gain.argmax()) if gain.size else -1
            # what is lost in rounding is no gain
            f, cut = divmod(place, BINS) if place >= 0 and gain.flat[place] > 1e-9 * total[at] else (-1, 0)
            found.append((tree, nodes - 1 + int(at), f, cut, total[at], left[at][f, cut] if f >= 0 else 0.0))
        return pd.DataFrame(found, columns=["tree", "node", "feature", "cut", "total", "left"]).astype({"tree": "int32", "node": "int32", "feature": "int32", "cut": "int32"})
    return best


def fit(df: DataFrame, label: str, features: list[str], trees: int, depth: int, least: int = 1, seed: int = 42) -> tuple[Forest, DataFrame]:
    """The forest and the packed rows it was grown from."""
    if depth < 1:
        raise ValueError("a tree needs a level")
    size = 2 ** (depth + 1) - 1
    forest = Forest(thresholds(df, features), depth, seed, np.full((trees, size), -1), np.zeros((trees, size), np.int64), np.zeros((trees, size)))
    rows = packed(forest, df, label, features)
    for d in range(depth):
        sums = rows.mapInPandas(_level_sums(forest, d), "tree int, label string, sums array<double>")
        best = sums.groupBy("tree").applyInPandas(_best_cuts(forest, d, least), "tree int, node int, feature int, cut int, total double, left double")
        for r in best.collect():
            t, i = r["tree"], r["node"]
            forest.feature[t, i], forest.cut[t, i], forest.rows[t, i] = r["feature"], r["cut"], r["total"]
            if r["feature"] >= 0:
                forest.rows[t, 2 * i + 1], forest.rows[t, 2 * i + 2] = r["left"], r["total"] - r["left"]
    return forest, rows


def _weights(forest: Forest, cls: np.ndarray, bins: np.ndarray, n: np.ndarray, h: np.ndarray, classes: int) -> np.ndarray:
    """(tree and node, class): weights of the classes of a part in the leaves."""
    size = forest.feature.shape[1]
    out = np.zeros((forest.trees * size, classes))
    for tree in range(forest.trees):
        leaf = forest.node(bins, tree)
        out[tree * size : (tree + 1) * size] = np.bincount(leaf * classes + cls, copies(h, n, tree, forest.seed), size * classes).reshape(size, classes)
    return out


def _shares(forest: Forest, weights: np.ndarray) -> np.ndarray:
    rows = forest.rows.ravel()[:, None]
    return np.floor(_ONE * np.divide(weights, rows, out=np.zeros_like(weights), where=rows > 0))


def _told(forest: Forest, leaves: np.ndarray) -> np.ndarray:
    """(combination, tree and node): 1 at each leaf of a combination."""
    size = forest.feature.shape[1]
    out = np.zeros((len(leaves), forest.trees * size))
    out[np.arange(len(leaves))[:, None], np.arange(forest.trees)[None] * size + leaves] = 1.0
    return out


def _first_best(scores: np.ndarray, labels: list[str]) -> tuple[np.ndarray, list[str]]:
    at = scores.argmax(axis=1)
    return scores[np.arange(len(scores)), at], [labels[i] for i in at]


def guesses(forest: Forest, rows: DataFrame, df: DataFrame, label: str, features: list[str]) -> DataFrame:
    """``(class, n, guess)``: rows of ``df`` grouped by class and leaves; of several best classes the first in text order is guessed.

    ``rows`` are the packed rows of the fit.
    """
    wide, trees = len(features), forest.trees

    def routed(batches):
        for batch in batches:
            bins = forest.binned(batch[features].to_numpy(dtype="float64").reshape(len(batch), -1))
            leaves = np.column_stack([forest.node(bins, t) for t in range(trees)]).astype(np.uint16)
            yield pd.DataFrame({"class": batch[label], "leaves": [r.tobytes() for r in leaves]})

    asked = cut_lineage(df.select(label, *features).mapInPandas(routed, "class string, leaves binary").groupBy("class", "leaves").agg(F.count(F.lit(1)).alias("n")))
    distinct = cut_lineage(asked.select("leaves").distinct())
    blocks = max(1, -(-distinct.count() // ASKED_ROWS))
    listed = distinct.groupBy(F.pmod(F.xxhash64("leaves"), F.lit(blocks)).alias("block")).agg(F.collect_list("leaves").alias("asked"))
    block = cut_lineage(listed.select("asked"))

    def spread(batches):
        held: dict[str, np.ndarray] = {}
        for row in _packed_rows(batches):
            labels, cls, bins, n, h = _unpacked(row, wide)
            held[labels[0]] = held.get(labels[0], 0) + _weights(forest, cls, bins, n, h, 1)[:, 0]
        if held:
            yield pd.DataFrame({"label": list(held), "node": [np.arange(len(v)) for v in held.values()], "weight": list(held.values())}).explode(["node", "weight"]).astype({"node": "int32", "weight": "float64"})

    # classes of many rows: fewer than parts, one column of weights each
    sums = rows.where("hot").mapInPandas(spread, "label string, node int, weight double").groupBy("label", "node").agg(F.sum("weight").alias("weight")).collect()
    large = sorted({r["label"] for r in sums})
    weights = np.zeros((trees * forest.feature.shape[1], len(large)))
    for r in sums:
        weights[r["node"], large.index(r["label"])] = r["weight"]

    def frame(leaves, score, guess) -> pd.DataFrame:
        return pd.DataFrame({"leaves": leaves, "score": score, "guess": guess})

    def of_large(batches):
        shares = _shares(forest, weights)
        for row in _packed_rows(batches):
            told = _told(forest, np.array([np.frombuffer(x, np.uint16) for x in row["asked"]], dtype=np.int64))
            yield frame(list(row["asked"]), *_first_best(told @ shares, large))

    def of_part(batches):
        for row in _packed_rows(batches):
            labels, cls, bins, n, h = _unpacked(row, wide)
            told = _told(forest, np.array([np.frombuffer(x, np.uint16) for x in row["asked"]], dtype=np.int64))
            best, guess = np.full(len(told), -1.0), np.full(len(told), None, dtype=object)
            for low in range(0, len(labels), CLASSES):
                here = (cls >= low) & (cls < low + CLASSES)
                part = labels[low : low + CLASSES]
                shares = _shares(forest, _weights(forest, cls[here] - low, bins[here], n[here], h[here], len(part)))
                score, names = _first_best(told @ shares, part)
                more = score > best
                best[more], guess[more] = score[more], np.array(names, dtype=object)[more]
            yield frame(list(row["asked"]), best, guess)

    schema = "leaves binary, score double, guess string"
    found = rows.where("NOT hot").crossJoin(block).mapInPandas(of_part, schema)
    if large:
        found = found.unionByName(block.mapInPandas(of_large, schema))
    best = found.groupBy("leaves").agg(F.min(F.struct((-F.col("score")).alias("less"), "guess")).alias("top"))
    return asked.join(best.select("leaves", F.col("top.guess").alias("guess")), "leaves", "left").select("class", "n", "guess")


def accuracy(told: DataFrame) -> float | None:
    """Share of the rows of ``guesses`` whose class was guessed."""
    hit = F.when(F.col("guess") == F.col("class"), F.col("n")).otherwise(F.lit(0))
    return told.agg(F.round(F.try_divide(F.sum(hit).cast("double"), F.sum("n")), 4)).first()[0]
