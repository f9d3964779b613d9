"""Exact top-k by inner product against all pairs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from facsimile.llm import inner

SCHEMA = "vec_id long, embedding array<double>, path string, _v string, rows int"


def plain(rows, asked, k):
    def whole(rows):
        out = set()
        for i, v, *_ in rows:
            if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
                out.add((i, tuple(math.floor(1024 * x) for x in v)))
        return out

    out = []
    data = whole(rows)
    for i, v in whole(asked):
        found = sorted((-max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(v, w)))), j) for j, w in data if len(w) == len(v) and (j, w) != (i, v))
        out += [(i, n, j, -s) for n, (s, j) in enumerate(found[:k], 1)]
    return sorted(out)


def found(df, asked, k, settings):
    return sorted(tuple(r) for r in inner.top(df, asked, k, settings).collect())


@pytest.mark.parametrize("settings", [
    inner.Settings(), inner.Settings(block_rows=40, query_rows=8, fan=4, sample=30, leaf=4), inner.Settings(block_rows=100, query_rows=3, fan=8, leaf=2)])
def test_search_equals_all_pairs(spark, settings):
    draw = np.random.default_rng(1)
    clusters = draw.normal(size=(12, 6))
    rows = [(i, [float(x) for x in clusters[i % 12] * (1 + i % 3) + draw.normal(size=6) * 0.05], "p", "v", 1) for i in range(600)]
    rows += [(700 + i, [1.0, 2.0, 3.0, -4.0, 0.5, 0.0], None, None, None) for i in range(60)]  # a common vector
    rows += rows[:30]
    rows += [(10, [9.0] * 6, None, None, None), (None, [1.0] * 6, None, None, None), (20, None, None, None, None), (30, [None] * 6, None, None, None),
             (40, [float("nan")] * 6, None, None, None), (50, [float("inf")] * 6, None, None, None), (60, [0.0] * 6, None, None, None), (800, [], None, None, None), (810, [1.0, 2.0], None, None, None),
             (820, [3.0, 2.0], None, None, None), (830, [], None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    asked = [r for r in rows if r[0] is not None and r[0] % 10 == 0]
    assert found(df, df.where(F.col("vec_id") % 10 == 0), 10, settings) == plain(rows, asked, 10)


def test_queries_from_another_table_and_huge_numbers(spark):
    rows = [(1, [1e18, 2.0], None, None, None), (2, [-1e18, 1e18], None, None, None), (3, [1e12, 5.5], None, None, None), (4, [1e300, 0.0], None, None, None), (5, [1.7e308, 1.0], None, None, None)]
    other = [(1, [0.5, 1e3], None, None, None), (9, [2.0**40, -3.25], None, None, None)]
    got = found(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(other, SCHEMA), 3, inner.Settings())
    want = plain([(i, [x if abs(x) < 1e305 else 1.7976931348623157e308 / 1024 for x in v]) for i, v, *_ in rows], other, 3)
    assert got == want


def test_nodes_are_pruned_only_when_no_pair_counts():
    draw = np.random.default_rng(2)
    x = np.floor(np.concatenate([draw.normal(size=(300, 5)) * 20 + c for c in (0, 400, -900)]))
    q = np.floor(draw.normal(size=(40, 5)) * 300)
    tq, tr = inner.Tree(q, 3), inner.Tree(x, 5)
    for tree in (tq, tr):
        for level, size in enumerate(tree.sizes):
            far = inner._apart(tree.x, np.zeros(5)) * 0
            for c in range(size):
                rows = tree.under[level] == c
                far[rows] = inner._apart(tree.x[rows], tree.x[tree.centres[c]])
                assert not rows.any() or far[rows].max() <= tree.radii[level][c]
    best, worst = [[] for _ in q], np.full(len(q), -np.inf)
    inner.search(tq, tr, best, worst, 4, np.ones(len(x), np.int32), np.arange(len(x)), np.arange(len(x)))
    s = q @ x.T
    for i in range(len(q)):
        assert [(b[0], b[1]) for b in best[i]] == sorted((-int(v), j) for j, v in enumerate(s[i]))[:4]


def test_no_vectors(spark):
    empty = spark.createDataFrame([], SCHEMA)
    some = spark.createDataFrame([(1, [1.0], None, None, None)], SCHEMA)
    assert found(empty, empty, 3, inner.Settings()) == [] == found(some, empty, 3, inner.Settings()) == found(some, some, 3, inner.Settings())
    assert found(empty, some, 3, inner.Settings()) == []
