import hashlib
import math
import random
from collections import Counter
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from facsimile.functions.tails import chi_square_tail, kolmogorov_tail
from facsimile.operators import association, relationship, statistical, structural


@pytest.fixture(scope="module")
def mixed(spark):
    rng = random.Random(5)
    make = lambda shift: spark.createDataFrame(
        [(rng.randint(20, 60), rng.gauss(50_000 + shift, 9_000), rng.choice(["HR", "IT", "OPS"]), rng.randint(0, 1)) for _ in range(100)],
        "age int, income double, department string, promoted int",
    )
    return make(0), make(800)


def test_chi_square_tail_known_values():
    assert chi_square_tail(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-12)
    assert chi_square_tail(18.307038053275146, 10) == pytest.approx(0.05, abs=1e-12)
    assert chi_square_tail(0.0, 3) == 1.0


def test_kolmogorov_tail_known_values():
    # critical distance of the limit law at five percent
    assert kolmogorov_tail(1.3581 / math.sqrt(50_000), 100_000, 100_000) == pytest.approx(0.05, abs=1e-3)
    assert kolmogorov_tail(0.0, 100, 100) == 1.0


def test_ks_against_brute_force(spark, rows):
    rng = np.random.default_rng(1)
    a, b = np.round(rng.normal(0, 1, 400), 1), np.round(rng.normal(0.3, 1.2, 300), 1)
    grid = np.union1d(a, b)
    want = max(abs((a <= g).mean() - (b <= g).mean()) for g in grid)
    frame = lambda v: spark.createDataFrame(pd.DataFrame({"x": v}))
    got = rows(statistical.ks_test(frame(a), frame(b), ["x"]))["x"]
    assert got["statistic"] == round(want, 6)


def test_ks_needs_two_values(spark, rows):
    got = rows(statistical.ks_test(spark.createDataFrame([(1.0,)], "x double"), spark.createDataFrame([(1.0,), (2.0,)], "x double"), ["x"]))["x"]
    assert got["statistic"] is None and not got["similar"]


def test_identical_tables_score_full(mixed):
    real, _ = mixed
    assert statistical.statistical_fidelity(real, real).first()["score"] == 100.0
    assert structural.structural_fidelity(real, real).first()["score"] == 100.0
    assert relationship.relationship_fidelity(real, real, "promoted").first()["score"] == 100.0


def test_mixed_pair(mixed):
    found = statistical.statistical_fidelity(*mixed).first()
    assert 0 <= found["score"] <= 100 and found["num_numeric"] == 3 and found["num_categorical"] == 1


def test_histogram_counts_every_value_once(mixed):
    real, synth = mixed
    bins = statistical.histogram(real, synth, ["income", "age"]).collect()
    assert len(bins) == 60
    width = {}
    for c in ("income", "age"):
        centers = sorted(b["center"] for b in bins if b["column"] == c)
        width[c] = centers[1] - centers[0]
    for side in ("real_density", "synth_density"):
        assert sum(b[side] * width[b["column"]] for b in bins if b["column"] == "age") == pytest.approx(1, abs=1e-3)


def test_constant_column_correlates_with_nothing(spark):
    df = spark.createDataFrame([(float(i), 7.0) for i in range(10)], "x double, c double")
    cells = {(r["col_i"], r["col_j"]): r["delta"] for r in statistical.correlation_delta(df, df, ["x", "c"]).collect()}
    assert len(cells) == 4 and set(cells.values()) == {0.0}


def test_empty_synthetic_category_column_fails(spark, rows):
    real = spark.createDataFrame([("a",), ("b",)], "c string")
    synth = spark.createDataFrame([(None,), (None,)], "c string")
    got = rows(statistical.chi_square(real, synth, ["c"]))["c"]
    assert got["p_value"] == 0.0 and not got["similar"]


def test_constants(spark, rows):
    real = spark.createDataFrame([(42, "FIXED", None), (42, "FIXED", None)], "n int, s string, z string")
    synth = spark.createDataFrame([(42, "OTHER", None), (42, "FIXED", None)], "n int, s string, z string")
    found = rows(structural.constant_preservation(real, synth))
    assert found["n"]["preserved"] and not found["s"]["preserved"] and "z" not in found


def test_novel_missing_and_extra(spark):
    real = spark.createDataFrame([("a", 1), ("b", 2)], "c string, gone int")
    synth = spark.createDataFrame([("a", 1.0), ("zzz", 2.0)], "c string, new double")
    assert {r["column"]: r["presence"] for r in structural.column_preservation(real, synth).collect()} == {
        "c": "common", "gone": "missing", "new": "extra"}
    row = structural.structural_fidelity(real, synth).first()
    assert row["status"] != "passed" and row["column_preservation_rate"] == 0.5
    messages = [r["message"] for r in structural.structural_warnings(real, synth).collect()]
    assert any("novel" in m for m in messages) and any("missing columns" in m for m in messages)
    assert structural.structural_fidelity(real, synth, ("gone",)).first()["missing_columns"] == 0


def test_type_compatibility(spark, rows):
    real = spark.createDataFrame([(1, True, "x")], "a int, b boolean, c string")
    synth = spark.createDataFrame([(1.0, 1, 5)], "a double, b int, c int")
    assert {c: r["compatible"] for c, r in rows(structural.type_compatibility(real, synth)).items()} == {"a": True, "b": True, "c": False}


def test_spearman_matches_pandas_with_nulls(spark):
    rng = np.random.default_rng(3)
    frame = pd.DataFrame({"a": rng.integers(0, 9, 120).astype(float), "b": rng.normal(size=120), "c": rng.integers(0, 4, 120).astype(float)})
    frame["b"] += frame["a"]
    frame.loc[frame.index[::7], "a"] = None
    frame.loc[frame.index[::11], "c"] = None
    want = frame.corr(method="spearman")
    df = spark.createDataFrame([tuple(None if pd.isna(v) else float(v) for v in row) for row in frame.to_numpy()], "a double, b double, c double")
    for r in association.spearman(df, ["a", "b", "c"]).collect():
        assert r["r"] == pytest.approx(want.loc[r["col_i"], r["col_j"]], abs=1e-9)


def test_melted_ranks_equal_broadcast_ranks(spark, monkeypatch):
    rng = np.random.default_rng(4)
    cells = [
        ("xy"[k % 2], *[None if rng.random() < hole else float(v) for hole, v in zip((0.4, 0.0, 0.4), rng.integers(0, 7, 3))])
        for k in range(150)
    ] + [("x", None, None, None), (None, 1.0, 2.0, 3.0)]
    df = spark.createDataFrame(cells, "side string, a double, b double, c double")
    order = lambda found: sorted(map(repr, found.collect()))
    want = order(association.with_ranks(df, ["a", "b", "c"], ["a", "c"], ["side"]))
    for numbers in (0, 60):  # all columns melted, or some
        monkeypatch.setattr(association, "BROADCAST_NUMBERS", numbers)
        found = association.with_ranks(df, ["a", "b", "c"], ["a", "c"], ["side"])
        names = ["side", *[f"{c}__{r}" for c in "abc" for r in ("r", "r0", "r1")]]
        monkeypatch.undo()
        again = association.with_ranks(df, ["a", "b", "c"], ["a", "c"], ["side"])
        assert order(found.select(*names)) == order(again.select(*names)) and len(want) == 152


def test_cramers_v_perfect_and_degenerate(spark):
    df = spark.createDataFrame([("abc"[i % 3], "xyz"[i % 3], "k", None) for i in range(60)], "p string, q string, one string, none string")
    got = {(r["col_i"], r["col_j"]): r["v"] for r in association.cramers_v(df, [("p", "q"), ("p", "one"), ("p", "none")]).collect()}
    assert got[("p", "q")] == pytest.approx(1.0) and got[("p", "one")] == 0.0 and got[("p", "none")] == 0.0


def test_block_counts_equal_row_copies(spark):
    rng = np.random.default_rng(5)
    names = [f"c{i}" for i in range(8)]
    long = ["é" * 70, "é" * 71, "b" * 63, "b" * 64]
    rows = [
        ("xy"[k % 2] if k % 5 else None, k % 3, *[None if v == 0 else long[v % 4] if i == 7 else str(v) for i, v in enumerate(rng.integers(0, 6, 8))])
        for k in range(400)
    ] + [(None, 0, *[None] * 8)]
    df = spark.createDataFrame(rows, "side string, part int, " + ", ".join(f"{n} string" for n in names)).repartition(3)
    pairs = list(combinations(names, 2))
    assert len(pairs) > 2 * len(names)
    for by in ([], ["side"], ["side", "part"]):
        want = Counter()
        for row in rows:
            cells = dict(zip(["side", "part", *names], row))
            for i, j in pairs:
                a, b = (hashlib.sha256(v.encode()).hexdigest() if v and len(v) >= 64 else v for v in (cells[i], cells[j]))
                if a is not None and b is not None:
                    want[(*[cells[c] for c in by], i, j, a, b)] += 1
        for found in (association.contingency(df, pairs, by), association.block_counts(df, names, pairs, by, block=32)):
            got = Counter()
            for r in found.collect():
                got[tuple(r)[:-1]] += r["n"]
            assert got == want
    empty = association.cramers_v(df.limit(0), pairs).collect()
    assert len(empty) == len(pairs) and all(r["v"] == 0 for r in empty)


def test_block_counts_do_not_grow_with_the_rows(spark):
    names = [f"c{i:02d}" for i in range(32)]
    pairs = list(combinations(names, 2))
    df = spark.range(0, 20_000, 1, 2).select(*[((F.col("id") + i) % 2).cast("string").alias(c) for i, c in enumerate(names)])
    sent = association.block_counts(df, names, pairs, []).count()
    assert sent == 2 * 2 * len(pairs)  # two tasks, two cells a pair: 0.1 rows a row instead of 496


def test_many_categorical_columns_are_capped_only_on_request(spark):
    names = [f"c{i:02d}" for i in range(40)]
    df = spark.createDataFrame([tuple("ab"[(i + j) % 2] for j in range(40)) for i in range(50)], ", ".join(f"{n} string" for n in names))
    assert relationship.association_columns(df, names, 30) == names[:30]
    assert relationship.association_columns(df, names) == names


def test_no_applicable_relationship(spark):
    df = spark.createDataFrame([(1.0,), (2.0,)], "x double")
    row = relationship.relationship_fidelity(df, df).first()
    assert not row["applicable"] and row["score"] == 100.0


def test_rank_correlation_with_nulls_in_a_fixed_number_of_jobs(spark):
    import numpy as np

    from facsimile.operators import association

    rng = np.random.default_rng(8)
    base = rng.integers(0, 12, (200, 4)).astype(float)
    holes = rng.random((200, 4)) < 0.3
    context, jobs = spark.sparkContext, {}

    def average_rank(v):
        order = np.sort(v)
        return (np.searchsorted(order, v, "left") + np.searchsorted(order, v, "right") + 1) / 2

    for nullable in (0, 1, 4):
        cells = [[None if holes[k, c] and c < nullable else float(base[k, c]) for c in range(4)] for k in range(200)]
        df = spark.createDataFrame(cells, "a double, b double, c double, d double")
        context.setJobGroup(f"ranks-{nullable}", "ranks")
        got = {(r["col_i"], r["col_j"]): r["r"] for r in association.spearman(df, list("abcd")).collect()}
        context.setJobGroup("others", "others")
        jobs[nullable] = len(context.statusTracker().getJobIdsForGroup(f"ranks-{nullable}"))
        for i in range(4):
            for j in range(i + 1, 4):
                both = [(x[i], x[j]) for x in cells if x[i] is not None and x[j] is not None]
                x, y = (average_rank(np.array(v)) for v in zip(*both))
                assert abs(got["abcd"[i], "abcd"[j]] - np.corrcoef(x, y)[0, 1]) < 1e-9
    assert jobs[1] == jobs[4] and jobs[4] <= jobs[0] + 2
