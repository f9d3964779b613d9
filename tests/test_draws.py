import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from facsimile.functions import rng
from facsimile.operators import model as models
from facsimile.operators import moments
from facsimile.operators import sample as draws
from facsimile.operators.mechanisms import PrivacyParams, protect


@pytest.mark.parametrize("size", [0, 1, 54, 55, 56, 63, 64, 119, 120, 300])
def test_digest_units_equal_hashlib(size):
    messages = np.random.default_rng(size).integers(0, 256, (5, size)).astype(np.uint8)
    first, second = rng.digest_units(messages)
    for row, x, y in zip(messages, first, second):
        digest = hashlib.md5(row.tobytes()).hexdigest()
        assert (x, y) == tuple((int(digest[k:k + 13], 16) + 0.5) / 2**52 for k in (0, 13))


def test_draws_taken_together_equal_single_ones(spark):
    df = spark.range(0, 2000, 7, 3).select("id", F.when(F.col("id") % 3 > 0, F.concat(F.lit("é"), F.repeat(F.lit("x"), (F.col("id") % 80).cast("int")))).alias("k"))
    for key in (["id"], ["k"], ["k", "id"]):
        held = rng.Draws(5)
        single = [rng.uniform(5, "u", *key), rng.normal(5, "n", *key), rng.uniform(5, "n", *key)]
        joint = [rng.uniform(held, "u", *key), rng.normal(held, "n", *key), rng.uniform(held, "n", *key)]
        same = [(x == y) & x.isNotNull() for x, y in zip(single, joint)]
        assert held.over(df).where(same[0] & same[1] & same[2]).count() == df.count() == 286


def test_protected_draws_of_many_columns_are_compiled(spark, capsys):
    """A generated method beyond 8000 bytes is interpreted by the JVM."""
    real = spark.range(400).select(
        *[((F.col("id") * (k + 3)) % 101 + F.lit(k)).cast("int" if k % 2 else "double").alias(f"c{k}") for k in range(9)],
        (F.col("id") % 3).cast("string").alias("t"), (F.col("id") % 2).cast("string").alias("s"))
    kinds = {**{f"c{k}": "numeric" for k in range(9)}, "t": "categorical", "s": "categorical"}
    drawn = draws.sample(models.fit(real, known_kinds=kinds), spark, 50, 3, keep_row_id=True)
    table = protect(drawn, real, PrivacyParams(5.0), ["row_id"], None, 3)[0]
    table.explain("codegen")
    sizes = [int(part.split(";")[0]) for part in capsys.readouterr().out.split("maxMethodCodeSize:")[1:]]
    assert sizes and max(sizes) < 8000
    assert table.count() == 50


def test_correlations_of_shifted_sparse_and_constant_columns(spark):
    rng_ = np.random.default_rng(6)
    x = rng_.normal(size=(600, 4)) + np.array([0.0, 1e9, -5.0, 3.0])
    x[:, 2] += x[:, 0]
    x[:, 3] = 0.1
    x[rng_.random((600, 4)) < 0.3] = np.nan
    side = rng_.integers(0, 3, 600)
    cells = [("xyz"[g] if g else None, *[None if np.isnan(v) else float(v) for v in row]) for g, row in zip(side, x)]
    df = spark.createDataFrame(cells, "side string, a double, b double, c double, d double").repartition(5)
    found = {(r["side"], r["col_i"], r["col_j"]): r["r"] for r in moments.correlations(df, list("abcd"), ["side"]).collect()}
    assert len(found) == 18
    for (name, i, j), r in found.items():
        rows = x[side == ("xyz".index(name) if name else 0)][:, ["abcd".index(i), "abcd".index(j)]]
        rows = rows[~np.isnan(rows).any(axis=1)]
        assert r is None if j == "d" else r == pytest.approx(np.corrcoef(rows.T)[0, 1], abs=1e-7)
    nothing = moments.correlations(df.where("false"), list("abcd")).collect()
    assert len(nothing) == 6 and all(r["r"] is None for r in nothing)


def test_correlations_are_one_scan_of_small_methods(spark, capsys):
    df = spark.range(50).select(*[(F.col("id") * (k + 1) % 13).cast("double").alias(f"c{k}") for k in range(9)])
    found = moments.correlations(df, df.columns)
    found.explain()
    plan = capsys.readouterr().out
    assert plan.count("MapInArrow") == 1 and "covar_samp" not in plan


def test_rank_correlation_with_one_large_column_moves_no_row(spark, monkeypatch):
    from facsimile.operators import association

    rng_ = np.random.default_rng(12)
    x = np.stack([rng_.integers(0, 5, 500), rng_.normal(size=500), rng_.integers(0, 4, 500), np.full(500, 7.0)], axis=1)
    x[:, 1] += x[:, 0]
    x[::4, 1] = x[::8, 1].repeat(2)[:125]
    x[rng_.random((500, 4)) < np.array([0.2, 0.2, 0.0, 0.0])] = np.nan
    side = rng_.integers(0, 2, 500)
    rows = [("xy"[g], *[None if np.isnan(v) else float(v) for v in row]) for g, row in zip(side, x)]
    df = spark.createDataFrame([*rows, ("z", 1.0, None, 2.0, 7.0), ("z", 2.0, None, 1.0, 7.0)], "side string, a double, b double, c double, d double")
    order = lambda found: sorted((str(r["side"]), r["col_i"], r["col_j"], None if r["r"] is None else round(r["r"], 9)) for r in found.collect())
    for columns in (list("abcd"), list("bac"), ["c", "b"]):
        want = order(association.spearman(df, columns, ["side"]))
        with monkeypatch.context() as patch:
            patch.setattr(association, "BROADCAST_NUMBERS", 200)
            patch.setattr(association, "with_ranks", None)
            assert order(association.spearman(df, columns, ["side"])) == want
            whole = association.spearman(df.drop("side"), columns).collect()
        again = {(r["col_i"], r["col_j"]): r["r"] for r in association.spearman(df.drop("side"), columns).collect()}
        assert len(whole) == len(again) and all(r["r"] == pytest.approx(again[r["col_i"], r["col_j"]], abs=1e-9) for r in whole)
