"""Attribute inference on targets with very many classes, and exact tails of small samples."""

import itertools
import math

import pytest

from facsimile.functions.tails import kolmogorov_exact, kolmogorov_tail
from facsimile.operators import audit, level_attack, statistical


def test_wide_target_is_audited(spark):
    real = [(f"name{i}", i % 7, f"street{i}") for i in range(60)]
    leaked = spark.createDataFrame(real, "name string, zone int, street string")
    strange = spark.createDataFrame([(f"other{i}", i % 7, f"road{i}") for i in range(60)], "name string, zone int, street string")
    found = {s: audit.attribute_inference(leaked, t, ["name"], most_classes=10).first() for s, t in (("leaked", leaked), ("strange", strange))}
    assert found["leaked"]["accuracy"] == 1.0 and found["leaked"]["vulnerable"] and found["leaked"]["error"] is None
    assert found["leaked"]["baseline_accuracy"] == round(1 / 60, 4) and found["leaked"]["n_classes"] == 60
    assert found["strange"]["accuracy"] == 0.0 and found["strange"]["n_classes"] == 120 and not found["strange"]["vulnerable"]


def test_surest_level_wins(spark):
    synth = spark.createDataFrame([("x", "a", "p"), ("x", "a", "q"), ("y", "a", "q"), ("y", "b", "q"), (None, "c", None)], "t string, f string, g string")
    real = spark.createDataFrame([("x", "a", "p"), ("y", "a", "q"), ("z", "new", "new"), (None, "c", None), ("y", "a", "q")], "t string, f string, g string")
    told = {(r["class"], r["guess"]): r["n"] for r in level_attack.guesses(real, synth, "t", ["f", "g"]).collect()}
    # (a, q): x holds 2 of 3 of a, y 2 of 3 of q; equal support, so the first column is believed
    assert told == {("x", "x"): 1, ("y", "x"): 2, ("z", "x"): 1, ("nan", "nan"): 1}
    row = level_attack.level_attack(real, synth, "t", ["f", "g"]).first()
    assert (row["accuracy"], row["baseline_accuracy"], row["advantage"], row["n_classes"]) == (0.4, 0.4, 0.0, 4)
    assert level_attack.level_attack(real, synth, "t", []).first()["accuracy"] == 0.2
    assert level_attack.level_attack(real.limit(0), synth, "t", ["f"]).first()["accuracy"] is None


@pytest.mark.parametrize("n, m", [(1, 3), (2, 7), (3, 4), (4, 6), (5, 5)])
def test_exact_tail_equals_enumeration(n, m):
    g = math.gcd(n, m)
    reach = []
    for chosen in itertools.combinations(range(n + m), n):
        i = j = most = 0
        for step in range(n + m):
            i, j = (i + 1, j) if step in chosen else (i, j + 1)
            most = max(most, abs(i * m - j * n))
        reach.append(most)
    for width in range(0, n * m + 1, g):
        share = sum(r >= width for r in reach) / len(reach)
        assert kolmogorov_exact(width / (n * m), n, m) == pytest.approx(share, abs=1e-12)


def test_exact_tail_known_values():
    # two samples of eight, largest distance 5/8; of ten and eight, 1/2: tabled probabilities
    assert kolmogorov_exact(5 / 8, 8, 8) == pytest.approx(0.0870240870, abs=1e-9)
    assert kolmogorov_exact(1.0, 10, 8) == pytest.approx(2 / math.comb(18, 8), rel=1e-9)
    assert kolmogorov_exact(0.05, 4000, 3000) == pytest.approx(kolmogorov_tail(0.05, 4000, 3000), abs=1e-3)


def test_small_samples_use_the_exact_tail(spark):
    a = spark.createDataFrame([(float(i),) for i in range(8)], "v double")
    b = spark.createDataFrame([(float(i) + 4.5,) for i in range(8)], "v double")
    row = statistical.ks_test(a, b, ["v"]).first()
    assert row["statistic"] == 0.625 and row["p_value"] == round(kolmogorov_exact(0.625, 8, 8), 6)
