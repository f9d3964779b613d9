import math
import random

import pytest
from pyspark.sql import functions as F

from facsimile.functions import masking, rng
from facsimile.operators import accounting, mechanisms


def test_gaussian_sigma_and_laplace_scale():
    assert mechanisms.gaussian_sigma(1, 1, 1e-5) == pytest.approx(4.844805262605389)
    assert mechanisms.laplace_scale(2, 0.5) == 4
    for bad in (lambda: mechanisms.laplace_scale(1, 0), lambda: mechanisms.gaussian_sigma(1, 1, 0)):
        with pytest.raises(ValueError):
            bad()


@pytest.mark.parametrize("epsilon, columns, want", [
    (1, 1, 1.031980), (1, 5, 2.324741), (1, 10, 3.348852), (0.5, 1, 0.523574), (2, 3, 3.689681)])
def test_composed_epsilon(epsilon, columns, want):
    steps = [(3.0, mechanisms.gaussian_sigma(3.0, epsilon, 1e-5))] * columns
    assert accounting.rdp_epsilon(steps, 1e-5) == pytest.approx(want, abs=1e-6)
    assert accounting.rdp_epsilon([], 1e-5) == 0.0


def test_composed_epsilon_table(spark):
    sigma = mechanisms.gaussian_sigma(1.0, 1, 1e-5)
    steps = spark.createDataFrame([("a", 1.0, sigma)] * 5 + [("b", 1.0, sigma)], "d string, sensitivity double, sigma double")
    found = {r["d"]: (round(r["epsilon"], 6), r["best_alpha"]) for r in accounting.rdp_epsilon_table(steps, 1e-5, ["d"]).collect()}
    assert found == {"a": (2.324741, 12.0), "b": (1.03198, 20.0)}


def test_draws_do_not_depend_on_partitions(spark):
    draw = lambda n: sorted(map(tuple, spark.range(0, 500, 1, n).select(
        "id", rng.uniform(7, "c", "id"), rng.normal(7, "n", "id"), rng.laplace(2.0, 7, "l", "id")).collect()))
    assert draw(1) == draw(3) == draw(8)


def test_draw_distributions(spark):
    row = spark.range(20_000).select(rng.uniform(1, "u", "id").alias("u"), rng.normal(1, "n", "id").alias("n"), rng.laplace(2.0, 1, "l", "id").alias("l")).agg(
        F.avg("u"), F.min("u"), F.max("u"), F.avg("n"), F.stddev("n"), F.avg("l"), F.avg(F.abs("l"))).first()
    assert row[0] == pytest.approx(0.5, abs=0.01) and 0 < row[1] and row[2] < 1
    assert row[3] == pytest.approx(0, abs=0.03) and row[4] == pytest.approx(1, abs=0.02)
    assert row[5] == pytest.approx(0, abs=0.07) and row[6] == pytest.approx(2, abs=0.06)


def answers(spark, joined):
    domain = [f"v{i}" for i in range(6)]
    df = spark.range(12_000).select("id", F.when(F.col("id") % 3 == 0, "v0").when(F.col("id") % 97 != 0, F.concat(F.lit("v"), (F.floor(F.col("id") / 3) % 6).cast("string"))).alias("c"))
    if joined:
        table = mechanisms.numbered_domain(df, "c")
        return df, mechanisms.randomized_response_joined(df, "c", table, 6, 1.0, 5, ["id"]).withColumnRenamed("c", "answer"), domain
    return df, df.select("id", mechanisms.randomized_response(F.col("c"), "c", domain, 1.0, 5, ["id"]).alias("answer")), domain


@pytest.mark.parametrize("joined", [False, True])
def test_randomized_response(spark, joined):
    df, got, domain = answers(spark, joined)
    both = df.join(got, "id")
    assert both.count() == 12_000
    assert both.where("c IS NULL AND answer IS NOT NULL OR c IS NOT NULL AND answer IS NULL").count() == 0
    kept = both.where("c IS NOT NULL").agg(F.avg((F.col("c") == F.col("answer")).cast("int"))).first()[0]
    assert kept == pytest.approx(math.e / (math.e + 5), abs=0.015)
    others = {r["answer"]: r["count"] for r in both.where("c = 'v0' AND answer <> 'v0'").groupBy("answer").count().collect()}
    assert set(others) == set(domain) - {"v0"} and max(others.values()) < 1.2 * min(others.values())


def test_large_epsilon_does_not_overflow():
    assert mechanisms.keep_probability(5000.0, 10) == 1.0


def test_protect(spark, rows):
    real = spark.createDataFrame([(i, i % 2, float(i), "abc"[i % 3], i % 2 == 0, None if i == 3 else 5.0) for i in range(50)],
                                 "id int, flag int, x double, c string, b boolean, y double")
    params = mechanisms.PrivacyParams(2.0, clip_bound=1000.0)
    got, meta = mechanisms.protect(real, real, params, ["id"], "flag", 9)
    assert got.schema.simpleString() == real.schema.simpleString()
    again, _ = mechanisms.protect(real.repartition(3), real, params, ["id"], "flag", 9)
    assert got.exceptAll(again).count() == 0
    found = {r["id"]: r for r in got.collect()}
    assert all(found[i]["flag"] == i % 2 and 0 <= found[i]["x"] <= 49 for i in range(50))
    assert found[3]["y"] is None and found[4]["y"] == 5.0
    info = rows(meta)
    assert info["c"]["domain_size"] == 3 and info["x"]["mechanism"] == "gaussian" and info["flag"]["mechanism"] == "preserved"
    summary = mechanisms.privacy_summary(meta, params).first()
    assert summary["rdp_steps"] == 2 and summary["epsilon_sequential"] == 8.0
    laplace = mechanisms.PrivacyParams(2.0, mechanism="laplace", clip_bound=1000.0)
    _, meta = mechanisms.protect(real, real, laplace, ["id"], "flag", 9)
    assert mechanisms.privacy_summary(meta, laplace).first()["epsilon_actual"] == 2.0


def fold(requests, budget):
    used, out = 0, []
    for cost in requests:
        ok = used + cost <= budget
        used += cost if ok else 0
        out.append(ok)
    return out


def ledger(spark, histories):
    rows = [(d, i, c / 1e6, 1e-6, "op") for d, costs in histories.items() for i, c in enumerate(costs)]
    return spark.createDataFrame(rows, "dataset_id string, seq long, epsilon double, delta double, operation string")


@pytest.mark.parametrize("limit", [10_000, 0])
def test_admission_matches_the_sequential_rule(spark, limit):
    rand = random.Random(3)
    histories = {
        "ones": [1_000_000] * 20,
        "falling": [max(1, 3_000_000 - 150_000 * i) for i in range(40)],
        "mixed": [rand.choice([10, 5_000, 900_000, 2_000_000, 5_000_001]) for _ in range(60)],
        "tiny": [rand.randint(0, 200_000) for _ in range(120)],
        "big first": [5_000_000, 1, 0],
    }
    got = accounting.admit(ledger(spark, histories), 5.0, fold_limit=limit).collect()
    for name, costs in histories.items():
        verdicts = [r["accepted"] for r in sorted((r for r in got if r["dataset_id"] == name), key=lambda r: r["seq"])]
        assert verdicts == fold(costs, 5_000_000), name
    assert sum(r["accepted"] for r in got if r["dataset_id"] == "ones") == 5


@pytest.mark.parametrize("rows_per_range", [7, 1 << 16])
def test_long_histories_are_folded_by_ranges_in_few_rounds(spark, monkeypatch, rows_per_range):
    monkeypatch.setattr(accounting, "RANGE_ROWS", rows_per_range, raising=False)
    rand = random.Random(5)
    histories = {
        "spread": [int(rand.expovariate(1 / 500_000)) for _ in range(400)],
        "halving": [5_000_000 >> i for i in range(1, 30)],
        "small, then one that fits": [20_000] * 100 + [3_000_000, 2_000_001, 0, 1],
        "never": [5_000_001] * 30,
    }
    spark.sparkContext.setJobGroup(f"ledger {rows_per_range}", "")
    try:
        got = accounting.admit(ledger(spark, histories), 5.0, fold_limit=10).collect()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    for name, costs in histories.items():
        verdicts = [r["accepted"] for r in sorted((r for r in got if r["dataset_id"] == name), key=lambda r: r["seq"])]
        assert verdicts == fold(costs, 5_000_000), name
    # one range holds each history: a round that spends it and at most one that ends it
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup(f"ledger {rows_per_range}")
    assert rows_per_range < 400 or len(jobs) <= 50


def test_budget_state_and_history(spark, rows):
    admitted = accounting.admit(ledger(spark, {"a": [1_000_000] * 20, "b": [2_600_000]}), 5.0)
    known = spark.createDataFrame([("a",), ("b",), ("fresh",)], "dataset_id string")
    state = rows(accounting.budget_state(admitted, 5.0, known), "dataset_id")
    assert (state["a"]["remaining_epsilon"], state["a"]["warning_level"], state["a"]["num_queries"]) == (0.0, "critical", 5)
    assert state["b"]["warning_level"] == "medium" and state["b"]["utilization_pct"] == 52.0
    assert state["fresh"]["remaining_epsilon"] == 5.0 and state["fresh"]["warning_level"] is None
    history = accounting.budget_history(admitted, 2).where("dataset_id = 'a'").orderBy("seq").collect()
    assert [r["cumulative_epsilon"] for r in history] == [4.0, 5.0]


def test_masking(spark):
    df = spark.createDataFrame([("abcdef", "xyz", 5)], "secret_name string, short string, n int")
    row = df.select(masking.mask(F.col("secret_name")), masking.mask(F.col("short"))).first()
    assert tuple(row) == ("***def", "***")
    assert masking.redact(df).first()["secret_name"] == "[REDACTED]"
    assert masking.redact(df).first()["short"] == "xyz"


def test_fingerprint_ignores_order_but_not_content(spark):
    df = spark.range(100).selectExpr("id", "concat('v', id) as s")
    first = masking.table_fingerprint(df).first()["fingerprint"]
    assert first == masking.table_fingerprint(df.repartition(5).orderBy(F.desc("id"))).first()["fingerprint"]
    assert first != masking.table_fingerprint(df.where("id <> 5")).first()["fingerprint"]


def test_response_does_not_depend_on_the_join(spark, monkeypatch):
    rows = spark.createDataFrame([(k, f"v{k % 17}") for k in range(300)], "k long, c string")
    params = mechanisms.PrivacyParams(1.0, 1e-5, "laplace", clip_bound=1.0)
    inline = mechanisms.protect(rows, rows, params, ["k"], seed=3)[0].collect()
    monkeypatch.setattr(mechanisms, "INLINE_DOMAIN", 0)
    joined = mechanisms.protect(rows, rows, params, ["k"], seed=3)[0].collect()
    assert sorted(inline) == sorted(joined)
