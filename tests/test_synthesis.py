import datetime

import pytest

from facsimile.operators import model as models
from facsimile.operators import sample as draws
from facsimile.operators.mechanisms import PrivacyParams
from facsimile.plans.generate import model_tables, synthesize
from facsimile.sources.demo import COLUMNS, demo_table


@pytest.fixture(scope="module")
def health(spark):
    return spark.createDataFrame(
        [
            (i, 20 + i % 50, 100.0 + (i * 7) % 40, ["flu", "cold", "none"][i % 3], i % 2, 5, f"2024-01-{1 + i % 28:02d}",
             None if i % 5 == 0 else i % 2 == 0, datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=i),
             f"a fairly long free remark with number {i}")
            for i in range(80)
        ],
        "patient_id int, age int, blood_pressure double, condition string, diagnosis int, version int, visit_date string,"
        " insured boolean, seen timestamp, notes string",
    )


@pytest.fixture(scope="module")
def made(health):
    return synthesize(health, 300, seed=11, order_by=["patient_id"])


def test_columns_and_domains(health, made):
    table = made.table
    assert made.identifiers == ["patient_id"] and made.target == "diagnosis"
    assert table.columns == health.columns[1:] and table.count() == 300
    assert dict(table.dtypes) == {c: t for c, t in health.dtypes if c != "patient_id"}
    rows = table.collect()
    assert {r["condition"] for r in rows} == {"flu", "cold", "none"}
    assert {r["diagnosis"] for r in rows} == {0, 1} and {r["version"] for r in rows} == {5}
    assert all(20 <= r["age"] <= 69 and 100 <= r["blood_pressure"] <= 139 for r in rows)
    assert all(len(r["visit_date"]) == 10 for r in rows)
    assert 20 < sum(r["insured"] is None for r in rows) < 110
    pool = {r["notes"] for r in health.collect()}
    assert all(r["notes"] in pool for r in rows)


def test_means_and_correlation_survive(spark):
    df = spark.range(2000).selectExpr("cast(id % 97 as double) x", "cast(id % 97 as double) * 3 + id % 11 as y")
    fitted = models.fit(df, known_kinds={"x": "numeric", "y": "numeric"})
    drawn = draws.sample(fitted, spark, 4000, 3)
    row = drawn.selectExpr("avg(x) ax", "corr(x, y) r").first()
    assert row["ax"] == pytest.approx(48, abs=1.5) and row["r"] > 0.95


def test_same_seed_same_table_whatever_the_partitions(spark, health):
    fitted = models.fit(health.drop("patient_id"), ["seen"])
    first = sorted(map(str, draws.sample(fitted, spark, 120, 5).collect()))
    again = sorted(map(str, draws.sample(fitted, spark, 120, 5).repartition(3).collect()))
    other = sorted(map(str, draws.sample(fitted, spark, 120, 6).collect()))
    assert first == again and first != other


def test_large_domain_draw_is_whole_and_fair(spark):
    skewed = spark.range(6000).selectExpr("case when id % 3 = 0 then 'hot' else concat('v', id % 900) end as c")
    fitted = models.fit(skewed, known_kinds={"c": "categorical"})
    drawn = draws.sample(fitted, spark, 3000, 9, keep_row_id=True)
    assert drawn.count() == 3000 == drawn.select("row_id").distinct().count()
    hot = drawn.where("c = 'hot'").count()
    assert 880 < hot < 1120
    assert drawn.join(skewed, "c", "left_anti").count() == 0


def test_all_null_and_constant_columns(spark):
    df = spark.createDataFrame([(None, 3, "k")] * 5, "z string, n int, s string")
    row = draws.sample(models.fit(df), spark, 4, 1).distinct().collect()
    assert [tuple(r) for r in row] == [(None, 3, "k")]


def test_text_pool_keeps_first_distinct(spark):
    df = spark.createDataFrame([(i, f"t{i // 3}") for i in range(2000)], "k int, t string")
    pool = models.text_pool(df, "t", ["k"]).orderBy("place").collect()
    assert [r["value"] for r in pool] == [f"t{i}" for i in range(100)]


def test_text_pool_of_few_distinct_values(spark):
    df = spark.createDataFrame([(i, f"t{i % 4}") for i in range(3000)], "k int, t string")
    assert [r["value"] for r in models.text_pool(df, "t", ["k"]).orderBy("place").collect()] == ["t0", "t1", "t2", "t3"]


def test_whole_text_pool_is_numbered_across_ranges(spark):
    df = spark.createDataFrame([(i, f"t{(i * 7) % 900}") for i in range(3000)] + [(5000, None)], "k int, t string").repartition(7)
    pool = {r["place"]: r["value"] for r in models.text_pool(df, "t", ["k"], None).collect()}
    assert pool == {i + 1: f"t{(i * 7) % 900}" for i in range(900)}
    assert models.text_pool(df.limit(0), "t", ["k"], None).count() == 0


def test_texts_are_drawn_from_the_whole_pool(spark):
    df = spark.createDataFrame([(f"sentence {i}",) for i in range(400)] + [("often",)] * 400, "t string")
    drawn = draws.sample(models.fit(df, known_kinds={"t": "text"}), spark, 4000, 3, keep_row_id=True)
    assert drawn.count() == 4000 == drawn.select("row_id").distinct().count()
    seen = {r["t"]: r["count"] for r in drawn.groupBy("t").count().collect()}
    assert len(seen) > 395 and seen["often"] < 40 and drawn.join(df, "t", "left_anti").count() == 0
    assert {r["t"] for r in draws.sample(models.fit(df.limit(0), known_kinds={"t": "text"}), spark, 3, 3).collect()} == {""}


def test_not_positive_definite_falls_back_to_independent():
    bad = {("a", "b"): 0.9, ("a", "c"): -0.9, ("b", "c"): 0.9}
    assert (draws.correlation_factor(["a", "b", "c"], bad) == [[1, 0, 0], [0, 1, 0], [0, 0, 1]]).all()


def test_target_is_preserved_under_protection(spark):
    df = spark.createDataFrame([(i % 2, float(i), i % 2) for i in range(40)], "binary_feature int, numeric_feature double, target int")
    plain = synthesize(df, 50, seed=4).table
    noisy = synthesize(df, 50, PrivacyParams(0.5), seed=4)
    column = lambda t, c: [r[c] for r in t.collect()]
    assert sorted(column(plain, "target")) == sorted(column(noisy.table, "target"))
    assert sorted(column(plain, "numeric_feature")) != sorted(column(noisy.table, "numeric_feature"))
    assert {r["column"]: r["mechanism"] for r in noisy.privacy.collect()}["target"] == "preserved"


def test_model_tables(made):
    tables = model_tables(made)
    assert tables["params"].count() == len(made.model.columns)
    assert tables["probs"].groupBy("column").sum("p").first()[1] == pytest.approx(1)


def test_demo_table(spark):
    demo = demo_table(spark)
    assert demo.columns == COLUMNS and demo.count() == 1000
    row = demo.selectExpr("avg(age) a", "min(bmi) b", "max(glucose) g", "avg(diabetes) d", "max(hypertension) h").first()
    assert 53 < row["a"] < 57 and row["b"] >= 15 and row["g"] <= 300 and 0.1 < row["d"] < 0.9 and row["h"] == 1
    assert demo.exceptAll(demo_table(spark).repartition(3)).count() == 0


def test_categorical_draw_does_not_depend_on_the_join(spark, monkeypatch):
    from facsimile.operators import model, sample

    levels = [(f"level {chr(97 + k % 26)}{k}", ) for k in range(12) for _ in range(k * k + 1)]
    fitted = model.fit(spark.createDataFrame(levels, "c string"), known_kinds={"c": "categorical"})
    inline = sample.sample(fitted, spark, 500, 7, keep_row_id=True).collect()
    monkeypatch.setattr(sample, "INLINE_DOMAIN", 0)
    joined = sample.sample(fitted, spark, 500, 7, keep_row_id=True).collect()
    assert sorted(inline) == sorted(joined) and len({r["c"] for r in joined}) > 5


def test_clock_time_of_string_dates(spark):
    from facsimile.operators import model

    df = spark.createDataFrame([(1, "2024-05-01 10:00:00"), (2, "2024-04-01"), (3, None)], "k int, d string")
    for order, want in ((["k"], True), (None, True)):
        fitted = model.fit(df, order, known_kinds={"k": "numeric", "d": "datetime"})
        assert {p["column"]: p.get("with_time") for p in fitted.params}["d"] is want
    turned = df.withColumn("k", -df["k"])
    assert {p["column"]: p.get("with_time") for p in model.fit(turned, ["k"], known_kinds={"k": "numeric", "d": "datetime"}).params}["d"] is False
