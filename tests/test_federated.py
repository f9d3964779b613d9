import pytest

from facsimile.operators import federated
from facsimile.operators import model as models
from facsimile.operators import sample as draws


@pytest.fixture(scope="module")
def sites(spark):
    make = lambda base, n: spark.createDataFrame(
        [(i, base + i % 9, 180.0 + base + (i * 3) % 11, "ab"[i % 2] if base < 50 else "bc"[i % 2]) for i in range(n)],
        "patient_id int, age int, cholesterol double, ward string")
    return {"north": make(40, 30), "south": make(60, 90)}


def test_combine_and_register(sites):
    both = federated.combine_sites(sites)
    assert "patient_id" not in both.columns and both.count() == 120
    listed = {r["site"]: r.asDict() for r in federated.site_register(sites, {"north": "North"}).collect()}
    assert listed["north"]["records"] == 30 and listed["north"]["name"] == "North" and listed["south"]["columns"] == ["age", "cholesterol", "ward"]


def test_weighted_merge(sites, rows):
    both = federated.combine_sites(sites)
    fitted = federated.site_spread(both, ["age", "cholesterol"])
    merged = rows(federated.merge_spread(fitted, federated.site_list(both)))
    local = {(r["site"], r["column"]): r for r in fitted.collect()}
    want = 0.25 * local["north", "age"]["mean"] + 0.75 * local["south", "age"]["mean"]
    assert merged["age"]["mean"] == pytest.approx(want) and merged["age"]["low"] == 40 and merged["age"]["high"] == 68


def test_merge_does_not_depend_on_the_order_of_sites(sites, rows):
    merge = lambda order: rows(federated.merge_spread(
        federated.site_spread(federated.combine_sites(order), ["age", "cholesterol"]), federated.site_list(federated.combine_sites(order))))
    forward, backward = merge(sites), merge(dict(reversed(list(sites.items()))))
    for column in forward:
        assert abs(forward[column]["mean"] - backward[column]["mean"]) < 1e-10


def test_site_without_a_column(spark, sites, rows):
    part = {"north": sites["north"].drop("cholesterol"), "south": sites["south"]}
    both = federated.combine_sites(part)
    fitted, listed = federated.site_spread(both, ["age", "cholesterol"]), federated.site_list(both)
    local = {(r["site"], r["column"]): r["mean"] for r in fitted.collect()}
    assert ("north", "cholesterol") not in local
    assert rows(federated.merge_spread(fitted, listed))["cholesterol"]["mean"] == pytest.approx(local["south", "cholesterol"])
    assert rows(federated.merge_spread(fitted, listed, strict=True))["cholesterol"]["mean"] == pytest.approx(0.75 * local["south", "cholesterol"])


def test_categorical_merge_normalises(sites):
    both = federated.combine_sites(sites)
    merged = federated.merge_categorical(models.fit_categorical(both, ["ward"], ["site"]), federated.site_list(both))
    found = {r["category"]: r["p"] for r in merged.collect()}
    assert found == pytest.approx({"a": 0.125, "b": 0.5, "c": 0.375})
    noisy = federated.noisy_categorical(merged, 2.0, 1).collect()
    assert sum(r["p"] for r in noisy) == pytest.approx(1) and all(r["p"] > 0 for r in noisy)


def test_fit_and_generate(spark, sites):
    both = federated.combine_sites(sites)
    fitted = federated.federated_fit(both, seed=4)
    first = draws.sample(fitted, spark, 50, 4)
    assert first.columns == ["age", "cholesterol", "ward"] and first.count() == 50
    again = draws.sample(federated.federated_fit(both.repartition(5), seed=4), spark, 50, 4)
    strip = lambda t: sorted((r["age"], round(r["cholesterol"], 6), r["ward"]) for r in t.collect())
    assert strip(first) == strip(again)
    assert all(40 <= r["age"] <= 68 for r in first.collect())


def test_one_site_is_refused(sites):
    with pytest.raises(ValueError):
        federated.federated_fit(federated.combine_sites({"north": sites["north"]}))


def test_history(sites):
    history = federated.training_history(federated.combine_sites(sites), 3).collect()
    assert [r["round"] for r in history] == [1, 2, 3] and history[0]["total_records"] == 120
    assert history[0]["dp_noise_sigma"] == 4.844805
