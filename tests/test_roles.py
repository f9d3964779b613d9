import uuid

import pytest

from facsimile.functions.names import normalize_name
from facsimile.operators import roles
from facsimile.operators.columns import coerce
from facsimile.operators.facts import collect_facts


def ids_and_target(df, order_by=None):
    facts = collect_facts(df, order_by)
    return roles.identifier_columns(facts), roles.target_column(facts)


@pytest.fixture(scope="module")
def banking(spark):
    return spark.createDataFrame(
        [(100 + i, 1000.5 * i, 300 + i % 7, 5000 + 10 * (i % 5), "yes" if i % 3 else "no") for i in range(30)],
        "customer_id int, income double, credit_score int, loan_amount int, default_status string",
    )


def test_names():
    assert normalize_name("  Customer ID# ") == "customer_id"


def test_banking(banking):
    assert ids_and_target(banking) == (["customer_id"], "default_status")


def test_cybersecurity(spark):
    df = spark.createDataFrame(
        [(i, f"10.0.0.{i % 4}", 80 + i % 3, 100 + i, ["dos", "scan", "none"][i % 3]) for i in range(25)],
        "event_id int, source_ip string, destination_port int, packet_size int, attack_type string",
    )
    ids, target = ids_and_target(df)
    assert "event_id" in ids and target == "attack_type"


def test_repeated_identifiers_and_protections(spark):
    df = spark.createDataFrame(
        [(f"C{i % 5}", 10.5 + i, f"2024-01-{i + 1:02d}", str(uuid.UUID(int=i + 2**100)), i, 20.0 + i, i) for i in range(24)],
        "customer_id string, distance_km double, order_date string, reference string, sequence int, temperature_celsius double, quantity int",
    )
    ids, _ = ids_and_target(df)
    assert ids == ["customer_id", "reference", "sequence"]


def test_small_unique_integers_are_no_identifiers(spark):
    df = spark.createDataFrame([(i,) for i in range(19)], "n int")
    assert ids_and_target(df)[0] == []


def test_unsupervised_floats_have_no_target(spark):
    df = spark.createDataFrame([(i * 1.5, i * 2.5) for i in range(30)], "x double, y double")
    assert ids_and_target(df)[1] is None


def test_flag_loses_to_outcome(spark):
    df = spark.createDataFrame([(i % 2, (i // 2) % 2) for i in range(24)], "is_member int, returned int")
    assert ids_and_target(df)[1] == "returned"


def test_sensitive(spark):
    df = spark.createDataFrame([(i, f"n{i}", "MF"[i % 2], "xyz"[i % 3]) for i in range(24)], "user_id int, full_name string, gender string, grp string")
    assert roles.sensitive_columns(collect_facts(df)) == ["full_name", "gender", "grp"]


def test_keep_overrides_the_integer_rule(spark):
    df = spark.createDataFrame([(30_000 + i, "ab"[i % 2]) for i in range(30)], "salary int, dept string")
    assert roles.drop_identifiers(df).columns == ["dept"]
    assert roles.drop_identifiers(df, keep=("salary",)).columns == ["salary", "dept"]


def test_coarse_types(spark, rows):
    df = spark.createDataFrame([(i % 2, i % 3, float(i), "2024-01-01", "a", True) for i in range(100)], "b int, few int, x double, d string, s string, t boolean")
    found = rows(roles.role_table(df))
    assert {c: r["coarse_type"] for c, r in found.items()} == {
        "b": "boolean", "few": "categorical", "x": "numerical", "d": "datetime", "s": "categorical", "t": "boolean"}


def test_coerce(spark):
    df = spark.createDataFrame([("1.5", "nan", True), ("bad", "x", False)], "n string, c string, b boolean")
    got = coerce(df, {"n": "numerical", "c": "categorical", "b": "boolean", "absent": "numerical"}).collect()
    assert [tuple(r) for r in got] == [(1.5, None, 1), (None, "x", 0)]


def test_sample_order_does_not_depend_on_partitions(spark):
    df = spark.createDataFrame([(f"v{i}", f"2024-01-{1 + i % 28:02d}") for i in range(200)], "a string, d string")
    first = collect_facts(df.repartition(1))
    assert first == collect_facts(df.repartition(7))


def test_sparse_columns_get_their_own_sample(spark):
    from facsimile.operators.facts import first_values

    df = spark.range(3000).selectExpr("id", "case when id >= 2500 then concat('late', id) end as s", "concat('v', id) as t")
    got = first_values(df, ["s", "t"], 2, ["id"]).collect()
    assert sorted((r["column"], r["place"], r["value"]) for r in got) == [
        ("s", 1, "late2500"), ("s", 2, "late2501"), ("t", 1, "v0"), ("t", 2, "v1")]


def test_roles_are_decided_on_the_whole_column(spark):
    # the first 200 rows read as dates, hex or neither, the other 300 the other way round
    df = spark.createDataFrame(
        [(i, f"2024-01-{1 + i % 28:02d}" if i < 200 else f"word{i}", f"{i:032x}" if i < 200 else f"word{i}",
          f"word{i}" if i < 30 else f"{i:032x}", f"2024-02-{1 + i % 28:02d}" if i % 50 else None) for i in range(500)],
        "n int, turned string, mixed string, late string, dated string")
    facts = {f.column: f for f in collect_facts(df, ["n"])}
    assert facts["turned"].date_share == pytest.approx(0.4) and not facts["turned"].is_datetime_like and not facts["turned"].coarse_date_parses
    assert facts["mixed"].hex_share == pytest.approx(0.4) and facts["late"].hex_share == pytest.approx(0.94)
    assert facts["dated"].is_datetime_like and facts["dated"].date_share == 1.0 and facts["dated"].coarse_date_parses
    assert roles.drop_identifiers(df, ["n"], keep=("n",)).columns == ["n", "turned", "mixed", "dated"]
    # the published samples, on request
    assert roles.drop_identifiers(df, ["n"], keep=("n",), sampled=True).columns == ["n", "turned", "late", "dated"]
    found = {r["column"]: r["semantic_type"] for r in roles.role_table(df, ["n"], sampled=True).collect()}
    assert found["turned"] == "datetime"


def test_text_pool_size_of_a_fit(spark):
    from facsimile.operators.model import fit

    df = spark.createDataFrame([(i, f"a sentence long enough to be text, number {i}, " + "and so on " * 5) for i in range(300)], "n int, t string")
    assert len(fit(df, ["n"], known_kinds={"n": "numeric", "t": "text"}, pool_size=150).pools["t"].collect()) == 150
    assert fit(df, ["n"], known_kinds={"n": "numeric", "t": "text"}).pools["t"].count() == 300
