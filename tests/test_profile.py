import datetime

import pytest

from facsimile.operators import profile


def test_quartiles(spark, rows):
    df = spark.createDataFrame([(float(v),) for v in (10, 20, 30, 40, 50)], "v double")
    stats = rows(profile.numeric_stats(df, ["v"]))["v"]
    assert (stats["mean"], stats["median"], stats["q25"], stats["q75"]) == (30, 30, 20, 40)
    assert (stats["min"], stats["max"], stats["std"]) == (10, 50, 15.8114)


def test_quantiles_interpolate_and_skip_missing(spark, rows):
    df = spark.createDataFrame([(None,), (3.0,), (9.0,), (1.0,), (float("nan"),)], "v double")
    stats = rows(profile.numeric_stats(df, ["v"]))["v"]
    assert (stats["q25"], stats["median"], stats["q75"]) == (2.0, 3.0, 6.0)


def test_top_category(spark):
    df = spark.createDataFrame([(c,) for c in ("NY", "SF", "NY", "LA", "NY", "SF")], "city string")
    first = profile.top_categories(df, ["city"]).orderBy("place").first()
    assert (first["value"], first["count"], first["percentage"], first["num_categories"]) == ("NY", 3, 50.0, 3)


def test_category_ties_go_to_the_smaller_value(spark):
    df = spark.createDataFrame([(10, "b"), (9, "a"), (10, "a"), (9, "b")], "n int, s string")
    tops = {r["column"]: r["value"] for r in profile.top_categories(df, ["n", "s"], 1).collect()}
    assert tops == {"n": "9", "s": "a"}


def test_missing(spark):
    df = spark.createDataFrame([(1.0, "x"), (None, "y"), (3.0, None), (None, "w")], "a double, b string")
    row = profile.table_profile(df).first()
    assert (row["missing_count"], row["missing_percentage"]) == (3, 37.5)


def test_duplicates(spark):
    df = spark.createDataFrame([(1, "x"), (2, "y"), (1, "x"), (1, "x")], "a int, b string")
    row = profile.table_profile(df).first()
    assert (row["duplicate_count"], row["duplicate_percentage"]) == (2, 50.0)


def test_rows_that_differ_by_the_place_of_a_null_are_not_duplicates(spark):
    df = spark.createDataFrame([(1, None), (None, 1), (None, None), (None, None)], "a int, b int")
    assert profile.table_profile(df).first()["duplicate_count"] == 1


def test_empty_table(spark):
    row = profile.table_profile(spark.createDataFrame([], "a int, b string")).first()
    assert (row["row_count"], row["missing_percentage"], row["duplicate_count"]) == (0, 0.0, 0)


def test_full_profile(spark, rows):
    df = spark.createDataFrame(
        [(i, f"name {i}", f"u{i}@x.org", 1000.0 + i, i % 2, 42, "FIXED") for i in range(30)],
        "user_id int, full_name string, email_address string, salary double, churn int, const_num int, const_str string",
    )
    found = rows(profile.column_profile(df, ["user_id"]))
    assert found["user_id"]["identifier"] and found["user_id"]["semantic_type"] == "identifier"
    assert found["churn"]["target_candidate"] and found["churn"]["semantic_type"] == "boolean"
    assert {c for c, r in found.items() if r["sensitive_candidate"]} == {"full_name", "email_address", "salary", "churn"}
    assert found["const_num"]["semantic_type"] == found["const_str"]["semantic_type"] == "constant"
    assert found["salary"]["numeric_stats"]["median"] == 1014.5
    assert found["const_str"]["top_categories"][0]["count"] == 30
    assert found["user_id"]["sample_values"] == ["0", "1", "2", "3", "4"]


@pytest.mark.parametrize("values", [
    ["2023-01-01", "2023-02-15", "2023-12-31"], ["01/02/2023", "05/06/2023", "11/12/2023"],
    ["2023-01-01T10:00:00", "2023-01-02T11:30:00", "2023-01-03T00:00:00"], ["01 Jan 2020", "15 Feb 2021", "28 Mar 2022"],
])
def test_date_strings(spark, rows, values):
    df = spark.createDataFrame([(v,) for v in values], "d string")
    assert rows(profile.column_profile(df))["d"]["semantic_type"] == "datetime"


def test_native_and_broken_dates(spark, rows):
    moment = datetime.datetime(2024, 1, 1)
    df = spark.createDataFrame([(moment, "2023-01-01"), (moment, "2023-99-99"), (moment, "2023-13-01")], "t timestamp, broken string")
    found = rows(profile.column_profile(df))
    assert found["t"]["semantic_type"] == "datetime" and found["broken"]["semantic_type"] == "categorical"


def test_text(spark, rows):
    df = spark.createDataFrame([(f"This is a rather long remark number {i} on a product", "short") for i in range(20)], "review string, tag string")
    found = rows(profile.column_profile(df))
    assert found["review"]["semantic_type"] == "text" and found["tag"]["semantic_type"] == "constant"


def test_ingest_stats(spark, rows):
    df = spark.createDataFrame([(1.0, "a"), (2.0, "b"), (4.5, "b"), (None, None)], "x double, c string")
    found = rows(profile.ingest_stats(df, {"x": "numerical", "c": "categorical"}))
    assert (found["x"]["mean"], found["x"]["std"], found["x"]["missing"]) == (2.5, 1.8, 1)
    assert (found["c"]["unique"], found["c"]["top"], found["c"]["missing"]) == (2, "b", 1)
