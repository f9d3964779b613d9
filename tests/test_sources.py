from concurrent.futures import ThreadPoolExecutor

import pytest

from facsimile.operators import report
from facsimile.operators.mechanisms import PrivacyParams
from facsimile.plans.generate import BudgetExhausted, generate
from facsimile.plans.quality import quality_report
from facsimile.session import cut_lineage
from facsimile.sources.demo import demo_table
from facsimile.sources.registry import Registry
from facsimile.sources.tables import RejectedTable, preview, read_csv, read_table, write_table

GOOD = "order_id,amount,city,at\nA1,10.5,Rome,2024-01-01 10:00:00\nA2,,Oslo,2024-01-02 11:00:00\nA3,7,Rome,2024-01-03 12:30:00\n"


def test_read_csv(spark, tmp_path):
    (tmp_path / "good.csv").write_text(GOOD)
    df = read_csv(spark, str(tmp_path / "good.csv"))
    assert dict(df.dtypes) == {"order_id": "string", "amount": "double", "city": "string", "at": "timestamp"}
    assert df.count() == 3 and df.where("amount is null").count() == 1
    assert [r["order_id"] for r in preview(df, ["order_id"], 2).collect()] == ["A1", "A2"]


@pytest.mark.parametrize("content", [b"", b"a,b,c\n", b"a,b\n1,2\n3,4,5\n", b"a,b\n1,caf\xff\xfe\n"])
def test_rejected_csv(spark, tmp_path, content):
    path = tmp_path / "bad.csv"
    path.write_bytes(content)
    with pytest.raises(RejectedTable):
        read_csv(spark, str(path))


def test_write_and_read_back(spark, tmp_path):
    df = demo_table(spark, 20)
    for source in ("parquet", "csv"):
        path = write_table(df, str(tmp_path / source), source)
        assert read_table(spark, path, source).count() == 20
        with pytest.raises(Exception):
            write_table(df, path, source)


@pytest.fixture()
def registry(spark, tmp_path):
    write_table(demo_table(spark, 200).withColumnRenamed("age", "age"), str(tmp_path / "data"))
    return Registry(spark, str(tmp_path / "registry"))


def test_register_and_load(registry, tmp_path):
    first = registry.register_dataset(str(tmp_path / "data"), "data")
    record = registry.dataset(first)
    assert record["num_rows"] == 200 and record["column_types"]["gender"] == "categorical" and record["num_cols"] == 12
    assert registry.load_dataset(first).count() == 200 and registry.load_dataset("nope") is None
    assert [r["id"] for r in registry.datasets().collect()] == [first]
    assert registry.budget(first)["remaining_epsilon"] == 10.0


def test_generate_records_runs_and_charges_the_budget(registry, tmp_path):
    dataset = registry.register_dataset(str(tmp_path / "data"), "data")
    done = generate(registry, dataset, 50, str(tmp_path / "out"), PrivacyParams(6.0), seed=1)
    assert done["num_rows_generated"] == 50 and done["target_column"] and len(done["preview"]) == 5
    assert done["privacy_budget"]["remaining_epsilon"] == 4.0 and done["dp_metadata"]["epsilon_requested"] == 6.0
    with pytest.raises(BudgetExhausted):
        generate(registry, dataset, 50, str(tmp_path / "out2"), PrivacyParams(6.0), seed=1)
    generate(registry, dataset, 30, str(tmp_path / "out3"), None, seed=1)
    assert registry.load_output(dataset).count() == 30
    assert registry.load_output(run_id=done["run_id"]).count() == 50
    assert registry.load_output(path=str(tmp_path / "out")).count() == 50
    assert registry.load_output("other") is None
    registry.record_run(dataset, None, "failed")
    assert registry.load_output(dataset).count() == 30
    assert registry.budgets().first()["num_queries"] == 1
    assert registry.table("ledger").count() == 2


def test_concurrent_spending_stops_at_the_budget(registry):
    with ThreadPoolExecutor(8) as pool:
        verdicts = list(pool.map(lambda _: registry.spend("d", 1.0, 1e-6, "op", 3.0), range(8)))
    assert sum(verdicts) == 3


def test_two_registries_share_one_budget(spark, tmp_path):
    from facsimile.sources.registry import Registry

    root = str(tmp_path / "shared")
    both = [Registry(spark, root), Registry(spark, root)]
    with ThreadPoolExecutor(6) as pool:
        verdicts = list(pool.map(lambda i: both[i % 2].spend("d", 1.0 if i % 3 else 0.5, 1e-6, f"op{i}", 3.0), range(12)))
    log = both[0].table("ledger").orderBy("seq").collect()
    assert [r["seq"] for r in log] == list(range(1, 13)) and {r["operation"] for r in log} == {f"op{i}" for i in range(12)}
    used = 0.0
    for r in log:  # the order of the log decides
        assert r["accepted"] == (used + r["epsilon"] <= 3.0)
        used += r["epsilon"] if r["accepted"] else 0.0
    assert used == 3.0 and sum(verdicts) == sum(r["accepted"] for r in log)
    assert both[1].budget("d", 3.0)["remaining_epsilon"] == 0.0 and not list((tmp_path / "shared" / ".pending").iterdir())


def test_another_process_claims_numbers_too(spark, tmp_path):
    import subprocess
    import sys

    from facsimile.sources.registry import Registry

    registry = Registry(spark, str(tmp_path / "p"))
    assert registry.spend("d", 2.0, 0.0, "first", 5.0)
    code = f"""
from pyspark.sql import SparkSession
from facsimile.sources.registry import Registry
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", {str(tmp_path / 'c')!r}).getOrCreate()
r = Registry(spark, {str(tmp_path / 'p')!r})
print("verdicts", [r.spend("d", 1.5, 0.0, "other", 5.0) for _ in range(3)])
spark.stop()
"""
    other = subprocess.Popen([sys.executable, "-c", code], stdout=subprocess.PIPE, text=True)
    mine = [registry.spend("d", 1.5, 0.0, "mine", 5.0) for _ in range(3)]
    said = other.communicate(timeout=300)[0]
    theirs = eval(said.split("verdicts ")[1].splitlines()[0])
    assert sum(mine) + sum(theirs) == 2
    assert registry.budget("d", 5.0)["total_epsilon_used"] == 5.0


def test_ledger_of_the_old_form_still_counts(spark, tmp_path):
    from facsimile.sources.registry import Registry

    old = [("d", 100, 4.0, 0.0, "a", True), ("d", 200, 3.0, 0.0, "b", True), ("d", 300, 9.0, 0.0, "c", False)]
    spark.createDataFrame(old, "dataset_id string, seq long, epsilon double, delta double, operation string, accepted boolean").coalesce(1).write.parquet(
        str(tmp_path / "o" / "ledger"))
    registry = Registry(spark, str(tmp_path / "o"))
    assert registry.spend("d", 4.0, 0.0, "too much") is False and registry.spend("d", 3.0, 0.0, "fits") is True
    assert registry.budget("d")["remaining_epsilon"] == 0.0


def test_reports(spark, registry):
    rows = report.metric_rows("structural", spark.createDataFrame([(97.5, "passed")], "score double, status string"))
    saved = registry.save_report("quality", "d", rows)
    assert {r["metric"]: r["value"] for r in registry.report(saved).collect()} == {"score": "97.5", "status": "passed"}
    assert registry.reports().first()["type"] == "quality"
    assert '"score":"97.5"' in report.as_json(rows).first()["report"]


def test_fidelity_score_renormalises(spark):
    pillars = spark.createDataFrame(
        [("structural", 80.0, True), ("statistical", 60.0, True), ("relationship", 100.0, False), ("ml_utility", None, False)],
        "pillar string, score double, applicable boolean")
    row = report.fidelity_score(pillars).first()
    assert row["data_fidelity_score"] == round((80 * 0.25 + 60 * 0.35) / 0.6, 2) and row["data_fidelity_grade"] == "C"


def test_quality_report(spark):
    wanted = ["age", "bmi", "gender", "smoking_status", "diabetes"]
    real, synth = (cut_lineage(demo_table(spark, 250, seed).select(*wanted)) for seed in (1, 2))
    found = quality_report(real, synth, settings={"RandomForest": {"numTrees": 5, "maxDepth": 4}})
    summary = found.summary.first()
    assert 60 < summary["data_fidelity_score"] <= 100 and summary["warnings_count"] == found.warnings.count()
    assert set(summary["applicable_pillars"]) == {"structural", "statistical", "relationship", "ml_utility"}
    assert {r["pillar"] for r in found.metrics().select("pillar").distinct().collect()} == {
        "structural", "statistical", "relationship", "ml_utility", "privacy"}


def test_a_damaged_ledger_is_no_fresh_budget(spark, tmp_path):
    from facsimile.sources.registry import Registry

    registry = Registry(spark, str(tmp_path / "r"))
    assert registry.spend("d", 1.0, 0.0, "first") is True
    for part in (tmp_path / "r" / "ledger").glob("part-*"):
        part.write_bytes(b"damaged")
    with pytest.raises(Exception):
        registry.spend("d", 9.0, 0.0, "second")
