import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from facsimile.operators import audit, classifiers, knn, scoring, utility
from facsimile.operators.encode import dictionary, encode_table
from facsimile.operators.split import bounded_sample, split, split_copies
from facsimile.session import cut_lineage
from facsimile.sources.demo import demo_table

FOREST = {"numTrees": 5, "maxDepth": 4}


@pytest.fixture(scope="module")
def people(spark):
    return cut_lineage(demo_table(spark, 250, 1)), cut_lineage(demo_table(spark, 250, 2))


def test_collisions(spark):
    real = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "d"), (5, "e")], "n int, c string")
    synth = spark.createDataFrame([(1, "a"), (2, "b"), (99, "z"), (7, "q"), (8, "r")], "n int, c string")
    row = audit.exact_collisions(real, synth).first()
    assert (row["exact_count"], row["exact_rate"]) == (2, 0.4)


def test_collisions_with_repeats_and_missing_cells(spark):
    real = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (3, None), (4, "d")], "n int, c string")
    synth = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (3, None)], "n int, c string")
    row = audit.exact_collisions(real, synth).first()
    assert (row["exact_count"], row["exact_rate"]) == (3, 0.75)


def test_collisions_between_integer_and_double_columns(spark):
    real = spark.createDataFrame([(1, 10_000_000.0)], "a int, b double")
    synth = spark.createDataFrame([(1.0, 10_000_000)], "a double, b long")
    assert audit.exact_collisions(real, synth).first()["exact_count"] == 1


def brute(queries, points, k):
    d = np.sqrt(((queries[:, None] - points[None]) ** 2).sum(2))
    return np.sort(d, axis=1)[:, :k]


@pytest.mark.parametrize("kind, size, k, block", [("clusters", 700, 5, 4096), ("clusters", 700, 3, 50), ("copies", 400, 4, 60), ("line", 300, 2, 64), ("few", 3, 5, 4096)])
def test_nearest_distances_against_brute_force(spark, monkeypatch, kind, size, k, block):
    monkeypatch.setattr(knn, "BLOCK_ROWS", block)
    rng = np.random.default_rng(size + k)
    points = rng.normal(size=(size, 3)) + rng.integers(0, 6, (size, 1)) * 8.0
    if kind == "copies":
        points[: size // 3] = points[0]
    if kind == "line":
        points[:, 1:] = 0
    queries = np.vstack([points[: size // 2], rng.normal(size=(60, 3)) * 20])
    frame = lambda m: spark.createDataFrame([(r.tolist(),) for r in m], "features array<double>")
    group = lambda m: knn.grouped_vectors(frame(m), F.col("features"))
    got = knn.nearest_distances(group(queries), group(points), k).collect()
    want = {tuple(q): d for q, d in zip(queries.tolist(), brute(queries, points, k))}
    assert sum(r["n"] for r in got) == len(queries) and len(got) == len(want)
    for r in got:
        assert np.allclose(r["distances"], want[tuple(r["features"])], atol=1e-9)


def test_reidentification_flags_copies(spark):
    real = spark.range(400).selectExpr("cast(id as double) * 10 as x", "cast(id % 20 as double) as y")
    copied, far = audit.distance_counts(real, real), audit.distance_counts(real, real.selectExpr("x + 5000 as x", "y"))
    assert audit.reidentification(copied).first()["risk_level"] == "critical"
    assert audit.reidentification(far).first()["records_at_risk"] == 0
    bins = audit.distance_histogram(far).collect()
    assert len(bins) == 30 and sum(b["synth_to_real"] + b["real_to_real"] for b in bins) <= 800


def test_membership_features_keep_every_record(spark):
    real = spark.range(90).selectExpr("cast(id % 30 as double) as x", "cast(id % 3 as string) as c")
    found = audit.membership_features(real, real.limit(20), real, 5)
    assert {r["label"]: r["count"] for r in found.groupBy("label").count().collect()} == {1.0: 90, 0.0: 20}


def test_attacks_and_pillar(people):
    real, synth = people
    found = audit.all_attacks(real, synth)
    row = found.first()
    assert 0 <= row["overall_risk_score"] <= 100 and 0 <= row["mia_auc"] <= 1
    pillar = audit.privacy_pillar(real, synth, found).first()
    assert pillar["exact_count"] == 0 and pillar["privacy_protection_score"] == round(100 - row["overall_risk_score"], 2)
    leaked = audit.privacy_pillar(real, real, found).first()
    assert leaked["exact_count"] == 250 and leaked["raw_privacy_risk_score"] == pytest.approx(min(100, row["overall_risk_score"] + 50))
    assert any("EXACT MATCH" in r["message"] for r in audit.privacy_warnings(audit.privacy_pillar(real, real, found)).collect())


def test_bounded_sample_is_exact_and_stable(spark):
    df = spark.range(7000)
    got = {r["id"] for r in bounded_sample(df, ["id"]).collect()}
    assert len(got) == 5000 and got == {r["id"] for r in bounded_sample(df.repartition(3), ["id"]).collect()}
    assert bounded_sample(spark.range(10), ["id"]).count() == 10


def test_split_sizes_and_stability(spark):
    df = spark.range(2003).selectExpr("id", "case when id % 3 = 0 then 'hot' when id = 1 then null else concat('c', id % 5) end as c")
    got = split(df, ["id"], 0.3, "c")
    sizes = {r["c"]: (r["n"], r["t"]) for r in got.groupBy("c").agg(F.count("*").alias("n"), F.count_if("is_test").alias("t")).collect()}
    assert all(t == -(-3 * n // 10) for n, t in sizes.values()) and sizes["hot"][0] == 668
    assert got.exceptAll(split(df.repartition(1), ["id"], 0.3, "c")).count() == 0
    assert split(df, ["id"], 0.2).where("is_test").count() == 401


def test_encoding_shares_one_dictionary(spark):
    df = spark.createDataFrame([("b", 1.0, True), ("a", None, False), (None, 5.0, None)], "c string, x double, f boolean")
    got = [tuple(r) for r in encode_table(df, ["c", "x", "f"], []).collect()]
    assert got == [(1.0, 1.0, 1.0), (0.0, 0.0, 0.0), (2.0, 5.0, 0.0)]
    median = [r["x"] for r in encode_table(df, ["x"], [], "median").collect()]
    assert median == [1.0, 3.0, 5.0]


def test_large_dictionary(spark):
    df = spark.range(3000).selectExpr("case when id % 3 = 0 then 'k0' else concat('k', id % 700) end as c", "id")
    codes = {r["value"]: r["code"] for r in dictionary(df, "c").collect()}
    assert [codes[v] for v in sorted(codes)] == list(range(700))
    got = encode_table(df.withColumn("same", F.col("c")), ["c"], ["same"]).distinct().collect()
    assert {r["same"]: int(r["c"]) for r in got} == codes


def test_scores(spark):
    df = spark.createDataFrame([(1, 1, 0.9), (1, 0, 0.4), (0, 0, 0.4), (0, 0, 0.1)], "y int, g int, s double")
    got = scoring.macro_scores(scoring.confusion(df, "y", "g")).first().asDict()
    assert got == {"accuracy": 0.75, "f1_score": 0.7333, "precision": 0.8333, "recall": 0.75}
    assert scoring.auc(df, F.col("y") == 1, "s").first()["auc"] == 0.875


def test_utility(people):
    real, synth = people
    small = {"RandomForest": FOREST, "GradientBoosting": {"maxIter": 3, "maxDepth": 2}}
    found = utility.ml_utility(real, synth, "diabetes", settings=small)
    values = {(r["model"], r["regime"], r["metric"]): r["value"] for r in found.collect()}
    assert 0 <= values["RandomForest", "gap", "utility_score"] <= 100
    assert 0.4 <= values["RandomForest", "trtr", "roc_auc"] <= 1 and 0.3 <= values["GradientBoosting", "tstr", "accuracy"] <= 1
    pillar = utility.utility_pillar(real, synth, "diabetes", report=found).first()
    assert pillar["applicable"] and pillar["score"] == values["RandomForest", "gap", "utility_score"]


def test_utility_with_three_classes_and_without_target(people):
    real, synth = people
    small = {"RandomForest": FOREST, "GradientBoosting": {"maxIter": 2, "maxDepth": 2}}
    found = utility.ml_utility(real, synth, "smoking_status", settings=small)
    assert found.where("metric = 'roc_auc' and value between 0 and 1").count() == 4
    missing = utility.utility_pillar(real, synth, None).first()
    assert not missing["applicable"] and missing["status"] == "not_applicable"


def test_wide_columns_are_audited_without_a_classifier(spark):
    rows = spark.createDataFrame([(f"name {k}", k % 3, float(k)) for k in range(60)], "name string, disease int, x double")
    found = {r["column"]: r for r in audit.attribute_inference(rows, rows, ["name", "disease"], settings={"numTrees": 3, "maxDepth": 2}, most_classes=20).collect()}
    assert found["name"]["error"] is None and (found["name"]["accuracy"], found["name"]["n_classes"]) == (1.0, 60)
    assert found["disease"]["error"] is None and found["disease"]["n_classes"] == 3


def test_one_far_query_does_not_send_all_points(spark, monkeypatch):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 3)) * 100
    points = [(centres[k % 40] + rng.normal(size=3)).tolist() for k in range(2000)] + [[0.5, 0.5, 0.5]] * 1000
    asked = points[::20] + [[1e5, 1e5, 1e5]]
    make = lambda rows: knn.grouped_vectors(spark.createDataFrame([(r,) for r in rows], "v array<double>"), F.col("v"))
    monkeypatch.setattr(knn, "BLOCK_ROWS", 100)
    pairs, inner = [], knn._compared

    def counted(queries, held, keys, k):
        both = queries.groupBy(*keys).count().join(held.groupBy(*keys).agg(F.count(F.lit(1)).alias("m")), keys)
        pairs.append(both.agg(F.sum(F.col("count") * F.col("m"))).first()[0] or 0)
        return inner(queries, held, keys, k)

    monkeypatch.setattr(knn, "_compared", counted)
    got = {tuple(r["features"]): r["distances"] for r in knn.nearest_distances(make(asked), make(points), 4).collect()}
    x = np.array(points)
    for q in {tuple(a) for a in asked}:
        want = np.sort(np.sqrt(((x - np.array(q)) ** 2).sum(axis=1)))[:4]
        assert np.allclose(got[q], want, atol=1e-9)
    # the far query may meet every point, the others their neighbourhood
    assert sum(pairs) < len(points) + len(asked) * len(points) / 4


def test_split_divides_the_rows_of_the_key_at_the_cut(spark):
    rows = [(1, "a", k) for k in range(900)] + [(k, "a", k) for k in range(2, 102)] + [(None, "b", k) for k in range(7)] + [(5, None, 1)] * 3
    df = spark.createDataFrame(rows, "k int, s string, v int").repartition(6)
    marked = split(df, ["k"], 0.3, "s")
    counts = {r["s"]: (r["n"], r["t"]) for r in marked.groupBy("s").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_test").alias("t")).collect()}
    assert counts == {"a": (1000, 300), "b": (7, 3), None: (3, 1)}
    assert marked.drop("is_test").exceptAll(df).count() == 0 and marked.count() == 1010
    # other keys stay on one side
    both = marked.where("s = 'a' and k <> 1").groupBy("k").agg(F.count_distinct("is_test").alias("sides"))
    assert both.where("sides > 1").count() == 0


def test_copies_are_divided_by_arithmetic(spark):
    rows = [(k, "a", 1) for k in range(50)] + [(99, "a", 1001), (100, "b", 7), (101, "b", 2), (102, "b", 1)]
    df = spark.createDataFrame(rows, "k int, s string, n long").repartition(3)
    found = split_copies(df, ["k"], "n", 0.3, "s").collect()
    assert len(found) == 54 and all(r["n_train"] + r["n_test"] == r["n"] and min(r["n_train"], r["n_test"]) >= 0 for r in found)
    tests = {s: sum(r["n_test"] for r in found if r["s"] == s) for s in "ab"}
    exploded = split(df.selectExpr("k", "s", "explode(sequence(1, n)) c"), ["k", "c"], 0.3, "s")
    assert tests == {r["s"]: r["t"] for r in exploded.groupBy("s").agg(F.count_if("is_test").alias("t")).collect()} == {"a": 316, "b": 3}
    assert abs(next(r["n_test"] for r in found if r["k"] == 99) - 300) <= 1


def test_weighted_scores_equal_those_of_repeated_rows(spark):
    rows = [(float(k % 2), float(k % 3 == 0), [0.2, (k * 7 % 10) / 10], 1 + k % 4) for k in range(40)]
    df = spark.createDataFrame(rows, "label double, prediction double, scores array<double>, n int")
    long = df.selectExpr("label", "prediction", "scores", "explode(sequence(1, n)) c")
    assert scoring.confusion(df, "label", "prediction", "n").exceptAll(scoring.confusion(long, "label", "prediction")).count() == 0
    assert classifiers.auc_of(df, 2, "n") == classifiers.auc_of(long, 2)


def test_membership_of_a_record_that_fills_a_third(spark):
    rng = np.random.default_rng(9)
    make = lambda m: spark.createDataFrame([(float(a), float(b)) for a, b in m], "a double, b double")
    members = np.vstack([rng.normal(size=(120, 2)), np.tile([[0.3, 0.1]], (60, 1))])
    records = audit.membership_records(make(members), make(rng.normal(size=(60, 2)) + 3), make(members[:120]))
    assert records.count() == 181 and records.agg(F.sum("n")).first()[0] == 240
    row = audit.membership_inference(make(members), make(rng.normal(size=(60, 2)) + 3), make(members[:120]), settings=FOREST).first()
    assert (row["n_members"], row["n_non_members"]) == (180, 60) and row["attack_auc"] > 0.9


def test_a_split_moves_no_rows_by_their_stratum(spark):
    rows = spark.range(3000).select("id", F.when(F.col("id") % 10 < 8, "hot").otherwise("cold").alias("c"))
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        marked = split(rows, ["id"], 0.3, "c")
        plan = marked._jdf.queryExecution().executedPlan().toString()
        counts = {r["c"]: r["n"] for r in marked.where("is_test").groupBy("c").agg(F.count(F.lit(1)).alias("n")).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    # all rows of a stratum would be one key of a sorted join
    assert "SortMergeJoin" not in plan and counts == {"hot": 720, "cold": 180}


def test_models_are_fitted_on_every_core(spark, monkeypatch):
    rows = spark.range(400).select(F.array((F.col("id") % 7).cast("double")).alias("x"), (F.col("id") % 2).cast("double").alias("label")).coalesce(1)
    rows = cut_lineage(rows.select(array_to_vector("x").alias("features"), "label"))
    seen, plain = [], classifiers.RandomForestClassifier.fit
    monkeypatch.setattr(classifiers.RandomForestClassifier, "fit", lambda self, df: seen.append(df.rdd.getNumPartitions()) or plain(self, df))
    model = classifiers.train(rows, "RandomForest", 2, FOREST)
    assert seen == [spark.sparkContext.defaultParallelism] and classifiers.predictions(model, rows).count() == 400


def test_membership_records_are_computed_once(spark, monkeypatch):
    seen = spark.sparkContext.accumulator(0)

    def noted(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    records = spark.createDataFrame(
        [(str(k), float(k % 2), 2, k / 80, k / 70, 0.1, k / 60) for k in range(80)],
        "record string, label double, n long, d_min double, d_mean double, d_std double, d_max double")
    monkeypatch.setattr(audit, "membership_records", lambda *a: records.mapInPandas(noted, records.schema))
    row = audit.membership_inference(records, records, records, settings=FOREST).first()
    assert (row["n_members"], row["n_non_members"]) == (80, 80)
    assert seen.value == 80
