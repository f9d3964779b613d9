"""Privacy audits of a (real, synthetic) pair: collisions, re-identification, membership and attribute inference."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facsimile.operators.classifiers import (
    ATTACK_FOREST, ATTRIBUTE_FOREST, assembled, auc_of, predictions, train,
)
from facsimile.operators import forest
from facsimile.operators.buckets import Buckets, near_distances
from facsimile.operators.columns import common_columns, tagged_union, with_row
from facsimile.operators.encode import encode_table, scaled, scaling, text_level
from facsimile.operators.facts import collect_facts
from facsimile.operators.freq import row_digest
from facsimile.operators.grades import level
from facsimile.operators.knn import grouped_vectors, nearest_distances
from facsimile.operators.level_attack import level_attack
from facsimile.operators.prefix import long_ranges, ordered_totals
from facsimile.operators.quantiles import quantiles_of_counts
from facsimile.operators.roles import sensitive_columns
from facsimile.operators.scoring import confusion, macro_scores, majority_share
from facsimile.operators.split import bounded_sample, split, split_copies
from facsimile.session import cut_lineage, local_rows

# Neighbours, thresholds, weights and levels of the published audits
NEIGHBOURS = 5
REID_PERCENTILE = 5.0
HISTOGRAM_BINS = 30
WEIGHTS = {"membership": 0.40, "reidentification": 0.35, "attribute": 0.25}
VULNERABLE = 0.15


def exact_collisions(real: DataFrame, synth: DataFrame) -> DataFrame:
    """One row ``(exact_count, exact_rate, synth_rows)``: synthetic rows equal to some real row.

    Rows with a missing cell cannot collide; the rate is over all synthetic rows.  Both tables meet in
    one aggregate on row digests, so copies collapse inside the tasks before the shuffle.
    """
    columns = common_columns(real, synth)
    whole = tagged_union(real, synth, columns)
    complete = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])
    groups = whole.select("side", complete.alias("complete"), row_digest(whole, columns).alias("digest")).groupBy(
        "digest"
    ).agg(
        F.count_if(F.col("complete") & (F.col("side") == "real")).alias("n_real"),
        F.count_if(F.col("complete") & (F.col("side") == "synth")).alias("n_synth"),
        F.count_if(F.col("side") == "synth").alias("rows"),
    )
    counted = groups.agg(
        F.coalesce(F.sum(F.when(F.col("n_real") > 0, F.col("n_synth"))), F.lit(0)).alias("exact_count"),
        F.coalesce(F.sum("rows"), F.lit(0)).alias("synth_rows"),
    )
    rate = F.coalesce(F.try_divide(F.col("exact_count").cast("double"), F.col("synth_rows")), F.lit(0.0))
    return counted.select("exact_count", F.round(rate, 6).alias("exact_rate"), "synth_rows")


def _sampled(df: DataFrame, rows: int | None) -> DataFrame:
    """The whole table, or exactly ``rows`` rows of it when the caller asks for a bounded audit."""
    if rows is None:
        return df
    keyed = df.withColumn("_key", row_digest(df).cast("string"))
    return bounded_sample(keyed, ["_key"], rows).drop("_key")


def encoded_sides(tables: dict[str, DataFrame], scale_on: str) -> tuple[DataFrame, list[str]]:
    """``(side, features)`` of several tables, string codes shared, scaled by one of them."""
    columns = [c for c in next(iter(tables.values())).columns if all(c in t.columns for t in tables.values())]
    first, *rest = tables.items()
    both = tagged_union(first[1], rest[0][1], columns).withColumn(
        "side", F.when(F.col("side") == "real", F.lit(first[0])).otherwise(F.lit(rest[0][0]))
    )
    for name, table in rest[1:]:
        extra = tagged_union(first[1].limit(0), table, columns).withColumn("side", F.lit(name))
        both = both.unionByName(extra)
    coded = cut_lineage(encode_table(both, columns, ["side"], "zero"))
    scale = scaling(coded.where(F.col("side") == scale_on), columns)
    return coded.select("side", F.array(*[scaled(c, scale) for c in columns]).alias("features")), columns


def _distances(queries: DataFrame, points: DataFrame, k: int, approximate: Buckets | None) -> DataFrame:
    """Exact neighbours, or those of random-projection buckets where a caller asks for them."""
    return nearest_distances(queries, points, k) if approximate is None else near_distances(queries, points, k, approximate)


def distance_counts(
    real: DataFrame, synth: DataFrame, sample_rows: int | None = None, approximate: Buckets | None = None,
) -> DataFrame:
    """``(column, value, n)``: distances ``synth_to_real`` (nearest) and ``real_to_real`` (second nearest,
    a row being its own first) on columns standardised by the real table.

    ``approximate`` bounds the work by the number of rows: distances are then at least the true ones.
    """
    sides, _ = encoded_sides({"real": _sampled(real, sample_rows), "synth": _sampled(synth, sample_rows)}, "real")
    of = lambda side: grouped_vectors(sides.where(F.col("side") == side), F.col("features"))
    points = cut_lineage(of("real"))
    outward = _distances(of("synth"), points, 1, approximate)
    inward = _distances(points, points, 2, approximate)

    def rows(found: DataFrame, name: str, place: int) -> DataFrame:
        return found.groupBy(F.get("distances", F.lit(place)).alias("value")).agg(F.sum("n").alias("n")).where(
            F.col("value").isNotNull()
        ).select(F.lit(name).alias("column"), "value", "n")

    return cut_lineage(rows(outward, "synth_to_real", 0).unionByName(rows(inward, "real_to_real", 1)))


def reidentification(distances: DataFrame, percentile: float = REID_PERCENTILE) -> DataFrame:
    """One row of re-identification risk from ``distance_counts``."""
    totals = ordered_totals(distances, long_ranges(distances), ["n"])
    spread = quantiles_of_counts(totals, {"cut": percentile / 100.0, "median": 0.5})
    of = lambda name, field: F.max(F.when(F.col("column") == name, F.col(field))).alias(field)
    marks = cut_lineage(spread.agg(of("real_to_real", "cut"), of("synth_to_real", "median")))
    outward = distances.where(F.col("column") == "synth_to_real")
    found = with_row(outward, marks).agg(
        F.coalesce(F.sum(F.when(F.col("value") < F.col("cut"), F.col("n"))), F.lit(0)).alias("records_at_risk"),
        F.sum("n").alias("total"),
        (F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("mean"),
        F.min("value").alias("low"),
        F.max("cut").alias("cut"), F.max("median").alias("median"),
    )
    share = F.round(F.col("records_at_risk") * 100.0 / F.col("total"), 2)
    return found.select(
        "records_at_risk", share.alias("records_at_risk_pct"), F.col("total").alias("total_synthetic_records"),
        F.round("cut", 4).alias("threshold_distance"), F.round("mean", 4).alias("mean_distance"),
        F.round("median", 4).alias("median_distance"), F.round("low", 4).alias("min_distance"),
        F.least(F.lit(100.0), F.round(share * 2.0, 2)).alias("risk_score"),
        level(share, 1, 5, 15).alias("risk_level"),
    )


def distance_histogram(distances: DataFrame, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """``(bin, center, synth_to_real, real_to_real)``: counts in equal bins up to the joint 95th percentile."""
    joint = distances.groupBy("value").agg(F.sum("n").alias("n")).select(F.lit("all").alias("column"), "value", "n")
    top = quantiles_of_counts(ordered_totals(joint, long_ranges(joint), ["n"]), {"top": 0.95}).select(
        "top", (F.col("top") / bins).alias("width")
    )
    top = cut_lineage(top)
    guess = F.least(F.lit(bins - 1), F.coalesce(F.floor(F.try_divide(F.col("value"), F.col("width"))), F.lit(bins - 1)))
    down = (guess > 0) & (F.col("value") < guess * F.col("width"))
    up = (guess < bins - 1) & (F.col("value") >= (guess + 1) * F.col("width"))
    placed = with_row(distances, top).where(
        F.col("value") <= F.col("top")
    ).withColumn("bin", F.when(down, guess - 1).when(up, guess + 1).otherwise(guess).cast("int"))
    of = lambda name: F.coalesce(F.sum(F.when(F.col("column") == name, F.col("n"))), F.lit(0)).alias(name)
    counted = placed.groupBy("bin").agg(of("synth_to_real"), of("real_to_real"))
    grid = top.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return grid.join(counted, "bin", "left").select(
        "bin", F.round((F.col("bin") + 0.5) * F.col("width"), 4).alias("center"), zero("synth_to_real"), zero("real_to_real")
    )


def membership_records(
    members: DataFrame, holdout: DataFrame, synth: DataFrame, neighbours: int = NEIGHBOURS, approximate: Buckets | None = None,
) -> DataFrame:
    """``(record, label, n, d_min, d_mean, d_std, d_max)``: one row per different record and label with its number of rows, and
    its distances to synthetic rows."""
    sides, _ = encoded_sides({"members": members, "holdout": holdout, "synth": synth}, "synth")
    points = grouped_vectors(sides.where(F.col("side") == "synth"), F.col("features"))
    asked = cut_lineage(sides.where(F.col("side") != "synth").groupBy("features").agg(
        F.count_if(F.col("side") == "members").alias("n_members"),
        F.count_if(F.col("side") == "holdout").alias("n_holdout"),
    ))
    found = _distances(
        asked.select("features", (F.col("n_members") + F.col("n_holdout")).alias("n")), points, neighbours, approximate
    )
    size = F.size("distances")
    mean = F.aggregate("distances", F.lit(0.0), lambda a, x: a + x) / size
    square = F.aggregate("distances", F.lit(0.0), lambda a, x: a + F.pow(x - F.col("d_mean"), F.lit(2)))
    described = found.where(size > 0).withColumn("d_mean", mean).select(
        "features", F.col("distances")[0].alias("d_min"), "d_mean", F.sqrt(square / size).alias("d_std"),
        F.element_at("distances", -1).alias("d_max"),
    ).join(asked, "features")
    copies = F.array(
        F.struct(F.lit(1.0).alias("label"), F.col("n_members").alias("n")),
        F.struct(F.lit(0.0).alias("label"), F.col("n_holdout").alias("n")),
    )
    listed = described.select("features", "d_min", "d_mean", "d_std", "d_max", F.inline(copies)).where(F.col("n") > 0)
    return listed.select(F.md5(F.col("features").cast("string")).alias("record"), "label", "n", "d_min", "d_mean", "d_std", "d_max")


def membership_features(
    members: DataFrame, holdout: DataFrame, synth: DataFrame, neighbours: int = NEIGHBOURS, approximate: Buckets | None = None,
) -> DataFrame:
    """``(record, label, copy, d_min, d_mean, d_std, d_max)``: ``membership_records`` with one row per audited row."""
    found = membership_records(members, holdout, synth, neighbours, approximate)
    return found.select(
        "record", "label", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("copy"), "d_min", "d_mean", "d_std", "d_max")


def membership_inference(
    members: DataFrame, holdout: DataFrame, synth: DataFrame, neighbours: int = NEIGHBOURS,
    sample_rows: int | None = None, settings: dict | None = None, approximate: Buckets | None = None,
) -> DataFrame:
    """One row: how well distances to the synthetic table tell members from non-members.

    Equal records are one weighted row up to the fit and the scores; 30 % of the rows of each label are the test.
    """
    spark = members.sparkSession
    # written once: the split reads its rows several times, and each time the neighbours would be searched again
    rows = cut_lineage(membership_records(*(_sampled(t, sample_rows) for t in (members, holdout, synth)), neighbours, approximate))
    marked = cut_lineage(assembled(
        split_copies(rows, ["record", "label"], "n", 0.3, "label"), ["d_min", "d_mean", "d_std", "d_max"]
    ).select("label", "features", "n", "n_train", "n_test"))
    model = train(marked.where("n_train > 0").withColumn("n_train", F.col("n_train").cast("double")), "RandomForest", 2, settings or ATTACK_FOREST, "n_train")
    scored = cut_lineage(predictions(model, marked.where("n_test > 0"), ("n_test",)))
    accuracy = macro_scores(confusion(scored, "label", "prediction", "n_test")).first()["accuracy"]
    area = auc_of(scored, 2, "n_test")
    area = 0.5 if area is None else area
    advantage = max(0.0, (area - 0.5) * 2)
    sizes = {r["label"]: r["n"] for r in marked.groupBy("label").agg(F.sum("n").alias("n")).collect()}
    risk = "low" if area <= 0.55 else "medium" if area <= 0.65 else "high" if area <= 0.75 else "critical"
    return local_rows(
        spark,
        [(accuracy, round(area, 4), round(advantage, 4), round(advantage * 100, 2), risk,
          int(sizes.get(1.0, 0)), int(sizes.get(0.0, 0)))],
        "attack_accuracy double, attack_auc double, attack_advantage double, risk_score double, risk_level string,"
        " n_members long, n_non_members long",
    )


def _level_audit(real: DataFrame, synth: DataFrame, target: str, features: list[str]) -> tuple:
    """Figures and error of a target that a caller wants attacked without a classifier."""
    try:
        row = level_attack(real, synth, target, features).first()
    except PySparkException as error:
        return None, None, None, None, None, str(error).splitlines()[0]
    vulnerable = row["advantage"] is not None and row["advantage"] > VULNERABLE
    return row["accuracy"], row["baseline_accuracy"], row["advantage"], row["n_classes"], vulnerable, None


def attribute_inference(
    real: DataFrame, synth: DataFrame, columns: list[str] | None = None, order_by: list[str] | None = None,
    sample_rows: int | None = None, settings: dict | None = None, limit: int | None = None, most_classes: int | None = None,
) -> DataFrame:
    """``(column, accuracy, baseline_accuracy, advantage, n_classes, vulnerable, error)`` per sensitive column.

    A shallow forest learns the column from the synthetic rows and is tested on the real ones, whatever the number of its
    classes (``forest``).  Without ``columns`` all sensitive columns are audited, all columns where none is sensitive; ``limit``
    keeps the first few.  Only a caller who gives ``most_classes`` has columns with more levels attacked by what single levels of the other
    columns give away (``level_attack``).  A column whose audit fails has the reason in ``error``, no figures, and does not count in averages.
    """
    real, synth = _sampled(real, sample_rows), _sampled(synth, sample_rows)
    common = common_columns(real, synth)
    chosen = columns or sensitive_columns(collect_facts(real.select(*common), order_by), limit) or common[:limit]
    both = tagged_union(real, synth, common)
    grown = ATTRIBUTE_FOREST | (settings or {})
    label = "_class"
    while label in common:
        label += "_"
    found = []
    for target in (c for c in chosen if c in common):
        features = [c for c in common if c != target]
        classes = both.select(text_level(target).alias("level")).distinct().count()
        if most_classes is not None and classes > most_classes:
            found.append((target, *_level_audit(real, synth, target, features)))
            continue
        rows = cut_lineage(encode_table(both.withColumn(label, text_level(target)), features, ["side", label], "zero"))
        learnt, tested = rows.where(F.col("side") == "synth"), rows.where(F.col("side") == "real")
        if not learnt.limit(1).count():
            found.append((target, None, None, None, None, None, "no synthetic rows to learn from"))
            continue
        trees, packed = forest.fit(learnt, label, features, grown["numTrees"], grown["maxDepth"], grown.get("minInstancesPerNode", 1))
        accuracy = forest.accuracy(forest.guesses(trees, packed, tested, label, features))
        baseline = majority_share(tested, label).first()["majority_share"]
        advantage = None if accuracy is None else round(max(0.0, accuracy - baseline), 4)
        found.append((target, accuracy, baseline, advantage, classes, advantage is not None and advantage > VULNERABLE, None))
    return local_rows(
        real.sparkSession, found,
        "column string, accuracy double, baseline_accuracy double, advantage double, n_classes int, vulnerable boolean, error string",
    )


def attribute_risk(found: DataFrame) -> DataFrame:
    """One row ``(average_advantage, risk_score, risk_level)`` from ``attribute_inference``."""
    average = F.coalesce("average", F.lit(0.0))
    return found.agg(F.avg("advantage").alias("average")).select(
        F.round(average, 4).alias("average_advantage"),
        F.least(F.lit(100.0), F.round(average * 150.0, 2)).alias("risk_score"),
        level(average, 0.08, 0.20, 0.35).alias("risk_level"),
    )


def combined_risk(membership: Column, reidentification: Column, attribute: Column) -> tuple[Column, Column]:
    """Weighted audit risk and its level."""
    score = F.round(
        membership * WEIGHTS["membership"] + reidentification * WEIGHTS["reidentification"]
        + attribute * WEIGHTS["attribute"], 2,
    )
    return score, level(score, 15, 35, 60)


def all_attacks(
    real: DataFrame, synth: DataFrame, holdout: DataFrame | None = None, key: list[str] | None = None,
    sample_rows: int | None = None, order_by: list[str] | None = None, approximate: Buckets | None = None,
) -> DataFrame:
    """One row with the three audits and their combined risk.  Without a holdout, 30 % of the real rows serve."""
    if holdout is None:
        keyed = real.withColumn("_key", F.concat_ws("|", *key) if key else row_digest(real).cast("string"))
        marked = split(keyed, ["_key"], 0.3).drop("_key")
        members, holdout = marked.where(~F.col("is_test")).drop("is_test"), marked.where("is_test").drop("is_test")
    else:
        members = real
    mia = membership_inference(members, holdout, synth, sample_rows=sample_rows, approximate=approximate).select(
        F.col("attack_auc").alias("mia_auc"), F.col("attack_advantage").alias("mia_advantage"),
        F.col("risk_score").alias("mia_risk"), F.col("risk_level").alias("mia_level"),
    )
    reid = reidentification(distance_counts(real, synth, sample_rows, approximate)).select(
        "records_at_risk_pct", F.col("risk_score").alias("reid_risk"), F.col("risk_level").alias("reid_level"),
    )
    attr = attribute_risk(attribute_inference(real, synth, order_by=order_by, sample_rows=sample_rows)).select(
        "average_advantage", F.col("risk_score").alias("attr_risk"), F.col("risk_level").alias("attr_level"),
    )
    joined = with_row(with_row(mia, reid), attr)
    score, label = combined_risk(F.col("mia_risk"), F.col("reid_risk"), F.col("attr_risk"))
    return joined.withColumn("overall_risk_score", score).withColumn("overall_risk_level", label)


def privacy_pillar(real: DataFrame, synth: DataFrame, attacks: DataFrame | None = None, **options) -> DataFrame:
    """One row: raw risk, protection score, level and status, collisions included.

    ``attacks`` is a row of ``all_attacks`` computed before; otherwise the audits run now.
    """
    attacks = attacks if attacks is not None else all_attacks(real, synth, **options)
    joined = with_row(exact_collisions(real, synth), attacks)
    penalty = F.when(F.col("exact_count") > 0, F.least(F.lit(50.0), F.col("exact_rate") * 500.0)).otherwise(F.lit(0.0))
    raw = F.round(F.least(F.lit(100.0), F.col("overall_risk_score") + penalty), 2)
    scored = joined.withColumn("raw_privacy_risk_score", raw)
    risk = scored.withColumn("risk_level", level(F.col("raw_privacy_risk_score"), 20, 40, 70))
    calm = F.col("risk_level").isin("low", "medium")
    return risk.select(
        F.round(F.greatest(F.lit(0.0), 100.0 - F.col("raw_privacy_risk_score")), 2).alias("privacy_protection_score"),
        "raw_privacy_risk_score", "risk_level",
        F.when(calm & (F.col("exact_count") == 0), F.lit("passed"))
        .when((F.col("risk_level") == "high") | (F.col("exact_count") <= 2), F.lit("warning"))
        .otherwise(F.lit("failed")).alias("status"),
        "exact_count", "exact_rate", "mia_auc", "mia_advantage", "records_at_risk_pct", "average_advantage",
        "overall_risk_score", "overall_risk_level",
    )


def privacy_warnings(pillar: DataFrame) -> DataFrame:
    """``(pillar, message)`` for collisions and elevated audit results."""
    # The wording of the messages below
    tag = F.lit("privacy").alias("pillar")
    message = lambda test, text, *values: pillar.where(test).select(tag, F.format_string(text, *values).alias("message"))
    return reduce(DataFrame.unionByName, [
        message(
            F.col("exact_count") > 0,
            "EXACT MATCH COLLISION: %d synthetic record(s) (%.2f%%) identically match real training records.",
            F.col("exact_count"), F.col("exact_rate") * 100.0,
        ),
        message(F.col("mia_auc") > 0.65, "High Membership Inference risk (AUC = %.3f).", F.col("mia_auc")),
        message(
            F.col("records_at_risk_pct") > 5.0,
            "High Re-identification risk (%.1f%% records dangerously close to real records).", F.col("records_at_risk_pct"),
        ),
        message(
            F.col("average_advantage") > 0.15,
            "Elevated Attribute Inference advantage (%.3f over majority baseline).", F.col("average_advantage"),
        ),
    ])
