"""Classifier scores, neighbour distances, privacy audits and the quality report."""

from __future__ import annotations

from pyspark.sql import functions as F

from facsimile.operators import audit, encode, knn, level_attack, report, scoring, utility
from facsimile.operators.buckets import Buckets, near_distances
from facsimile.operators.grades import grade
from facsimile.plans import generate, quality
from facsimile.plans.catalog.shared import PAIR, REAL, SEED, derived, pair, table
from facsimile.session import cut_lineage

MATCHED = ["balance", "nation"]
DISGUISED_REAL = "SELECT c_name, c_nationkey, c_mktsegment, c_acctbal FROM customer"
DISGUISED = """
SELECT CASE WHEN c_custkey % 5 = 0 THEN concat(c_name, '*') ELSE c_name END AS c_name, c_nationkey, c_mktsegment,
       CASE WHEN c_custkey % 3 = 0 THEN CAST(c_nationkey AS DOUBLE) ELSE c_acctbal END AS c_acctbal
FROM customer"""


def _scored(spark, sf):
    """Labelled documents with a score that needs no model: their length."""
    joined = table(spark, sf, "labels").join(table(spark, sf, "documents"), "doc_id")
    return joined.select("doc_id", "quality", "toxic", "lang", F.col("n_chars").cast("double").alias("score"))


def confusion_table(spark, sf):
    rows = _scored(spark, sf).withColumn("guess", (F.col("score") > 500).cast("int"))
    return scoring.confusion(rows, "quality", "guess")


def macro_scores(spark, sf):
    rows = _scored(spark, sf).withColumn("guess", F.when(F.col("score") > 3000, 2).when(F.col("score") > 500, 1).otherwise(0))
    return scoring.macro_scores(scoring.confusion(rows, "quality", "guess"))


def auc_exact(spark, sf):
    found = scoring.auc(_scored(spark, sf), F.col("quality") == 1, "score")
    return found.select(F.round("auc", 6).alias("auc"))


def auc_by_language(spark, sf):
    rows = _scored(spark, sf).withColumn("lang", F.coalesce("lang", F.lit("unknown")))
    return scoring.auc(rows, F.col("quality") == 1, "score", ["lang"]).withColumn("auc", F.round("auc", 6))


def roc_curve(spark, sf):
    return scoring.roc_points(scoring.score_totals(_scored(spark, sf), F.col("quality") == 1, "score"))


def majority_baseline(spark, sf):
    return scoring.majority_share(table(spark, sf, "orders"), "o_orderpriority")


def feature_encoding(spark, sf):
    lines = derived(spark, sf, REAL, "lineitem")
    found = encode.encode_table(lines, ["l_returnflag", "l_linestatus", "l_tax", "l_quantity"], ["l_linenumber"], "median")
    return found.withColumn("l_tax", F.round("l_tax", 6))


def dictionary_codes(spark, sf):
    return encode.dictionary(table(spark, sf, "customer"), "c_name")


def _matched(spark, sf):
    """Customers and suppliers as a (real, synthetic) pair with the same columns."""
    real = table(spark, sf, "customer").select(F.col("c_acctbal").alias("balance"), F.col("c_nationkey").alias("nation"))
    synth = table(spark, sf, "supplier").select(F.col("s_acctbal").alias("balance"), F.col("s_nationkey").alias("nation"))
    return real, synth


def exact_collisions(spark, sf):
    return audit.exact_collisions(*pair(spark, sf))


def nearest_vectors(spark, sf):
    vectors = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("features"))
    points = knn.grouped_vectors(vectors, F.col("features"))
    found = knn.nearest_distances(points, points, 5)
    joined = vectors.join(found, "features")
    return joined.select("vec_id", *[F.round(F.col("distances")[i], 6).alias(f"d{i + 1}") for i in range(5)])


NEAR = Buckets(tables=10, signs=12, leaf_rows=128)


def near_vectors(spark, sf):
    """Approximate neighbours by projection buckets; the SQL repeats the directions and the buckets."""
    vectors = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("features"))
    points = knn.grouped_vectors(vectors, F.col("features"))
    joined = vectors.join(near_distances(points, points, 5, NEAR), "features")
    return joined.select("vec_id", *[F.round(F.col("distances")[i], 6).alias(f"d{i + 1}") for i in range(5)])


def _disguised(spark, sf):
    """Customers, and a synthetic counterpart: every third has another balance, every fifth another customer's name."""
    return derived(spark, sf, DISGUISED_REAL, "customer"), derived(spark, sf, DISGUISED, "customer")


def attribute_inference_wide(spark, sf):
    """Targets with as many classes as rows: no list of classes, no classifier."""
    real, synth = _disguised(spark, sf)
    found = audit.attribute_inference(real, synth, ["c_name", "c_acctbal"], most_classes=20)
    return found.select("column", "accuracy", "baseline_accuracy", "advantage", "n_classes", "vulnerable")


def level_guesses(spark, sf):
    """What the attack believes of every real customer."""
    real, synth = _disguised(spark, sf)
    told = level_attack.guesses(real, synth, "c_name", ["c_nationkey", "c_mktsegment", "c_acctbal"])
    return told.select("class", "n", "guess")


def reidentification_risk(spark, sf):
    return audit.reidentification(audit.distance_counts(*_matched(spark, sf)))


def distance_histogram(spark, sf):
    return audit.distance_histogram(audit.distance_counts(*_matched(spark, sf)))


def membership_features(spark, sf):
    real, holdout = _matched(spark, sf)
    synth = real.withColumn("balance", F.col("balance") * F.lit(1.01))
    found = audit.membership_features(real, holdout, synth)
    return found.select("label", *[F.round(c, 6).alias(c) for c in ("d_min", "d_mean", "d_std", "d_max")])


def membership_inference(spark, sf):
    real, holdout = _matched(spark, sf)
    return audit.membership_inference(real, holdout, real.withColumn("balance", F.col("balance") * F.lit(1.01)))


def _people(spark, sf):
    """Customers with a target, and a synthetic counterpart drawn from their model."""
    people = table(spark, sf, "customer").withColumn(
        "default", (F.col("c_acctbal") + 150 * F.col("c_nationkey") > 6000).cast("int"))
    made = generate.synthesize(people, people.count(), None, SEED)
    return people, cut_lineage(made.table)


def attribute_inference(spark, sf):
    return audit.attribute_inference(*_people(spark, sf))


def tstr_random_forest(spark, sf):
    return utility.ml_utility(*_people(spark, sf), "default", models=("RandomForest",))


def tstr_gradient_boosting(spark, sf):
    return utility.ml_utility(*_people(spark, sf), "default", models=("GradientBoosting",))


def quality_summary(spark, sf):
    found = quality.quality_report(*_people(spark, sf))
    return found.summary


def fidelity_verdict(spark, sf):
    """Scores of every nation's customers against the rules of the summary."""
    customer = table(spark, sf, "customer")
    scored = customer.groupBy("c_nationkey").agg(
        F.round(F.avg("c_acctbal") / 60, 2).alias("fidelity"), F.round(F.max("c_acctbal") / 120, 2).alias("protection"),
        F.count_if(F.col("c_acctbal") < -900).alias("collisions"))
    return scored.select(
        "c_nationkey", "fidelity", "protection", grade(F.col("fidelity")).alias("grade"),
        report.verdict(F.col("fidelity"), F.col("protection"), F.col("collisions")).alias("verdict"))


def attribute_risk(spark, sf):
    """Every nation's customers as the advantages of one audit."""
    found = table(spark, sf, "customer").select(F.lit("balance").alias("column"), F.when(F.col("c_acctbal") > 0, F.col("c_acctbal") / 30_000.0).alias("advantage"))
    return audit.attribute_risk(found)


def combined_risk(spark, sf):
    customer = table(spark, sf, "customer").groupBy("c_nationkey").agg(
        F.round(F.avg("c_acctbal") / 60, 2).alias("m"), F.round(F.max("c_acctbal") / 150, 2).alias("r"), F.round(F.abs(F.min("c_acctbal")) / 40, 2).alias("a"))
    score, label = audit.combined_risk(F.col("m"), F.col("r"), F.col("a"))
    return customer.select("c_nationkey", F.round(score, 1).alias("score"), label.alias("risk"))


def executive_summary(spark, sf):
    """The summary of four scores, a privacy row and the warnings that the given tables yield."""
    lines, customer = table(spark, sf, "lineitem"), table(spark, sf, "customer")
    pillars = lines.groupBy("l_linenumber").agg(F.round(F.avg("l_quantity") * 3, 2).alias("score")).select(
        F.when(F.col("l_linenumber") == 1, "structural").when(F.col("l_linenumber") == 2, "statistical").when(F.col("l_linenumber") == 3, "relationship")
        .when(F.col("l_linenumber") == 4, "ml_utility").alias("pillar"), "score", (F.col("l_linenumber") != 4).alias("applicable")).where("pillar IS NOT NULL")
    privacy = customer.agg(F.round(100 - F.avg("c_acctbal") / 100, 2).alias("privacy_protection_score"), F.round(F.avg("c_acctbal") / 100, 2).alias("raw_privacy_risk_score"),
                           F.lit("medium").alias("risk_level"), F.count_if(F.col("c_acctbal") < -9999).alias("exact_count"))
    found = report.executive_summary(pillars, privacy, customer.where("c_acctbal < 0"))
    return found.withColumn("applicable_pillars", F.array_join("applicable_pillars", ","))


QUERIES = {
    f.__name__: f for f in (
        confusion_table, macro_scores, auc_exact, auc_by_language, roc_curve, majority_baseline, feature_encoding,
        dictionary_codes, exact_collisions, nearest_vectors, near_vectors, attribute_inference_wide, level_guesses, reidentification_risk, distance_histogram,
        membership_features, membership_inference, attribute_inference, tstr_random_forest, tstr_gradient_boosting,
        quality_summary, fidelity_verdict, attribute_risk, combined_risk, executive_summary,
    )
}

_LABELLED = "(SELECT labels.doc_id, quality, toxic, lang, CAST(n_chars AS DOUBLE) AS score FROM labels JOIN documents USING (doc_id))"
_AUC = """sum(CASE WHEN quality = 1 THEN nb + ne / 2.0::DOUBLE ELSE 0 END)
    / (count(*) FILTER (quality = 1) * count(*) FILTER (quality <> 1))::DOUBLE"""


def _ranked(by=""):
    part = f"PARTITION BY {by} " if by else ""
    same = f"PARTITION BY {by + ', ' if by else ''}score"
    return f"""(SELECT *, sum(CASE WHEN quality <> 1 THEN 1 ELSE 0 END) OVER ({part}ORDER BY score RANGE UNBOUNDED PRECEDING)
        - sum(CASE WHEN quality <> 1 THEN 1 ELSE 0 END) OVER ({same}) AS nb, sum(CASE WHEN quality <> 1 THEN 1 ELSE 0 END) OVER ({same}) AS ne FROM {_LABELLED})"""


# SQL: the matched pair standardised by the customers; columns b and k
_SCALE = "sc AS (SELECT avg(c_acctbal) AS mb, stddev_pop(c_acctbal) AS sb, avg(c_nationkey) AS mk, stddev_pop(c_nationkey) AS sk FROM customer)"
_R = "r AS (SELECT c_custkey AS i, (c_acctbal - mb) / sb AS b, (c_nationkey - mk) / sk AS k FROM customer, sc)"
_S = "s AS (SELECT s_suppkey AS i, (s_acctbal - mb) / sb AS b, (s_nationkey - mk) / sk AS k FROM supplier, sc)"
_DIST = "sqrt((x.b - y.b) ** 2 + (x.k - y.k) ** 2)"
_DISTANCES = f"""WITH {_SCALE}, {_R}, {_S},
    o AS (SELECT x.i, min({_DIST}) AS d FROM s x CROSS JOIN r y GROUP BY x.i),
    w AS (SELECT x.i, {_DIST} AS d, row_number() OVER (PARTITION BY x.i ORDER BY {_DIST}) AS place FROM r x CROSS JOIN r y),
    n AS (SELECT i, d FROM w WHERE place = 2)"""

def _level_attack(target, features):
    """SQL: the guesses of the attack on one column of the disguised customers, and its figures."""
    cells = lambda source, lead: " UNION ALL ".join(
        f"SELECT {lead}, {i} AS place, coalesce(CAST({c} AS VARCHAR), 'nan') AS level FROM {source}" for i, c in enumerate(features))
    return f"""
        n AS (SELECT place, level, guess, count(*) AS n FROM ({cells('s', f'CAST({target} AS VARCHAR) AS guess')}) GROUP BY ALL),
        b AS (SELECT place, level, sum(n) AS support, arg_min(guess, (-n, guess)) AS guess, max(n)::DOUBLE / sum(n) AS share FROM n GROUP BY ALL),
        q AS (SELECT row_number() OVER () AS id, * FROM r),
        a AS (SELECT id, place, level FROM ({cells('q', 'id')})),
        g AS (SELECT id, arg_max(guess, (share, support, -place)) AS guess FROM a JOIN b USING (place, level) GROUP BY id),
        u AS (SELECT CAST({target} AS VARCHAR) AS usual FROM s GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
        t AS (SELECT id, CAST({target} AS VARCHAR) AS class, coalesce(guess, usual) AS guess FROM q LEFT JOIN g USING (id) CROSS JOIN u)"""


def _level_figures(target, features):
    return f"""SELECT * FROM (WITH r AS ({DISGUISED_REAL}), s AS ({DISGUISED}), {_level_attack(target, features)},
        f AS (SELECT round(count(*) FILTER (class = guess) / count(*)::DOUBLE, 4) AS accuracy,
                     (SELECT round(max(n) / sum(n)::DOUBLE, 4) FROM (SELECT count(*) AS n FROM t GROUP BY class)) AS baseline_accuracy FROM t)
        SELECT '{target}' AS "column", accuracy, baseline_accuracy, round(greatest(0, accuracy - baseline_accuracy), 4) AS advantage,
               (SELECT count(*) FROM (SELECT class FROM t UNION SELECT CAST({target} AS VARCHAR) FROM s)) AS n_classes,
               round(greatest(0, accuracy - baseline_accuracy), 4) > 0.15 AS vulnerable FROM f)"""


ORACLES = {
    "attribute_inference_wide": _level_figures("c_name", ["c_nationkey", "c_mktsegment", "c_acctbal"]) + " UNION ALL "
    + _level_figures("c_acctbal", ["c_name", "c_nationkey", "c_mktsegment"]),
    "level_guesses": f"WITH r AS ({DISGUISED_REAL}), s AS ({DISGUISED}), {_level_attack('c_name', ['c_nationkey', 'c_mktsegment', 'c_acctbal'])} SELECT class, count(*) AS n, any_value(guess) AS guess FROM t GROUP BY class, guess",
    "near_vectors": f"""
        WITH g AS (SELECT DISTINCT embedding::DOUBLE[] AS e FROM embeddings), w AS (SELECT max(len(e)) AS w FROM g),
        m AS (SELECT list(a ORDER BY i) AS m FROM (SELECT i, round(avg(e[i + 1]), 9) AS a FROM g, w, range(0, 64) t(i) WHERE i < w GROUP BY i)),
        l AS (SELECT t, s, list(CASE WHEN instr('13579bdf', substr(md5('{NEAR.seed}|' || t || '|' || s || '|' || c), 1, 1)) > 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END ORDER BY c) AS line
              FROM w, range(0, {NEAR.tables}) x(t), range(0, {NEAR.signs}) y(s), range(0, 64) z(c) WHERE c < w GROUP BY t, s),
        k AS (SELECT e, t, string_agg(CASE WHEN round(list_dot_product(e, line) - list_dot_product(m, line), 9) >= 0 THEN '1' ELSE '0' END, '' ORDER BY s) AS code
              FROM g, m, l GROUP BY e, t),
        p AS (SELECT e, t, n, code[1:n] AS bucket, count(*) OVER (PARTITION BY t, n, code[1:n]) AS held FROM k, range(0, {NEAR.signs} + 1) r(n)),
        b AS (SELECT e, t, arg_min(bucket, n) AS bucket FROM p WHERE held <= {NEAR.leaf_rows} GROUP BY e, t),
        d AS (SELECT DISTINCT x.e, y.e AS o, list_distance(x.e, y.e) AS d FROM b x JOIN b y USING (t, bucket)),
        h AS (SELECT e, list(d ORDER BY d) AS d FROM d GROUP BY e)
        SELECT vec_id, """ + ", ".join(f"round(d[{i}], 6) AS d{i}" for i in range(1, 6)) + " FROM embeddings JOIN h ON h.e = embeddings.embedding::DOUBLE[]",
    "confusion_table": f"SELECT quality AS label, CASE WHEN score > 500 THEN 1 ELSE 0 END AS prediction, count(*) AS n FROM {_LABELLED} GROUP BY 1, 2",
    "macro_scores": f"""
        WITH p AS (SELECT quality AS y, CASE WHEN score > 3000 THEN 2 WHEN score > 500 THEN 1 ELSE 0 END AS g FROM {_LABELLED}),
        c AS (SELECT y AS k FROM p UNION SELECT g FROM p),
        t AS (SELECT k, (SELECT count(*) FROM p WHERE y = k AND g = k)::DOUBLE AS h, (SELECT count(*) FROM p WHERE y = k) AS a, (SELECT count(*) FROM p WHERE g = k) AS b FROM c)
        SELECT (SELECT round(avg(CASE WHEN y = g THEN 1.0::DOUBLE ELSE 0 END), 4) FROM p) AS accuracy, round(avg(CASE WHEN a + b > 0 THEN 2 * h / (a + b) ELSE 0 END), 4) AS f1_score,
               round(avg(CASE WHEN b > 0 THEN h / b ELSE 0 END), 4) AS precision, round(avg(CASE WHEN a > 0 THEN h / a ELSE 0 END), 4) AS recall FROM t""",
    "auc_exact": f"SELECT round({_AUC}, 6) AS auc FROM {_ranked()}",
    "auc_by_language": f"SELECT coalesce(lang, 'unknown') AS lang, round({_AUC}, 6) AS auc FROM {_ranked('lang')} GROUP BY lang",
    "roc_curve": f"""
        WITH f AS (SELECT score, count(*) FILTER (quality = 1) AS p, count(*) FILTER (quality <> 1) AS n FROM {_LABELLED} GROUP BY 1),
        c AS (SELECT row_number() OVER w AS position, sum(p) OVER w AS cp, sum(n) OVER w AS cn, sum(p) OVER () AS tp, sum(n) OVER () AS tn,
                     greatest(1, (count(*) OVER () + 1) // 50) AS step FROM f WINDOW w AS (ORDER BY score DESC))
        SELECT position, round(cn::DOUBLE / tn, 4) AS fpr, round(cp::DOUBLE / tp, 4) AS tpr FROM c WHERE position % step = 0
        UNION ALL SELECT 0, 0.0::DOUBLE, 0.0::DOUBLE FROM f HAVING count(*) > 0""",
    "majority_baseline": """
        SELECT CAST(sum(n) AS BIGINT) AS n, round(max(n) / sum(n)::DOUBLE, 4) AS majority_share, count(*) AS classes
        FROM (SELECT count(*) AS n FROM orders GROUP BY o_orderpriority)""",
    "feature_encoding": f"""
        WITH t AS ({REAL}), d AS (SELECT l_returnflag AS v, row_number() OVER (ORDER BY l_returnflag) - 1 AS c FROM t GROUP BY 1),
        e AS (SELECT l_linestatus AS v, row_number() OVER (ORDER BY l_linestatus) - 1 AS c FROM t GROUP BY 1)
        SELECT l_linenumber, CAST(d.c AS DOUBLE) AS l_returnflag, CAST(e.c AS DOUBLE) AS l_linestatus,
               round(coalesce(l_tax, (SELECT quantile_cont(l_tax, 0.5) FROM t)), 6) AS l_tax, l_quantity
        FROM t JOIN d ON d.v = l_returnflag JOIN e ON e.v = l_linestatus""",
    "dictionary_codes": "SELECT c_name AS value, row_number() OVER (ORDER BY c_name) - 1 AS code FROM customer GROUP BY 1",
    "exact_collisions": f"""
        {PAIR}, k AS (SELECT DISTINCT * FROM r WHERE l_tax IS NOT NULL),
        h AS (SELECT count(*) AS n FROM s WHERE EXISTS (SELECT 1 FROM k WHERE k.l_linenumber = s.l_linenumber AND k.l_quantity = s.l_quantity
              AND k.l_extendedprice = s.l_extendedprice AND k.l_discount = s.l_discount AND k.l_tax = s.l_tax
              AND k.l_returnflag = s.l_returnflag AND k.l_linestatus = s.l_linestatus))
        SELECT n AS exact_count, round(n::DOUBLE / (SELECT count(*) FROM s), 6) AS exact_rate, (SELECT count(*) FROM s) AS synth_rows FROM h""",
    "nearest_vectors": """
        WITH d AS (SELECT x.vec_id, list_distance(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) AS d,
                   row_number() OVER (PARTITION BY x.vec_id ORDER BY list_distance(x.embedding::DOUBLE[], y.embedding::DOUBLE[])) AS i
                   FROM embeddings x CROSS JOIN embeddings y)
        SELECT vec_id, """ + ", ".join(f"round(max(d) FILTER (i = {i}), 6) AS d{i}" for i in range(1, 6)) + " FROM d GROUP BY vec_id",
    "reidentification_risk": f"""{_DISTANCES},
        t AS (SELECT quantile_cont(d, 0.05) AS cut FROM n),
        a AS (SELECT count(*) FILTER (d < cut) AS risky, count(*) AS total, avg(d) AS mean, quantile_cont(d, 0.5) AS mid, min(d) AS low, max(cut) AS cut FROM o, t),
        p AS (SELECT *, round(risky * 100.0::DOUBLE / total, 2) AS pct FROM a)
        SELECT risky AS records_at_risk, pct AS records_at_risk_pct, total AS total_synthetic_records, round(cut, 4) AS threshold_distance,
               round(mean, 4) AS mean_distance, round(mid, 4) AS median_distance, round(low, 4) AS min_distance, least(100.0::DOUBLE, round(pct * 2, 2)) AS risk_score,
               CASE WHEN pct <= 1 THEN 'low' WHEN pct <= 5 THEN 'medium' WHEN pct <= 15 THEN 'high' ELSE 'critical' END AS risk_level FROM p""",
    "distance_histogram": f"""{_DISTANCES},
        b AS (SELECT 'o' AS side, d FROM o UNION ALL SELECT 'n', d FROM n), t AS (SELECT quantile_cont(d, 0.95) AS top, quantile_cont(d, 0.95) / 30 AS w FROM b),
        g AS (SELECT side, d, w, least(29, CAST(floor(d / w) AS INTEGER)) AS i FROM b, t WHERE d <= top),
        c AS (SELECT side, CASE WHEN i > 0 AND d < i * w THEN i - 1 WHEN i < 29 AND d >= (i + 1) * w THEN i + 1 ELSE i END AS bin FROM g)
        SELECT CAST(x.bin AS INTEGER) AS bin, round((x.bin + 0.5::DOUBLE) * w, 4) AS center, count(c.bin) FILTER (side = 'o') AS synth_to_real,
               count(c.bin) FILTER (side = 'n') AS real_to_real FROM range(30) AS x(bin) CROSS JOIN t LEFT JOIN c ON c.bin = x.bin GROUP BY x.bin, w""",
    "membership_features": """
        WITH y0 AS (SELECT c_acctbal * 1.01::DOUBLE AS b, c_nationkey AS k FROM customer),
        sc AS (SELECT avg(b) AS mb, stddev_pop(b) AS sb, avg(k) AS mk, stddev_pop(k) AS sk FROM y0),
        y AS (SELECT (b - mb) / sb AS b, (k - mk) / sk AS k FROM y0, sc),
        x AS (SELECT 1.0::DOUBLE AS label, c_custkey AS i, (c_acctbal - mb) / sb AS b, (c_nationkey - mk) / sk AS k FROM customer, sc
              UNION ALL SELECT 0.0::DOUBLE, s_suppkey, (s_acctbal - mb) / sb, (s_nationkey - mk) / sk FROM supplier, sc),
        d AS (SELECT label, i, sqrt((x.b - y.b) ** 2 + (x.k - y.k) ** 2) AS d,
                     row_number() OVER (PARTITION BY label, i ORDER BY sqrt((x.b - y.b) ** 2 + (x.k - y.k) ** 2)) AS place FROM x CROSS JOIN y)
        SELECT label, round(min(d), 6) AS d_min, round(avg(d), 6) AS d_mean, round(stddev_pop(d), 6) AS d_std, round(max(d), 6) AS d_max
        FROM d WHERE place <= 5 GROUP BY label, i""",
    "attribute_risk": """
        WITH t AS (SELECT avg(CASE WHEN c_acctbal > 0 THEN c_acctbal / 30000.0::DOUBLE END) AS a FROM customer)
        SELECT round(a, 4) AS average_advantage, least(100.0::DOUBLE, round(coalesce(a, 0) * 150, 2)) AS risk_score,
               CASE WHEN coalesce(a, 0) <= 0.08 THEN 'low' WHEN a <= 0.20 THEN 'medium' WHEN a <= 0.35 THEN 'high' ELSE 'critical' END AS risk_level FROM t""",
    "combined_risk": """
        WITH t AS (SELECT c_nationkey, round(avg(c_acctbal) / 60, 2) AS m, round(max(c_acctbal) / 150, 2) AS r, round(abs(min(c_acctbal)) / 40, 2) AS a FROM customer GROUP BY 1),
        s AS (SELECT c_nationkey, round(m * 0.40::DOUBLE + r * 0.35::DOUBLE + a * 0.25::DOUBLE, 2) AS v FROM t)
        SELECT c_nationkey, round(v, 1) AS score, CASE WHEN v <= 15 THEN 'low' WHEN v <= 35 THEN 'medium' WHEN v <= 60 THEN 'high' ELSE 'critical' END AS risk FROM s""",
    "executive_summary": """
        WITH p AS (SELECT l_linenumber AS k, round(avg(l_quantity) * 3, 2) AS s FROM lineitem WHERE l_linenumber <= 3 GROUP BY 1),
        f AS (SELECT round(sum(s * CASE k WHEN 1 THEN 0.25::DOUBLE WHEN 2 THEN 0.35::DOUBLE ELSE 0.20::DOUBLE END) / 0.80::DOUBLE, 2) AS f FROM p),
        c AS (SELECT round(100 - avg(c_acctbal) / 100, 2) AS s, round(avg(c_acctbal) / 100, 2) AS raw, count(*) FILTER (c_acctbal < 0) AS w FROM customer)
        SELECT f AS data_fidelity_score, CASE WHEN f >= 90 THEN 'A' WHEN f >= 75 THEN 'B' WHEN f >= 60 THEN 'C' WHEN f >= 40 THEN 'D' ELSE 'F' END AS data_fidelity_grade,
               s AS privacy_protection_score, CASE WHEN s >= 90 THEN 'A' WHEN s >= 75 THEN 'B' WHEN s >= 60 THEN 'C' WHEN s >= 40 THEN 'D' ELSE 'F' END AS privacy_protection_grade,
               raw AS raw_privacy_risk_score, 'medium' AS privacy_risk_level,
               CASE WHEN f >= 65 AND s >= 60 THEN 'Deployment Ready: Satisfies standard fidelity and privacy criteria.'
                    WHEN f >= 65 THEN 'Privacy Review Required: Fidelity is adequate, but privacy guarantees or collision risks require adjustment.'
                    WHEN s >= 60 THEN 'Fidelity Review Required: Privacy is protected, but statistical or ML utility is degraded.'
                    ELSE 'Revision Required: Both fidelity and privacy protection fall below standard deployment thresholds.' END AS trust_verdict,
               'relationship,statistical,structural' AS applicable_pillars, w AS warnings_count FROM f, c""",
    "fidelity_verdict": """
        WITH t AS (SELECT c_nationkey, round(avg(c_acctbal) / 60, 2) AS f, round(max(c_acctbal) / 120, 2) AS p, count(*) FILTER (c_acctbal < -900) AS c FROM customer GROUP BY 1)
        SELECT c_nationkey, f AS fidelity, p AS protection,
               CASE WHEN f >= 90 THEN 'A' WHEN f >= 75 THEN 'B' WHEN f >= 60 THEN 'C' WHEN f >= 40 THEN 'D' ELSE 'F' END AS grade,
               CASE WHEN f >= 65 AND p >= 60 AND c = 0 THEN 'Deployment Ready: Satisfies standard fidelity and privacy criteria.'
                    WHEN f >= 65 THEN 'Privacy Review Required: Fidelity is adequate, but privacy guarantees or collision risks require adjustment.'
                    WHEN p >= 60 AND c = 0 THEN 'Fidelity Review Required: Privacy is protected, but statistical or ML utility is degraded.'
                    ELSE 'Revision Required: Both fidelity and privacy protection fall below standard deployment thresholds.' END AS verdict FROM t""",
}
