"""Structural, statistical and relationship fidelity of the lineitem pair."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from facsimile.operators import association, freq, moments, relationship, statistical, structural
from facsimile.operators.columns import tagged_union
from facsimile.plans.catalog.shared import COLUMNS, NUMBERS, PAIR, TEXTS, derived, melt, pair, table

RANKED = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
TARGET = "l_returnflag"


def _rounded(df, digits, *names):
    return df.withColumns({n: F.round(n, digits) for n in names})


def ks_statistic(spark, sf):
    return statistical.ks_test(*pair(spark, sf), NUMBERS).select("column", "statistic")


def ks_p_value(spark, sf):
    return statistical.ks_test(*pair(spark, sf), NUMBERS)


SEGMENTS = {"building": ("BUILDING", "s_acctbal"), "machinery": ("MACHINERY", "s_acctbal + 400"), "household": ("HOUSEHOLD", "s_acctbal * CAST(0.5 AS DOUBLE)")}
FEW_REAL = "SELECT " + ", ".join(f"CASE WHEN c_mktsegment = '{s}' THEN c_acctbal END AS {c}" for c, (s, _) in SEGMENTS.items()) + " FROM customer"
FEW_SYNTH = "SELECT " + ", ".join(f"{e} AS {c}" for c, (_, e) in SEGMENTS.items()) + " FROM supplier"


def ks_p_value_exact(spark, sf):
    """Balances of customers by segment against suppliers: few enough rows for the exact tail."""
    return statistical.ks_test(derived(spark, sf, FEW_REAL, "customer"), derived(spark, sf, FEW_SYNTH, "supplier"), list(SEGMENTS))


def mean_variance(spark, sf):
    return statistical.mean_variance(*pair(spark, sf), NUMBERS)


def chi_square(spark, sf):
    # the statistic against an added category is huge: eight significant digits, not six decimals
    found = statistical.chi_square(*pair(spark, sf), TEXTS)
    return found.select("column", "categories", F.format_string("%.7e", "statistic").alias("statistic"), "similar")


def histogram(spark, sf):
    return statistical.histogram(*pair(spark, sf), NUMBERS)


def category_shares(spark, sf):
    return statistical.category_shares(*pair(spark, sf), TEXTS)


def correlation_delta(spark, sf):
    return _rounded(statistical.correlation_delta(*pair(spark, sf), NUMBERS), 6, "real_r", "synth_r", "delta")


def correlation_error(spark, sf):
    return statistical.correlation_error(statistical.correlation_delta(*pair(spark, sf), NUMBERS))


def column_scores(spark, sf):
    return statistical.column_scores(*pair(spark, sf)).select("column", "type", "quality_score")


def statistical_score(spark, sf):
    return statistical.statistical_fidelity(*pair(spark, sf))


def null_rates(spark, sf):
    return structural.null_rates(*pair(spark, sf)).drop("raw_diff")


def constants(spark, sf):
    real, synth = pair(spark, sf)
    real = real.withColumn("region", F.lit("EU")).withColumn("version", F.lit(3)).withColumn("unit", F.lit("kg"))
    synth = synth.withColumn("region", F.lit("EU")).withColumn("version", F.lit(4)).withColumn(
        "unit", F.when(F.col("l_linenumber") == 5, F.lit("lb")).otherwise(F.lit("kg")))
    return structural.constant_preservation(real, synth)


def _text_counts(spark, sf):
    return freq.side_counts(tagged_union(*pair(spark, sf), TEXTS), TEXTS)


def domain_overlap(spark, sf):
    return structural.domain_overlap(_text_counts(spark, sf)).drop("raw_overlap")


def novel_categories(spark, sf):
    return structural.novel_categories(_text_counts(spark, sf))


def cardinality(spark, sf):
    return structural.cardinality(freq.side_counts(tagged_union(*pair(spark, sf), COLUMNS), COLUMNS)).drop("raw_diff")


def duplicate_rates(spark, sf):
    return _rounded(structural.duplicate_rates(*pair(spark, sf)), 6, "real_rate", "synth_rate", "diff")


def structural_score(spark, sf):
    return structural.structural_fidelity(*pair(spark, sf))


def structural_warnings(spark, sf):
    return structural.structural_warnings(*pair(spark, sf))


def pearson_matrix(spark, sf):
    return _rounded(relationship.pearson_delta(*pair(spark, sf), NUMBERS), 6, "real_value", "synth_value", "delta")


def spearman_matrix(spark, sf):
    return _rounded(relationship.spearman_delta(*pair(spark, sf), RANKED), 6, "real_value", "synth_value", "delta")


def average_ranks(spark, sf):
    return association.average_ranks(table(spark, sf, "customer"), ["c_acctbal", "c_nationkey"])


def cramers_v(spark, sf):
    return _rounded(relationship.cramers_delta(*pair(spark, sf), TEXTS), 6, "real_value", "synth_value", "delta")


# 33 text columns of orders: 528 pairs, some with nulls, some of two levels
MANY = {
    "status": "o_orderstatus", "priority": "o_orderpriority",
    "late": "CASE WHEN o_orderdate >= TIMESTAMP '1998-01-01 00:00:00' THEN 'late' ELSE 'early' END",
    **{f"customer_{m}": f"CAST(o_custkey % {m} AS VARCHAR(4))" for m in range(2, 12)},
    **{f"order_{m}": f"CASE WHEN o_orderkey % 9 <> 4 THEN CAST(o_orderkey % {m} AS VARCHAR(4)) END" for m in range(2, 12)},
    **{f"price_{m}": f"CAST(CAST(floor(o_totalprice) AS BIGINT) % {m} AS VARCHAR(4))" for m in range(2, 12)},
}
MANY_TEXTS = "SELECT " + ", ".join(f"{e} AS {c}" for c, e in MANY.items()) + " FROM orders"


def cramers_v_many(spark, sf):
    """All pairs of 33 columns, counted in blocks."""
    texts = derived(spark, sf, MANY_TEXTS, "orders")
    return _rounded(association.cramers_v(texts, list(combinations(MANY, 2))), 6, "v")


def cramers_v_two_by_two(spark, sf):
    labels = table(spark, sf, "labels").select(F.col("quality").cast("string"), F.col("toxic").cast("string"))
    return _rounded(association.cramers_v(labels, [("quality", "toxic")]), 6, "v")


def correlation_ratio(spark, sf):
    lines = pair(spark, sf)[1]
    pairs = [(t, n) for t in TEXTS for n in NUMBERS]
    return _rounded(association.correlation_ratio(lines, pairs), 6, "eta")


def target_association(spark, sf):
    found = relationship.target_delta(*pair(spark, sf), TARGET)
    return _rounded(found, 4, "real_value", "synth_value", "delta")


def relationship_score(spark, sf):
    return relationship.relationship_fidelity(*pair(spark, sf), TARGET)


def column_moments(spark, sf):
    return _rounded(moments.numeric_moments(pair(spark, sf)[0], NUMBERS), 4, "mean", "std", "variance", "min", "max")


QUERIES = {
    f.__name__: f for f in (
        ks_statistic, ks_p_value, ks_p_value_exact, mean_variance, chi_square, histogram, category_shares, correlation_delta,
        correlation_error, column_scores, statistical_score, null_rates, constants, domain_overlap, novel_categories,
        cardinality, duplicate_rates, structural_score, structural_warnings, pearson_matrix, spearman_matrix,
        average_ranks, cramers_v, cramers_v_many, cramers_v_two_by_two, correlation_ratio, target_association, relationship_score,
        column_moments,
    )
}

_CELLS = f"{PAIR}, m AS ({melt('b', NUMBERS, 'DOUBLE', 'side')})"
_TEXT = f"{PAIR}, m AS ({melt('b', TEXTS, 'VARCHAR', 'side')})"
_SIDES = (
    "f AS (SELECT \"column\", value, count(*) FILTER (side = 'real') AS nr, count(*) FILTER (side = 'synth') AS ns"
    " FROM m GROUP BY ALL)"
)
_KS = f"""{_SIDES},
    c AS (SELECT "column", sum(nr) OVER w AS cr, sum(ns) OVER w AS cs, sum(nr) OVER (PARTITION BY "column") AS tr,
                 sum(ns) OVER (PARTITION BY "column") AS ts FROM f WINDOW w AS (PARTITION BY "column" ORDER BY value)),
    ks AS (SELECT "column", round(max(abs(cr::DOUBLE / tr - cs::DOUBLE / ts)), 6) AS statistic FROM c GROUP BY 1)"""
_MV = """mv0 AS (SELECT "column", avg(value) FILTER (side = 'real') AS rm, avg(value) FILTER (side = 'synth') AS sm,
                var_samp(value) FILTER (side = 'real') AS rv, var_samp(value) FILTER (side = 'synth') AS sv FROM m GROUP BY 1),
    mv AS (SELECT "column", round(rm, 4) AS real_mean, round(sm, 4) AS synth_mean,
                  round(abs(rm - sm) / (abs(rm) + 1e-10::DOUBLE) * 100, 2) AS mean_deviation_pct,
                  round(rv, 4) AS real_variance, round(sv, 4) AS synth_variance,
                  round(sv / (rv + 1e-10::DOUBLE), 4) AS variance_ratio FROM mv0)"""
_CHI = f"""{_SIDES.replace('f AS', 'g AS').replace('FROM m', 'FROM mt')},
    t AS (SELECT "column", sum(nr)::DOUBLE AS tr, sum(ns)::DOUBLE AS ts, count(*) AS k FROM g GROUP BY 1),
    x AS (SELECT g."column", k AS categories,
                 sum((ns * (tr / (ts + 1e-10::DOUBLE)) + 0.001::DOUBLE - nr - 0.001::DOUBLE) ** 2 / (nr + 0.001::DOUBLE)) AS statistic
          FROM g JOIN t ON g."column" = t."column" GROUP BY 1, 2)"""
# a statistic below 1 on at least one degree of freedom has p > 0.3; above 200 on at most ten, p < 1e-6
_CHI_SIMILAR = "CASE WHEN statistic < 1 THEN true WHEN statistic > 200 THEN false END"
_BOTH_KINDS = f"{_CELLS}, mt AS ({melt('b', TEXTS, 'VARCHAR', 'side')})"
_SCORES = f"""{_KS}, {_MV}, {_CHI},
    raw AS (SELECT ks."column", 'numerical' AS type,
                   greatest(0, 100 - statistic * 200) * 0.6::DOUBLE + greatest(0, 100 - mean_deviation_pct) * 0.4::DOUBLE AS score
            FROM ks JOIN mv ON ks."column" = mv."column"
            UNION ALL SELECT "column", 'categorical', CASE WHEN {_CHI_SIMILAR} THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END FROM x)"""


def _corr_cells(columns, matrix="cells"):
    """SQL: all cells of both Pearson matrices over the CTEs r and s."""
    parts = []
    for a in columns:
        for b in columns:
            value = (
                f"CASE WHEN var_samp({a}) > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END" if a == b else f"coalesce(corr({a}, {b}), 0)"
            )
            parts.append(
                f"SELECT '{a}' AS col_i, '{b}' AS col_j, (SELECT {value} FROM r) AS rv, (SELECT {value} FROM s) AS sv"
            )
    return f"{matrix} AS ({' UNION ALL '.join(parts)})"


def _rank(column, source, other):
    """SQL: average rank of a column over the rows where both columns are present."""
    return (
        f"(rank() OVER (ORDER BY {column}) + (count(*) OVER (PARTITION BY {column}) - 1) / 2.0::DOUBLE)"
    )


def _spearman_cells(columns):
    parts = []
    for a, b in combinations(columns, 2):
        side = lambda s: (
            f"(SELECT corr(x, y) FROM (SELECT {_rank(a, s, b)} AS x, {_rank(b, s, a)} AS y FROM {s}"
            f" WHERE {a} IS NOT NULL AND {b} IS NOT NULL))"
        )
        parts.append(f"SELECT '{a}' AS col_i, '{b}' AS col_j, {side('r')} AS rv, {side('s')} AS sv")
    upper = f"u AS ({' UNION ALL '.join(parts)})"
    diagonal = " UNION ALL ".join(f"SELECT '{c}', '{c}', 1.0::DOUBLE, 1.0::DOUBLE" for c in columns)
    return f"{upper}, sp AS (SELECT * FROM u UNION ALL SELECT col_j, col_i, rv, sv FROM u UNION ALL {diagonal})"


def _v(source, a, b):
    """SQL: bias-corrected V of a dense table larger than 2 x 2, or 2 x 2 with the continuity correction."""
    return f"""(
        WITH j AS (SELECT CAST({a} AS VARCHAR) AS a, CAST({b} AS VARCHAR) AS b, count(*)::DOUBLE AS n FROM {source}
                   WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY 1, 2),
        ma AS (SELECT a, sum(n) AS na FROM j GROUP BY 1), mb AS (SELECT b, sum(n) AS nb FROM j GROUP BY 1),
        g AS (SELECT ma.a, mb.b, na, nb, coalesce(n, 0) AS o, (SELECT sum(n) FROM j) AS t
              FROM ma CROSS JOIN mb LEFT JOIN j ON j.a = ma.a AND j.b = mb.b),
        q AS (SELECT (SELECT count(*) FROM ma)::DOUBLE AS r, (SELECT count(*) FROM mb)::DOUBLE AS k, max(t) AS n,
                     sum((o - na * nb / t) ** 2 / (na * nb / t)) AS plain,
                     sum(greatest(0, abs(o - na * nb / t) - 0.5::DOUBLE) ** 2 / (na * nb / t)) AS yates FROM g),
        z AS (SELECT r, k, n, greatest(0, (CASE WHEN r = 2 AND k = 2 THEN yates ELSE plain END) / n - (k - 1) * (r - 1) / (n - 1)) AS phi FROM q)
        SELECT least(1.0::DOUBLE, sqrt(phi / least(k - (k - 1) ** 2 / (n - 1) - 1, r - (r - 1) ** 2 / (n - 1) - 1))) FROM z)"""


def _eta(source, category, number):
    return f"""(
        WITH v AS (SELECT coalesce(CAST({category} AS VARCHAR), 'nan') AS c, CAST({number} AS DOUBLE) AS x FROM {source} WHERE {number} IS NOT NULL),
        a AS (SELECT avg(x) AS m, var_samp(x) AS s, count(*) AS n FROM v),
        l AS (SELECT c, avg(x) AS mc, count(*) AS nc FROM v GROUP BY c)
        SELECT least(1.0::DOUBLE, sqrt(sum(nc * (mc - m) ** 2) / max(n) / max(s))) FROM l, a)"""


_TARGETS = " UNION ALL ".join(
    [f"SELECT 'l_linestatus' AS \"column\", 'cramers_v' AS method, {_v('r', TARGET, 'l_linestatus')} AS rv, {_v('s', TARGET, 'l_linestatus')} AS sv"]
    + [f"SELECT '{n}', 'eta', {_eta('r', TARGET, n)}, {_eta('s', TARGET, n)}" for n in NUMBERS]
)
_DELTAS = "round(rv, {d}) AS real_value, round(sv, {d}) AS synth_value, round(abs(rv - sv), {d}) AS delta"
_DOMAIN = f"""{_SIDES}, d AS (SELECT "column", count(*) FILTER (nr > 0) AS real_categories, count(*) FILTER (ns > 0) AS synth_categories,
    count(*) FILTER (ns > 0 AND nr = 0) AS novel_categories, (count(*) FILTER (nr > 0 AND ns > 0))::DOUBLE / count(*) AS o FROM f GROUP BY 1)"""
_CARDINALITY = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", (SELECT count(DISTINCT {c}) FROM r) AS rc, (SELECT count(DISTINCT {c}) FROM s) AS sc" for c in COLUMNS
)
_NULLS = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", (SELECT avg(CASE WHEN {c} IS NULL THEN 1.0::DOUBLE ELSE 0 END) FROM r) AS rn,"
    f" (SELECT avg(CASE WHEN {c} IS NULL THEN 1.0::DOUBLE ELSE 0 END) FROM s) AS sn" for c in COLUMNS
)
_DUPLICATES = """du AS (SELECT 1 - (SELECT count(*) FROM (SELECT DISTINCT * FROM r))::DOUBLE / (SELECT count(*) FROM r) AS rd,
    1 - (SELECT count(*) FROM (SELECT DISTINCT * FROM s))::DOUBLE / (SELECT count(*) FROM s) AS sd)"""
_GRADE = "CASE WHEN {0} >= 90 THEN 'A' WHEN {0} >= 75 THEN 'B' WHEN {0} >= 60 THEN 'C' WHEN {0} >= 40 THEN 'D' ELSE 'F' END"
_STATUS = "CASE WHEN {0} >= 75 THEN 'passed' WHEN {0} >= 50 THEN 'warning' ELSE 'failed' END"

ORACLES = {
    "ks_statistic": f"{_CELLS}, {_KS} SELECT * FROM ks",
    "ks_p_value_exact": f"""
        WITH RECURSIVE r AS ({FEW_REAL}), s AS ({FEW_SYNTH}),
        x AS ({" UNION ALL ".join(f"SELECT '{c}' AS \"column\", {c} AS value, 1 AS a, 0 AS b FROM r WHERE {c} IS NOT NULL UNION ALL SELECT '{c}', {c}, 0, 1 FROM s" for c in SEGMENTS)}),
        c AS (SELECT "column", sum(a) OVER w AS ca, sum(b) OVER w AS cb, sum(a) OVER (PARTITION BY "column") AS ta, sum(b) OVER (PARTITION BY "column") AS tb
              FROM x WINDOW w AS (PARTITION BY "column" ORDER BY value)),
        k AS (SELECT "column", max(abs(ca::DOUBLE / ta - cb::DOUBLE / tb)) AS d, CAST(least(max(ta), max(tb)) AS BIGINT) AS n, CAST(greatest(max(ta), max(tb)) AS BIGINT) AS m FROM c GROUP BY 1),
        z AS (SELECT "column", d, n, m, n // gcd(n, m) AS un, m // gcd(n, m) AS um, CAST(round(d * (n // gcd(n, m)) * m) AS BIGINT) AS width FROM k),
        -- v[i + 1]: share of the lattice paths to (i, step - i) that have left the band
        p AS (SELECT *, 0::BIGINT AS step, list_transform(range(0, n + 1), lambda i: 0.0::DOUBLE) AS v FROM z
              UNION ALL SELECT "column", d, n, m, un, um, width, step + 1, list_transform(range(0, n + 1), lambda i:
                CASE WHEN i > step + 1 OR i < step + 1 - m THEN 0.0::DOUBLE WHEN abs(i * um - (step + 1 - i) * un) >= width THEN 1.0::DOUBLE
                     ELSE (CASE WHEN i > 0 THEN i * v[i] ELSE 0.0::DOUBLE END + (step + 1 - i) * v[i + 1]) / (step + 1) END) FROM p WHERE step < n + m)
        SELECT "column", round(d, 6) AS statistic, round(v[n + 1], 6) AS p_value, v[n + 1] > 0.05::DOUBLE AS similar FROM p WHERE step = n + m""",
    "ks_p_value": f"""{_CELLS}, {_KS},
        k0 AS (SELECT "column", max(abs(cr::DOUBLE / tr - cs::DOUBLE / ts)) AS d, max(tr)::DOUBLE * max(ts)::DOUBLE / (max(tr)::DOUBLE + max(ts)::DOUBLE) AS size FROM c GROUP BY 1),
        k1 AS (SELECT "column", d, d * sqrt(size) + 1 / (6 * sqrt(size)) + (d * sqrt(size) - 1) / (4 * size) AS z FROM k0),
        k2 AS (SELECT "column", any_value(d) AS d, CASE WHEN any_value(z) < 0.2 THEN 1.0::DOUBLE
                      ELSE least(1.0::DOUBLE, greatest(0.0::DOUBLE, 2 * sum((CASE WHEN j % 2 = 1 THEN 1 ELSE -1 END) * exp(-2.0::DOUBLE * j * j * z * z)))) END AS p
               FROM k1, range(1, 101) AS t(j) GROUP BY 1)
        SELECT "column", round(d, 6) AS statistic, round(p, 6) AS p_value, p > 0.05 AS similar FROM k2""",
    "mean_variance": f"{_CELLS}, {_MV} SELECT * FROM mv",
    "chi_square": f"{_TEXT.replace('m AS', 'mt AS')}, {_CHI} SELECT \"column\", categories, printf('%.7e', round(statistic, 6)) AS statistic, {_CHI_SIMILAR} AS similar FROM x",
    "histogram": f"""{_CELLS}, l AS (SELECT "column", min(value) AS lo, max(value) AS hi, (max(value) - min(value)) / 30.0::DOUBLE AS w,
            count(*) FILTER (side = 'real') AS rn, count(*) FILTER (side = 'synth') AS sn FROM m GROUP BY 1),
        g AS (SELECT m."column", side, value, lo, w, least(29, CAST(floor((value - lo) / w) AS INTEGER)) AS i FROM m JOIN l ON m."column" = l."column"),
        p AS (SELECT "column", side, CASE WHEN i > 0 AND value < lo + i * w THEN i - 1
                 WHEN i < 29 AND value >= lo + (i + 1) * w THEN i + 1 ELSE i END AS bin FROM g),
        c AS (SELECT "column", bin, count(*) FILTER (side = 'real') AS r, count(*) FILTER (side = 'synth') AS s FROM p GROUP BY 1, 2)
        SELECT l."column", CAST(t.bin AS INTEGER) AS bin,
               round((lo + t.bin * w + CASE WHEN t.bin = 29 THEN hi ELSE lo + (t.bin + 1) * w END) / 2, 4) AS center,
               round(coalesce(r, 0) / (rn * w), 6) AS real_density, round(coalesce(s, 0) / (sn * w), 6) AS synth_density
        FROM l CROSS JOIN range(30) AS t(bin) LEFT JOIN c ON c."column" = l."column" AND c.bin = t.bin""",
    "category_shares": f"""{_TEXT}, {_SIDES} SELECT "column", value AS category, round(nr::DOUBLE / sum(nr) OVER (PARTITION BY "column"), 4) AS real_proportion,
        round(ns::DOUBLE / sum(ns) OVER (PARTITION BY "column"), 4) AS synth_proportion FROM f""",
    "correlation_delta": f"{PAIR}, {_corr_cells(NUMBERS)} SELECT col_i, col_j, round(rv, 6) AS real_r, round(sv, 6) AS synth_r, round(abs(rv - sv), 6) AS delta FROM cells",
    "correlation_error": f"{PAIR}, {_corr_cells(NUMBERS)} SELECT round(avg(abs(rv - sv)), 6) AS mean_absolute_error, round(max(abs(rv - sv)), 6) AS max_absolute_error FROM cells",
    "column_scores": f"{_BOTH_KINDS}, {_SCORES} SELECT \"column\", type, round(score, 2) AS quality_score FROM raw",
    "statistical_score": f"""{_BOTH_KINDS}, {_SCORES}, {_corr_cells(NUMBERS)},
        e AS (SELECT round(avg(abs(rv - sv)), 6) AS mae, round(max(abs(rv - sv)), 6) AS top FROM cells),
        o AS (SELECT round(avg(score), 2) AS score FROM (SELECT score FROM raw UNION ALL SELECT greatest(0, 100 - mae * 200) FROM e))
        SELECT score, {_GRADE.format('score')} AS grade, {_STATUS.format('score')} AS status, 7 AS num_columns_analyzed,
               5 AS num_numeric, 2 AS num_categorical, mae AS correlation_mae, top AS correlation_max_error,
               round(greatest(0, 100 - mae * 200), 2) AS correlation_quality_score FROM o, e""",
    "null_rates": f"{PAIR}, n AS ({_NULLS}) SELECT \"column\", round(rn, 4) AS real_null_rate, round(sn, 4) AS synth_null_rate, round(abs(rn - sn), 4) AS diff FROM n",
    "constants": f"""{PAIR}, k AS (SELECT max(l_linenumber) AS top FROM s)
        SELECT 'region' AS "column", 'EU' AS real_value, 'EU' AS synth_value, true AS preserved FROM k
        UNION ALL SELECT 'version', '3', '4', false FROM k
        UNION ALL SELECT 'unit', 'kg', (SELECT min(CASE WHEN l_linenumber = 5 THEN 'lb' ELSE 'kg' END) FROM s),
            (SELECT count(*) FROM s WHERE l_linenumber = 5) = 0 FROM k""",
    "domain_overlap": f"{_TEXT}, {_DOMAIN} SELECT \"column\", real_categories, synth_categories, novel_categories, round(o, 4) AS overlap FROM d",
    "novel_categories": f"{_TEXT}, {_SIDES} SELECT \"column\", value AS category, ns AS n_synth FROM f WHERE nr = 0 AND ns > 0",
    "cardinality": f"{PAIR}, c AS ({_CARDINALITY}) SELECT \"column\", rc AS real_cardinality, sc AS synth_cardinality, round(abs(rc - sc)::DOUBLE / greatest(rc, 1), 4) AS relative_diff FROM c",
    "duplicate_rates": f"{PAIR}, {_DUPLICATES} SELECT round(rd, 6) AS real_rate, round(sd, 6) AS synth_rate, round(abs(rd - sd), 6) AS diff FROM du",
    "structural_score": f"""{_TEXT}, {_DOMAIN}, n AS ({_NULLS}), c AS ({_CARDINALITY}), {_DUPLICATES},
        k AS (SELECT (SELECT avg(abs(rn - sn)) FROM n) AS md, (SELECT avg(o) FROM d) AS ov,
                     (SELECT avg(least(1.0::DOUBLE, abs(rc - sc)::DOUBLE / greatest(rc, 1))) FROM c) AS cd, rd, sd, abs(rd - sd) AS dd FROM du),
        q AS (SELECT *, round(25 + 20 + 100 * (1 - md) * 0.2::DOUBLE + 10 + ov * 15 + 100 * (1 - dd) * 0.1::DOUBLE, 2) AS score FROM k)
        SELECT score, CASE WHEN score >= 80 THEN 'passed' WHEN score >= 60 THEN 'warning' ELSE 'failed' END AS status,
               7 AS column_count_real, 7 AS column_count_synth, 7 AS common_columns_count, 0 AS missing_columns, 0 AS extra_columns,
               1.0::DOUBLE AS column_preservation_rate, 1.0::DOUBLE AS dtype_match_rate, round(md, 4) AS mean_missing_difference,
               1.0::DOUBLE AS constant_preservation_rate, round(ov, 4) AS categorical_domain_overlap,
               round(cd, 4) AS mean_cardinality_diff_ratio, round(rd, 4) AS real_duplicate_rate,
               round(sd, 4) AS synth_duplicate_rate, round(dd, 4) AS duplicate_rate_diff FROM q""",
    "structural_warnings": f"""{_TEXT}, {_DOMAIN} SELECT 'structural' AS pillar,
        printf('Column ''%s'' introduced %d novel categories not in real data.', "column", novel_categories) AS message FROM d WHERE novel_categories > 0""",
    "pearson_matrix": f"{PAIR}, {_corr_cells(NUMBERS)} SELECT col_i, col_j, {_DELTAS.format(d=6)} FROM cells",
    "spearman_matrix": f"{PAIR}, {_spearman_cells(RANKED)} SELECT col_i, col_j, {_DELTAS.format(d=6)} FROM sp",
    "average_ranks": " UNION ALL ".join(
        f"SELECT DISTINCT '{c}' AS \"column\", CAST({c} AS DOUBLE) AS value, {_rank(c, 'customer', c)} AS rank FROM customer"
        for c in ("c_acctbal", "c_nationkey")),
    "cramers_v": f"{PAIR}, v AS (SELECT 'l_returnflag' AS col_i, 'l_linestatus' AS col_j, {_v('r', *TEXTS)} AS rv, {_v('s', *TEXTS)} AS sv) SELECT col_i, col_j, {_DELTAS.format(d=6)} FROM v",
    "cramers_v_many": f"""
        WITH o AS ({MANY_TEXTS}), x AS (SELECT row_number() OVER () AS id, * FROM o),
        w AS ({melt("x", list(MANY), "VARCHAR", "id")}),
        p AS (SELECT i, j FROM (VALUES {", ".join(f"('{c}', {k})" for k, c in enumerate(MANY))}) l(i, li),
              (VALUES {", ".join(f"('{c}', {k})" for k, c in enumerate(MANY))}) m(j, mj) WHERE li < mj),
        c AS (SELECT i, j, u.value AS a, v.value AS b, count(*)::DOUBLE AS n
              FROM p JOIN w u ON u."column" = i JOIN w v ON v."column" = j AND v.id = u.id GROUP BY ALL),
        ma AS (SELECT i, j, a, sum(n) AS na FROM c GROUP BY ALL), mb AS (SELECT i, j, b, sum(n) AS nb FROM c GROUP BY ALL),
        t AS (SELECT i, j, sum(n) AS t FROM c GROUP BY ALL),
        g AS (SELECT ma.i, ma.j, ma.a, mb.b, na * nb / t AS e, coalesce(n, 0) AS o, t
              FROM ma JOIN mb ON ma.i = mb.i AND ma.j = mb.j JOIN t ON t.i = ma.i AND t.j = ma.j
              LEFT JOIN c ON c.i = ma.i AND c.j = ma.j AND c.a = ma.a AND c.b = mb.b),
        q AS (SELECT i, j, count(DISTINCT a)::DOUBLE AS r, count(DISTINCT b)::DOUBLE AS k, max(t) AS n, sum((o - e) ** 2 / e) AS plain,
                     sum(greatest(0, abs(o - e) - 0.5::DOUBLE) ** 2 / e) AS yates FROM g GROUP BY 1, 2),
        z AS (SELECT i, j, r, k, n, greatest(0, (CASE WHEN r = 2 AND k = 2 THEN yates ELSE plain END) / n - (k - 1) * (r - 1) / (n - 1)) AS phi FROM q)
        SELECT i AS col_i, j AS col_j,
               round(least(1.0::DOUBLE, sqrt(phi / least(k - (k - 1) ** 2 / (n - 1) - 1, r - (r - 1) ** 2 / (n - 1) - 1))), 6) AS v FROM z""",
    "cramers_v_two_by_two": f"SELECT 'quality' AS col_i, 'toxic' AS col_j, round({_v('labels', 'quality', 'toxic')}, 6) AS v",
    "correlation_ratio": f"{PAIR} " + " UNION ALL ".join(
        f"SELECT '{t}' AS col_i, '{n}' AS col_j, round({_eta('s', t, n)}, 6) AS eta" for t in TEXTS for n in NUMBERS),
    "target_association": f"{PAIR}, t AS ({_TARGETS}) SELECT \"column\", method, {_DELTAS.format(d=4)} FROM t",
    "relationship_score": f"""{PAIR}, {_corr_cells(NUMBERS)}, {_spearman_cells(NUMBERS)}, t AS ({_TARGETS}),
        e AS (SELECT (SELECT avg(abs(rv - sv)) FROM cells) AS p, (SELECT avg(abs(rv - sv)) FROM sp) AS q,
                     abs({_v('r', *TEXTS)} - {_v('s', *TEXTS)}) AS c, (SELECT avg(abs(rv - sv)) FROM t) AS a),
        o AS (SELECT *, round((greatest(0, 100 - p * 150) + greatest(0, 100 - q * 150) + greatest(0, 100 - c * 150)
                               + greatest(0, 100 - a * 150)) / 4, 2) AS score FROM e)
        SELECT score, {_STATUS.format('score')} AS status, true AS applicable, round(p, 4) AS pearson_mae, round(q, 4) AS spearman_mae,
               round(c, 4) AS cramers_v_mae, round(a, 4) AS target_association_mae FROM o""",
    "column_moments": f"""{_CELLS} SELECT "column", count(*) AS n, (SELECT count(*) FROM r) - count(*) AS n_missing, round(avg(value), 4) AS mean,
        round(stddev_samp(value), 4) AS std, round(var_samp(value), 4) AS variance, round(min(value), 4) AS min, round(max(value), 4) AS max
        FROM m WHERE side = 'real' GROUP BY 1""",
}
