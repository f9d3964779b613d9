"""Drawing synthetic rows from a fitted model, as column expressions over a row number."""

from __future__ import annotations

from itertools import accumulate

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from facsimile.functions import rng
from facsimile.operators.model import Model
from facsimile.operators.prefix import running_totals, text_bounds, text_range
from facsimile.session import shuffle_width

# domains up to this many values are carried inside the plan; larger ones are joined, with the same draws
INLINE_DOMAIN = 256
# one whole probability in weight units; running sums of weights are whole numbers that doubles hold exactly
WEIGHT_UNIT = 2.0**52
ROW = "row_id"


def correlation_factor(columns: list[str], corr: dict[tuple[str, str], float]) -> np.ndarray:
    """Lower triangular factor of the k x k correlation matrix; identity when it is not positive definite."""
    k = len(columns)
    matrix = np.eye(k) * (1.0 + 1e-6)
    for i, a in enumerate(columns):
        for j, b in enumerate(columns):
            if i != j:
                matrix[i, j] = corr.get((a, b), corr.get((b, a), 0.0))
    try:
        return np.linalg.cholesky(matrix)
    except np.linalg.LinAlgError:
        return np.eye(k)


def correlated_normals(columns: list[str], corr: dict[tuple[str, str], float], draws: rng.Draws) -> dict[str, Column]:
    """Standard normals with the given correlations, as sums over independent ones: each is drawn once, however often it is mixed."""
    plain = [rng.normal(draws, f"normal:{c}", ROW) for c in columns]
    factor = correlation_factor(columns, corr) if len(columns) > 1 and corr else np.eye(len(columns))
    mixed = {}
    for i, c in enumerate(columns):
        terms = [F.lit(float(factor[i, j])) * plain[j] for j in range(i + 1) if factor[i, j] != 0.0]
        total = terms[0]
        for term in terms[1:]:
            total = total + term
        mixed[c] = total
    return mixed


def clipped(normal: Column, mean: float, std: float, low: float, high: float) -> Column:
    value = normal * F.lit(float(std)) + F.lit(float(mean))
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), value))


def numeric_draw(param: dict, normal: Column) -> Column:
    value = clipped(normal, param["mean"], param["std"], param["low"], param["high"])
    if param["is_integer"]:
        value = F.bround(value, 0)
    return value.cast(param["data_type"])


def datetime_draw(param: dict, normal: Column) -> Column:
    seconds = F.floor(clipped(normal, param["mean"], param["std"], param["low"], param["high"]))
    moment = F.timestamp_add("SECOND", seconds, F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")))
    if param["data_type"] == "string":
        return F.date_format(moment, "yyyy-MM-dd HH:mm:ss" if param["with_time"] else "yyyy-MM-dd")
    return moment.cast(param["data_type"])


def boolean_draw(param: dict, seed) -> Column:
    p = min(1.0, max(0.0, param["p_true"]))
    hit = rng.uniform(seed, f"boolean:{param['column']}", ROW) < F.lit(p)
    if param["data_type"] == "string":
        return F.when(hit, F.lit("1")).otherwise(F.lit("0"))
    return hit if param["data_type"] == "boolean" else hit.cast("int").cast(param["data_type"])


def constant_draw(param: dict) -> Column:
    return F.lit(param.get("constant")).cast(param["data_type"])


def joined_text_draw(rows: DataFrame, name: str, pool: DataFrame | None, seed) -> DataFrame:
    """Uniform over the numbered texts of a pool of any size, released verbatim; an empty text where there is none.

    Rows meet their text by its number.  Numbers are drawn uniformly, so no text is a hot key of the join.
    """
    size = pool.count() if pool is not None else 0
    if not size:
        return rows.withColumn(name, F.lit(""))
    texts = pool.select(F.col("place").cast("long").alias("_place"), F.col("value").alias(name))
    drawn = rows.withColumn("_place", F.floor(rng.uniform(seed, f"text:{name}", ROW) * F.lit(size)).cast("long") + 1)
    return drawn.join(texts, "_place").drop("_place")


def inline_category_draw(name: str, levels: list[tuple[str, float]], seed) -> Column:
    """Inverse CDF over a small domain, categories in text order; the cuts are those of ``joined_category_draw``."""
    levels = sorted(levels)
    sums = list(accumulate(max(1, int(np.rint(p * WEIGHT_UNIT))) for _, p in levels))
    bounds = [float(s) / float(sums[-1]) for s in sums]
    u = rng.uniform(seed, f"category:{name}", ROW)
    place = F.size(F.filter(F.array(*[F.lit(float(b)) for b in bounds[:-1]]), lambda b: b <= u)) \
        if len(levels) > 1 else F.lit(0)
    return F.get(F.array(*[F.lit(c) for c, _ in levels]), place)


def joined_category_draw(rows: DataFrame, name: str, probs: DataFrame, seed) -> DataFrame:
    """Inverse CDF over a domain of any size.

    Categories in text order own neighbouring stretches of [0, 1), cut at running sums of whole weights,
    so that neighbours share their cut.  The unit is divided into equal cells; a category is listed in
    the cells its stretch touches and a row meets it through the cell of its draw, an equi-join.  Draws
    are uniform, so cells hold equally many rows however skewed the categories are.
    """
    weight = F.greatest(F.lit(1), F.rint(F.col("p") * F.lit(WEIGHT_UNIT)).cast("long"))
    weights = probs.select("category", weight.alias("w"))
    size = weights.agg(F.sum("w").alias("total"), F.count(F.lit(1)).alias("levels")).first()
    total, cells = float(size["total"] or 1), max(shuffle_width(rows.sparkSession), 4 * size["levels"])
    spread = running_totals(weights, [], text_range(F.col("category"), text_bounds(weights, "category")), ["category"], ["w"])
    low, high = F.col("w_before").cast("double") / total, (F.col("w_before") + F.col("w")).cast("double") / total
    cell_of = lambda point: F.least(F.lit(cells - 1), F.floor(point * F.lit(float(cells))).cast("long"))
    intervals = spread.select(F.col("category").alias(name), low.alias("_low"), high.alias("_high")).withColumn(
        "_cell", F.explode(F.sequence(cell_of(F.col("_low")), cell_of(F.col("_high")))))
    drawn = rows.withColumn("_place", rng.uniform(seed, f"category:{name}", ROW)).withColumn("_cell", cell_of(F.col("_place")))
    met = drawn.join(intervals, "_cell").where((F.col("_low") <= F.col("_place")) & (F.col("_place") < F.col("_high")))
    return met.drop("_place", "_cell", "_low", "_high")


def with_missing(value: Column, name: str, rate: float | None, seed) -> Column:
    """Null where the draw falls under the missing rate."""
    if rate is None or not 0.0 < rate < 1.0:
        return value
    return F.when(rng.uniform(seed, f"missing:{name}", ROW) >= F.lit(float(rate)), value)


def small_domains(model: Model) -> tuple[dict[str, list[tuple[str, float]]], list[str]]:
    """Categorical columns whose levels fit the plan, with their levels; and the names of the others."""
    names = [p["column"] for p in model.of_kind("categorical")]
    if not names:
        return {}, []
    sizes = {
        r["column"]: r["n"]
        for r in model.probs.groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()
    }
    small = [c for c in names if sizes.get(c, 0) <= INLINE_DOMAIN]
    levels: dict[str, list[tuple[str, float]]] = {c: [] for c in small}
    if small:
        for r in model.probs.where(F.col("column").isin(small)).collect():
            levels[r["column"]].append((r["category"], r["p"]))
    return levels, [c for c in names if c not in small]


def sample(model: Model, spark: SparkSession, num_rows: int, seed=None, keep_row_id: bool = False) -> DataFrame:
    """``num_rows`` synthetic rows.  Row i depends on (seed, i) only, so any partitioning gives the same table."""
    seed = rng.fresh_seed() if seed is None else seed
    rows = spark.range(num_rows).withColumnRenamed("id", ROW)
    levels, large = small_domains(model)
    by_name = {p["column"]: p for p in model.params}
    for name in large:
        rows = joined_category_draw(rows, name, model.probs.where(F.col("column") == name), seed)
    for p in model.of_kind("text"):
        rows = joined_text_draw(rows, p["column"], model.pools.get(p["column"]), seed)
    spread = [p["column"] for p in model.of_kind("numeric", "datetime")]
    draws = rng.Draws(seed)
    normals = correlated_normals(spread, model.corr, draws)

    def draw(p: dict) -> Column:
        name, kind = p["column"], p["kind"]
        if kind == "numeric":
            return numeric_draw(p, normals[name])
        if kind == "datetime":
            return datetime_draw(p, normals[name])
        if kind == "boolean":
            return boolean_draw(p, draws)
        if kind == "constant":
            return constant_draw(p)
        if name in levels:
            return inline_category_draw(name, levels[name] or [("", 1.0)], draws).cast(p["data_type"])
        return F.col(name).cast(p["data_type"])

    cells = [with_missing(draw(by_name[c]), c, by_name[c]["missing_rate"], draws).alias(c) for c in model.columns]
    return draws.over(rows).select(*([ROW] if keep_row_id else []), *cells)


def inject_nulls(df: DataFrame, rates: dict[str, float], seed, key: list[str]) -> DataFrame:
    """Null out cells of an existing table at the given rates, by row key."""
    def cell(name: str) -> Column:
        rate = rates.get(name, 0.0)
        if not 0.0 < rate < 1.0:
            return F.col(name)
        return F.when(rng.uniform(seed, f"missing:{name}", *key) >= F.lit(float(rate)), F.col(name)).alias(name)
    return df.select(*[cell(c) for c in df.columns])
