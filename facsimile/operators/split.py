"""Exact seeded samples and splits that do not depend on the partitioning."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from facsimile.functions import rng
from facsimile.session import cut_lineage

# Bound of audit samples, seed of the published splits
AUDIT_SAMPLE = 5000
SPLIT_SEED = 42

# equal cells that one level cuts an interval of draws into, and how many levels narrow down the cut
_CELLS = 4096
_LEVELS = 2
# strata whose cuts are broadcast: a join by them would move the rows of each to one task
_FEW_STRATA = 100_000


def bounded_sample(df: DataFrame, key: list[str], size: int = AUDIT_SAMPLE, seed=SPLIT_SEED) -> DataFrame:
    """Exactly ``size`` rows, or the whole table when it is no larger: the rows with the smallest draws.

    A distributed top-k: every task keeps its own ``size`` smallest.
    """
    drawn = df.withColumn("_u", rng.uniform(seed, "sample", *key))
    return drawn.orderBy("_u", *key).limit(size).drop("_u")


def split(
    df: DataFrame, key: list[str], test_fraction: float = 0.3, stratify: str | None = None, seed=SPLIT_SEED,
    wanted: str | None = None,
) -> DataFrame:
    """``df`` with ``is_test``: ceil(fraction x n) rows, of the table or of each stratum.

    ``wanted`` names a column with the number itself, the same in all rows of a stratum.

    The cut is found from counts in equal cells of the draw, then in equal cells of the one cell that
    holds it; only keys of the last such cell, one in _CELLS ** _LEVELS, are ranked.  No stratum is ever
    sorted as a whole, however large.  Rows that share a key share a draw and fall on one side
    together, but for those of the key at the cut, which are divided so that the count is exact.
    """
    stratum = F.coalesce(F.col(stratify).cast("string"), F.lit("\0")) if stratify else F.lit("all")
    drawn = df.withColumn("_stratum", stratum).withColumn("_u", rng.uniform(seed, "split", *key))
    whole = Window.partitionBy("_stratum")
    upto = F.sum("n").over(whole.orderBy("_cell").rowsBetween(Window.unboundedPreceding, 0))
    rows, need = drawn, None
    for level in range(1, _LEVELS + 1):
        rows = rows.withColumn("_cell", F.floor(F.col("_u") * F.lit(float(_CELLS**level))).cast("long"))
        keys = ["_stratum", "_cell"] + (["need"] if need is not None else [])
        share = F.max("_asked").over(whole) if wanted else F.ceil(F.lit(float(test_fraction)) * F.sum("n").over(whole))
        need = F.col("need") if level > 1 else share
        # at most _CELLS rows per stratum in this window
        edges = (
            rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), (F.max(wanted) if wanted else F.lit(None)).alias("_asked"))
            .withColumn("upto", upto).withColumn("wanted", need)
            .where((F.col("upto") >= F.col("wanted")) & (F.col("upto") - F.col("n") < F.col("wanted")))
            .select("_stratum", "_cell", (F.col("wanted") - F.col("upto") + F.col("n")).alias("need"))
        )
        # one row a stratum at most
        rows = rows.drop("need").join(_told(cut_lineage(edges)), ["_stratum", "_cell"])
    place = F.struct("_u", *key)
    # rows of one key are one row here: a key that fills a third of the table is no large window
    near = rows.groupBy("_stratum", "need", place.alias("_cut")).agg(F.count(F.lit(1)).alias("n"))
    so_far = F.sum("n").over(Window.partitionBy("_stratum").orderBy("_cut").rowsBetween(Window.unboundedPreceding, 0))
    runs = near.withColumn("upto", so_far).where((F.col("upto") >= F.col("need")) & (F.col("upto") - F.col("n") < F.col("need")))
    cuts = cut_lineage(runs.select("_stratum", "_cut", "n", (F.col("need") - F.col("upto") + F.col("n")).alias("_rest")))
    marked = drawn.join(_told(cuts).select("_stratum", "_cut", "_rest"), "_stratum", "left")
    if not cuts.where(F.col("_rest") < F.col("n")).limit(1).count():
        return marked.select(*df.columns, F.coalesce(place <= F.col("_cut"), F.lit(False)).alias("is_test"))
    at = F.coalesce(place == F.col("_cut"), F.lit(False))
    sure = marked.where(~at).select(*df.columns, F.coalesce(place < F.col("_cut"), F.lit(False)).alias("is_test"))
    return sure.unionByName(_divided(marked.where(at), df.columns))


def _told(strata: DataFrame) -> DataFrame:
    """A written table of one row a stratum, for a join with the rows: broadcast, but where strata are many and so not large."""
    return F.broadcast(strata) if strata.count() <= _FEW_STRATA else strata


def _divided(run: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of the key at the cut, the first ``_rest`` of each stratum for the test: counted by task, numbered
    within it, and carried on from the tasks before."""
    kept = cut_lineage(run.select(*columns, "_stratum", "_rest", F.monotonically_increasing_id().alias("_row"))).withColumn("_task", F.shiftright("_row", 33))
    counts = kept.groupBy("_stratum", "_task").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("_stratum").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col("_stratum").alias("_s"), F.col("_task").alias("_t"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_stratum", "_task").orderBy("_row"))
    numbered = kept.withColumn("_at", inside).join(offsets, (F.col("_stratum") == F.col("_s")) & (F.col("_task") == F.col("_t")))
    return numbered.select(*columns, (F.col("_before") + F.col("_at") <= F.col("_rest")).alias("is_test"))


def split_copies(
    df: DataFrame, key: list[str], copies: str, test_fraction: float = 0.3, stratify: str | None = None, seed=SPLIT_SEED,
) -> DataFrame:
    """``df`` with ``n_train`` and ``n_test``: the ``copies`` of each row divided so that the test has ceil(fraction x all copies),
    of the table or of each stratum.

    Every row gives the whole part of its share; what is missing is one copy more of as many rows, drawn by their key.  A row
    that stands for a third of the table stays one row.
    """
    stratum = F.coalesce(F.col(stratify).cast("string"), F.lit("\0")) if stratify else F.lit("all")
    part = F.floor(F.lit(float(test_fraction)) * F.col(copies)).cast("long")
    shares = df.withColumn("_part", part).withColumn("_of", stratum)
    missing = shares.groupBy("_of").agg((F.ceil(F.lit(float(test_fraction)) * F.sum(copies)) - F.sum("_part")).alias("_missing"))
    marked = split(shares.join(missing, "_of"), key, stratify="_of", seed=seed, wanted="_missing")
    tested = F.col("_part") + F.col("is_test").cast("long")
    return marked.select(*df.columns, (F.col(copies) - tested).alias("n_train"), tested.alias("n_test"))
