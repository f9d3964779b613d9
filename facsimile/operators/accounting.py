"""Rényi accounting and the privacy budget ledger.

The ledger is an append-only table of requests ``(dataset_id, seq, epsilon, delta, operation)``.
Whether a request is admitted depends on all admitted ones before it, so admission is an ordered
fold per dataset.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facsimile.session import cut_lineage

# Orders of the accountant, default budget, warning levels, history length
ALPHA_ORDERS = [1.5, 2, 3, 4, 5, 6, 8, 10, 12, 16, 20, 32, 64, 128, 256]
MAX_EPSILON = 10.0
WARNING_LEVELS = [("critical", 0.9), ("high", 0.75), ("medium", 0.5)]
HISTORY = 20

# groups up to this many requests are folded in one array; longer ones in halving rounds over ranges
FOLD_LIMIT = 2_000
# requests in a range of a long history, which one task folds
RANGE_ROWS = 1 << 16
# budgets are compared in whole millionths of epsilon, so the order of additions cannot matter
MICRO = 1_000_000


def rdp_epsilon(steps: list[tuple[float, float]], delta: float) -> float:
    """Epsilon of composed Gaussian steps ``(sensitivity, sigma)``; 0 without steps."""
    if not steps:
        return 0.0
    total = sum(s * s / (2 * sigma * sigma) for s, sigma in steps)
    return min(a * total + math.log(1 / delta) / (a - 1) for a in ALPHA_ORDERS)


def rdp_by_order(steps: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``(by..., alpha, rdp)``: composed divergence per order of rows ``(by..., sensitivity, sigma)``."""
    by = by or []
    unit = F.col("sensitivity") * F.col("sensitivity") / (F.lit(2.0) * F.col("sigma") * F.col("sigma"))
    # divergence is linear in the order: sum once, then spread over the orders
    summed = steps.groupBy(*by).agg(F.sum(unit).alias("unit"))
    orders = F.array(*[F.lit(float(a)) for a in ALPHA_ORDERS])
    spread = summed.select(*by, "unit", F.explode(orders).alias("alpha"))
    return spread.select(*by, "alpha", (F.col("alpha") * F.col("unit")).alias("rdp"))


def rdp_epsilon_table(steps: DataFrame, delta: float, by: list[str] | None = None) -> DataFrame:
    """``(by..., epsilon, best_alpha)`` of composed Gaussian steps."""
    by = by or []
    candidate = F.col("rdp") + F.lit(math.log(1 / delta)) / (F.col("alpha") - 1.0)
    options = rdp_by_order(steps, by).withColumn("epsilon", candidate)
    return options.groupBy(*by).agg(
        F.min("epsilon").alias("epsilon"), F.min_by("alpha", "epsilon").alias("best_alpha")
    )


def micro(epsilon: Column) -> Column:
    """Epsilon in whole millionths."""
    return F.round(epsilon * F.lit(float(MICRO))).cast("long")


def admit_stated(requests: DataFrame, limit: str) -> DataFrame:
    """``admit`` where each request states, in column ``limit``, the budget it may use up.

    Datasets whose requests all state one budget go the usual way; others are folded as one array each.
    """
    stated = requests.groupBy("dataset_id").agg(F.min(limit).alias("least"), F.max(limit).alias("most"), F.count(F.lit(1)).alias("requests_n"))
    stated = cut_lineage(stated)
    alike = stated.where((F.col("least") == F.col("most")) & (F.col("requests_n") > FOLD_LIMIT))
    found = _admit_short(requests.join(alike, "dataset_id", "left_anti"), micro(F.col(limit)))
    # budgets that long histories state: as a rule one
    for row in alike.select("most").distinct().collect():
        own = requests.join(alike.where(F.col("most") == row["most"]).select("dataset_id"), "dataset_id", "left_semi")
        found = found.unionByName(_admit_long(own, int(round(row["most"] * MICRO))))
    return found


def admit(requests: DataFrame, max_epsilon: float = MAX_EPSILON, fold_limit: int = FOLD_LIMIT) -> DataFrame:
    """``requests`` with ``accepted``: in order, a request is taken iff it still fits its dataset's budget.

    A rejected request consumes nothing.  Datasets with few requests are folded as one short array
    each; longer histories go through ``_admit_long``, which never gathers a dataset in one task.
    """
    budget = int(round(max_epsilon * MICRO))
    sizes = requests.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("requests_n"))
    long = cut_lineage(sizes.where(F.col("requests_n") > fold_limit).select("dataset_id"))
    if not long.limit(1).count():
        return _admit_short(requests, F.lit(budget))
    # one row for each history of more than fold_limit requests: never moves the requests of one to one task
    short = requests.join(F.broadcast(long), "dataset_id", "left_anti")
    return _admit_short(short, F.lit(budget)).unionByName(_admit_long(requests.join(F.broadcast(long), "dataset_id", "left_semi"), budget))


def _admit_short(requests: DataFrame, budget: Column) -> DataFrame:
    others = [c for c in requests.columns if c not in ("dataset_id", "seq")]
    rows = F.array_sort(F.collect_list(F.struct("seq", micro(F.col("epsilon")).alias("cost"), budget.alias("budget"))))

    def step(state: Column, row: Column) -> Column:
        fits = state["used"] + row["cost"] <= row["budget"]
        taken = F.struct(row["seq"].alias("seq"), fits.alias("accepted"))
        return F.struct(
            F.when(fits, state["used"] + row["cost"]).otherwise(state["used"]).alias("used"),
            F.concat(state["log"], F.array(taken)).alias("log"),
        )

    log_type = f"array<struct<seq:{requests.schema['seq'].dataType.simpleString()},accepted:boolean>>"
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast(log_type).alias("log"))
    verdicts = requests.groupBy("dataset_id").agg(rows.alias("rows")).select(
        "dataset_id", F.inline(F.aggregate("rows", start, step, lambda s: s["log"]))
    )
    return requests.join(verdicts, ["dataset_id", "seq"]).select("dataset_id", "seq", *others, "accepted")


def _admit_long(requests: DataFrame, budget: int) -> DataFrame:
    """Exact admission of long histories in rounds that at least halve each dataset's remaining budget.

    With r left, call a request small when it costs at most r/2.  Until the small ones add up to more
    than r/2 they all fit, and a big one fits iff it and the small ones before it stay within r.  The
    first request that pushes the small sum over r/2, or the first big one that fits, is the event.
    Ranges of the order are summed, which leaves few ranges that may hold it; these are folded, each in a
    task of its own, as if no earlier one held it.  The first range that does is taken as folded, the ranges
    before it give their small requests, and a round goes on behind it with at most r/2 left.  A round is
    one pass without a sort of the whole; there are at most log2(budget), two or three where the first range
    spends the budget.
    """
    # one row for each history of more than fold_limit requests at most, so the state of a round is broadcast
    order = F.col("seq").cast("double")
    pending = requests.select("dataset_id", "seq", micro(F.col("epsilon")).alias("cost")).where(F.col("cost") <= budget)
    rows = pending.count()
    parts = -(-rows // RANGE_ROWS)
    cuts = pending.agg(F.percentile_approx(order, [i / parts for i in range(1, parts)], 4 * parts).alias("c")).first()["c"] if parts > 1 else []
    pending = pending.withColumn("bucket", F.lit(0))
    if cuts:
        splits = [float("-inf"), *sorted(set(cuts)), float("inf")]
        placed = Bucketizer(splits=splits, inputCol="_order", outputCol="_range", handleInvalid="keep").transform(pending.withColumn("_order", order))
        pending = placed.withColumn("bucket", F.col("_range").cast("int")).drop("_order", "_range")
    pending = cut_lineage(pending)
    state = cut_lineage(pending.select("dataset_id").distinct().withColumn("r", F.lit(budget).cast("long")).withColumn("at", F.lit(0)))
    seq = requests.schema["seq"].dataType.simpleString()
    key = requests.schema["dataset_id"].dataType.simpleString()
    taken: list[DataFrame] = []
    while state.limit(1).count():
        # what no longer fits never will: the budget only shrinks
        pending = cut_lineage(pending.drop("r").join(F.broadcast(state), "dataset_id").where(
            (F.col("bucket") >= F.col("at")) & (F.col("cost") <= F.col("r"))).drop("at"))
        small = F.col("cost") * 2 <= F.col("r")
        sums = pending.groupBy("dataset_id", "r", "bucket").agg(
            F.coalesce(F.sum(F.when(small, F.col("cost"))), F.lit(0)).alias("small"), F.min(F.when(~small, F.col("cost"))).alias("big"))
        earlier = Window.partitionBy("dataset_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        before = sums.withColumn("before", F.coalesce(F.sum("small").over(earlier), F.lit(0)))
        sure = (F.col("before") + F.col("small")) * 2 > F.col("r")
        # the event is in the first of these ranges that holds one, and in none behind the first sure one
        maybe = sure | (F.col("before") + F.col("big") <= F.col("r"))
        asked = cut_lineage(before.where(maybe & (F.col("before") * 2 <= F.col("r"))).select("dataset_id", "bucket", "before"))
        folded = cut_lineage(
            pending.join(F.broadcast(asked), ["dataset_id", "bucket"]).groupBy("dataset_id", "bucket")
            .applyInPandas(_fold_range, f"dataset_id {key}, bucket int, seq {seq}, left long"))
        # what is left of the budget behind the range, and the range
        turn = folded.groupBy("dataset_id", "bucket").agg(F.min("left").alias("r")).groupBy("dataset_id").agg(
            F.min(F.struct("bucket", "r")).alias("turn"))
        turn = cut_lineage(turn.select("dataset_id", F.col("turn.bucket").alias("turn"), F.col("turn.r").alias("r")))
        ends = F.broadcast(turn.select("dataset_id", "turn"))
        # without an event all small ones fit and no big one does: the dataset is finished
        taken += [
            pending.where(small).join(ends, "dataset_id", "left").where(F.col("turn").isNull() | (F.col("bucket") < F.col("turn"))).select("dataset_id", "seq"),
            folded.join(ends, "dataset_id").where(F.col("bucket") == F.col("turn")).select("dataset_id", "seq"),
        ]
        state = turn.select("dataset_id", "r", (F.col("turn") + 1).alias("at"))
    others = [c for c in requests.columns if c not in ("dataset_id", "seq")]
    if not taken:
        return requests.withColumn("accepted", F.lit(False))
    accepted = reduce(DataFrame.unionByName, taken).withColumn("accepted", F.lit(True))
    flagged = requests.join(accepted, ["dataset_id", "seq"], "left")
    return flagged.select("dataset_id", "seq", *others, F.coalesce("accepted", F.lit(False)).alias("accepted"))


def _fold_range(rows: pd.DataFrame) -> pd.DataFrame:
    """The admitted requests of one range of one dataset and what is left behind it, or nothing where the range holds no event."""
    rows = rows.sort_values("seq")
    cost, r, before = rows["cost"].to_numpy(), int(rows["r"].iloc[0]), int(rows["before"].iloc[0])
    small = cost * 2 <= r
    upto = before + np.cumsum(np.where(small, cost, 0))
    events = np.flatnonzero(np.where(small, upto * 2 > r, upto + cost <= r))
    if not len(events):
        return pd.DataFrame({"dataset_id": [], "bucket": [], "seq": [], "left": []}).astype(rows[["dataset_id", "bucket", "seq"]].dtypes)
    first = int(events[0])
    took = small.copy()
    took[first:] = False
    left = r - before - int(cost[:first][took[:first]].sum())
    for i, c in enumerate(cost[first:].tolist(), first):
        if c <= left:
            took[i], left = True, left - c
    return rows.loc[took, ["dataset_id", "bucket", "seq"]].assign(left=left)


def budget_state(
    ledger: DataFrame, max_epsilon: float = MAX_EPSILON, registry: DataFrame | None = None,
) -> DataFrame:
    """One row per dataset: used, remaining, utilisation, warning level, number of admitted requests.

    With a ``registry`` of dataset ids, datasets without a request are listed with a fresh budget.
    """
    accepted = ledger.where("accepted") if "accepted" in ledger.columns else ledger
    budget = int(round(max_epsilon * MICRO))
    used = accepted.groupBy("dataset_id").agg(
        F.sum(micro(F.col("epsilon"))).alias("used"),
        F.sum("delta").alias("delta"), F.count(F.lit(1)).alias("num_queries"),
    )
    known = registry if registry is not None else ledger
    state = known.select("dataset_id").distinct().join(used, "dataset_id", "left").withColumn(
        "used", F.coalesce("used", F.lit(0))
    )
    # whole-number arithmetic: a share that ends in a five is rounded up whatever its binary form
    hundredths = F.expr(f"(20000 * least(used, {budget}) + {budget}) div {2 * budget}")
    share = F.col("used") / F.lit(float(budget))
    warning = F.lit(None).cast("string")
    for name, bound in reversed(WARNING_LEVELS):
        warning = F.when(share >= bound, F.lit(name)).otherwise(warning)
    epsilon = lambda m: (m / F.lit(float(MICRO)))
    return state.select(
        "dataset_id", F.lit(float(max_epsilon)).alias("max_epsilon"),
        epsilon(F.col("used")).alias("total_epsilon_used"),
        F.round(F.coalesce("delta", F.lit(0.0)), 10).alias("total_delta_used"),
        epsilon(F.greatest(F.lit(0), F.lit(budget) - F.col("used"))).alias("remaining_epsilon"),
        (hundredths / F.lit(100.0)).alias("utilization_pct"),
        warning.alias("warning_level"), F.coalesce("num_queries", F.lit(0)).alias("num_queries"),
    )


def budget_history(ledger: DataFrame, last: int = HISTORY) -> DataFrame:
    """The last admitted requests per dataset with the budget used up to each.

    Ranked from the newest, so the limit is applied inside every task before the shuffle; the running
    total counts back from the dataset's total over these few rows.
    """
    accepted = ledger.where("accepted") if "accepted" in ledger.columns else ledger
    newest = Window.partitionBy("dataset_id").orderBy(F.desc("seq"))
    recent = accepted.withColumn("back", F.row_number().over(newest)).where(F.col("back") <= last)
    totals = accepted.groupBy("dataset_id").agg(F.sum(micro(F.col("epsilon"))).alias("total"))
    later = newest.rowsBetween(Window.unboundedPreceding, -1)
    spent_later = F.coalesce(F.sum(micro(F.col("epsilon"))).over(later), F.lit(0))
    return recent.join(totals, "dataset_id").withColumn("later", spent_later).select(
        "dataset_id", "seq", "epsilon", "delta", "operation",
        ((F.col("total") - F.col("later")) / F.lit(float(MICRO))).alias("cumulative_epsilon"),
    )
