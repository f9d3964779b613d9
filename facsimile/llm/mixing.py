"""Mixing sources to target weights by temperature.

A source's weight is its token share to the power of an exponent in [0, 1], normalised: 1 keeps the
natural shares, 0 gives all sources the same.  The exponent is found by bisection: the largest whose
entropy meets the target, raised if need be to the smallest that no source is repeated more often than
the limit.  Five halvings are answered by one aggregate over the table of sources, which stays
distributed: only sums over it reach the driver.

The weights are then realised exactly and without a global sort.  The documents of a source stand in a
permutation given by the md5 of seed, id and text; it is cut into blocks of about ``block_tokens`` tokens.
A source takes its whole permutation as many times as its budget holds, then whole blocks from the
start, then documents of one block up to what is left.  Only that one block is ordered by row.

Only DataFrame expressions are used.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from facsimile.llm.common import columns_but, free_name, stored

LEVELS, JOBS = 5, 6  # halvings by job, jobs
DIGITS = 6  # of the exponent


@dataclass(frozen=True)
class Target:
    """``entropy``: share of the largest possible entropy, log(sources), to reach.  ``repeats``: most passes over a source.

    ``budget``: tokens to draw in all; None draws as many as there are.
    """

    entropy: float | None = 0.98
    repeats: float | None = 4.0
    budget: int | None = None
    block_tokens: int = 1_000_000
    seed: int = 0


def token_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _group(source: Column) -> Column:
    """A join key for a source that may be null."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("-"))


def _place(seed: int, identity: Column, text: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(identity.cast("string"), F.lit("")), F.coalesce(F.md5(text), F.lit(""))))


def _bisect(low: float, high: float, passes) -> tuple[float, float]:
    """Halve [low, high] LEVELS * JOBS times; ``passes(list)`` says for each exponent whether the cut lies above it."""
    for _ in range(JOBS):
        parts = 2**LEVELS
        grid = [low + (high - low) * k / parts for k in range(parts + 1)]
        verdicts = passes(grid[1:-1])
        above = sum(verdicts)  # monotone: true up to the cut
        low, high = grid[above], grid[above + 1]
    return low, high


def exponent(shares: DataFrame, target: Target, budget_ratio: float) -> float:
    """The exponent for ``shares`` (share > 0, one row a source); ``budget_ratio`` is budget over all tokens."""
    n, ceiling = shares.agg(F.count(F.lit(1)), F.max("share")).first()
    if not n:
        return 1.0

    def sums(grid: list[float]):
        p = F.col("share")
        row = shares.agg(*[e for k, a in enumerate(grid) for e in (
            F.sum(F.pow(p, F.lit(a))).alias(f"z{k}"),
            F.sum(F.pow(p, F.lit(a)) * F.log(p) * a).alias(f"e{k}"),
            F.max(F.pow(p, F.lit(a - 1.0))).alias(f"m{k}"),
        )]).first()
        return [(row[f"z{k}"], row[f"e{k}"], row[f"m{k}"]) for k in range(len(grid))]

    found = 1.0
    if target.entropy is not None:
        least = target.entropy * math.log(n)
        meets = lambda grid: [math.log(z) - e / z >= least for z, e, _ in sums(grid)]
        found = 1.0 if meets([1.0])[0] else _bisect(0.0, 1.0, meets)[0]
    if target.repeats is not None:
        exceeds = lambda grid: [budget_ratio * m / z > target.repeats for z, _, m in sums(grid)]
        if exceeds([found])[0]:
            found = _bisect(found, 1.0, exceeds)[1]
    return round(found, DIGITS)


def weights(documents: DataFrame, target: Target = Target(), text: str = "text", source: str = "source", identity: str = "doc_id") -> DataFrame:
    """One row a source: _group, tokens, weight, passes (whole ones), blocks, cut (the last place of the part pass, or null)."""
    slim = stored(
        documents.select(_group(F.col(source)).alias("_group"), _place(target.seed, F.col(identity), F.col(text)).alias("_place"), token_count(F.col(text)).alias("_n")),
        "places").where(F.col("_n") > 0)
    sizes = stored(slim.groupBy("_group").agg(F.sum("_n").alias("tokens")), "sizes")
    total = sizes.agg(F.sum("tokens")).first()[0] or 0
    budget = total if target.budget is None else target.budget
    shares = sizes.withColumn("share", F.col("tokens") / F.lit(float(max(total, 1))))
    a = exponent(shares, target, budget / max(total, 1))
    z = shares.agg(F.sum(F.pow("share", F.lit(a)))).first()[0] or 1.0
    weighted = shares.withColumn("weight", F.round(F.pow("share", F.lit(a)) / z, 12))
    due = F.floor(F.round(F.col("weight") * budget, 3)).cast("long")
    counted = (
        weighted.withColumn("_due", due)
        .withColumn("passes", F.floor(F.col("_due") / F.col("tokens")).cast("long"))
        .withColumn("_left", F.col("_due") - F.col("passes") * F.col("tokens"))
        .withColumn("blocks", F.ceil(F.col("tokens") / target.block_tokens).cast("long"))
        .select("_group", "tokens", "weight", "passes", "_left", "blocks")
    )
    counted = stored(counted, "weights")
    placed = slim.join(counted.select("_group", "blocks", "_left"), "_group").withColumn("_block", block_of(F.col("_place"), F.col("blocks")))
    by_block = placed.groupBy("_group", "_block", "_left").agg(F.sum("_n").alias("_n"))
    running = by_block.withColumn("_before", F.sum("_n").over(W.partitionBy("_group").orderBy("_block")) - F.col("_n"))
    crossing = stored(running.where((F.col("_before") <= F.col("_left")) & (F.col("_before") + F.col("_n") > F.col("_left"))).select("_group", "_block", "_before"), "crossing")
    inside = (
        placed.join(crossing, ["_group", "_block"]).groupBy("_group", "_place", "_before", "_left").agg(F.sum("_n").alias("_n"))
        .withColumn("_end", F.col("_before") + F.sum("_n").over(W.partitionBy("_group").orderBy("_place")))
        .where(F.col("_end") <= F.col("_left")).groupBy("_group").agg(F.max("_place").alias("_last"))
    )
    cut = crossing.join(inside, "_group", "left").select("_group", F.col("_block").alias("cut_block"), F.col("_last").alias("cut"))
    return stored(counted.drop("_left").join(cut, "_group", "left"), "mix")


def block_of(place: Column, blocks: Column) -> Column:
    """The block of a place: its first 12 hex digits as a fraction of the permutation."""
    return F.floor(F.conv(F.substring(place, 1, 12), 16, 10).cast("double") / float(16**12) * blocks).cast("long")


def mix(documents: DataFrame, target: Target = Target(), text: str = "text", source: str = "source", identity: str = "doc_id") -> DataFrame:
    """``documents`` with n_tokens, weight (of the source), copies, block and place.

    Write every row ``copies`` times, ordered by pass, block and place, and the shares of the sources are
    the weights.  Every row is kept: one beyond its source's budget has copies 0.  Rows without words
    cost nothing and take the whole passes of their source (0 where the whole source has no words); a
    null source is a source.  Rows equal in id and text share a place and are taken together.  Columns
    of these names are replaced.
    """
    names = columns_but(documents.columns, ("n_tokens", "weight", "copies", "block", "place"))
    helpers = {c: free_name(documents, c) for c in ("_group", "passes", "blocks", "cut_block", "cut")}
    group, passes, blocks, cut_block, cut = helpers.values()
    made = weights(documents, target, text, source, identity).select("weight", *[F.col(c).alias(own) for c, own in helpers.items()])
    n, place, block = F.col("n_tokens"), F.col("place"), F.col("block")
    extra = (
        (n > 0) & (F.when(block == F.col(cut_block), F.coalesce(place <= F.col(cut), F.lit(False))).otherwise(block < F.col(cut_block)))
    )
    return (
        documents.withColumns({
            group: _group(F.col(source)), "n_tokens": token_count(F.col(text)), "place": _place(target.seed, F.col(identity), F.col(text))})
        .drop("weight").join(made, group, "left")
        .withColumn("block", F.coalesce(block_of(place, F.col(blocks)), F.lit(0)))
        .withColumn("copies", (F.coalesce(passes, F.lit(0)) + F.coalesce(extra.cast("long"), F.lit(0))).cast("long"))
        .withColumn("weight", F.coalesce("weight", F.lit(0.0)))
        .select(*names, "n_tokens", "weight", "copies", "block", "place")
    )
