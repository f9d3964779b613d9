"""Exact top-k by inner product of integer vectors: a dual-tree search over cover trees.

Queries and data are indexed together.  A cell that holds more than ``block_rows`` different vectors is divided by
centres taken from a sample of it, level by level, until every cell is a block.  Within a block
the centres are found farthest first, so that each prefix of them is a net that covers the block within a radius: the levels of a
cover tree, a node being a centre, its covering radius and the nodes or vectors below.  Queries are grouped
at the highest cells that hold few enough of them, and get the same tree.

Two nodes with centres c and d and covering radii r and s hold no pair of a larger product than c.d + |c| s + |d| r + r s.  A
pair of nodes is dropped when that is below the worst k-th score that any query of the one has already.  Each query
starts with the k-th score of its own block; pairs of query groups and cells descend the levels by joins, those of blocks are
searched in tasks, best bounds first.  Scores are exact; where the data has no structure little is pruned, and the
work approaches all pairs of queries and blocks.
"""

from __future__ import annotations

from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from facsimile.llm.common import stored

LARGEST = float(np.finfo(np.float64).max)
_EXACT = float(1 << 53)
_SLACK = 1e-9


@dataclass(frozen=True)
class Settings:
    """``fan``: centres a cell is divided by, from ``sample`` of its vectors; ``leaf``: vectors below a lowest node, about."""

    block_rows: int = 4096
    query_rows: int = 1024
    fan: int = 32
    sample: int = 256
    leaf: int = 16
    scale: int = 1024


@contextmanager
def batches(spark: SparkSession, rows: int):
    """Arrow batches of ``rows`` rows while blocks of vectors pass through Python."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def usable(vectors: DataFrame, identity: str, embedding: str, scale: int) -> DataFrame:
    """(_id, _v): floor(scale * x) of every component; rows with a null id or vector, or a null or non-finite component, take no part.

    Equal rows are one.  Components stay doubles, which hold these integers exactly; one beyond the largest double is that.
    """
    bad = F.exists("_v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    whole = lambda c: F.when(F.abs(c) < 2.0**52 / scale, F.floor(c * scale).cast("double")).otherwise(
        F.greatest(F.least(c * scale, F.lit(LARGEST)), F.lit(-LARGEST)))
    rows = vectors.select(F.col(identity).cast("long").alias("_id"), F.col(embedding).cast("array<double>").alias("_v"))
    return rows.where(F.col("_id").isNotNull() & F.col("_v").isNotNull() & ~bad).select("_id", F.transform("_v", whole).alias("_v")).distinct()


def _apart(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore", invalid="ignore"):
        d = x - centre
        return np.nan_to_num(np.sqrt((d * d).sum(axis=1)), nan=np.inf, posinf=np.inf)


def spread(x: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(centres, distance of each to those before, nearest centre of each row): farthest first from row 0."""
    near, of = _apart(x, x[0]), np.zeros(len(x), np.int64)
    centres, gaps = [0], [np.inf]
    while len(centres) < most:
        far = int(near.argmax())
        if not near[far] > 0:
            break
        d = _apart(x, x[far])
        closer = d < near
        of[closer], near[closer] = len(centres), d[closer]
        centres.append(far), gaps.append(float(d[centres[:-1]].min()))
    return np.array(centres), np.array(gaps), of


class Tree:
    """Nets of a block from coarse to fine: node c of a level is centre c, its parent the nearest centre of the level above."""

    def __init__(self, x: np.ndarray, leaf: int):
        self.x, n = x, len(x)
        self.centres, gaps, self.of = spread(x, max(1, min(256, -(-n // leaf))))
        radius = gaps[1] if len(gaps) > 1 else 0.0
        sizes = [1]
        while sizes[-1] < len(self.centres) and len(sizes) < 16:
            radius /= 2
            sizes.append(max(sizes[-1], int((gaps > radius).sum())))
            if sizes[-1] == sizes[-2]:
                sizes.pop()
        if sizes[-1] < len(self.centres):
            sizes.append(len(self.centres))
        self.sizes, self.up, self.radii = sizes, [np.zeros(1, np.int64)], []
        c = x[self.centres]
        for above, size in zip(sizes, sizes[1:]):
            up = np.arange(size)
            for i in range(above, size):
                up[i] = int(_apart(c[:above], c[i]).argmin())
            self.up.append(up)
        of = self.of
        self.under = []  # node of every row, by level from the finest
        for level in range(len(sizes) - 1, -1, -1):
            r = np.zeros(sizes[level])
            d = np.empty(n)
            for i in range(sizes[level]):
                rows = np.flatnonzero(of == i)
                d[rows] = _apart(x[rows], c[i])
            np.maximum.at(r, of, d)
            self.radii.insert(0, r)
            self.under.insert(0, of)
            of = self.up[level][of]
        with np.errstate(over="ignore"):
            self.norms = np.nan_to_num(np.sqrt((c * c).sum(axis=1)), posinf=np.inf)

    def below(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Children of the nodes of a level, grouped: (bounds, children)."""
        up = self.up[level + 1]
        return np.searchsorted(np.sort(up), np.arange(self.sizes[level] + 1)), np.argsort(up, kind="stable")


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of integer rows, exact; as doubles where those hold them, else as whole numbers of Python cut to 64 bits."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)))
    top = np.abs(a).max() * np.abs(b).max() * a.shape[1]
    if top < _EXACT:
        return a @ b.T
    whole = np.vectorize(int, otypes=[object])
    exact = whole(a).dot(whole(b).T)
    return np.vectorize(lambda v: max(-(1 << 63), min((1 << 63) - 1, v)), otypes=[object])(exact)


def _opened(qi: np.ndarray, ri: np.ndarray, bounds: np.ndarray, children: np.ndarray, first: bool) -> tuple[np.ndarray, np.ndarray]:
    at = qi if first else ri
    n = bounds[at + 1] - bounds[at]
    where = np.repeat(bounds[at] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
    other = np.repeat(ri if first else qi, n)
    return (children[where], other) if first else (other, children[where])


def search(q: Tree, r: Tree, best: list, worst: np.ndarray, want: int, sizes: np.ndarray, ids: np.ndarray, numbers: np.ndarray) -> None:
    """Fill ``best`` (per query: (-score, id, number) ascending) and raise ``worst`` (its last score, once there are ``want``) from the rows of ``r``.

    ``sizes``: ids of each row of ``r``, ``ids`` in one list; ``numbers``: the number of each row.
    """
    cq, cr = q.x[q.centres], r.x[r.centres]
    qi, ri, ql, rl = np.zeros(1, np.int64), np.zeros(1, np.int64), 0, 0
    while True:
        least = np.full(q.sizes[ql], np.inf)
        np.minimum.at(least, q.under[ql], worst)
        with np.errstate(over="ignore", invalid="ignore"):
            rq, rr = q.radii[ql][qi], r.radii[rl][ri]
            top = (cq[qi] * cr[ri]).sum(axis=1)
            reach = q.norms[qi] * rr + r.norms[ri] * rq + rq * rr
            # the slack is taken of the absolute terms, whose rounding it covers
            high = top + reach + _SLACK * (q.norms[qi] * r.norms[ri] + reach) + 1
            keep = ~(high < least[qi])
        qi, ri, high = qi[keep], ri[keep], high[keep]
        deeper_q, deeper_r = ql + 1 < len(q.sizes), rl + 1 < len(r.sizes)
        if not len(qi) or not deeper_q and not deeper_r:
            break
        if deeper_q:
            qi, ri = _opened(qi, ri, *q.below(ql), True)
        if deeper_r:
            qi, ri = _opened(qi, ri, *r.below(rl), False)
        ql, rl = ql + deeper_q, rl + deeper_r
    start = np.concatenate([[0], np.cumsum(sizes)])
    for node in np.unique(qi):
        at = np.flatnonzero(qi == node)
        at = at[np.argsort(-high[at], kind="stable")]
        mine = np.flatnonzero(q.under[-1] == node)
        while len(at):
            at = at[~(high[at] < worst[mine].min())]
            some, at = at[:32], at[32:]
            rows = np.flatnonzero(np.isin(r.under[-1], ri[some]))
            if not len(rows):
                continue
            scores = _products(q.x[mine], r.x[rows])
            for i, line in zip(mine, scores):
                few = np.partition(line, len(line) - want)[len(line) - want] if len(line) > want else -np.inf
                for j in np.flatnonzero(line >= max(few, worst[i])):
                    row = rows[j]
                    best[i] += [(-int(line[j]), int(n), int(numbers[row])) for n in ids[start[row] : start[row + 1]]]
                best[i].sort()
                del best[i][want:]
                if len(best[i]) == want:
                    worst[i] = float(-best[i][-1][0])


def _pack(x: np.ndarray) -> bytes:
    """A letter for the width of the numbers, then the numbers."""
    top = np.abs(x).max() if x.size else 0
    kind = "<i2" if top < 1 << 15 else "<i4" if top < 1 << 31 else "<f8"
    return kind.encode() + x.astype(kind).tobytes()


def _unpack(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw[3:], raw[:3].decode()).astype(np.float64).reshape(n, -1)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in column])


def _divide(nodes: DataFrame, settings: Settings) -> tuple[DataFrame, DataFrame]:
    """(nodes with their cells, centres of the cells): no cell holds more than ``block_rows`` vectors."""
    spark = nodes.sparkSession
    columns = nodes.columns
    schema = nodes.schema
    centres: DataFrame | None = None

    def choose(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("h", kind="stable")
        x = _matrix(rows["_v"])
        # half of them far apart, half as they come: outliers get cells of their own, the bulk is divided
        far = spread(x, settings.fan // 2)[0].tolist()
        chosen = far + [i for i in range(len(x)) if i not in set(far)][: settings.fan - len(far)]
        return pd.DataFrame({"path": [key[0]] * len(chosen), "at": np.arange(len(chosen), dtype=np.int32), "centre": list(x[chosen])})

    def place(rows):
        current, held = None, None
        for batch in rows:
            out = []
            for path, part in batch.groupby("path", sort=False):
                told = part[part["at"].notna()]
                if len(told):
                    held = _matrix(told.sort_values("at")["_v"]) if current != path else np.concatenate([held, _matrix(told.sort_values("at")["_v"])])
                    current = path
                part = part[part["at"].isna()]
                if len(part):
                    x = _matrix(part["_v"])
                    with np.errstate(over="ignore", invalid="ignore"):
                        far = np.nan_to_num((held * held).sum(axis=1)[None, :] - 2 * (x @ held.T), nan=np.inf, posinf=np.inf)
                    same = [f"{path}/{c}" for c in far.argmin(axis=1)]
                    out.append(part.assign(path=same))
            if out:
                yield pd.concat(out)[columns]

    done: list[DataFrame] = []
    while True:
        counts = nodes.groupBy("path").agg(F.count(F.lit(1)).alias("rows"))
        large = stored(counts.where(F.col("rows") > settings.block_rows).select(
            F.col("path").alias("p"), F.ceil(F.col("rows") / (settings.block_rows * 16)).alias("salts")), "cells")
        if not large.limit(1).count():
            done.append(nodes)
            break
        inner = nodes.join(large, nodes["path"] == large["p"])
        done.append(nodes.join(large, nodes["path"] == large["p"], "left_anti"))
        h = F.xxhash64("_v", F.lit(7))
        sample = inner.withColumn("h", h).withColumn("k", F.row_number().over(W.partitionBy("path").orderBy("h", "_n"))).where(F.col("k") <= settings.sample)
        chosen = stored(sample.select("path", "h", "_v").groupBy("path").applyInPandas(choose, "path string, at int, centre array<double>"), "centres")
        centres = chosen if centres is None else centres.unionByName(chosen)
        # a cell's centres go to each of its salts, then its vectors stream past them
        told = chosen.join(large, chosen["path"] == large["p"]).select(
            "path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), "at", F.col("centre").alias("_v"),
            *[F.lit(None).cast(schema[c].dataType).alias(c) for c in columns if c not in ("path", "_v")])
        rows = inner.withColumn("salt", F.pmod(F.xxhash64("_v"), F.col("salts"))).withColumn("at", F.lit(None).cast("int"))
        both = told.unionByName(rows.select(told.columns)).repartition("path", "salt").sortWithinPartitions("path", "salt", F.asc_nulls_last("at"))
        nodes = stored(both.mapInPandas(place, schema), "nodes")
    every = done[0]
    for more in done[1:]:
        every = every.unionByName(more)
    empty = spark.createDataFrame([], "path string, at int, centre array<double>")
    named = (empty if centres is None else centres).select(F.concat_ws("/", "path", F.col("at").cast("string")).alias("path"), F.col("path").alias("parent"), "centre")
    return every, named


def _dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def top(vectors: DataFrame, queries: DataFrame, k: int = 10, settings: Settings = Settings(), identity: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` largest inner products of each query row over the rows of ``vectors``, ties to the smaller id.

    Components are floor(scale * x).  Rows with a null id or vector, or null or non-finite components, take no part; equal rows are one; vectors meet those of their own length only;
    fewer answers where there are fewer rows; scores beyond 64 bits are cut to them.  The row with a query's own id and vector is
    no answer to it; other rows of the same id are.  An id that asks with several vectors has an answer for each.
    Other columns are not looked at.
    """
    spark, want = vectors.sparkSession, k + 1
    asked = stored(usable(queries, identity, embedding, settings.scale), "asked")
    # of equal vectors as many ids as any answer can need, limited inside every task before the shuffle
    rows = usable(vectors, identity, embedding, settings.scale)
    few = rows.withColumn("_k", F.row_number().over(W.partitionBy("_v").orderBy("_id"))).where(F.col("_k") <= want).select("_v", "_id", F.lit(False).alias("_q"))
    both = few.unionByName(asked.select("_v", F.lit(None).cast("long").alias("_id"), F.lit(True).alias("_q")).distinct())
    grouped = both.groupBy("_v").agg(F.array_sort(F.collect_list("_id")).alias("_ids"), F.max("_q").alias("_q"))
    nodes = stored(grouped.select(F.monotonically_increasing_id().alias("_n"), F.size("_v").cast("string").alias("path"), "_v", "_ids", "_q"), "nodes")
    placed, centres = _divide(nodes, settings)
    placed = stored(placed, "placed")

    def block(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_n")
        x = _matrix(rows["_v"])
        centre = x.mean(axis=0) if x.shape[1] and np.abs(x).max() < 1e150 else x[0]
        sizes = np.array([len(i) for i in rows["_ids"]], np.int32)
        mine = np.flatnonzero(rows["_q"].to_numpy(bool))
        bound = np.full(len(mine), -np.inf)
        held = np.flatnonzero(sizes)
        for low in range(0, len(mine), 256):
            part = mine[low : low + 256]
            if len(held):
                scores = _products(x[part], x[held])
                for i, line in enumerate(scores):
                    order = np.argsort(-line, kind="stable")[:want]
                    upto = np.flatnonzero(np.cumsum(sizes[held][order]) >= want)
                    if len(upto):
                        bound[low + i] = float(line[order[upto[0]]])
        return pd.DataFrame({
            "path": [key[0]], "rows": [len(x)], "centre": [centre], "radius": [float(_apart(x, centre).max())],
            "vectors": [_pack(x)], "sizes": [sizes.tobytes()], "ids": [np.concatenate([np.asarray(i, np.int64) for i in rows["_ids"]]).tobytes()],
            "numbers": [rows["_n"].to_numpy(np.int64).tobytes()], "asking": [mine.astype(np.int32).tobytes()], "bounds": [bound.tobytes()],
        })

    blocks = stored(placed.groupBy("path").applyInPandas(
        block, "path string, rows int, centre array<double>, radius double, vectors binary, sizes binary, ids binary, numbers binary, asking binary, bounds binary"), "blocks")

    # queries by the highest cell that holds few enough of them
    prefixes = lambda c: F.transform(F.sequence(F.lit(1), F.size(F.split(c, "/"))), lambda i: F.array_join(F.slice(F.split(c, "/"), 1, i), "/"))
    asking = blocks.select("path", (F.length("asking") / 4).cast("long").alias("n")).where(F.col("n") > 0)
    above = asking.select("path", "n", F.posexplode(prefixes(F.col("path"))).alias("depth", "cell"))
    held = above.groupBy("cell").agg(F.sum("n").alias("all"))
    grouping = above.join(held, "cell").groupBy("path").agg(F.min(F.when(F.col("all") <= settings.query_rows, F.struct("depth", "cell"))).alias("g"))
    grouping = grouping.select("path", F.coalesce("g.cell", "path").alias("group"))

    def lines(blocks):
        for batch in blocks:
            for r in batch.itertuples():
                at = np.frombuffer(r.asking, np.int32)
                if not len(at):
                    continue
                x = _unpack(r.vectors, r.rows)[at]
                yield pd.DataFrame({"group": r.group, "_n": np.frombuffer(r.numbers, np.int64)[at], "_v": list(x), "bound": np.frombuffer(r.bounds, np.float64)})

    def group(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_n")
        x = _matrix(rows["_v"])
        centre = x.mean(axis=0) if x.shape[1] and np.abs(x).max() < 1e150 else x[0]
        return pd.DataFrame({
            "group": [key[0]], "q_rows": [len(x)], "q_centre": [centre], "q_radius": [float(_apart(x, centre).max())], "worst": [float(rows["bound"].min())],
            "q_vectors": [_pack(x)], "q_numbers": [rows["_n"].to_numpy(np.int64).tobytes()], "q_bounds": [rows["bound"].to_numpy(np.float64).tobytes()]})

    def searched(pairs):
        for batch in pairs:
            out = {"_n": [], "scores": [], "ids": [], "numbers": []}
            for r in batch.itertuples():
                q = Tree(_unpack(r.q_vectors, r.q_rows), settings.leaf)
                x, sizes = _unpack(r.vectors, r.rows), np.frombuffer(r.sizes, np.int32)
                best: list = [[] for _ in range(r.q_rows)]
                search(q, Tree(x, settings.leaf), best, np.frombuffer(r.q_bounds, np.float64).copy(), want, sizes, np.frombuffer(r.ids, np.int64), np.frombuffer(r.numbers, np.int64))
                for n, found in zip(np.frombuffer(r.q_numbers, np.int64), best):
                    if found:
                        out["_n"].append(n), out["scores"].append([-s for s, _, _ in found]), out["ids"].append([i for _, i, _ in found]), out["numbers"].append([m for _, _, m in found])
            if out["_n"]:
                yield pd.DataFrame(out)

    with batches(spark, 8):
        every = blocks.join(grouping, "path").mapInPandas(lines, "group string, _n long, _v array<double>, bound double")
        groups = stored(every.groupBy("group").applyInPandas(
            group, "group string, q_rows int, q_centre array<double>, q_radius double, worst double, q_vectors binary, q_numbers binary, q_bounds binary"), "groups")
        frontier = groups.select("group", F.element_at(F.split("group", "/"), 1).alias("path"), "q_centre", "q_radius", "worst", F.sqrt(_dot("q_centre", "q_centre")).alias("q_norm"))
        leaves = stored(blocks.select("path", "centre", "radius"), "leaves")
        # inner cells: their centre, and a radius that covers the blocks below
        far = lambda a, b: F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
        below = leaves.select(F.col("centre").alias("block"), F.col("radius").alias("r"), F.explode(prefixes(F.col("path"))).alias("path"))
        inner = below.join(centres, "path").groupBy("path").agg(F.first("parent").alias("parent"), F.first("centre").alias("centre"), F.max(far("centre", "block") + F.col("r")).alias("radius"))
        cells = stored(inner.join(leaves.select("path", F.lit(True).alias("leaf")), "path", "left").select("path", "parent", "centre", "radius", F.coalesce("leaf", F.lit(False)).alias("leaf"), F.sqrt(_dot("centre", "centre")).alias("norm")), "tree")
        pairs = stored(frontier.join(leaves.select("path"), "path").select("group", "path"), "pairs")  # a root that is a block itself
        frontier = frontier.join(leaves.select("path"), "path", "left_anti")
        reach = F.col("q_norm") * F.col("radius") + F.col("norm") * F.col("q_radius") + F.col("q_radius") * F.col("radius")
        high = _dot("q_centre", "centre") + reach + _SLACK * (F.col("q_norm") * F.col("norm") + reach) + 1
        while frontier.limit(1).count():
            down = frontier.withColumnRenamed("path", "parent").join(cells, "parent").where(F.isnan(high) | (high >= F.col("worst")))
            down = stored(down.select("group", "path", "q_centre", "q_radius", "worst", "q_norm", "leaf"), "frontier")
            pairs = pairs.unionByName(down.where("leaf").select("group", "path"))
            frontier = down.where(~F.col("leaf")).drop("leaf")
        payload = pairs.join(groups.select("group", "q_rows", "q_vectors", "q_numbers", "q_bounds"), "group").join(blocks.select("path", "rows", "vectors", "sizes", "ids", "numbers"), "path")
        found = stored(payload.mapInPandas(searched, "_n long, scores array<long>, ids array<long>, numbers array<long>"), "found")
    each = found.select("_n", F.explode(F.arrays_zip("scores", "ids", "numbers")).alias("x")).select(
        "_n", F.col("x.scores").alias("score"), F.col("x.ids").alias("vec_id"), F.col("x.numbers").alias("_m"))
    order = [F.desc("score"), "vec_id", "_m"]
    best = each.withColumn("place", F.row_number().over(W.partitionBy("_n").orderBy(*order))).where(F.col("place") <= want)
    best = best.groupBy("_n").agg(F.array_sort(F.collect_list(F.struct("place", "vec_id", "score", "_m"))).alias("best"))
    known = asked.join(nodes.where("_q").select("_n", "_v"), "_v").select(F.col("_id").alias("query_id"), "_n")
    mine = known.join(best, "_n").select(
        "query_id", F.slice(F.filter("best", lambda x: (x["vec_id"] != F.col("query_id")) | (x["_m"] != F.col("_n"))), 1, k).alias("best"))
    return mine.select("query_id", F.posexplode("best").alias("at", "x")).select(
        "query_id", (F.col("at") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))
