"""Approximate nearest neighbours by cosine: one hierarchical navigable small-world graph for each shard.

Equal vectors are one node, which keeps the smallest ids that any answer can need.  Nodes are dealt to
shards by a hash of the vector, so a shard has about ``shard_rows`` of them at every size.  In a shard the
layers are drawn geometrically; a node's links in a layer are chosen, by the usual diversity rule, among
its nearest nodes of that layer, and links are kept in both directions.  The graph is stored as flat
arrays, one row for each shard.  A query descends the layers and walks the lowest with a beam; blocks of
queries walk together.  Every query is asked of every shard, in blocks, and the shards' answers, scored
anew in double precision on the original vectors, are merged.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from facsimile.llm.common import stored


@dataclass(frozen=True)
class Settings:
    """``links``: by node above the lowest layer, where there are twice as many.  ``most``: largest k the index can answer."""

    shard_rows: int = 4096
    links: int = 12
    candidates: int = 48
    beam: int = 64
    most: int = 5
    query_rows: int = 1024
    seed: int = 5


def _unit(x: np.ndarray) -> np.ndarray:
    # scaled by the largest component first, so that squares neither overflow nor vanish
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _layer(x: np.ndarray, links: int, candidates: int) -> np.ndarray:
    """(nodes, 2 * links) neighbour numbers, -1 where there is none: ``links`` chosen ones, then the closest that chose the node."""
    n = len(x)
    out = np.full((n, 2 * links), -1, np.int32)
    if n == 1:
        return out
    width, step = min(candidates, n - 1), 256
    for low in range(0, n, step):
        block = x[low : low + step]
        sims = block @ x.T
        sims[np.arange(len(block)), np.arange(low, low + len(block))] = -np.inf
        near = np.argpartition(-sims, width - 1, axis=1)[:, :width]
        s = np.take_along_axis(sims, near, axis=1)
        order = np.argsort(-s, axis=1, kind="stable")
        near, s = np.take_along_axis(near, order, axis=1), np.take_along_axis(s, order, axis=1)
        v = x[near]
        among = v @ v.transpose(0, 2, 1)
        taken = np.zeros(near.shape, bool)
        for r in range(width):  # a candidate closer to a chosen one than to the node adds no direction
            taken[:, r] = ~(taken & (among[:, r] > s[:, r : r + 1])).any(axis=1) & (taken.sum(axis=1) < links)
        rank = np.argsort(~taken, axis=1, kind="stable")[:, : min(links, width)]  # chosen first, then the nearest others
        out[low : low + len(block), : rank.shape[1]] = np.take_along_axis(near, rank, axis=1)
    src = np.repeat(np.arange(n), links)
    dst = out[:, :links].ravel()
    src, dst = src[dst >= 0], dst[dst >= 0]
    fresh = ~np.isin(dst.astype(np.int64) * n + src, src.astype(np.int64) * n + dst)
    back_from, back_to = dst[fresh].astype(np.int64), src[fresh]
    close = np.einsum("ij,ij->i", x[back_from], x[back_to])
    order = np.lexsort((back_to, -close, back_from))
    back_from, back_to = back_from[order], back_to[order]
    rank = np.arange(len(back_from)) - np.searchsorted(back_from, back_from)
    ok = rank < links
    out[back_from[ok], links + rank[ok]] = back_to[ok]
    return out


def build(vectors: np.ndarray, settings: Settings) -> list[tuple[np.ndarray, np.ndarray]]:
    """Layers from the lowest up: (node numbers, neighbours numbered within the layer)."""
    n = len(vectors)
    x = _unit(vectors.astype(np.float64)).astype(np.float32)
    draw = np.random.default_rng(settings.seed).random(n)
    level = np.floor(-np.log(np.maximum(draw, 1e-12)) / np.log(settings.links)).astype(int)
    layers = []
    for k in range(int(level.max()) + 1):
        nodes = np.flatnonzero(level >= k).astype(np.int32)
        layers.append((nodes, _layer(x[nodes], settings.links * (2 if k == 0 else 1), settings.candidates)))
    return layers


def _walk(x: np.ndarray, links: np.ndarray, queries: np.ndarray, starts: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, similarities), best first, of a beam search for all queries at once from their ``starts`` (queries, m); -1 pads."""
    count, rows = len(queries), np.arange(len(queries))
    seen = np.zeros((count, len(x)), bool)
    seen[rows[:, None], starts] = True
    ids = np.full((count, beam), -1, np.int32)
    sims = np.full((count, beam), -np.inf, np.float32)
    m = min(beam, starts.shape[1])
    ids[:, :m] = starts[:, :m]
    sims[:, :m] = np.einsum("qd,qmd->qm", queries, x[starts[:, :m]])
    done = ids < 0
    while True:
        open_sims = np.where(done, -np.inf, sims)
        pick = open_sims.argmax(axis=1)
        live = np.flatnonzero(open_sims[rows, pick] > -np.inf)
        if not len(live):
            break
        chosen = ids[live, pick[live]]
        done[live, pick[live]] = True
        near = links[chosen]
        fresh = (near >= 0) & ~seen[live[:, None], near]
        seen[live[:, None], np.where(near >= 0, near, chosen[:, None])] = True
        s = np.where(fresh, np.einsum("qd,qmd->qm", queries[live], x[near]), -np.inf).astype(np.float32)
        all_ids = np.concatenate([ids[live], np.where(fresh, near, -1)], axis=1)
        all_sims = np.concatenate([sims[live], s], axis=1)
        all_done = np.concatenate([done[live], ~fresh], axis=1)
        keep = np.argsort(-all_sims, axis=1, kind="stable")[:, :beam]
        ids[live] = np.take_along_axis(all_ids, keep, axis=1)
        sims[live] = np.take_along_axis(all_sims, keep, axis=1)
        done[live] = np.take_along_axis(all_done, keep, axis=1)
    order = np.argsort(-sims, axis=1, kind="stable")
    return np.take_along_axis(ids, order, axis=1), np.take_along_axis(sims, order, axis=1)


def search(vectors: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]], queries: np.ndarray, beam: int, wanted: int) -> np.ndarray:
    """(queries, wanted) node numbers found, nearest first, -1 where there are no more."""
    x, q = _unit(vectors.astype(np.float64)).astype(np.float32), _unit(queries.astype(np.float64)).astype(np.float32)
    nodes = layers[-1][0]
    at = np.tile(np.arange(min(4, len(nodes)), dtype=np.int64), (len(q), 1))
    for k in range(len(layers) - 1, -1, -1):
        nodes, links = layers[k]
        width = beam if k == 0 else min(4, len(nodes))
        found, _ = _walk(x[nodes], links, q, at, width)
        if k:
            found = np.where(found < 0, found[:, :1], found)
            at = np.searchsorted(layers[k - 1][0], nodes[found])
    found = found[:, :wanted]
    return np.where(found < 0, -1, layers[0][0][found])


def usable(vectors: DataFrame, identity: str, embedding: str) -> DataFrame:
    """(_id, _v): rows whose vector has only finite components, not all zero, and whose id is not null; equal rows once."""
    v = F.col("_v")
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return (
        vectors.select(F.col(identity).cast("long").alias("_id"), F.col(embedding).cast("array<double>").alias("_v"))
        .where(F.col("_id").isNotNull() & v.isNotNull() & ~bad & F.exists(v, lambda c: c != 0.0)).distinct()
    )


def index(vectors: DataFrame, settings: Settings = Settings(), identity: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """One row a shard: shard, dim, nodes, members (ids of each node), vectors and layers as flat arrays."""
    rows = usable(vectors, identity, embedding)
    # the smallest ids of a vector are limited inside every task before the shuffle, so a common vector is no hot group
    ranked = rows.withColumn("_k", F.row_number().over(W.partitionBy("_v").orderBy("_id"))).where(F.col("_k") <= settings.most + 1)
    nodes = stored(ranked.groupBy("_v").agg(F.array_sort(F.collect_list("_id")).alias("_ids")), "nodes")
    shards = max(1, -(-nodes.count() // settings.shard_rows))
    dealt = nodes.withColumn("_shard", F.pmod(F.xxhash64("_v"), F.lit(shards))).withColumn("_dim", F.size("_v"))

    def graph(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.assign(first=[ids[0] for ids in rows["_ids"]]).sort_values("first")
        x = np.stack(rows["_v"].to_numpy()).astype(np.float64)
        layers = build(x, settings)
        return pd.DataFrame({
            "shard": [key[0]], "dim": [key[1]], "nodes": [len(x)],
            "sizes": [[len(ids) for ids in rows["_ids"]]], "ids": [np.concatenate(rows["_ids"].to_numpy()).astype(np.int64).tobytes()],
            "vectors": [x.tobytes()], "layer_nodes": [[n.tobytes() for n, _ in layers]], "layer_links": [[k.tobytes() for _, k in layers]],
        })

    made = dealt.groupBy("_shard", "_dim").applyInPandas(
        graph, "shard long, dim int, nodes int, sizes array<int>, ids binary, vectors binary, layer_nodes array<binary>, layer_links array<binary>")
    return stored(made, "shards")


def nearest(shards: DataFrame, queries: DataFrame, k: int = 5, settings: Settings = Settings(), identity: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of each query row, without rows of the query's own id.

    Nearest first, ties to the smaller id; all candidates where there are fewer.  Vectors that take no part
    are no queries either; vectors are compared with those of the same length.  An id that stands for
    several vectors asks once for each and its answers are merged.
    """
    if k > settings.most:
        raise ValueError(f"the index keeps enough ids for {settings.most} answers")
    asked = stored(usable(queries, identity, embedding), "queries")
    blocks = max(1, -(-asked.count() // settings.query_rows))
    kept = shards.select("shard", "dim")
    posed = (
        asked.withColumn("block", F.pmod(F.xxhash64("_id"), F.lit(blocks))).withColumn("dim", F.size("_v"))
        .join(kept.groupBy("dim").agg(F.collect_list("shard").alias("_shards")), "dim")
        .select("block", "dim", F.explode("_shards").alias("shard"), "_id", "_v")
    )
    spread = shards.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))

    def answer(key: tuple, held: pd.DataFrame, posed: pd.DataFrame) -> pd.DataFrame:
        names = ["query_id", "vec_id", "score"]
        if held.empty or posed.empty:
            return pd.DataFrame({n: pd.Series(dtype="float64" if n == "score" else "int64") for n in names})
        r = held.iloc[0]
        x = np.frombuffer(r["vectors"], np.float64).reshape(r["nodes"], r["dim"])
        layers = [(np.frombuffer(n, np.int32), np.frombuffer(e, np.int32).reshape(len(n) // 4, -1)) for n, e in zip(r["layer_nodes"], r["layer_links"])]
        bounds, ids = np.concatenate([[0], np.cumsum(r["sizes"])]), np.frombuffer(r["ids"], np.int64)
        q, own = np.stack(posed["_v"].to_numpy()).astype(np.float64), posed["_id"].to_numpy()
        found = search(x, layers, q, settings.beam, settings.beam)
        unit_x, unit_q = _unit(x), _unit(q)
        out = []
        for i in range(len(q)):
            at = found[i][found[i] >= 0]
            score = (unit_x[at] * unit_q[i]).sum(axis=1)
            member = np.concatenate([ids[bounds[a] : bounds[a + 1]] for a in at])
            scores = np.repeat(score, bounds[at + 1] - bounds[at])
            other = member != own[i]
            member, scores = member[other], scores[other]
            best = np.lexsort((member, -scores))[: k]
            out.append(pd.DataFrame({"query_id": own[i], "vec_id": member[best], "score": scores[best]}))
        return pd.concat(out)

    answers = spread.groupBy("shard", "dim", "block").cogroup(posed.groupBy("shard", "dim", "block")).applyInPandas(answer, "query_id long, vec_id long, score double")
    best = answers.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def every(vectors: DataFrame, step: int, identity: str = "vec_id") -> DataFrame:
    """The query rows: ids divisible by ``step``."""
    divides: Column = F.pmod(F.col(identity), F.lit(step)) == 0
    return vectors.where(divides)
