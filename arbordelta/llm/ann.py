"""Approximate nearest neighbours: a hierarchical navigable small-world graph for each shard, shard results merged.

Equal vectors are one node that keeps its k + 1 smallest vec_ids (ties go to smaller vec_ids and a query leaves out only
its own, so no more can appear). Nodes are dealt by hash into shards of about `shard_rows`. A shard's graph is built by
insertion: a node's level is geometric, and those of higher levels come first. A node descends the layers above, searches the
layer as it stands with a beam, and is joined to a diverse choice of what it finds; full neighbour lists are thinned by the same
rule. Nodes are inserted a few together (an eighth of what is there) and also see those of their own batch. The graph is
stored as flat neighbour arrays, one row for each shard.
Blocks of queries are written once. Each of at most `tasks` groups of shards reads the blocks from there (a Cartesian product,
which copies neither side to shuffle files or the driver) and keeps only the best of the whole group for each query, so what is
written follows the input. A block descends the layers greedily and searches the lowest with a beam of `beam` nodes, all its queries at once. Scores are cosines of the original vectors in double precision.

Defined cases: vectors that are null, zero, or hold null or non-finite components, and rows without vec_id, take no part;
vectors of different lengths never meet; repeated rows count once, and a vec_id with several vectors has its best score;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import arrow_map, materialize, ship

DEGREE, POOL = 16, 48


def _diverse(sims: np.ndarray, among: np.ndarray, most: int) -> list[int]:
    """Positions of at most `most` of the candidates (nearest first): one is left out if it is nearer to a chosen one."""
    blocked, chosen = np.zeros(len(sims), bool), []
    for j in range(len(sims)):
        if not blocked[j]:
            chosen.append(j)
            if len(chosen) == most:
                return chosen
            blocked |= among[j] > sims
    if len(chosen) < most:
        taken = set(chosen)
        chosen += [j for j in range(len(sims)) if j not in taken][: most - len(chosen)]
    return chosen


def insert(v: np.ndarray, width: int, above: tuple[list, list] | None, degree: int = DEGREE, pool: int = POOL) -> np.ndarray:
    """A layer's neighbours (rows of `width`, -1 where none) of the unit vectors v, inserted in order.

    above: nodes and links of the layers above, from the lowest; their nodes are the first of v.
    """
    n, room = len(v), width + width // 2  # while it grows, a list may hold half as much again before it is thinned
    links: list[list[int]] = [[] for _ in range(n)]
    table = np.full((n, room), -1, np.int32)

    def thin(i: int, found: np.ndarray, most: int) -> list[int]:
        near = v[found] @ v[i]
        order = np.argsort(-near, kind="stable")
        found = found[order]
        return found[_diverse(near[order], v[found] @ v[found].T, most)].tolist()

    done = 1
    while done < n:
        stop = min(n, done + max(1, done // 8))
        q = v[done:stop]
        nodes, tables = [np.arange(done)], [table[:done]]
        if above is not None and done >= len(above[0][0]):  # all nodes of the layers above are in this one
            nodes, tables = nodes + above[0], tables + above[1]
        found = search(v[:done], nodes, tables, q, min(pool, done))
        own = q @ q.T
        touched = set()
        for k in range(stop - done):
            i, near = done + k, found[k][found[k] >= 0]
            if k:
                best = np.argsort(-own[k, :k], kind="stable")[:degree]
                near = np.concatenate([near, done + best])
            links[i] = thin(i, near, degree)
            touched.add(i)
            for j in links[i]:
                links[j].append(i)
                touched.add(j)
                if len(links[j]) > room:
                    links[j] = thin(j, np.array(links[j]), width)
        for i in touched:
            table[i, : len(links[i])] = links[i]
            table[i, len(links[i]) :] = -1
        done = stop
    for i, own in enumerate(links):
        if len(own) > width:
            own = thin(i, np.array(own), width)
            table[i, :width] = own
    return np.ascontiguousarray(table[:, :width])


def build(v: np.ndarray, seed: int = 3) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Layers from the lowest: (levels, nodes of each layer, neighbours within it). levels fall, so a layer's nodes are the first."""
    u = np.random.default_rng(seed).random(len(v))
    levels = np.sort(np.minimum(12, (-np.log(1 - u) / math.log(DEGREE)).astype(np.int64)))[::-1]
    nodes = [np.arange(int((levels >= k).sum())) for k in range(int(levels.max()) + 1)]
    links: list[np.ndarray] = []
    for k in range(len(nodes) - 1, -1, -1):
        own = v[: len(nodes[k])]
        links.insert(0, insert(own, 2 * DEGREE if k == 0 else DEGREE, (nodes[k + 1 :], links) if links else None))
    return levels, nodes, links


def search(v: np.ndarray, nodes: list[np.ndarray], links: list[np.ndarray], q: np.ndarray, beam: int) -> np.ndarray:
    """For each unit query, up to `beam` nodes (-1 where none), nearest first."""
    m, n = len(q), len(v)
    at = np.zeros(m, np.int64)  # the first node of the highest layer
    for k in range(len(nodes) - 1, 0, -1):
        own, sims = v[nodes[k]], np.einsum("ij,ij->i", q, v[nodes[k]][at])
        active = np.arange(m)
        while len(active):
            near = links[k][at[active]]
            s = np.einsum("ijk,ik->ij", own[np.maximum(near, 0)], q[active])
            s[near < 0] = -np.inf
            best = s.argmax(1)
            better = s[np.arange(len(active)), best] > sims[active]
            active, near, s, best = active[better], near[better], s[better], best[better]
            rows = np.arange(len(active))
            at[active], sims[active] = near[rows, best], s[rows, best]
        at = np.searchsorted(nodes[k - 1], nodes[k][at])
    ids, sims = np.full((m, beam), -1, np.int64), np.full((m, beam), -np.inf, np.float32)
    done, seen = np.ones((m, beam), bool), np.zeros((m, n), bool)
    ids[:, 0], sims[:, 0], done[:, 0] = at, np.einsum("ij,ij->i", q, v[at]), False
    seen[np.arange(m), at] = True
    active = np.arange(m)
    while True:
        open_sims = np.where(done[active], -np.inf, sims[active])
        best = open_sims.argmax(1)
        more = open_sims[np.arange(len(active)), best] > -np.inf
        active, best = active[more], best[more]
        if not len(active):
            break
        done[active, best] = True
        near = links[0][ids[active, best]]
        fresh = (near >= 0) & ~seen[active[:, None], np.maximum(near, 0)]
        s = np.einsum("ijk,ik->ij", v[np.maximum(near, 0)], q[active])
        s[~fresh] = -np.inf
        r, c = np.nonzero(fresh)
        seen[active[r], near[r, c]] = True
        all_s, all_i = np.hstack([sims[active], s]), np.hstack([ids[active], near])
        all_d = np.hstack([done[active], ~fresh])
        top = np.argpartition(-all_s, beam - 1, axis=1)[:, :beam]
        sims[active], ids[active], done[active] = (np.take_along_axis(x, top, 1) for x in (all_s, all_i, all_d))
    ids[np.isneginf(sims)] = -1
    return np.take_along_axis(ids, np.argsort(-sims, axis=1, kind="stable"), 1)


def _scaled(v: np.ndarray) -> np.ndarray:
    """Rows as they are, but those whose squares would leave the range of doubles, which are scaled."""
    top = np.abs(v).max(1, keepdims=True)
    return np.where((top > 1e150) | (top < 1e-150), v / top, v)


def _unit(v: np.ndarray) -> np.ndarray:
    return (v / np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]).astype(np.float32)


INDEX = "dim int, shard int, vectors binary, ids binary, levels binary, links binary"


def build_index(rows: DataFrame, k: int, shard_rows: int) -> tuple[DataFrame, int]:
    """The stored graphs, a row for each shard, and the number of shards. rows: vec_id, v (valid vectors)."""
    ranked = rows.withColumn("r", F.dense_rank().over(W.partitionBy("v").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    nodes = materialize(ranked.groupBy("v").agg(F.sort_array(F.collect_set("vec_id")).alias("ids")), "ann-nodes")
    shards = max(1, -(-nodes.count() // shard_rows))

    def make(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("first", kind="stable")
        v = _scaled(np.array(group["v"].tolist(), np.float64))
        original = np.array(group["v"].tolist(), np.float64)
        levels, _, links = build(_unit(v))
        ids = np.array([[*own, *[own[0]] * (k + 1 - len(own))] for own in group["ids"]], np.int64)  # filled up by repeats
        flat = b"".join(x.tobytes() for x in links)
        return pd.DataFrame([(len(v[0]), int(group["shard"].iloc[0]), original.tobytes(), ids.tobytes(), levels.astype(np.int8).tobytes(), flat)], columns=[x.split()[0] for x in INDEX.split(", ")])

    ship(rows.sparkSession)
    dealt = nodes.select("v", "ids", F.col("ids")[0].alias("first"), F.size("v").alias("dim"), F.pmod(F.xxhash64("v"), F.lit(shards)).cast("int").alias("shard"))
    return materialize(dealt.groupBy("dim", "shard").applyInPandas(make, INDEX), "ann-index"), shards


def nearest(embeddings: DataFrame, is_query: Column, k: int = 5, shard_rows: int = 16384, block: int = 1024, beam: int = 80, tasks: int = 128) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of embeddings that is_query holds for, its k nearest other rows found."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0))
    index, shards = build_index(rows, k, shard_rows)

    asked = rows.where(is_query).distinct()
    blocks = max(1, -(-asked.count() // block))

    def gather(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("vec_id", kind="stable")
        q = np.array(group["v"].tolist(), np.float64)
        return pd.DataFrame([(q.shape[1], int(group["block"].iloc[0]), group["vec_id"].to_numpy(np.int64).tobytes(), q.tobytes())], columns=["dim", "block", "query_ids", "queries"])

    asked = asked.withColumns({"dim": F.size("v"), "block": F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")})
    asked = asked.groupBy("dim", "block").applyInPandas(gather, "dim int, block int, query_ids binary, queries binary")
    asked = materialize(asked, "ann-queries").coalesce(max(1, blocks // 128))

    def run(batches):
        shard, best = None, {}  # best: by block, its queries and for each the nearest of the shards so far
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(n)[i].as_py() for n in ("dim", "shard", "block", "query_ids", "queries")}
                d = row["dim"]
                if (d, row["shard"]) != shard:
                    shard = d, row["shard"]
                    own = {n: batch.column(n)[i].as_py() for n in ("vectors", "ids", "levels", "links")}
                    v, ids = _scaled(np.frombuffer(own["vectors"]).reshape(-1, d)), np.frombuffer(own["ids"], np.int64).reshape(-1, k + 1)
                    levels, flat, links, nodes, at = np.frombuffer(own["levels"], np.int8), np.frombuffer(own["links"], np.int32), [], [], 0
                    for layer in range(int(levels.max()) + 1):
                        nodes.append(np.flatnonzero(levels >= layer))
                        width = 2 * DEGREE if layer == 0 else DEGREE
                        links.append(flat[at : at + len(nodes[-1]) * width].reshape(-1, width))
                        at += len(nodes[-1]) * width
                    unit, norm_v = _unit(v), np.sqrt(np.einsum("ij,ij->i", v, v))
                q, query_ids = _scaled(np.frombuffer(row["queries"]).reshape(-1, d)), np.frombuffer(row["query_ids"], np.int64).tolist()
                found = search(unit, nodes, links, _unit(q), max(beam, k + 1))
                near, norm_q = np.maximum(found, 0), np.sqrt(np.einsum("ij,ij->i", q, q))
                score = np.empty(near.shape)
                for j in range(len(q)):
                    score[j] = (v[near[j]] * q[j]).sum(1) / (norm_v[near[j]] * norm_q[j])
                score[found < 0] = -np.inf
                top = np.argsort(-score, axis=1, kind="stable")[:, : 2 * (k + 1)]
                kept = best.setdefault((d, row["block"]), (query_ids, [[] for _ in query_ids]))[1]
                for j, own_id in enumerate(query_ids):
                    pairs = kept[j] + [(-score[j, t], x) for t in top[j] if found[j, t] >= 0 for x in {*ids[found[j, t]].tolist()} if x != own_id]
                    nearest_of: dict[int, float] = {}  # a vec_id with several vectors counts once
                    for s, x in sorted(pairs):
                        nearest_of.setdefault(x, s)
                        if len(nearest_of) == k:
                            break
                    kept[j] = [(s, x) for x, s in nearest_of.items()]
        for query_ids, kept in best.values():
            rows = [(own_id, x, -s) for own_id, pairs in zip(query_ids, kept) for s, x in pairs]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * 3, (pa.int64(), pa.int64(), pa.float64()))], ["query_id", "vec_id", "score"])

    pairs = index.coalesce(tasks).join(asked.hint("shuffle_replicate_nl"), "dim")
    met = arrow_map(pairs, run, "query_id long, vec_id long, score double")
    best = met.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
