"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard, shard results merged.

Vectors are dealt to shards of about SHARD rows by hash of their identifier, so the number of shards follows the input and no
shard grows with it. A shard's graph is a table with a row a distinct vector: its level, the identifiers that have the vector,
and one flat array of neighbours, level after level, each level closed by -1. A shard is small enough for exact distances, so
a layer's candidates come from those instead of one insertion after another; the usual selection keeps a
candidate that is nearer to the node than to any neighbour kept before. Neighbours in identifier order are linked too,
so that each layer is connected. Queries descend greedily and search the lowest layer with a beam of EF.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import write_table

SHARD, M, CANDIDATES, EF, BLOCK = 2048, 16, 64, 96, 4096


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vector) without null identifiers and null, empty, zero or non-finite vectors; repeated rows once."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.transform(F.col(vector_col), lambda x: x.cast("double")).alias("vector"))
    whole = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return rows.filter("id is not null and size(vector) > 0").filter(F.coalesce(whole, F.lit(False))).filter(F.exists("vector", lambda x: x != 0)).distinct()


def layer(points: np.ndarray, m: int) -> list[list[int]]:
    """Neighbours of each point among points: selected, made mutual, and at most 2 m besides the two in order."""
    n = len(points)
    if n == 1:
        return [[]]
    norms = (points**2).sum(axis=1)
    d = np.maximum(norms[:, None] + norms[None] - 2 * points @ points.T, 0)
    np.fill_diagonal(d, np.inf)
    k = min(CANDIDATES, n - 1)
    near = np.argpartition(d, k - 1, axis=1)[:, :k]
    near = np.take_along_axis(near, np.argsort(np.take_along_axis(d, near, axis=1), axis=1, kind="stable"), axis=1)
    links: list[set[int]] = [set() for _ in range(n)]
    for i in range(n):
        mine, kept = near[i], []
        among = d[np.ix_(mine, mine)]
        blocked = np.zeros(k, bool)
        for c in range(k):
            if not blocked[c]:
                kept.append(c)
                if len(kept) == m:
                    break
                blocked |= among[c] < d[i, mine]
        for c in kept:
            links[i].add(int(mine[c]))
    for i in range(n):
        for j in list(links[i]):
            if len(links[j]) < 2 * m:
                links[j].add(i)
    for i in range(n - 1):
        links[i].add(i + 1)
        links[i + 1].add(i)
    return [sorted(x) for x in links]


def build(rows: pd.DataFrame) -> pd.DataFrame:
    """The graph of one shard, from (dim, shard, id, vector)."""
    rows = rows.sort_values("id")
    points = np.stack(rows["vector"].to_numpy()).astype(float)
    distinct, first, inverse = np.unique(points, axis=0, return_index=True, return_inverse=True)
    order = np.argsort(first)
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    nodes, owner = distinct[order], place[inverse.ravel()]
    ids: list[list[int]] = [[] for _ in nodes]
    for i, o in zip(rows["id"], owner):
        ids[o].append(int(i))
    draw = np.random.default_rng(1).random(len(nodes))
    levels = np.minimum((-np.log(1 - draw) / math.log(M)).astype(int), 8)
    levels[0] = levels.max()
    flat: list[list[int]] = [[] for _ in nodes]
    for level in range(int(levels.max()) + 1):
        at = np.flatnonzero(levels >= level)
        for i, near in zip(at, layer(nodes[at], M)):
            flat[i] += [*(int(at[j]) for j in near), -1]
    return pd.DataFrame({"dim": rows["dim"].iloc[0], "shard": rows["shard"].iloc[0], "node": np.arange(len(nodes)), "level": levels, "ids": ids, "vector": list(nodes), "near": flat})


class Graph:
    def __init__(self, rows: pd.DataFrame) -> None:
        rows = rows.sort_values("node")
        self.points = np.stack(rows["vector"].to_numpy()).astype(float)
        self.levels, self.ids = rows["level"].to_numpy(), rows["ids"].to_list()
        self.near: list[list[np.ndarray]] = []
        for flat in rows["near"]:
            flat = np.asarray(flat)
            ends = np.flatnonzero(flat == -1)
            self.near.append([flat[a:b] for a, b in zip([0, *(ends[:-1] + 1)], ends)])

    def search(self, q: np.ndarray, ef: int) -> list[tuple[float, int]]:
        far = lambda at: ((self.points[at] - q) ** 2).sum(axis=1)
        here = int(np.argmax(self.levels))
        best = float(far([here])[0])
        for level in range(int(self.levels.max()), 0, -1):
            while True:
                near = self.near[here][level]
                if not len(near) or (d := far(near)).min() >= best:
                    break
                here, best = int(near[d.argmin()]), float(d.min())
        seen = np.zeros(len(self.points), bool)
        seen[here] = True
        todo, found = [(best, here)], [(-best, here)]
        while todo:
            d, i = heapq.heappop(todo)
            if len(found) >= ef and d > -found[0][0]:
                break
            near = self.near[i][0]
            near = near[~seen[near]]
            if not len(near):
                continue
            seen[near] = True
            for x, j in zip(far(near).tolist(), near.tolist()):
                if len(found) < ef or x < -found[0][0]:
                    heapq.heappush(todo, (x, j))
                    heapq.heappush(found, (-x, j))
                    if len(found) > ef:
                        heapq.heappop(found)
        return sorted((-d, i) for d, i in found)


def build_index(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", shard: int = SHARD) -> tuple[DataFrame, int]:
    """The table of graphs, and the number of shards a width is dealt to."""
    rows = usable(vectors, id_col, vector_col)
    shards = max(1, math.ceil(rows.count() / shard))
    rows = rows.select(F.size("vector").alias("dim"), F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"), "id", "vector")
    graph = rows.groupBy("dim", "shard").applyInPandas(build, "dim int, shard int, node int, level int, ids array<long>, vector array<double>, near array<int>")
    return write_table(graph, "hnsw"), shards


def search(index: DataFrame, shards: int, queries: DataFrame, k: int = 10, ef: int = EF, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found by Euclidean distance, ties to the smaller vec_id.

    Queries go to every shard of their width in blocks of about BLOCK, so neither side of a task grows with the input. A query does not
    find its own identifier. Unusable vectors (see usable) take no part; no vectors, no rows.
    """
    asked = usable(queries, id_col, vector_col)
    blocks = max(1, math.ceil(asked.count() / BLOCK))
    asked = asked.select(F.size("vector").alias("dim"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.pmod(F.hash("id"), F.lit(blocks)).alias("block"), "id", "vector")
    spread = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def find(graph: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, float]] = []
        if len(graph) and len(ask):
            g = Graph(graph)
            for qid, vector in zip(ask["id"], ask["vector"]):
                q, got = np.asarray(vector, float), []
                for _, i in g.search(q, ef):
                    score = math.sqrt(((g.points[i] - q) ** 2).sum())
                    got += [(score, v) for v in list(g.ids[i])[: k + 1] if v != qid]
                out += [(int(qid), int(v), s) for s, v in sorted(got)[:k]]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    keys = ["dim", "shard", "block"]
    found = spread.groupBy(keys).cogroup(asked.groupBy(keys)).applyInPandas(find, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5(vectors: DataFrame) -> DataFrame:
    index, shards = build_index(vectors)
    return search(index, shards, vectors.filter("vec_id % 100 = 0"))
